"""The index tables, cleaned: documents in the index, live postings, recorded statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.sources.tables import table


def indexed_documents(doclens: DataFrame) -> DataFrame:
    """doc_id of each document in the index, once."""
    return doclens.select("doc_id").where("doc_id is not null").distinct()


def live_postings(postings: DataFrame, doclens: DataFrame) -> DataFrame:
    """field, term, doc_id, freq: one row for each live posting.

    Rows of an older load of their document, with a frequency that isn't above 0, without term or of a
    document that isn't in the index are left out; rows equal in all columns count once, and freq is
    summed over what is the same posting once terms are compared in the index's form.

    Both tables are brought together by document once; the latest load, repeats and sums are then found among a document's rows, and
    no further shuffle follows. Of rows that can't be live only the load travels.
    """
    # a row's freq doesn't matter to which load is the latest
    rows = postings.where("doc_id is not null and loaded_at is not null").select("doc_id", "loaded_at", F.when((F.col("freq") > 0) & F.col("term").isNotNull(), F.struct("segment", "field", "term", "freq", "pos")).alias("p"))
    indexed = doclens.where("doc_id is not null").select("doc_id", F.lit(None).cast(dict(postings.dtypes)["loaded_at"]).alias("loaded_at"), F.lit(None).cast(rows.schema["p"].dataType).alias("p"))
    both = rows.unionByName(indexed).repartition("doc_id")
    w = Window.partitionBy("doc_id")
    latest = both.withColumn("latest", F.max("loaded_at").over(w)).withColumn("indexed", F.bool_or(F.col("loaded_at").isNull()).over(w)).where("indexed and loaded_at = latest and p is not null")
    once = latest.select("doc_id", "p.*").distinct()
    return once.select("field", text.term("term").alias("term"), "doc_id", "freq").where("term <> ''").groupBy("field", "term", "doc_id").agg(F.sum("freq").alias("freq"))


def read_live(spark: SparkSession, folder: str) -> DataFrame:
    return live_postings(table(spark, folder, "postings"), table(spark, folder, "doclens"))


def recorded_doc_freq(termstats: DataFrame) -> DataFrame:
    """field, term, doc_freq: recorded numbers, rows equal in all columns once, summed over the segments."""
    once = termstats.select("segment", "field", "term", "doc_freq", "idf").distinct()
    return once.select("field", text.term("term").alias("term"), "doc_freq").where("term <> ''").groupBy("field", "term").agg(F.coalesce(F.sum("doc_freq"), F.lit(0)).alias("doc_freq"))


SQL_INDEXED = "indexed as (select distinct doc_id from doclens where doc_id is not null)"
SQL_LIVE = f"""{SQL_INDEXED},
latest as (select doc_id, max(loaded_at) as latest from postings where doc_id is not null group by doc_id),
once as (select distinct segment, field, term, doc_id, freq, pos, loaded_at from postings where freq > 0),
spelled as (select o.field, {text.sql_term("o.term")} as term, o.doc_id, o.freq
            from once o join latest l on o.doc_id = l.doc_id and o.loaded_at = l.latest where o.doc_id in (select doc_id from indexed)),
live as (select field, term, doc_id, sum(freq)::bigint as freq from spelled where term <> '' group by field, term, doc_id)"""
