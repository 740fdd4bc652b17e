"""Document counts per term against the recorded ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.combine import combine_by_key
from quern.plans.live import SQL_LIVE, read_live, recorded_doc_freq
from quern.functions import text
from quern.sources.tables import table


def count_differences(live: DataFrame, recorded: DataFrame) -> DataFrame:
    """field, term, counted, recorded of each field and term for which the two numbers differ; none counts as 0.

    Both sides are reduced to one row per key before they meet, so the join has no skew.
    """
    counted = combine_by_key(live, {"field": "field", "term": "term"}, {"counted": ("count", F.lit(1))})
    both = counted.select("field", "term", "counted", F.lit(0).cast("long").alias("recorded")).unionByName(
        recorded.select("field", "term", F.lit(0).cast("long").alias("counted"), F.col("doc_freq").cast("long").alias("recorded"))
    )
    return combine_by_key(both, {"field": "field", "term": "term"}, {"counted": ("sum", "counted"), "recorded": ("sum", "recorded")}).where("counted <> recorded")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return count_differences(read_live(spark, folder), recorded_doc_freq(table(spark, folder, "termstats"))).select("field", "term")


def p7_doc_counts(spark: SparkSession, folder: str) -> DataFrame:
    return combine_by_key(read_live(spark, folder), {"field": "field", "term": "term"}, {"docs": ("count", F.lit(1)), "occurrences": ("sum", "freq"), "most": ("max", "freq")})


QUERIES = {"p7_found": p7_found, "p7_doc_counts": p7_doc_counts}

SQL = {
    "p7_found": f"""with {SQL_LIVE},
counted as (select field, term, count(*) as n from live group by field, term),
recorded as (select field, {text.sql_term("term")} as term, sum(doc_freq) as n from (select distinct segment, field, term, doc_freq, idf from termstats) group by 1, 2)
select coalesce(c.field, r.field) as field, coalesce(c.term, r.term) as term
from counted c full join (select * from recorded where term <> '') r on c.field = r.field and c.term = r.term
where coalesce(c.n, 0) <> coalesce(r.n, 0)""",
    "p7_doc_counts": f"with {SQL_LIVE} select field, term, count(*) as docs, sum(freq)::bigint as occurrences, max(freq)::bigint as most from live group by field, term",
}
