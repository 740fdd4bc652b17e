"""Queries of the subpackage and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.llm.distinctive_terms import most_distinctive, term_scores, word_degrees
from quern.llm.heavy_hitters import heavy_hitters
from quern.llm.link_groups import link_groups
from quern.llm.mixing import mix_sources, reached_shares, read_targets
from quern.llm.packing import pack
from quern.llm.rank_sketch import merge_sketches, quantiles, sketches
from quern.llm.subjects import document_subjects
from quern.llm.term_frequencies import mark_terms, term_frequencies
from quern.llm.token_counts import token_count
from quern.llm.top_items import cluster_by_group, skipped_row_groups, top_per_group
from quern.plans.live import SQL_INDEXED, SQL_LIVE, indexed_documents, read_live
from quern.scratch import Scratch
from quern.sources.tables import table


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = table(spark, folder, "unique_terms").select(text.term("term").alias("term")).where("term <> ''").distinct()
    counts = term_frequencies(read_live(spark, folder), "term", "doc_id", "freq", vocabulary)
    return mark_terms(counts, indexed_documents(table(spark, folder, "doclens")).count())


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_terms(spark, folder).where("mark is not null").select("term", "mark")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "derivations").select(text.term("word_a").alias("a"), text.term("word_b").alias("b"))
    return link_groups(words, "a", "b")


def _valid_searches(log: DataFrame) -> DataFrame:
    """id, algo, build, day, elapsed of the searches whose time counts; a search that was sent again counts once."""
    rows = log.select("id", F.lower(F.trim("algo_resolved")).alias("algo"), F.trim("index_built").alias("build"), F.to_date("ts").alias("day"), "elapsed", "cached")
    valid = rows.where("id is not null and cached = 0 and elapsed > 0 and elapsed < double('infinity') and algo <> '' and build <> ''")
    return valid.select("id", "algo", "build", "day", "elapsed").dropDuplicates(["id"])


def p3_days(spark: SparkSession, folder: str) -> DataFrame:
    """Medians of each day, from sketches that are kept per day."""
    keys = {"algo_resolved": "algo", "index_built": "build", "day": "day"}
    daily = merge_sketches(sketches(_valid_searches(table(spark, folder, "search_log")), keys, "elapsed"), list(keys))
    return quantiles(daily, list(keys), [0.5, 0.9, 0.99])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    keys = {"algo_resolved": "algo", "index_built": "build"}
    merged = merge_sketches(sketches(_valid_searches(table(spark, folder, "search_log")), keys, "elapsed"), list(keys))
    q = quantiles(merged, list(keys), [0.5, 0.95])
    return q.where(F.col("quantiles")[1] >= 6 * F.col("quantiles")[0]).where("n >= 100").select(*keys)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The formula of this query has the frequency as local weight; the degree is that of p4_degrees."""
    live = read_live(spark, folder).where("field = 'opening'")
    n = indexed_documents(table(spark, folder, "doclens")).count()
    return most_distinctive(term_scores(live, "doc_id", "term", "freq", n), "doc_id").select("doc_id", "term")


def p4_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """Graph-of-words score of every term of every title and opening, each field by itself."""
    indexed = indexed_documents(table(spark, folder, "doclens"))
    docs = table(spark, folder, "documents").join(indexed, "doc_id", "left_semi")
    texts = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), text.tokens(f).alias("words")) for f in ("title", "opening")))).alias("x")).select("doc_id", "x.*")
    return term_scores(word_degrees(texts, ["doc_id", "field"], "words"), "doc_id", "term", "degree", indexed.count(), within=["field"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_per_group(read_live(spark, folder), ["field", "term"], "freq", "doc_id", 3).select("field", "term", "doc_id")


def p6_row_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Row groups and rows in all files of the clustered postings, and how many of them weren't read for the best 3."""
    with Scratch(spark, "row-groups") as scratch:
        uri = scratch.folder()
        cluster_by_group(read_live(spark, folder), ["field", "term"], "freq", "doc_id", uri)
        return scratch.write(skipped_row_groups(spark, uri, 3).agg(*(F.sum(c).alias(c) for c in ("row_groups", "skipped", "rows", "rows_read"))), keep=True)


def _heavy_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The commonest queries with estimated and exact counts."""
    log = table(spark, folder, "search_log").where("page = 1 and id is not null").select("id", text.phrase("query").alias("query"))
    found = heavy_hitters(log.where("query <> ''"), "query", 0.005, once_by="id")
    return found.withColumnRenamed("value", "query")


def p5_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the sketch's estimates are within a quarter of the threshold of the counts, as the width is chosen for."""
    return _heavy_queries(spark, folder).select("query", "count", (F.abs(F.col("estimate") - F.col("count")) <= 0.25 * 0.005 * F.col("total")).alias("close"))


def p5_queries(spark: SparkSession, folder: str) -> DataFrame:
    return _heavy_queries(spark, folder).select("query", "count", "total")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_queries(spark, folder).select("query")


def _few(df: DataFrame, most: int = 10_000) -> list:
    """Rows of a table of settings, which must be small."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows of settings")
    return rows


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every text, in every packing task, with its bin."""
    sizes = table(spark, folder, "documents").select("doc_id", token_count("text").alias("tokens"))
    tasks = [(r["pack_id"], r["capacity"]) for r in _few(table(spark, folder, "pack_sizes").orderBy("pack_id"))]
    return pack(sizes, "doc_id", "tokens", tasks)


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, list]:
    records = table(spark, folder, "documents").select("doc_id", text.trim(text.fold("source")).alias("source"), token_count("text").alias("tokens"))
    targets = table(spark, folder, "source_targets").withColumn("source", text.trim(text.fold("source")))
    wanted = read_targets(targets, "source", "target_share", "max_repeats")
    return mix_sources(records, "doc_id", "source", "tokens", wanted), wanted


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and how often it is used."""
    return _mixture(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that were reached."""
    return reached_shares(*(lambda m, t: (m, "source", "tokens", t))(*_mixture(spark, folder)))


def p8_bins(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for a packing: each text once and whole, cut only above the capacity; no bin over it; and bins within 1 % of the least possible number, or one bin."""
    packed = p8_packed(spark, folder)
    tasks = table(spark, folder, "pack_sizes").select("pack_id", F.col("capacity").cast("long").alias("capacity"))
    own = packed.join(F.broadcast(tasks.limit(10_000)), "pack_id")
    texts = own.groupBy("pack_id", "doc_id", "capacity").agg(F.count("*").alias("parts"), F.sum("size").alias("size"), F.max("part").alias("last"))
    cut = texts.groupBy("pack_id").agg(F.count("*").alias("texts"), F.max((F.col("parts") != F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity")))) | (F.col("last") != F.col("parts") - 1)).alias("wrong"))
    bins = own.where("bin_id is not null").groupBy("pack_id", "capacity", "bin_id").agg(F.sum("size").alias("fill"))
    full = bins.groupBy("pack_id", "capacity").agg(F.count("*").alias("bins"), F.max("fill").alias("most"), F.sum("fill").alias("tokens"))
    least = F.ceil(F.col("tokens") / F.col("capacity"))
    return full.join(cut, "pack_id").select("pack_id", "capacity", "texts", (~F.col("wrong")).alias("whole"), (F.col("most") <= F.col("capacity")).alias("fits"), (F.col("bins") <= F.greatest(least + 1, 1.01 * least)).alias("tight"))


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for a mixture, for each wanted source: its target, its texts, each used at most max_repeats times, and all of them evenly."""
    mixture, wanted = _mixture(spark, folder)
    asked = spark.createDataFrame([(s, round(w, 9), m) for s, w, m in wanted], "source string, target_share double, max_repeats int")
    use = mixture.groupBy("source").agg(F.count("*").alias("texts"), F.max("copies").alias("most"), F.min(F.when(F.col("tokens") > 0, F.col("copies"))).alias("least"))
    both = F.broadcast(asked).join(use, "source", "left")
    return both.select("source", "target_share", "max_repeats", F.coalesce("texts", F.lit(0)).cast("long").alias("texts"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("kept"), (F.coalesce(F.col("most") - F.col("least"), F.lit(0)) <= 1).alias("even"))


def p10_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects of all documents, with the share of sentences about each."""
    subjects = [r["subject"] for r in _few(table(spark, folder, "subjects").orderBy("subject"))]
    return document_subjects(table(spark, folder, "documents"), "doc_id", "text", "lang", table(spark, folder, "subject_labels"), subjects)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    labelled = table(spark, folder, "subject_labels").where("doc_id is not null").select("doc_id").distinct()
    return p10_subjects(spark, folder).join(labelled, "doc_id", "left_anti").select("doc_id", "subject")


QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p2_found": p2_found, "p3_found": p3_found, "p3_days": p3_days, "p4_found": p4_found, "p4_degrees": p4_degrees, "p5_found": p5_found, "p5_queries": p5_queries, "p5_estimates": p5_estimates, "p6_found": p6_found, "p6_row_groups": p6_row_groups, "p8_packed": p8_packed, "p8_bins": p8_bins, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_kept": p9_kept, "p10_found": p10_found, "p10_subjects": p10_subjects}

SQL_TERMS = f"""with {SQL_LIVE},
vocabulary as (select distinct {text.sql_term("term")} as term from unique_terms),
counted as (select term, count(distinct doc_id) as doc_freq, sum(freq)::bigint as occurrences from live group by term),
terms as (select coalesce(c.term, v.term) as term, coalesce(occurrences, 0) as occurrences, coalesce(doc_freq, 0) as doc_freq
          from counted c full join (select * from vocabulary where term <> '') v on c.term = v.term),
marked as (select *, case when doc_freq <= 2 then 'rare' when doc_freq > 0.25 * (select count(*) from indexed) then 'common' end as mark from terms)"""

SQL_VALID = """valid as (select distinct id, lower(trim(algo_resolved)) as algo_resolved, trim(index_built) as index_built, elapsed from search_log
where id is not null and cached = 0 and elapsed > 0 and not isnan(elapsed) and not isinf(elapsed) and trim(algo_resolved) <> '' and trim(index_built) <> '')"""

SQL = {
    "p1_found": f"{SQL_TERMS} select term, mark from marked where mark is not null",
    "p1_terms": f"{SQL_TERMS} select term, occurrences, doc_freq, mark from marked",
    "p2_found": f"""with recursive pairs as (select distinct {text.sql_term("word_a")} as a, {text.sql_term("word_b")} as b from derivations),
links as (select a, b from pairs where a <> '' and b <> '' and a <> b union select b, a from pairs where a <> '' and b <> '' and a <> b),
reach as (select distinct a as word, a as other from links union select r.word, l.b from reach r join links l on r.other = l.a)
select word, min(other) as group_word from reach group by word""",
    "p3_found": f"""with {SQL_VALID} select algo_resolved, index_built from valid group by 1, 2
having count(*) >= 100 and quantile_disc(elapsed, 0.95) >= 6 * quantile_disc(elapsed, 0.5)""",
    "p4_found": f"""with {SQL_LIVE},
o as (select doc_id, term, freq from live where field = 'opening'), df as (select term, count(*) as df from o group by term),
scored as (select doc_id, o.term, round(freq * ln(((select count(*) from indexed) + 0.5) / (df + 0.5) + 1), 6) as score from o join df on o.term = df.term)
select doc_id, term from scored qualify row_number() over (partition by doc_id order by score desc, term) = 1""",
    "p4_degrees": f"""with {SQL_INDEXED},
w as (select doc_id, 'title' as field, {text.sql_tokens("title")} as w from documents where doc_id in (select doc_id from indexed)
      union all select doc_id, 'opening', {text.sql_tokens("opening")} from documents where doc_id in (select doc_id from indexed)),
pl as (select doc_id, field, unnest(w) as a, unnest(range(len(w))) as i from w),
near as (select x.doc_id, x.field, x.a as term, y.a as near from pl x join pl y on x.doc_id = y.doc_id and x.field = y.field and x.a <> y.a and abs(x.i - y.i) between 1 and 3),
deg as (select a.doc_id, a.field, a.a as term, coalesce(any_value(k), 0) as weight from pl a
        left join (select doc_id, field, term, count(distinct near) as k from near group by all) n on a.doc_id = n.doc_id and a.field = n.field and a.a = n.term group by 1, 2, 3),
df as (select field, term, count(*) as doc_freq from deg group by all)
select doc_id, field, d.term, weight, doc_freq, round(weight * ln(((select count(*) from indexed) + 0.5) / (doc_freq + 0.5) + 1), 6) as score from deg d join df using (field, term)""",
    "p6_found": f"with {SQL_LIVE} select field, term, doc_id from live qualify row_number() over (partition by field, term order by freq desc, doc_id) <= 3",
    "p5_estimates": f"""with once as (select distinct id, {text.sql_phrase("query")} as query from search_log where page = 1 and id is not null),
counted as (select query, count(*) as n from once where query <> '' group by query)
select query, n as count, true as close from counted where n >= 0.005 * (select sum(n) from counted)""",
    "p8_bins": "select pack_id, capacity::bigint as capacity, (select count(*) from documents) as texts, true as whole, true as fits, true as tight from pack_sizes",
    "p9_kept": f"""with wanted as (select {text.sql_trim(text.sql_fold("source"))} as source, round(sum(greatest(target_share, 0)), 9) as target_share, max(max_repeats)::int as max_repeats from (select distinct * from source_targets) group by 1),
have as (select {text.sql_trim(text.sql_fold("source"))} as source, count(*) as texts from documents group by 1)
select w.source, target_share, max_repeats, coalesce(texts, 0) as texts, true as kept, true as even from wanted w left join have h on w.source = h.source""",
    "p5_queries": f"""with once as (select distinct id, {text.sql_phrase("query")} as query from search_log where page = 1 and id is not null),
counted as (select query, count(*) as n from once where query <> '' group by query)
select query, n as count, (select sum(n) from counted)::bigint as total from counted where n >= 0.005 * (select sum(n) from counted)""",
    "p5_found": f"""with once as (select distinct id, {text.sql_phrase("query")} as query from search_log where page = 1 and id is not null),
counted as (select query, count(*) as n from once where query <> '' group by query)
select query from counted where n >= 0.005 * (select sum(n) from counted)""",
}
