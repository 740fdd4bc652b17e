"""Relevance studies: labelled queries under all algorithms, reciprocal ranks, consensus and differences between runs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators.search_queries import WEIGHTS, document_index
from quern.plans.query import ALGORITHMS
from quern.scratch import Scratch
from quern.search import Searcher
from quern.sources.tables import table

DEPTH = 50
CONCRETE = ALGORITHMS[1:]


def run_study(searcher: Searcher, queries: Sequence[tuple[str, str, Sequence[str]]], algorithms: Sequence[str] = CONCRETE, **options) -> DataFrame:
    """query, category, algo, rank (of the first target title in the first 50, or null), top1: all algorithms in one batch."""
    spark = searcher.index.spark
    asked = F.broadcast(spark.createDataFrame([(i, q, c, [text.fold_py(t) for t in ts]) for i, (q, c, ts) in enumerate(queries)], "query_id long, query string, category string, targets array<string>"))
    hits = searcher.best([q for q, _, _ in queries], algorithms, DEPTH, **options)
    hit = hits.join(asked, "query_id").withColumn("found", F.array_contains("targets", text.fold("title")))
    ranks = hit.groupBy("query_id", "algo").agg(F.min(F.when(F.col("found"), F.col("rank"))).alias("rank"), F.max(F.when(F.col("rank") == 1, F.col("title"))).alias("top1"))
    wanted = asked.withColumn("algo", F.explode(F.array(*map(F.lit, algorithms))))
    return wanted.join(ranks, ["query_id", "algo"], "left").select("query", "category", "algo", "rank", "top1")


def mrr_by_category(study: DataFrame) -> DataFrame:
    """category, algo, queries, mrr: an unranked target counts 0."""
    return study.groupBy("category", "algo").agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.sum((F.col("rank") == 1).cast("int")).alias("first"))


def mrr_macro(study: DataFrame, without: Sequence[str] = ("ambiguous",)) -> DataFrame:
    """algo, mrr: mean of the categories' means."""
    return mrr_by_category(study).where(~F.col("category").isin(list(without))).groupBy("algo").agg(F.round(F.avg("mrr"), 6).alias("mrr"))


def consensus(study: DataFrame) -> DataFrame:
    """query, top1, votes, agree: the first title that most algorithms give (ties: the smallest) and whether all do."""
    votes = study.where("top1 is not null").groupBy("query", "top1").agg(F.count("*").alias("votes"))
    best = votes.groupBy("query").agg(F.max(F.struct("votes", F.col("top1"))).alias("m"), F.count("*").alias("different"), F.max("votes").alias("most"))
    tied = votes.join(best.select("query", "most", "different"), "query").where("votes = most").groupBy("query").agg(F.min("top1").alias("top1"), F.first("votes").alias("votes"), F.first("different").alias("different"))
    return tied.select("query", "top1", "votes", (F.col("different") == 1).alias("agree"))


def run_diff(before: DataFrame, after: DataFrame, on: Sequence[str] = ("query", "algo")) -> DataFrame:
    """Ranks of two runs side by side, with what is in one only."""
    a, b = before.select(*on, F.col("rank").alias("before"), F.lit(True).alias("in_a")), after.select(*on, F.col("rank").alias("after"), F.lit(True).alias("in_b"))
    both = a.join(b, list(on), "full")
    state = F.when(F.col("in_a").isNull(), "new").when(F.col("in_b").isNull(), "gone").when(F.col("before").eqNullSafe(F.col("after")), "same").when(F.col("before").isNull() | (F.col("after") < F.col("before")), "better").otherwise("worse")
    return both.select(*on, "before", "after", state.alias("state"))


def save_run(study: DataFrame, path: str) -> None:
    study.write.json(path)


def load_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query string, category string, algo string, rank long, top1 string").json(path)


def known_items(spark: SparkSession, folder: str) -> list[tuple[str, str, list[str]]]:
    """Titles of every fiftieth document as queries for themselves."""
    rows = table(spark, folder, "documents").where("doc_id % 50 = 0").select("doc_id", "title", F.coalesce(F.substring(F.lower("lang"), 1, 2), F.lit("?")).alias("lang")).where("trim(title) <> ''").orderBy("doc_id")
    return [(r["title"], r["lang"], [r["title"]]) for r in rows.toLocalIterator()]


def _study(spark: SparkSession, folder: str, algorithms: Sequence[str] = CONCRETE) -> DataFrame:
    study = run_study(Searcher(document_index(spark, folder)), known_items(spark, folder), algorithms, fields=WEIGHTS)
    with Scratch(spark, "study") as scratch:
        return scratch.write(study, keep=True)


def _bm25_and_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Both runs are parts of one study."""
    study = _study(spark, folder, ["bm25", "cover"])
    return run_diff(*(study.where(F.col("algo") == a).withColumn("algo", F.lit("any")) for a in ("bm25", "cover")))


QUERIES = {
    "batch_known_item": lambda spark, folder: _study(spark, folder).select("query", "algo", "rank"),
    "mrr_by_category": lambda spark, folder: mrr_by_category(_study(spark, folder)),
    "mrr_macro": lambda spark, folder: mrr_macro(_study(spark, folder)),
    "consensus_top1": lambda spark, folder: consensus(_study(spark, folder)),
    "run_diff": _bm25_and_cover,
}
SQL: dict[str, str] = {}


def describe(results: Sequence[dict]) -> str:
    """Diagnostics as lines for people: what widened a search, and what only ranks."""
    lines = []
    for d in results:
        wide = [e for e in d["expansions"] if e["class"] in ("synonym", "derivation", "fuzzy")]
        rank = [e for e in d["expansions"] if e not in wide]
        lines.append(json.dumps({"algo": d["algo"]["resolved"], "widening": [e["term"] for e in wide], "ranking": [e["term"] for e in rank], "sampled": d["truncated"]}, ensure_ascii=False))
    return "\n".join(lines)
