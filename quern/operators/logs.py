"""The search log: its schema and sink, reports, and the cache of result pages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.search import Result
from quern.sources.tables import table

LOG_SCHEMA = (
    "id long, ts timestamp_ntz, corpus string, query string, algo string, confidence int, fields string, stemming int, stopwords int, synonyms int, total int, page int, elapsed double, ip string, "
    "algo_resolved string, two_phase int, exhaustive int, oewn_senses int, per_page int, elapsed_expand double, mem_kb int, top_results string, index_built string, engine string, cached int, diag string"
)
CACHE_SCHEMA = "key string, created timestamp_ntz, payload string"
ENGINE = "1"


def each_search(log: DataFrame) -> DataFrame:
    """A search that was sent again, with the same id, once; rows without id stay."""
    return log.where("id is not null").dropDuplicates(["id"]).unionByName(log.where("id is null"))


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows of LOG_SCHEMA; logging never fails a search."""
    try:
        rows.write.mode("append").parquet(path)
    except Exception as e:  # the search has been answered
        print(f"search log not written: {e}")


def time_taken(c: str = "elapsed") -> Column:
    """Times that can be: numbers from 0 on."""
    return F.when((F.col(c) >= 0) & ~F.isnan(c), F.col(c))


def label(c: str) -> Column:
    return F.lower(F.trim(c))


def kpis(log: DataFrame) -> DataFrame:
    """Searches, searches without result, mean time of those that weren't cached, cached ones."""
    t = time_taken()
    return each_search(log).agg(F.count("*").alias("searches"), F.count_if(F.col("total") == 0).alias("zero_results"), F.round(F.avg(F.when(F.col("cached") == 0, t)), 6).alias("mean_uncached"), F.sum("cached").alias("cached"))


def mode_means(log: DataFrame) -> DataFrame:
    """Mean time by search mode."""
    t = F.when(F.col("cached") == 0, time_taken())
    pick = lambda c: F.round(F.avg(F.when(c, t)), 6)
    return each_search(log).agg(pick(F.col("two_phase") == 1).alias("two_phase"), pick(F.col("two_phase") == 0).alias("one_phase"), pick(F.col("exhaustive") == 1).alias("exhaustive"), pick(F.col("stemming") == 1).alias("stemming"), pick(F.col("confidence") < 100).alias("fuzzy"), pick(F.col("synonyms") == 1).alias("synonyms"))


def routes(log: DataFrame, top: int = 12) -> DataFrame:
    """The commonest ways from the requested algorithm to the one that ran."""
    route = F.when(label("algo") == "auto", F.concat(F.lit("auto > "), F.coalesce(label("algo_resolved"), F.lit("?")))).otherwise(label("algo"))
    return each_search(log).groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.round(F.avg(time_taken()), 6).alias("mean")).orderBy(F.desc("n"), F.asc_nulls_first("route")).limit(top)


def builds(log: DataFrame, top: int = 8) -> DataFrame:
    return each_search(log).groupBy(F.coalesce(F.trim("index_built"), F.lit("?")).alias("build"), F.coalesce(F.trim("engine"), F.lit("?")).alias("engine")).agg(F.count("*").alias("n"), F.round(F.avg(time_taken()), 6).alias("mean")).orderBy(F.desc("n"), "build", "engine").limit(top)


def _first_pages(log: DataFrame) -> DataFrame:
    return each_search(log).where("page = 1").withColumn("q", text.phrase("query")).where("q <> ''")


def zero_results(log: DataFrame, top: int = 15) -> DataFrame:
    return _first_pages(log).where("total = 0").groupBy(F.col("q").alias("query")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(top)


def common(log: DataFrame, top: int = 15) -> DataFrame:
    return _first_pages(log).groupBy(F.col("q").alias("query")).agg(F.count("*").alias("n"), F.round(F.avg("total"), 6).alias("mean_total")).orderBy(F.desc("n"), "query").limit(top)


def slowest(log: DataFrame, top: int = 10) -> DataFrame:
    return each_search(log).withColumn("t", time_taken()).where("t is not null and t < double('infinity')").select("id", "query", F.col("t").alias("elapsed")).orderBy(F.desc("elapsed"), "id").limit(top)


def recent(log: DataFrame, page: int = 1, per_page: int = 25) -> DataFrame:
    """A page of the log, the latest first."""
    return each_search(log).select("id", "ts", "query", "total").orderBy(F.desc_nulls_last("ts"), F.desc("id")).offset((page - 1) * per_page).limit(per_page)


def corpora(log: DataFrame) -> DataFrame:
    return log.select(label("corpus").alias("corpus")).where("corpus is not null").distinct()


def expansion_classes(log: DataFrame) -> DataFrame:
    """How many expansions of each class the searches had, from the JSON of their diagnostics."""
    classes = F.from_json(F.get_json_object("diag", "$.classes"), "map<string,int>")
    return each_search(log).select(F.explode(classes).alias("class", "k")).groupBy("class").agg(F.sum("k").alias("expansions"), F.count("*").alias("searches"))


def timing(log: DataFrame) -> DataFrame:
    t = F.when(time_taken() < float("inf"), time_taken())
    return each_search(log).agg(F.round(F.sum(t), 4).alias("total"), F.round(F.avg(t), 6).alias("mean"), F.max(t).alias("most"), F.max("mem_kb").alias("peak_kb"))


class ResultCache:
    """Pages of results by a hash of what they depend on; entries age, and only the newest are kept."""

    def __init__(self, spark: SparkSession, path: str, days: int = 7, newest: int = 500, depth: int = 200):
        self.spark, self.path, self.days, self.newest, self.depth = spark, path, days, newest, depth

    def key(self, query: str, options: dict, index_version: str) -> str:
        """Options that don't change results, page and diagnostics, are left out."""
        import hashlib

        kept = {k: v for k, v in options.items() if k not in ("page", "per_page", "diagnostics") and not callable(v)}
        return hashlib.sha256(json.dumps([query, kept, index_version, ENGINE], sort_keys=True, default=str).encode()).hexdigest()

    def _table(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)
        except Exception:
            return None

    def get(self, key: str, page: int = 1, per_page: int = 20) -> list[dict] | None:
        t = self._table()
        if t is None:
            return None
        fresh = F.col("created") > F.expr(f"cast(current_timestamp() as timestamp_ntz) - interval {self.days} days")
        rows = t.where((F.col("key") == key) & fresh).orderBy(F.desc("created")).limit(1).collect()
        return json.loads(rows[0]["payload"])[(page - 1) * per_page : page * per_page] if rows else None

    def put(self, key: str, result: Result) -> None:
        """Keep the first depth hits of a search of one query."""
        hits = [r.asDict(recursive=True) for r in result.hits.orderBy("rank").limit(self.depth).collect()]
        row = self.spark.createDataFrame([(key, json.dumps(hits, default=str))], "key string, payload string").select("key", F.expr("cast(current_timestamp() as timestamp_ntz)").alias("created"), "payload")
        row.write.mode("append").parquet(self.path)

    def evict(self, to: str) -> None:
        """Write the newest entries to another folder, which then is the cache."""
        w = Window.partitionBy("key").orderBy(F.desc("created"))
        self._table().withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").orderBy(F.desc("created")).limit(self.newest).write.parquet(to)
        self.path = to


def _report(f):
    return lambda spark, folder: f(table(spark, folder, "search_log"))


QUERIES = {"log_" + n: _report(f) for n, f in {"kpis": kpis, "mode_means": mode_means, "routes": routes, "builds": builds, "zero_results": zero_results, "common": common, "slowest": slowest, "recent": recent, "corpora": corpora, "expansion_classes": expansion_classes, "timing": timing}.items()}

_EACH = "with log as (select distinct * from search_log)"
_T = "case when elapsed >= 0 and not isnan(elapsed) then elapsed end"
_PAGE = f"{_EACH}, p as (select {text.sql_phrase('query')} as q, total from log where page = 1)"
SQL = {
    "log_kpis": f"{_EACH} select count(*) as searches, count(*) filter (total = 0) as zero_results, round(avg({_T}) filter (cached = 0), 6) as mean_uncached, sum(cached)::bigint as cached from log",
    "log_mode_means": f"{_EACH} select "
    + ", ".join(f"round(avg({_T}) filter (cached = 0 and {c}), 6) as {n}" for n, c in {"two_phase": "two_phase = 1", "one_phase": "two_phase = 0", "exhaustive": "exhaustive = 1", "stemming": "stemming = 1", "fuzzy": "confidence < 100", "synonyms": "synonyms = 1"}.items())
    + " from log",
    "log_routes": f"{_EACH} select case when lower(trim(algo)) = 'auto' then 'auto > ' || coalesce(lower(trim(algo_resolved)), '?') else lower(trim(algo)) end as route, count(*) as n, round(avg({_T}), 6) as mean from log group by 1 order by n desc, route nulls first limit 12",
    "log_builds": f"{_EACH} select coalesce(trim(index_built), '?') as build, coalesce(trim(engine), '?') as engine, count(*) as n, round(avg({_T}), 6) as mean from log group by 1, 2 order by n desc, 1, 2 limit 8",
    "log_zero_results": f"{_PAGE} select q as query, count(*) as n from p where q <> '' and total = 0 group by q order by n desc, q limit 15",
    "log_common": f"{_PAGE} select q as query, count(*) as n, round(avg(total), 6) as mean_total from p where q <> '' group by q order by n desc, q limit 15",
    "log_slowest": f"{_EACH} select id, query, elapsed from log where elapsed >= 0 and not isnan(elapsed) and not isinf(elapsed) order by elapsed desc, id limit 10",
    "log_recent": f"{_EACH} select id, ts, query, total from log order by ts desc nulls last, id desc limit 25",
    "log_corpora": "select distinct lower(trim(corpus)) as corpus from search_log where corpus is not null",
    "log_expansion_classes": f"""{_EACH}, c as (select diag, unnest(json_keys(diag, '$.classes')) as class from log where diag is not null)
select class, sum(json_extract(diag, '$.classes.' || class)::int)::bigint as expansions, count(*) as searches from c group by class""",
    "log_timing": f"{_EACH}, t as (select case when elapsed >= 0 and not isnan(elapsed) and not isinf(elapsed) then elapsed end as e, mem_kb from log) select round(sum(e), 4) as total, round(avg(e), 6) as mean, max(e) as most, max(mem_kb) as peak_kb from t",
}
