"""Streams: documents into an index, and the search log by time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.logs import label, time_taken
from quern.plans.index import Index
from quern.sources.tables import table


def index_stream(docs: DataFrame, path: str, checkpoint: str, *, doc_id: str = "doc_id", title: str | None = None, opening: str | None = None, rebuild_every: int = 10, **trigger) -> StreamingQuery:
    """Upsert each micro-batch into the index at path; statistics are rebuilt with every rebuild_every-th batch.

    A batch that is repeated after a failure replaces the same documents, so the result is the same.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            Index.open(batch.sparkSession, path).upsert(batch, doc_id=doc_id, title=title, opening=opening, auto_stats=number % rebuild_every == 0)

    return docs.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def log_windows(log: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, algo, searches, zero_results, seconds: the log by time window; works on a stream, which forgets windows after ``late``.

    A search that is sent again within that time counts once.
    """
    at = log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    once = at.dropDuplicates(["id", "at"])
    return once.groupBy(F.window("at", window).alias("w"), label("algo").alias("algo")).agg(F.count("*").alias("searches"), F.count_if(F.col("total") == 0).alias("zero_results"), F.round(F.sum(time_taken()), 4).alias("seconds")).select(F.col("w.start").alias("start"), "algo", "searches", "zero_results", "seconds")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, events, total of event sessions: stretches without a pause longer than the gap."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").alias("start"), "events", "total")


QUERIES = {
    "log_windows": lambda spark, folder: log_windows(table(spark, folder, "search_log")).withColumn("start", F.col("start").cast("timestamp_ntz")),
    "user_sessions": lambda spark, folder: user_sessions(table(spark, folder, "events")).select("user_id", F.unix_timestamp("start").alias("start"), "events", "total"),
}
SQL = {
    "log_windows": """with log as (select distinct * from search_log where ts is not null)
select date_trunc('hour', ts) as start, lower(trim(algo)) as algo, count(*) as searches, count(*) filter (total = 0) as zero_results, round(sum(case when elapsed >= 0 and not isnan(elapsed) then elapsed end), 4) as seconds from log group by 1, 2""",
    "user_sessions": """with e as (select user_id, epoch(ts::timestamp) as t, value, lag(epoch(ts::timestamp)) over (partition by user_id order by ts) as before from events where user_id is not null and ts is not null),
s as (select *, sum(case when before is null or t - before >= 1800 then 1 else 0 end) over (partition by user_id order by t rows unbounded preceding) as k from e)
select user_id, floor(min(t))::bigint as start, count(*) as events, round(sum(value), 4) as total from s group by user_id, k""",
}
