"""Problem 6: the N highest-scoring items of every group, ties broken the same way each time.

Statistics-guided skipping. The rows are written clustered by group, in files of small row groups; each
file is then read row group by row group in descending order of the maximum score in the file's footer, and
a row group is skipped if its maximum is strictly below the N-th score so far of every group it can contain.
A group that fills many files is cut between them by the sort, and the files' winners are joined at the end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.arrow import open_fs
from quern.scratch import Scratch, files

ROW_GROUP_BYTES = 1 << 16


def top_per_group(df: DataFrame, groups: list[str], score: str, item: str, n: int) -> DataFrame:
    """groups, item, score: for each group its n rows of the greatest score, all of them if there are fewer.

    Ties in score go to the smallest item; rows equal in group, score and item are rows of their own, so repeats may take
    several places. score: a number; null and NaN rank below every number, null last. item: a bigint; null ranks after all others.
    A null group is a group. An empty input gives no rows. Other columns aren't read, so their names can't clash.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    with Scratch(df.sparkSession, "top-items") as scratch:
        uri = scratch.folder()
        cluster_by_group(df, groups, score, item, uri)
        kept = scratch.write(_read_clustered(df.sparkSession, uri, n), keep=True)
    return _ranked(kept, {f.name: f.dataType.simpleString() for f in df.select(*groups).schema}, score, item, n)


def cluster_by_group(df: DataFrame, groups: list[str], score: str, item: str, uri: str) -> None:
    """Write the rows to a folder, clustered for top_of_clustered, which may be asked for several n.

    The input's plan runs once: range borders are sampled from a written table. They include score and item, so that a group of
    any size is spread over as many files as it needs.
    """
    # groups as one string that keeps them apart; the file's statistics are of it and of the score
    key = F.to_json(F.array(*(F.col(g).cast("string") for g in groups)), {"ignoreNullFields": "false"})
    value = F.col(score).cast("double")
    with Scratch(df.sparkSession, "to-cluster") as scratch:
        rows = scratch.write(df.select(key.alias("g"), F.when(F.isnan(value), None).otherwise(value).alias("s"), F.col(item).cast("long").alias("i")))
        order = ("g", F.desc_nulls_last("s"), F.asc_nulls_last("i"))
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(uri)


def top_of_clustered(spark: SparkSession, uri: str, groups: dict[str, str], score: str, item: str, n: int) -> DataFrame:
    """The same as top_per_group for a folder that cluster_by_group has written; groups: names and types."""
    return _ranked(_read_clustered(spark, uri, n), groups, score, item, n)


def skipped_row_groups(spark: SparkSession, uri: str, n: int) -> DataFrame:
    """row_groups, skipped, rows, rows_read of each file of a clustered folder, in reading its n best of each group."""
    schema = pa.schema([("row_groups", pa.int64()), ("skipped", pa.int64()), ("rows", pa.int64()), ("rows_read", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u in b.column(0).to_pylist():
                seen = dict.fromkeys(schema.names, 0)
                for _ in _top_of_file(u, n, seen):
                    pass
                yield pa.RecordBatch.from_pylist([seen], schema=schema)

    return _files(spark, uri).mapInArrow(count, "row_groups long, skipped long, rows long, rows_read long")


def _files(spark: SparkSession, uri: str) -> DataFrame:
    found = [(u,) for u, _ in files(spark, uri)]
    return spark.createDataFrame(found, "uri string").repartition(max(1, len(found)))


def _read_clustered(spark: SparkSession, uri: str, n: int) -> DataFrame:
    """g, s, i: at most n rows of a group and row group."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u in b.column(0).to_pylist():
                yield from _top_of_file(u, n, {})

    return _files(spark, uri).mapInArrow(read, "g string, s double, i long")


def _ranked(kept: DataFrame, groups: dict[str, str], score: str, item: str, n: int) -> DataFrame:
    # only groups on the borders of row groups and files, or larger than these, have more than n rows left
    order = F.struct(F.coalesce(-F.col("s"), F.lit(float("inf"))).alias("a"), F.col("s").isNull().alias("b"), F.col("i").isNull().alias("c"), F.col("i"))
    ranked = kept.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(order))).where(F.col("r") <= n)
    parts = F.from_json("g", "array<string>")
    return ranked.select(*(parts[j].cast(kind).alias(g) for j, (g, kind) in enumerate(groups.items())), F.col("i").alias(item), F.col("s").alias(score))


_OUT = pa.schema([("g", pa.string()), ("s", pa.float64()), ("i", pa.int64())])


def _top_of_file(uri: str, n: int, seen: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Rows that may be among the best n of their group, by row groups in descending maximum score; seen: what was read.

    A row group is skipped if its maximum is strictly below the n-th score so far of each group in it. Rows are sorted by group and
    descending score, so one with several groups has the best row of all but its first group and can't be below their n-th scores:
    those that can be skipped are the ones of a single group, and of that group the n-th score is kept.
    """
    system, path = open_fs(uri)
    with system.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        stats = []
        for k in range(file.num_row_groups):
            group = file.metadata.row_group(k)
            g, s = group.column(0).statistics, group.column(1).statistics
            one = g.min if g is not None and g.has_min_max and g.min == g.max else None
            stats.append((s.max if s is not None and s.has_min_max else None, one, k))
        # row groups without a number as maximum hold nulls only, or nothing is known of them: read last, never skipped unless full
        stats.sort(key=lambda x: (x[0] is None, -(x[0] or 0.0), x[2]))
        nth: dict[str, list] = {one: [] for _, one, _ in stats if one is not None}
        seen |= {"row_groups": len(stats), "skipped": 0, "rows": file.metadata.num_rows, "rows_read": 0}
        for most, one, k in stats:
            if one is not None and most is not None and len(h := nth[one]) == n and most < h[0]:
                seen["skipped"] += 1
                continue
            whole = file.read_row_group(k, columns=["g", "s", "i"])
            seen["rows_read"] += whole.num_rows
            best = _best_of(whole, n)
            if not best.num_rows:
                continue
            for g in {best.column("g")[0].as_py(), best.column("g")[-1].as_py()} & nth.keys():
                for s in best.filter(pc.equal(best.column("g"), g)).column("s").to_pylist():
                    (heapq.heappush if len(nth[g]) < n else heapq.heappushpop)(nth[g], -np.inf if s is None else s)
            yield from best.cast(_OUT).to_batches(20_000)


def _best_of(t: pa.Table, n: int) -> pa.Table:
    """Of a sorted row group the first n rows of each group; the order in the file makes these its best."""
    codes = t.column("g").combine_chunks().dictionary_encode()
    idx = codes.indices.to_numpy()
    if not len(idx):
        return t
    starts = np.flatnonzero(np.r_[True, idx[1:] != idx[:-1]])
    place = np.arange(len(idx)) - np.repeat(starts, np.diff(np.r_[starts, len(idx)]))
    return t.take(pa.array(np.flatnonzero(place < n)))
