"""Problem 1: how often every distinct term occurs, in how many records, and whether that is too rare or too common.

Recursive radix spilling. Rows are combined where they are read, spilled to disk by the leading
bits of the term's hash, and the partitions that are still too large are split again by the next
bits, all of a level at once; when the bits of the hash no longer split it, one term holds most of it, and it is split by
the record's hash instead. Each leaf is then aggregated by one task in DuckDB, out of core.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import open_fs
from quern.scratch import Scratch, bits_for, files, parallelism

LEAF_ROWS = 4_000_000
ROWS_IN_MEMORY = 500_000
COMBINE_ROWS, COMBINE_BYTES = 1_000_000, 64 << 20
MEMORY = "384MB"
ROW_SCHEMA = pa.schema([("t", pa.string()), ("d", pa.int64()), ("n", pa.int64())])
SUM_SCHEMA = pa.schema([("t", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])


def _duckdb(spill_to: str):
    """spill_to: a folder, or "" for none."""
    import duckdb

    return duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "preserve_insertion_order": False, "temp_directory": spill_to})


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same term and record become one, within a stretch of the input that is bounded and stays in memory."""
    con, held, rows, size = _duckdb(""), [], 0, 0

    def flush():
        part = pa.Table.from_batches(held, ROW_SCHEMA)  # noqa: F841
        yield from con.sql("select t, d, sum(n)::bigint as n from part group by t, d").to_arrow_reader(20_000)

    for b in batches:
        held.append(b.cast(ROW_SCHEMA))
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= COMBINE_ROWS or size >= COMBINE_BYTES:
            yield from flush()
            held, rows, size = [], 0, 0
    if held:
        yield from flush()


def _aggregate(spill_root: str):
    """Sums of each leaf, given as rows of its files' URIs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for b in batches:
            for uris in b.column("uris").to_pylist():
                opened = [open_fs(u) for u in uris]
                leaf = ds.dataset([p for _, p in opened], filesystem=opened[0][0], schema=ROW_SCHEMA, format="parquet")  # noqa: F841
                shared, path = open_fs(spill_root)
                # what doesn't fit into memory goes to the shared folder; where that is no path of the file system, leaves are small enough to need none
                con = _duckdb(f"{path}/duckdb-{uuid.uuid4().hex}" if shared.type_name == "local" else "")
                # records are numbered by a hash of their id; a null record only names a term
                out = con.sql("select t, count(d) as docs, sum(n)::bigint as n from (select t, d, sum(n) as n from leaf group by t, d) group by t")
                for r in out.to_arrow_reader(20_000):
                    yield r.cast(SUM_SCHEMA)
                con.close()

    return run


@dataclass(frozen=True)
class Part:
    """A partition: what it is split by, the bits of either hash used before and those to be used now, its rows (None if not known)."""

    by: str = "t"
    used_t: int = 0
    used_d: int = 0
    bits: int = 8
    rows: int | None = None

    def child(self, rows: int, leaf_rows: int) -> Part | None:
        """How to split a partition of this one again; None for a leaf."""
        t, d = self.used_t + (self.by == "t") * self.bits, self.used_d + (self.by == "d") * self.bits
        # if the bits don't split it, one term holds most of it
        by = "d" if self.by == "d" or t >= 64 or self.rows is not None and rows > 0.5 * self.rows else "t"
        left = 64 - (d if by == "d" else t)
        if rows <= leaf_rows or not left:
            return None
        return Part(by, t, d, min(12, left, bits_for(math.ceil(2 * rows / leaf_rows))), rows)


def term_frequencies(records: DataFrame, term: str | Column, record: str, occurrences: str | Column | None = None, vocabulary: DataFrame | None = None, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """term, occurrences, doc_freq of every distinct term.

    records: a row for each term of a record (repeats add up). record: a bigint column; rows without
    record count occurrences, not documents. Rows without term are left out. occurrences: a number
    per row, 1 if not given; null counts as 0. vocabulary: further terms (its first column) that have a
    row even if no record has them. An empty input gives no rows. Other columns aren't read.
    leaf_rows: rows that one task aggregates at most, as far as the hashes can split them.

    One job for each level splits all partitions that are still too large. To the driver: a row for each partition, about 2 x rows / leaf_rows, and file names.
    """
    spark = records.sparkSession
    col = lambda c: F.col(c) if isinstance(c, str) else c
    n = F.lit(1) if occurrences is None else F.coalesce(col(occurrences), F.lit(0))
    rows = records.select(col(term).cast("string").alias("t"), F.col(record).cast("long").alias("d"), n.cast("long").alias("n")).where("t is not null")
    if vocabulary is not None:
        rows = rows.unionByName(vocabulary.select(F.col(vocabulary.columns[0]).alias("t"), F.lit(None).cast("long").alias("d"), F.lit(0).cast("long").alias("n")).where("t is not null"))
    with Scratch(spark, "term-frequencies") as scratch:
        if open_fs(scratch.uri)[0].type_name != "local":
            leaf_rows = min(leaf_rows, ROWS_IN_MEMORY)
        parts = {0: Part(bits=min(12, bits_for(parallelism(spark))))}
        level = rows.mapInArrow(_combine, "t string, d long, n long").withColumn("part", F.lit(0))
        leaves: list[list[str]] = []
        by_record = False
        while parts:
            how = spark.createDataFrame([(k, p.by, p.used_t, p.used_d, p.bits) for k, p in parts.items()], "part int, by string, used_t int, used_d int, bits int")
            radix = F.expr("cast(shiftrightunsigned(shiftleft(case by when 't' then xxhash64(t) else xxhash64(d) end, case by when 't' then used_t else used_d end), 64 - bits) as int)")
            split = level.join(F.broadcast(how), "part").select("t", "d", "n", "part", radix.alias("radix"))
            table = scratch.write(split.hint("rebalance", "part", "radix"), "part", "radix")
            sizes = {(r["part"], r["radix"]): r["count"] for r in table.groupBy("part", "radix").count().collect()}
            found: dict[tuple[int, int], list[str]] = {}
            for uri, _ in files(spark, table._quern_uri):
                part, k = uri.rsplit("part=", 1)[1].split("/")[:2]
                found.setdefault((int(part), int(k.removeprefix("radix="))), []).append(uri)
            again: dict[int, Part] = {}
            numbers, folders = [], []
            for (part, k), uris in found.items():
                child = parts[part].child(sizes.get((part, k), 0), leaf_rows)
                if child is None:
                    leaves.append(uris)
                else:
                    by_record |= child.by == "d"
                    numbers.append((part, k, len(again)))
                    folders.append(uris[0].rsplit("/", 1)[0])
                    again[len(again)] = child
            if again:
                number = spark.createDataFrame(numbers, "part int, radix int, next int")
                read = spark.read.schema("t string, d long, n long, part int, radix int").option("basePath", table._quern_uri).parquet(*folders)
                level = read.join(F.broadcast(number), ["part", "radix"]).select("t", "d", "n", F.col("next").alias("part"))
            parts = again
        plan = spark.createDataFrame([(u,) for u in leaves], "uris array<string>")
        sums = plan.repartition(max(1, len(leaves))).mapInArrow(_aggregate(scratch.uri), "t string, docs long, n long") if leaves else spark.createDataFrame([], "t string, docs long, n long")
        if by_record:  # records of one term lie in several leaves, each record in one
            sums = sums.groupBy("t").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        out = scratch.write(sums, keep=True)
    return out.select(F.col("t").alias("term"), F.col("n").alias("occurrences"), F.col("docs").alias("doc_freq"))


def mark_terms(frequencies: DataFrame, n_docs: int, rare: int = 2, common: float = 0.25) -> DataFrame:
    """Adds mark: 'rare' for terms of at most ``rare`` records, 'common' for those of more than the share ``common``, else null."""
    mark = F.when(F.col("doc_freq") <= rare, "rare").when(F.col("doc_freq") > common * n_docs, "common")
    return frequencies.withColumn("mark", mark)
