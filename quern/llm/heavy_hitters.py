"""Problem 5: the most frequent values of a column with very many rows and distinct values, in bounded memory.

A hierarchy of count sketches over prefixes of the values' hash. Each task adds its rows, with
signed hashes, to counters whose number depends on the parameters only; counters of tasks add
up. From the shortest prefixes on, those whose estimate may reach the threshold are extended
by the next bits; the rows under the prefixes that are left are counted exactly in a second scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 12
LEVELS = 4
DEPTH = 5
WIDTH = 8192
SLICE = 1024
SLACK = 0.5
MOST_WIDTH = 1 << 20


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of each prefix, another one for each seed."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PrefixSketch:
    """Counters of all levels. Where the prefixes are no more than the width, the level is counted exactly."""

    def __init__(self, width: int = WIDTH, depth: int = DEPTH, levels: int = LEVELS, step: int = STEP):
        self.width, self.depth, self.levels, self.step = width, depth, levels, step
        self.exact = [1 << (step * (h + 1)) <= width for h in range(levels)]
        self.counts = [np.zeros((1, 1 << (step * (h + 1))) if e else (depth, width), np.int64) for h, e in enumerate(self.exact)]

    def _places(self, h: int, row: int, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = _mix(prefixes, 97 * h + row)
        return (z >> np.uint64(1)) % np.uint64(self.width), (z & np.uint64(1)).astype(np.int64) * 2 - 1

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        for h in range(self.levels):
            prefixes = hashes >> np.uint64(64 - self.step * (h + 1))
            if self.exact[h]:
                self.counts[h][0] += np.bincount(prefixes.astype(np.int64), counts, self.counts[h].shape[1]).astype(np.int64)
                continue
            for row in range(self.depth):
                place, sign = self._places(h, row, prefixes)
                self.counts[h][row] += np.bincount(place.astype(np.int64), sign * counts, self.width).astype(np.int64)

    def estimates(self, h: int, prefixes: np.ndarray) -> np.ndarray:
        if self.exact[h]:
            return self.counts[h][0][prefixes.astype(np.int64)].astype(float)
        rows = []
        for row in range(self.depth):
            place, sign = self._places(h, row, prefixes)
            rows.append(self.counts[h][row][place.astype(np.int64)] * sign)
        return np.median(np.array(rows), axis=0)

    def descend(self, least: float) -> np.ndarray:
        """Longest prefixes of which each shorter one, too, is estimated at that count or above."""
        alive = np.zeros(1, np.uint64)
        for h in range(self.levels):
            found = [np.empty(0, np.uint64)]
            for some in np.array_split(alive, max(1, math.ceil(len(alive) / 256))):  # bounds the memory of a level
                children = ((some[:, None] << np.uint64(self.step)) | np.arange(1 << self.step, dtype=np.uint64)).ravel()
                found.append(children[self.estimates(h, children) >= least])
            alive = np.concatenate(found)
        return alive

    def slices(self) -> Iterator[tuple[int, bytes]]:
        flat = np.concatenate([c.ravel() for c in self.counts])
        for i in range(0, len(flat), SLICE):
            if flat[i : i + SLICE].any():
                yield i // SLICE, flat[i : i + SLICE].tobytes()

    def load(self, slices: list[tuple[int, bytes]]) -> None:
        flat = np.zeros(sum(c.size for c in self.counts), np.int64)
        for i, data in slices:
            flat[i * SLICE : (i + 1) * SLICE] = np.frombuffer(data, np.int64)
        ends = np.cumsum([c.size for c in self.counts])[:-1]
        self.counts = [x.reshape(c.shape) for x, c in zip(np.split(flat, ends), self.counts)]


_SLICES = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])


def _fill(shape: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = PrefixSketch(*shape)
        for b in batches:
            hashes, counts = np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            sketch.add(hashes, counts)
        found = list(sketch.slices())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())], schema=_SLICES)

    return run


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices that a task gets; it holds each slice once, whatever the number of tasks before."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i in sums:
                sums[i] += np.frombuffer(data, np.int64)
            else:
                sums[i] = np.frombuffer(data, np.int64).copy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], schema=_SLICES)


def heavy_hitters(df: DataFrame, value: str | Column, share: float, once_by: str | None = None, width: int | None = None, depth: int = DEPTH, slack: float = SLACK) -> DataFrame:
    """value, estimate, count, total: the values that make up at least that share of the counted rows.

    value: a string; rows in which it is null aren't counted. once_by: rows that agree in this column,
    if it isn't null, count once (they must agree in the value, too). count is exact; estimate is that of the
    sketch. An empty input gives no rows.

    Memory: levels x depth x width counters per task and on the driver. width: by default a power of 2 from 40 / share on, WIDTH at least;
    a share that asks for more than MOST_WIDTH is refused. Prefixes estimated at slack x
    threshold or above are followed, so a value is missed only if the median of depth rows errs by more
    than (1 - slack) x threshold. In a row, rarer values err by a standard deviation of at most 1 / sqrt(20) of that, and one of the
    commoner ones, of which there are at most 1 / (slack x share), shares the counter with a chance of 5 %. At most levels x 1 / (slack x share) prefixes, give or
    take that error, are followed. Shuffled is the hash alone, of the rows under candidates the value.
    """
    spark = df.sparkSession
    if not 0 < share <= 1:
        raise ValueError("the share must be above 0 and 1 at most")
    if width is None:
        width = max(WIDTH, 1 << math.ceil(math.log2(40 / share)))
        if width > MOST_WIDTH:
            raise ValueError(f"a share of {share} would take {width} counters in a row; the least is {40 / MOST_WIDTH}")
    shape = (width, depth, LEVELS, STEP)
    rows = df.select((F.col(value) if isinstance(value, str) else value).cast("string").alias("v"), (F.col(once_by) if once_by else F.lit(None)).alias("id")).where("v is not null")
    hashed = rows.select(F.xxhash64("v").alias("h"), "id")
    if once_by:
        # a row without id counts by itself
        known = hashed.where("id is not null").groupBy("id").agg(F.any_value("h").alias("h")).select("h")
        hashed = known.unionByName(hashed.where("id is null").select("h"))
    parts = hashed.select("h").mapInArrow(_fill(shape), "slice int, counts binary").repartition("slice").mapInArrow(_add_slices, "slice int, counts binary")
    sketch = PrefixSketch(*shape)
    sketch.load([(r["slice"], bytes(r["counts"])) for r in parts.collect()])  # as many slices as the counters have
    total = int(sketch.counts[0].sum()) if sketch.exact[0] else None
    if total is None:
        raise ValueError("the width must hold the first level")
    found = sketch.descend(max(1.0, slack * share * total)) if total else np.empty(0, np.uint64)
    estimates = sketch.estimates(LEVELS - 1, found) if len(found) else []
    prefixes = spark.createDataFrame([(int(p), float(e)) for p, e in zip(found, estimates)], "prefix long, estimate double")
    prefix = F.shiftrightunsigned(F.xxhash64("v"), 64 - STEP * LEVELS)
    near = rows.withColumn("prefix", prefix).join(F.broadcast(prefixes), "prefix")
    if once_by:
        near = near.where("id is not null").groupBy("id").agg(*(F.any_value(c).alias(c) for c in ("v", "estimate"))).select("v", "estimate").unionByName(near.where("id is null").select("v", "estimate"))
    counted = near.groupBy("v", "estimate").agg(F.count("*").alias("count")).where(F.col("count") >= share * total)
    return counted.select(F.col("v").alias("value"), "estimate", "count", F.lit(total).alias("total"))
