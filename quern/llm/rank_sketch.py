"""Problem 3: percentiles of very large numeric columns, from sketches that can be put together later.

Relative-rank compactors. A sketch is a ladder of buffers; an item on level h stands for 2^h
values. A buffer that is over its capacity leaves its upper part alone and promotes every second item of
the rest, so the few largest values are kept exactly and the error of a rank is in proportion to the number
of values above it. Merging joins the buffers level by level and compacts again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTION = 50
SECTIONS = 3
MAX_GROUPS = 20_000
HELD = 4096


def relative_error(section: int = SECTION) -> float:
    """Three standard deviations of the error of a rank, as a share of the values above it (at most of all values: 3 * 0.084 / section)."""
    return 3 * np.sqrt(0.0512 / SECTIONS) / section


class RankSketch:
    """Sketch of numbers; n, low and high are exact."""

    __slots__ = ("section", "n", "low", "high", "levels", "states", "held", "n_held")

    def __init__(self, section: int = SECTION):
        self.section, self.n, self.low, self.high = section, 0, np.inf, -np.inf
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.states: list[int] = [0]
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def update(self, values: np.ndarray) -> None:
        """Take in numbers; NaN isn't one."""
        if not len(values):
            return
        self.n += len(values)
        self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
        self.held.append(np.array(values, dtype=float))
        self.n_held += len(values)
        if self.n_held >= HELD:
            self.compress()

    def merge(self, other: RankSketch) -> None:
        if other.section != self.section:
            raise ValueError(f"sketches of sections {self.section} and {other.section} can't be merged")
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self.held += other.held
        self.n_held += other.n_held
        for h, level in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(level)
                self.states.append(other.states[h])
            else:
                self.levels[h] = np.concatenate([self.levels[h], level])
                self.states[h] |= other.states[h]
        self.compress()

    def _sections(self, h: int) -> int:
        """Sections of a level: they double when its compactions have used all of them."""
        n = SECTIONS
        while self.states[h] >= 1 << (n - 1):
            n *= 2
        return n

    def compress(self) -> None:
        if self.held:
            self.levels[0] = np.concatenate([self.levels[0], *self.held])
            self.held, self.n_held = [], 0
        h = 0
        while h < len(self.levels):
            sections = self._sections(h)
            level = self.levels[h]
            if len(level) > 2 * sections * self.section:
                level = np.sort(level)
                # sections that are compacted: one more than the trailing ones of the number of compactions so far
                ones = (~self.states[h] & (self.states[h] + 1)).bit_length() - 1
                spared = sections * self.section + max(0, sections - 1 - ones) * self.section
                cut = len(level) - spared
                cut -= cut % 2
                coin = _coin(h, self.states[h], self.n)
                promoted, self.levels[h] = level[coin:cut:2], level[cut:]
                self.states[h] += 1
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                    self.states.append(0)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], promoted])
            h += 1

    def quantiles(self, shares: Sequence[float]) -> list[float]:
        """The smallest kept value of which at least that share of the values is at or below; null for an empty sketch."""
        if not self.n:
            return [None] * len(shares)
        self.compress()
        values = np.concatenate(self.levels)
        weights = np.repeat([2**h for h in range(len(self.levels))], [len(x) for x in self.levels])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        at = np.searchsorted(upto, np.asarray(shares) * self.n * (1 - 1e-12), side="left")
        found = values[order][np.minimum(at, len(values) - 1)]
        return [self.low if q <= 0 else self.high if q >= 1 else float(v) for q, v in zip(shares, found)]

    def to_bytes(self) -> bytes:
        self.compress()
        head = struct.pack("<BHqddB", 1, self.section, self.n, self.low, self.high, len(self.levels))
        return head + b"".join(struct.pack("<qI", s, len(x)) + x.tobytes() for s, x in zip(self.states, self.levels))

    @classmethod
    def from_bytes(cls, data: bytes) -> RankSketch:
        version, section, n, low, high, levels = struct.unpack_from("<BHqddB", data)
        if version != 1:
            raise ValueError(f"sketch of unknown version {version}")
        out, at = cls(section), struct.calcsize("<BHqddB")
        out.n, out.low, out.high, out.levels, out.states = n, low, high, [], []
        for _ in range(levels):
            state, size = struct.unpack_from("<qI", data, at)
            at += struct.calcsize("<qI")
            out.states.append(state)
            out.levels.append(np.frombuffer(data, float, size, at))
            at += 8 * size
        return out


def _coin(h: int, state: int, n: int) -> int:
    """0 or 1, the same for a repeated task: each second toss is the opposite of the one before."""
    toss = ((h * 0x9E3779B97F4A7C15 + (state >> 1) * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) >> 17) & 1
    return toss ^ (state & 1)


def sketches(df: DataFrame, keys: dict[str, str | Column], value: str, section: int = SECTION, max_groups: int = MAX_GROUPS) -> DataFrame:
    """The keys, part (number of the task) and sketch of the values, one row or more per key and task.

    Key columns are strings in the result; a null key is a key of its own. Null and NaN values aren't
    counted. A task holds at most max_groups sketches and passes them on when there would be more.
    """
    names = list(keys)
    rows = df.select(*(F.col(c).cast("string").alias(f"k{i}") if isinstance(c, str) else c.cast("string").alias(f"k{i}") for i, c in enumerate(keys.values())), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    schema = pa.schema([(f"k{i}", pa.string()) for i in range(len(names))] + [("part", pa.int32()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.zeros(b.num_rows, np.int64)
            groups: list[tuple] = [()]
            for i in range(len(names)):
                d = b.column(i).dictionary_encode()
                own = [*d.dictionary.to_pylist(), None]
                codes = codes * len(own) + d.indices.fill_null(len(own) - 1).to_numpy(zero_copy_only=False)
                used, codes = np.unique(codes, return_inverse=True)
                groups = [(*groups[u // len(own)], own[u % len(own)]) for u in used]
            order = np.argsort(codes, kind="stable")
            values = b.column(len(names)).to_numpy(zero_copy_only=False)[order]
            ends = np.searchsorted(codes[order], np.arange(len(groups) + 1))
            for g, key in enumerate(groups):
                if key not in held:
                    if len(held) >= max_groups:
                        yield from _rows(held, part, schema)
                        held = {}
                    held[key] = RankSketch(section)
                held[key].update(values[ends[g] : ends[g + 1]])
        yield from _rows(held, part, schema)

    out = rows.mapInArrow(run, ", ".join(f"k{i} string" for i in range(len(names))) + ", part int, sketch binary")
    return out.select(*(F.col(f"k{i}").alias(n) for i, n in enumerate(names)), "part", "sketch")


def _rows(held: dict, part: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    items = list(held.items())
    for i in range(0, len(items), 200):
        some = items[i : i + 200]
        columns = [[k[j] for k, _ in some] for j in range(len(schema) - 2)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, [part] * len(some), [s.to_bytes() for _, s in some]], schema)], schema=schema)


def merge_sketches(df: DataFrame, keys: Sequence[str], fan_in: int = 64) -> DataFrame:
    """keys, sketch: one for each key, from any number of sketches, of tasks, files or days.

    A task has one open sketch at a time. Up to fan_in sketches of a key in a row are merged by
    one task, then theirs, so no task has to read all of a key's sketches when there are many tasks.
    """
    keys = list(keys)
    schema = pa.schema([(f"k{i}", pa.string()) for i in range(len(keys))] + [("part", pa.int32()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_sketch, done = None, None, []
        for b in batches:
            for *key, part, data in zip(*(b.column(i).to_pylist() for i in range(len(keys) + 2))):
                if (*key, part) != at:
                    if open_sketch is not None:
                        done.append((at[:-1], open_sketch))
                        if len(done) == 200:
                            yield from _merged(done, schema)
                            done = []
                    at, open_sketch = (*key, part), RankSketch.from_bytes(data)
                else:
                    open_sketch.merge(RankSketch.from_bytes(data))
        if open_sketch is not None:
            done.append((at[:-1], open_sketch))
        yield from _merged(done, schema)

    ddl = ", ".join(f"k{i} string" for i in range(len(keys))) + ", part int, sketch binary"
    now = df.select(*(F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)), (F.col("part") if "part" in df.columns and "part" not in keys else F.lit(0)).cast("int").alias("part"), "sketch")
    own = [f"k{i}" for i in range(len(keys))]
    from quern.scratch import parallelism

    if parallelism(df.sparkSession) > fan_in:
        group = F.floor(F.col("part") / fan_in).cast("int")
        now = now.withColumn("part", group).repartition(*own, "part").sortWithinPartitions(*own, "part").mapInArrow(run, ddl)
    now = now.withColumn("part", F.lit(0)).repartition(*own).sortWithinPartitions(*own).mapInArrow(run, ddl)
    return now.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "sketch")


def _merged(done: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if done:
        columns = [[k[j] for k, _ in done] for j in range(len(schema) - 2)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, [0] * len(done), [s.to_bytes() for _, s in done]], schema)], schema=schema)


def quantiles(df: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """keys, n, low, high and quantiles (array, in the order of shares) of a table of sketches."""
    keys = list(keys)
    schema = pa.schema([(f"k{i}", pa.string()) for i in range(len(keys))] + [("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("quantiles", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [RankSketch.from_bytes(x) for x in b.column(len(keys)).to_pylist()]
            tail = [[s.n for s in found], [s.low for s in found], [s.high for s in found], [s.quantiles(shares) for s in found]]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), *(pa.array(c, f.type) for c, f in zip(tail, [*schema][len(keys) :]))], schema=schema)

    ddl = ", ".join(f"k{i} string" for i in range(len(keys))) + ", n long, low double, high double, quantiles array<double>"
    out = df.select(*(F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)), "sketch").mapInArrow(run, ddl)
    return out.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "n", "low", "high", "quantiles")
