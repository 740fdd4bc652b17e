"""Problem 9: combining records from several sources so that each makes up its target share of the total size.

Cube-method balanced sampling. Every record starts with the inclusion probability that its source's target
asks for; probabilities then move, three records at a time, along the direction that changes neither the
source's tokens nor its number of records, until they are 0 or 1. This is done for buckets of a
source's records and leaves at most two of each undecided. These are joined by the source's largest records and by a reserve of a
few thousand others; the large ones are decided first, the reserve makes up for the rounding that this
takes, and the last two records are rounded to what comes nearest to the source's tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.scratch import Scratch

MOST_SOURCES = 100_000
TINY = 1e-9
RESERVE = 2000
BUCKET_ROWS = 200_000
LARGE_SHARE = 0.005


def fly(tokens: np.ndarray, chances: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Chances moved to 0 or 1 but for at most two; their sums, plain and weighted with tokens, stay."""
    chances = chances.copy()
    open_ = np.flatnonzero((chances > TINY) & (chances < 1 - TINY))
    while len(open_) >= 3:
        m = len(open_) // 3
        at = open_[: 3 * m].reshape(m, 3)
        t, p = tokens[at], chances[at]
        u = np.stack([t[:, 1] - t[:, 2], t[:, 2] - t[:, 0], t[:, 0] - t[:, 1]], axis=1)
        u[~u.any(axis=1)] = (1.0, -1.0, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min(axis=1)
            down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)).min(axis=1)
        go_up = rng.random(m) < down / (up + down)
        p = p + np.where(go_up, up, -down)[:, None] * u
        p[p < TINY] = 0.0
        p[p > 1 - TINY] = 1.0
        chances[at] = p
        open_ = np.flatnonzero((chances > TINY) & (chances < 1 - TINY))
    return chances


def _round(tokens: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """At most two undecided rounded to the nearest sum of tokens, then of records."""
    chances = np.where(chances < TINY, 0.0, np.where(chances > 1 - TINY, 1.0, chances))
    open_ = np.flatnonzero((chances > 0) & (chances < 1))
    ways = [np.array([w >> j & 1 for j in range(len(open_))], float) for w in range(1 << len(open_))]
    off = [w - chances[open_] for w in ways]
    best = min(range(len(ways)), key=lambda w: (abs(float(off[w] @ tokens[open_])), abs(float(off[w].sum()))))
    chances[open_] = ways[best]
    return chances


def land(tokens: np.ndarray, chances: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """All decided: first the large records among themselves, then the others, which make up for what rounding the large ones changed."""
    wanted = float(tokens @ chances)
    chances = chances.copy()
    large = tokens > 4 * np.median(tokens) if len(tokens) else np.zeros(0, bool)
    chances[large] = _round(tokens[large], fly(tokens[large], chances[large], rng))
    small = np.flatnonzero(~large & (tokens > 0))
    for _ in range(50):
        off = wanted - float(tokens @ chances)
        p = chances[small]
        room = small[(p < 1 - TINY) if off > 0 else (p > TINY)]
        if abs(off) < 0.5 or not len(room):
            break
        chances[room] = np.clip(chances[room] + off * tokens[room] / float(tokens[room] @ tokens[room]), 0, 1)
    return _round(tokens, fly(tokens, chances, rng))


def _flight(seed: int, last: bool):
    """Over rows (s, bucket, id, n, base, p), sorted by source and bucket, whose number in a bucket is bounded. last: none stays undecided.

    What is drawn depends on the seed, the source and the bucket, not on how the rows lie in partitions.
    """

    def decide(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(parts)
        source, bucket = own.column("s")[0].as_py(), own.column("bucket")[0].as_py()
        rng = np.random.default_rng([seed, int(last), bucket, zlib.crc32(source.encode())])
        p = (land if last else fly)(own.column("n").to_numpy().astype(float), own.column("p").to_numpy(), rng)
        yield from own.set_column(own.column_names.index("p"), "p", pa.array(p)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        at = None
        for b in batches:
            keys = list(zip(b.column("s").to_pylist(), b.column("bucket").to_pylist()))
            start = 0
            for i, k in enumerate(keys):
                if k != at:
                    if i > start:
                        parts.append(b.slice(start, i - start))
                    if parts:
                        yield from decide(parts)
                    parts, start, at = [], i, k
            if len(keys) > start:
                parts.append(b.slice(start))
        if parts:
            yield from decide(parts)

    return run


def plan_shares(targets: list[tuple[str, float, int]], available: dict[str, int], total: int | None = None) -> dict[str, tuple[float, float]]:
    """For each source its requested tokens and how often each of its records is used on average.

    total: size of the mixture; by default as many tokens as the wanted sources have. A source that can't reach
    its share with max_repeats gives all it can, and one without tokens nothing; the others keep their targets.
    """
    whole = sum(share for _, share, _ in targets) or 1.0
    if total is None:
        total = sum(available.get(s, 0) for s, _, _ in targets)
    out = {}
    for source, share, repeats in targets:
        wanted, have = total * share / whole, available.get(source, 0)
        out[source] = (wanted, min(wanted / have, float(repeats)) if have else 0.0)
    return out


def read_targets(targets: DataFrame, source: str, share: str, max_repeats: str) -> list[tuple[str, float, int]]:
    """The table of targets, which must be small. Rows of one source add up; null or negative shares are 0, null repeats 1."""
    rows = targets.select(F.col(source).alias("s"), F.col(share).cast("double").alias("w"), F.col(max_repeats).cast("int").alias("m")).where("s is not null").distinct().limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found: dict[str, tuple[float, int]] = {}
    for r in sorted(rows, key=lambda r: r["s"]):
        w = r["w"] if r["w"] is not None and r["w"] > 0 else 0.0
        m = 1 if r["m"] is None else max(0, r["m"])
        old = found.get(r["s"], (0.0, 0))
        found[r["s"]] = (old[0] + w, max(old[1], m))
    return [(s, w, m) for s, (w, m) in found.items()]


def mix_sources(records: DataFrame, record: str, source: str, size: str, targets: list[tuple[str, float, int]], total: int | None = None, seed: int = 1) -> DataFrame:
    """record, source, size, copies: how often each record is used in the mixture, every record once.

    Records of sources without target, without source or of no size aren't used (copies 0). A source whose average use is
    k + f has k copies of each of its records and one more of those that balanced sampling draws with chance f;
    its tokens come out within those of two ordinary records of the target, unless it has too few to make up for a
    large one. The draw depends on the seed and the records, not on how they are spread over tasks.
    """
    spark = records.sparkSession
    with Scratch(spark, "mixing") as scratch:
        kind = dict(records.dtypes)[record]
        rows = scratch.write(records.select(F.col(record).alias("id"), F.col(source).alias("s"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n")), keep=True)
        asked = spark.createDataFrame([(s,) for s, _, _ in targets], "s string")
        sums = rows.join(F.broadcast(asked), "s", "left_semi").groupBy("s").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()  # at most one row for each target
        uses = plan_shares(targets, {r["s"]: r["n"] for r in sums}, total)
        about = {r["s"]: (max(1, r["k"] // RESERVE), int(LARGE_SHARE * r["n"]), -(-r["k"] // BUCKET_ROWS)) for r in sums}
        frame = spark.createDataFrame([(s, int(u), float(u - int(u)), *about.get(s, (1, 0, 1))) for s, (_, u) in uses.items()], "s string, base int, p double, every long, large long, buckets long")
        with_use = rows.join(F.broadcast(frame), "s", "left").withColumn("used", F.col("base").isNotNull() & (F.col("n") > 0))
        draw = F.col("used") & (F.col("p") > TINY) & (F.col("p") < 1 - TINY)
        schema = f"s string, bucket long, id {kind}, n long, base int, p double"
        columns = ["s", "bucket", "id", "n", "base", "p"]
        # held back for the end: fewer than 1 / LARGE_SHARE large records of a source and about RESERVE others
        held = (F.col("n") > F.col("large")) | (F.pmod(F.xxhash64("id", "n"), F.col("every")) == 0)
        some = with_use.where(draw).withColumn("held", held).withColumn("bucket", F.when(F.col("held"), -1).otherwise(F.pmod(F.xxhash64("n", "id", F.lit(seed)), F.col("buckets"))))
        order = ("s", "bucket", F.xxhash64("id", F.lit(seed)), "id", "n")
        first = some.where("not held").select(*columns).repartition("s", "bucket").sortWithinPartitions(*order).mapInArrow(_flight(seed, False), schema)
        flown = scratch.write(first.unionByName(some.where("held").select(*columns)), keep=True)
        done = F.col("p").isin(0.0, 1.0) | (F.col("p") <= TINY) | (F.col("p") >= 1 - TINY)
        # what was held back and at most two records of each bucket before
        landed = flown.where(~done).withColumn("bucket", F.lit(0).cast("long")).repartition("s").sortWithinPartitions(*order).mapInArrow(_flight(seed, True), schema)
        landed = scratch.write(landed, keep=True)
        drawn = flown.where(done).unionByName(landed).select("id", "s", "n", (F.col("base") + F.round("p")).cast("int").alias("copies"))
        fixed = with_use.where(~F.coalesce(draw, F.lit(False))).select("id", "s", "n", F.when(F.col("used"), F.col("base") + F.round("p")).otherwise(0).cast("int").alias("copies"))
    return drawn.unionByName(fixed).select(F.col("id").alias(record), F.col("s").alias(source), F.col("n").alias(size), "copies")


def reached_shares(mixture: DataFrame, source: str, size: str, targets: list[tuple[str, float, int]]) -> DataFrame:
    """source, target_share, max_repeats, available_tokens, records, mixed_tokens, reached_share, most_copies: a row for each target."""
    spark = mixture.sparkSession
    schema = f"`{source}` string, target_share double, max_repeats int, available_tokens long, records long, mixed_tokens long, reached_share double, most_copies int"
    asked = F.broadcast(spark.createDataFrame([(s,) for s, _, _ in targets], "s string"))
    own = mixture.select(F.col(source).alias("s"), F.col(size).alias("n"), "copies").join(asked, "s", "left_semi")
    sums = own.groupBy("s").agg(F.sum("n").alias("n"), F.sum("copies").alias("k"), F.sum(F.col("n") * F.col("copies")).alias("mixed"), F.max("copies").alias("most")).collect()  # at most one row for each target
    got = {r["s"]: (r["n"], r["k"], r["mixed"], r["most"]) for r in sums}
    whole = sum(m for _, _, m, _ in got.values())
    rows = []
    for s, share, repeats in targets:
        n, k, mixed, most = got.get(s, (0, 0, 0, 0))
        rows.append((s, share, repeats, n, k, mixed, mixed / whole if whole else 0.0, most))
    return spark.createDataFrame(rows, schema)
