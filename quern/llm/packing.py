"""Problem 8: filling containers of fixed capacity with items of varying length, leaving little space unused.

Large-item matching. At most two items above a third of the capacity share a bin; they are paired
greedily, the largest with the largest that still fits, and the others then go, from large to small,
where the least space is left. Both steps need only how many items there are of each size: equal sizes are
placed together, so the plan is made on a histogram whose length the capacity bounds, whatever the number of items.
The items then find their bins by their rank among those of their size.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.scratch import Scratch

MOST_CAPACITY = 1 << 20
ROWS_PER_TASK = 500_000


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (size, first rank, rank after the last, first bin, items per bin) and the number of bins.

    histogram: how many items there are of each size from 1 to the capacity. Each step uses up a size
    or a range of bins of equal space, so there are at most a few runs for each size.
    """
    left = dict(histogram)
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    space: dict[int, list[tuple[int, int]]] = {}  # free space: ranges (first bin, bins)
    spaces: list[int] = []
    bins = 0

    def place(size: int, items: int, first: int, per_bin: int) -> None:
        runs.append((size, used[size], used[size] + items, first, per_bin))
        used[size] += items
        left[size] -= items

    def leave(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in space:
                bisect.insort(spaces, free)
                space[free] = []
            space[free].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        at = bisect.bisect_right(large, capacity - size) - 1
        if at >= 0 and large[at] == size and left[size] == 1:
            at -= 1
        if at < 0:
            n = left[size]
            place(size, n, bins, 1)
            leave(capacity - size, bins, n)
        elif (other := large[at]) == size:
            n = left[size] // 2
            place(size, 2 * n, bins, 2)
            leave(capacity - 2 * size, bins, n)
        else:
            n = min(left[size], left[other])
            place(size, n, bins, 1)
            place(other, n, bins, 1)
            leave(capacity - size - other, bins, n)
            if not left[other]:
                large.pop(at)
        bins += n
        if not left[size]:
            large.pop()
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect.bisect_left(spaces, size)
            if at == len(spaces):
                n = math.ceil(left[size] / (capacity // size))
                leave(capacity, bins, n)
                bins += n
                continue
            free = spaces[at]
            first, n = space[free].pop()
            if not space[free]:
                del space[free]
                spaces.pop(at)
            per_bin = free // size
            full = min(n, left[size] // per_bin)
            if full:
                place(size, full * per_bin, first, per_bin)
                leave(free - per_bin * size, first, full)
                first, n = first + full, n - full
            if n and left[size] and left[size] < per_bin:
                rest = left[size]
                place(size, rest, first, rest)
                leave(free - rest * size, first, 1)
                first, n = first + 1, n - 1
            leave(free, first, n)
    return runs, bins


def pack(items: DataFrame, item: str, size: str, tasks: Sequence[tuple[int, int]]) -> DataFrame:
    """pack_id, item, part, first_token, size, bin_id: a row for each piece of each item and task (pack_id, capacity).

    An item larger than the capacity is cut into pieces of the capacity and a rest; no other is cut. Items
    of null, zero or negative size take no space: one row with size 0 and without bin. Repeated rows are items
    of their own. A capacity over MOST_CAPACITY is refused. Bins are numbered from 0 in each task. Other columns of the items aren't read.
    """
    spark = items.sparkSession
    if any(capacity is None or capacity < 1 for _, capacity in tasks):
        raise ValueError("a capacity must be at least 1")
    if any(capacity > MOST_CAPACITY for _, capacity in tasks):
        raise ValueError(f"a capacity may be {MOST_CAPACITY} at most: the plan has a class for each size up to it")
    if not tasks:
        fields = {f.name: f.dataType.simpleString() for f in items.schema}
        return spark.createDataFrame([], f"pack_id int, `{item}` {fields[item]}, part int, first_token long, size long, bin_id long")
    offers = F.array(*(F.struct(F.lit(p).cast("int").alias("p"), F.lit(c).cast("long").alias("c")) for p, c in tasks))
    with Scratch(spark, "packing") as scratch:
        sized = scratch.write(items.select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n")), keep=True)
        pieces = (
            sized.select("item", "n", F.explode(offers).alias("o"))
            .select("item", "n", "o.*")
            .select("item", "n", "p", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / F.col("c")) - 1, F.lit(0)))).alias("part"))
            .select("item", "p", "part", (F.col("part") * F.col("c")).alias("start"), F.least(F.col("n") - F.col("part") * F.col("c"), F.col("c")).alias("n"))
            .withColumn("k", F.col("n"))
        )
        counts = pieces.where("n > 0").groupBy("p", "k").count().collect()  # at most as many rows as the capacity for each task
        runs, ways = [], []
        for p, capacity in tasks:
            histogram = {r["k"]: r["count"] for r in counts if r["p"] == p}
            ways += [(p, k, math.ceil(n / ROWS_PER_TASK)) for k, n in histogram.items()]
            runs += [(p, *run) for run in plan_bins(histogram, capacity)[0]]
        run = spark.createDataFrame(runs, "p int, k long, first long, after long, bin long, per_bin long")
        way = spark.createDataFrame(ways, "p int, k long, ways int")
        # rank among the pieces of a size: a size that many pieces have is counted in several ways at once
        split = pieces.where("n > 0").join(F.broadcast(way), ["p", "k"]).withColumn("way", F.pmod(F.xxhash64("item", "part"), F.col("ways")))
        ranked = split.withColumn("r", F.row_number().over(Window.partitionBy("p", "k", "way").orderBy("item", "part")) - 1)
        sizes = split.groupBy("p", "k", "way").count()
        before = sizes.select("p", "k", "way", (F.sum("count").over(Window.partitionBy("p", "k").orderBy("way")) - F.col("count")).alias("before"))
        placed = ranked.join(before, ["p", "k", "way"]).withColumn("r", F.col("r") + F.col("before"))
        fits = (F.col("r") >= F.col("first")) & (F.col("r") < F.col("after"))
        binned = placed.alias("a").join(F.broadcast(run).alias("b"), (F.col("a.p") == F.col("b.p")) & (F.col("a.k") == F.col("b.k")) & fits)
        out = binned.select("a.p", "item", "part", "start", "n", (F.col("bin") + F.floor((F.col("r") - F.col("first")) / F.col("per_bin"))).alias("bin"))
        out = out.unionByName(pieces.where("n <= 0").select("p", "item", "part", "start", "n", F.lit(None).cast("long").alias("bin")))
    return out.select(F.col("p").alias("pack_id"), F.col("item").alias(item), F.col("part").cast("int").alias("part"), F.col("start").alias("first_token"), F.col("n").alias("size"), F.col("bin").alias("bin_id"))
