"""Problem 2: one group name for all records that pairwise matches link, directly or through others.

Deterministic Borůvka hooking. Each round every component selects its smallest outgoing edge, the
trees that these edges make collapse by pointer doubling, and the edges are relabelled and
deduplicated, until none remain. All edges are ordered the same way, so the only cycles are
pairs that selected the same edge. Every round at least halves the components that have edges;
each round's map is kept as a table, and the maps are composed from the last to the first, so
the records themselves are joined once and not in every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.skew import join_key_values
from quern.scratch import Scratch


def link_groups(links: DataFrame, a: str, b: str) -> DataFrame:
    """word, group_word: for every record linked to at least one other, the smallest record of its group.

    Records are strings, compared by their bytes. Links run both ways. Links with a null or empty
    end and links of a record to itself link nothing; repeats change nothing. Without links the result is
    empty. Other columns aren't read.

    Hubs: the smallest edge of a record is an aggregate with map-side combining; the joins on
    pointers end in a written table, so that adaptive execution may split a hub's partition; the last join,
    in which one group may hold a third of all records, takes the largest groups by broadcast.
    """
    spark = links.sparkSession
    pair = links.select(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).where("x <> '' and y <> '' and x <> y")
    edges = pair.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    with Scratch(spark, "link-groups") as scratch:
        maps: list[DataFrame] = []
        edges = scratch.write(edges)
        while not edges.isEmpty():
            hooks = scratch.write(_hooks(edges))
            collapsed = _collapse(scratch, hooks)
            maps.append(collapsed)
            relabelled = (
                edges.join(collapsed.select(F.col("c").alias("u"), F.col("p").alias("x")), "u")
                .join(collapsed.select(F.col("c").alias("v"), F.col("p").alias("y")), "v")
                .where("x <> y")
                .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
                .distinct()
            )
            before, edges = edges, scratch.write(relabelled)
            scratch.drop(before)
        if not maps:
            return spark.createDataFrame([], "word string, group_word string")
        final = maps.pop()
        while maps:
            inner = maps.pop()
            outer = final.select(F.col("c").alias("p"), F.col("p").alias("root"))
            # a root of an inner round that had no edge left is final itself
            final = inner.join(outer, "p", "left").select("c", F.coalesce("root", "p").alias("p"))
        members = scratch.write(final, keep=True)
        names = scratch.write(members.groupBy("p").agg(F.min("c").alias("group_word"), F.count("*").alias("members")), keep=True)
        return join_key_values(members, names, ["p"], "members").select(F.col("c").alias("word"), "group_word")


def _hooks(edges: DataFrame) -> DataFrame:
    """c, p: each component and the other end of its smallest edge; of two that chose each other, the smaller is a root."""
    ends = edges.select("u", "v", F.explode(F.array("u", "v")).alias("c"))
    return ends.groupBy("c").agg(F.min(F.struct("u", "v")).alias("e")).select("c", F.when(F.col("c") == F.col("e.u"), F.col("e.v")).otherwise(F.col("e.u")).alias("p"), (F.col("c") == F.col("e.u")).alias("smaller"))


def _collapse(scratch: Scratch, hooks: DataFrame) -> DataFrame:
    """c, p: each component and the root of its tree."""
    chosen = hooks.select(F.col("c").alias("p"), F.col("p").alias("back"))
    # the smaller end of an edge that both ends chose points to itself
    step = hooks.join(chosen, "p").select("c", F.when(F.col("smaller") & (F.col("back") == F.col("c")), F.col("c")).otherwise(F.col("p")).alias("p"))
    now = scratch.write(step)
    while True:
        ahead = now.select(F.col("c").alias("p"), F.col("p").alias("q"))
        twice = now.join(ahead, "p").select("c", "q", (F.col("q") != F.col("p")).alias("moved"))
        nxt = scratch.write(twice.withColumnRenamed("q", "p"))
        moved = not nxt.where("moved").isEmpty()
        scratch.drop(now)
        now = nxt
        if not moved:
            return now.select("c", "p")
