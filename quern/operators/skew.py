"""Joining rows with one row per key where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVIEST = 1024


def join_key_values(rows: DataFrame, values: DataFrame, on: list[str], weight: str, heaviest: int = HEAVIEST) -> DataFrame:
    """Inner join of rows with values, which has one row per key and, in weight, about how many rows have the key.

    The heaviest keys, at most ``heaviest`` of them whatever the size of the data, are broadcast, so
    that their rows stay where they are; the other rows are shuffled, and no key among them holds
    more than 1/heaviest of all. Null keys join nothing. Both inputs are read twice: give tables or
    plans that end in a shuffle, which Spark reuses.
    """
    top = values.where(F.col(weight).isNotNull()).orderBy(F.desc(weight), *on).limit(heaviest)
    hot = rows.join(F.broadcast(top), on, "inner")
    cold = rows.join(F.broadcast(top.select(*on)), on, "left_anti").join(values, on, "inner")
    return hot.unionByName(cold)
