"""Results per key where a handful of keys hold most rows.

Only algebraic aggregates are used, which Spark computes in two steps: each task keeps a bounded
hash table of its keys' states (and goes over to sorting and spilling beyond that), and one
compact state per key and task is shuffled. So a key that holds a third of all rows
sends no more than any other, and no task works through a key's rows alone.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALGEBRAIC = {"count": lambda c: F.count(c), "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "stddev": F.stddev_samp, "any": F.bool_or, "all": F.bool_and}


def combine_by_key(df: DataFrame, keys: Mapping[str, str | Column], measures: Mapping[str, tuple[str, str | Column]], distinct: Mapping[str, str | Column] | None = None) -> DataFrame:
    """One row per key with the measures: output name to (count, sum, min, max, mean, stddev, any or all, column).

    keys: output name to column. distinct: rows that agree in the keys, these and all measured columns
    count once; they are removed in the same two steps, so repeats don't travel either.

    A null key is a key of its own; measures skip nulls as SQL does (count of lit(1) counts rows).
    An empty input gives no rows. Other columns of the input are not read, so their names can't clash.
    """
    unknown = sorted({how for how, _ in measures.values()} - set(ALGEBRAIC))
    if unknown:
        raise ValueError(f"not algebraic: {unknown}; there are {sorted(ALGEBRAIC)}")
    clash = set(keys) & set(measures)
    if clash:
        raise ValueError(f"names used for a key and a measure: {sorted(clash)}")
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    k = {name: f"k{i}" for i, name in enumerate(keys)}
    m = {name: f"m{i}" for i, name in enumerate(measures)}
    rows = df.select(
        *(as_col(c).alias(k[n]) for n, c in keys.items()),
        *(as_col(c).alias(m[n]) for n, (_, c) in measures.items()),
        *(as_col(c).alias(f"d{i}") for i, c in enumerate((distinct or {}).values())),
    )
    if distinct is not None:
        rows = rows.distinct()
    out = rows.groupBy(*k.values()).agg(*(ALGEBRAIC[how](F.col(m[n])).alias(m[n]) for n, (how, _) in measures.items()))
    return out.select(*(F.col(k[n]).alias(n) for n in keys), *(F.col(m[n]).alias(n) for n in measures))
