"""Tables made of a batch of queries, which are broadcast up to a checked number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """The rows as a table to broadcast. More than BROADCAST_ROWS are refused: such a batch must be asked in parts."""
    rows = list(rows)
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"a batch of queries with {len(rows)} rows ({schema}); at most {BROADCAST_ROWS} are broadcast, ask in smaller batches")
    return F.broadcast(spark.createDataFrame(rows, schema))
