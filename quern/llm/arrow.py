"""Reading the shared folder from Python workers."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Hadoop writes it (file:/x, file:///x, hdfs://..., s3://...)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def in_batches(rows: dict[str, list], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(rows.values())))
    for i in range(0, n, size):
        yield pa.RecordBatch.from_arrays([pa.array(rows[f.name][i : i + size], f.type) for f in schema], schema=schema)
