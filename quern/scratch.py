"""Tables that cut a plan's lineage, kept in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is local, as in tests on
one machine, a temporary folder is made. Executors may be lost at any time: what is written
here doesn't depend on them.
"""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: dict[str, str] = {}
_kept: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    """URI of the shared folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        path = spark._jvm.org.apache.hadoop.fs.Path(configured)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own_root:
        _own_root["dir"] = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _own_root["dir"]


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder on whatever file system its URI names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def files(spark: SparkSession, uri: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the Parquet files under a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    walk, found = fs.listFiles(path, True), []
    while walk.hasNext():
        f = walk.next()
        if f.getPath().getName().endswith(".parquet"):
            found.append((f.getPath().toString(), f.getLen()))
    return sorted(found)


@atexit.register
def clear() -> None:
    """Delete what operators left for the frames they returned; runs at exit, too."""
    for spark, uri in _kept:
        try:
            remove(spark, uri)
        except Exception:  # the session has ended before
            pass
    _kept.clear()


class Scratch:
    """Folder of one operator call. On leaving the block all tables but the kept ones are deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.uri = spark, f"{root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n, self._tables, self._keep = 0, {}, set()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for uri in set(self._tables.values()) - self._keep:
            remove(self.spark, uri)
        if self._keep and not error[0]:
            _kept.append((self.spark, self.uri))
        else:
            remove(self.spark, self.uri)

    def folder(self) -> str:
        self._n += 1
        return f"{self.uri}/{self._n}"

    def write(self, df: DataFrame, *partition_by: str, keep: bool = False) -> DataFrame:
        """Write df and return the table read back."""
        uri = self.folder()
        df.write.partitionBy(*partition_by).parquet(uri)
        out = self.spark.read.schema(df.schema).parquet(uri)
        self._tables[id(out)] = uri
        out._quern_uri = uri
        if keep:
            self._keep.add(uri)
        return out

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, self._tables.pop(id(df)))


def parallelism(spark: SparkSession) -> int:
    """Tasks that the cluster's owner wants a shuffle to have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bits_for(n: int) -> int:
    return max(1, math.ceil(math.log2(max(2, n))))
