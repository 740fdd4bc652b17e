"""The positional inverted index: a versioned folder of Parquet tables with a JSON sidecar.

The file of the highest number in <path>/pointers names the version that readers open; a version's tables are written first and the
next pointer last, so a reader sees the old tables or the new ones, whole. Pointers are never overwritten, and a writer whose version has
been overtaken is refused.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.plans.query import FIELD_NAME
from quern.scratch import Scratch, remove

# small enough that a search for a few terms leaves most of a large index unread
ROW_GROUP_BYTES = 16 << 20
TABLES = ("postings", "doclens", "documents", "termstats", "field_stats", "vocabulary")


def schema_of(table: str, doc_id_type: str, positions: bool) -> str:
    """Schemas are given, not inferred: a table without rows may have no file."""
    return {
        "postings": f"term string, doc_id {doc_id_type}, freq int, len int, title_len int, {'pos array<int>, ' if positions else ''}field string",
        "doclens": f"field string, doc_id {doc_id_type}, len int",
        "documents": f"doc_id {doc_id_type}, title string, opening string",
        "termstats": "field string, term string, doc_freq long, idf double",
        "field_stats": "field string, total_docs long, total_length long",
        "vocabulary": "term string, len int, fc string, first_field int",
    }[table]


FORMAT = {True: "quern-fold-v1", False: "quern-plain-v1"}


def _path(spark: SparkSession, uri: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _read_text(spark: SparkSession, uri: str) -> str | None:
    p, fs = _path(spark, uri)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, uri: str, content: str) -> None:
    """A new file; one that exists isn't overwritten."""
    p, fs = _path(spark, uri)
    stream = fs.create(p, False)
    stream.write(bytearray(content, "utf-8"))
    stream.close()


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Numbers and versions of the pointers, the latest first. One without content belongs to a writer at work, or to one that has failed."""
    p, fs = _path(spark, f"{path}/pointers")
    if not fs.exists(p):
        return []
    numbers = sorted((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), reverse=True)
    return [(n, _read_text(spark, f"{path}/pointers/{n:012d}") or "") for n in numbers]


def _publish(spark: SparkSession, path: str, version: str, read: str | None) -> None:
    """Make a version the current one, if the one that it was made from still is. Creating a number is atomic and fails if there is one."""
    found = _pointers(spark, path)
    if next((v for _, v in found if v), None) != read:
        raise RuntimeError(f"another writer has changed the index at {path}")
    try:
        _write_text(spark, f"{path}/pointers/{(found[0][0] if found else 0) + 1:012d}", version)
    except Exception as e:
        raise RuntimeError(f"another writer is changing the index at {path}") from e


def _check_fields(fields: Sequence[str]) -> None:
    bad = [f for f in fields if not FIELD_NAME.fullmatch(f)]
    if bad or not fields:
        raise ValueError(f"field names must match {FIELD_NAME.pattern}: {bad}")


def token_rows(df: DataFrame, fields: Sequence[str], folded: bool, tokenizer: Callable | None = None, title: str | None = None) -> DataFrame:
    """doc_id, field, tokens, title_len of text or token-list columns, in one scan; title: the field whose length every row has, or null."""
    kinds = dict(df.dtypes)
    make = tokenizer or (lambda c: text.tokens(c, folded))
    one = lambda f: F.struct(F.lit(f).alias("field"), (F.coalesce(F.col(f), F.array()) if kinds[f].startswith("array") else make(F.col(f))).alias("tokens"))
    found = df.select("doc_id", F.array(*map(one, fields)).alias("all"))
    length = F.size(F.get("all", F.lit(list(fields).index(title)))["tokens"]) if title in fields else F.lit(None).cast("int")
    return found.select("doc_id", length.alias("title_len"), F.explode("all").alias("x")).select("doc_id", "x.field", "x.tokens", "title_len")


def _gather(positions: bool):
    """Postings of each row of tokens: its distinct terms with their number and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                tokens = part.column("tokens")
                offsets = tokens.offsets.to_numpy()
                words = tokens.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
                code = words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = np.diff(offsets)
                row, place = np.repeat(np.arange(part.num_rows), lengths), np.arange(len(code)) - np.repeat(offsets[:-1] - offsets[0], lengths)
                v = len(words.dictionary) + 1
                key = (row * v + code)[code >= 0]
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.zeros(0, np.int64)
                own, freq = key[order][first], np.diff(np.r_[first, len(key)])
                at = pa.array(own // v)
                out = [part.column("field").take(at), words.dictionary.take(pa.array(own % v)), part.column("doc_id").take(at), pa.array(freq.astype(np.int32)), pa.array(lengths[own // v].astype(np.int32)), part.column("title_len").take(at)]
                if positions:
                    out.append(pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)].astype(np.int32)), pa.array(place[code >= 0][order].astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["field", "term", "doc_id", "freq", "len", "title_len", *(["pos"] if positions else [])])

    return run


def postings_of(tokens: DataFrame, positions: bool = True) -> DataFrame:
    """field, term, doc_id, freq, len, title_len and pos; a row of tokens has all of its postings, so they need no shuffle. Null tokens take a place and are no term."""
    kind = dict(tokens.dtypes)["doc_id"]
    given = tokens.select("doc_id", "field", "tokens", "title_len") if "title_len" in tokens.columns else tokens.select("doc_id", "field", "tokens", F.lit(None).cast("int").alias("title_len"))
    return given.mapInArrow(_gather(positions), f"field string, term string, doc_id {kind}, freq int, len int, title_len int" + (", pos array<int>" if positions else ""))


def with_idf(term_docs: DataFrame, totals: dict[str, int]) -> DataFrame:
    """Adds idf = ln((N + 0.5) / (df + 0.5) + 1), N of the field."""
    pairs = [x for f, n in totals.items() for x in (F.lit(f), F.lit(float(n)))]
    n = F.create_map(*pairs)[F.col("field")] if pairs else F.lit(None).cast("double")
    return term_docs.withColumn("idf", F.log((n + 0.5) / (F.col("doc_freq") + 0.5) + 1.0))


class Index:
    """An opened version of an index."""

    def __init__(self, spark: SparkSession, path: str, meta: dict):
        self.spark, self.path, self.meta = spark, path, meta
        self.fields: list[str] = meta["fields"]
        self.folded = meta["tokenizer"] == FORMAT[True]
        self.positions: bool = meta["positions"]
        self._small: dict = {}

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        version = next((v for _, v in _pointers(spark, path) if v), None)
        if version is None:
            raise ValueError(f"no index at {path}")
        meta = _read_text(spark, f"{path}/{version}/meta.json")
        if meta is None:
            raise ValueError(f"the index at {path} has no sidecar for version {version}")
        return Index(spark, path, json.loads(meta) | {"version": version})

    def read_meta(self, key: str):
        return self.meta.get(key)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(schema_of(name, self.meta["doc_id_type"], self.positions)).parquet(f"{self.path}/{self.meta['version']}/{name}")

    @property
    def field_stats(self) -> dict[str, tuple[int, int]]:
        """field -> (documents with tokens, tokens); a row for each field."""
        if "field_stats" not in self._small:
            self._small["field_stats"] = {r["field"]: (r["total_docs"], r["total_length"]) for r in self.table("field_stats").collect()}
        return self._small["field_stats"]

    def has_positions(self) -> bool:
        return self.positions

    def doc_id_type(self) -> str:
        return self.meta["doc_id_type"]

    def get_fields(self) -> list[str]:
        return sorted(self.fields)

    def get_term_list(self, field: str) -> DataFrame:
        return self.table("termstats").where(F.col("field") == field).select("term").orderBy("term")

    def frequent_words(self, share: float = 0.3) -> DataFrame:
        """term: words in more than that share of a field's documents, as a stopword list of the corpus itself."""
        totals = self.table("field_stats").select("field", "total_docs")
        often = self.table("termstats").join(F.broadcast(totals), "field").where(F.col("doc_freq") > share * F.col("total_docs"))
        return often.select("term").distinct()

    def get_stats(self) -> DataFrame:
        """field, postings, terms, docs, tokens."""
        p = self.table("termstats").groupBy("field").agg(F.sum("doc_freq").alias("postings"), F.count("*").alias("terms"))
        return self.table("field_stats").select("field", F.col("total_docs").alias("docs"), F.col("total_length").alias("tokens")).join(p, "field", "left").fillna(0)

    @staticmethod
    def build(df: DataFrame, path: str, fields: Sequence[str], *, doc_id: str = "doc_id", title: str | None = None, opening: str | None = None, positions: bool = True, fold: bool = True, doc_id_type: str = "bigint", order_by: str | None = None, tokenizer: Callable | None = None, meta: dict | None = None, on_progress: Callable[[str], None] | None = None) -> Index:
        """Build a new index; an existing one isn't overwritten.

        Rows with a null or empty id are skipped, and of rows with one id the first by order_by counts (any, if none
        is given). title, opening: columns kept for display. tokenizer: function from Column to Column of token arrays.
        """
        spark = df.sparkSession
        _check_fields(fields)
        if doc_id_type not in ("bigint", "string"):
            raise ValueError("doc_id_type must be bigint or string")
        if any(v for _, v in _pointers(spark, path)):
            raise ValueError(f"there is an index at {path}")
        docs = df.select(F.col(doc_id).try_cast(doc_id_type).alias("doc_id"), *fields, (F.col(title) if title else F.lit(None).cast("string")).alias("_title"), (F.col(opening) if opening else F.lit(None).cast("string")).alias("_opening"), *([F.col(order_by).alias("_order")] if order_by else []))
        docs = docs.where("doc_id is not null and cast(doc_id as string) <> ''")
        if order_by:
            docs = docs.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("_order"))).where("_n = 1").drop("_n", "_order")
        else:
            docs = docs.dropDuplicates(["doc_id"])
        side = {"schema_version": 1, "tokenizer": FORMAT[fold] if tokenizer is None else "custom", "builder": "quern", "positions": positions, "doc_id_type": doc_id_type, "fields": list(fields), "title": title if title in fields else None, "display": bool(title or opening)} | (meta or {})
        return Index._write(spark, path, docs, side, tokenizer, on_progress)

    @staticmethod
    def _write(spark: SparkSession, path: str, docs: DataFrame, side: dict, tokenizer: Callable | None = None, on_progress: Callable[[str], None] | None = None, kept: dict[str, DataFrame] | None = None, stats: bool = True) -> Index:
        say = on_progress or (lambda stage: None)
        version = f"v{time.strftime('%Y%m%d%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"
        at = f"{path}/{version}"
        folded = side["tokenizer"] == FORMAT[True]
        with Scratch(spark, "index") as scratch:
            say("parse")
            # materialised: a filter on the tokens would otherwise evaluate the whole chain of patterns again
            tokens = scratch.write(token_rows(docs, side["fields"], folded, tokenizer, side.get("title")))
            postings, lens = postings_of(tokens, side["positions"]), tokens.select("field", "doc_id", F.size("tokens").alias("len"))
            shown = docs.select("doc_id", F.col("_title").alias("title"), F.col("_opening").alias("opening"))
            if kept:
                postings, lens, shown = (kept[n].unionByName(x) for n, x in (("postings", postings), ("doclens", lens), ("documents", shown)))
            say("postings")
            columns = [f.split()[0] for f in schema_of("postings", side["doc_id_type"], side["positions"]).split(", ")]
            postings.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id").select(*columns).write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy("field").parquet(f"{at}/postings")
            lens.repartitionByRange("field", "doc_id").sortWithinPartitions("field", "doc_id").write.parquet(f"{at}/doclens")
            shown.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{at}/documents")
            say("stats")
            if stats or not kept:
                write_stats(spark, at, side)
            else:
                for name in ("termstats", "field_stats", "vocabulary"):
                    kept[name].write.parquet(f"{at}/{name}")
        read, side = side.get("from"), {k: v for k, v in side.items() if k != "from"} | {"built_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "stats_current": bool(stats or not kept)}
        _write_text(spark, f"{at}/meta.json", json.dumps(side))
        _publish(spark, path, version, read)
        return Index.open(spark, path)

    def upsert(self, df: DataFrame, *, doc_id: str = "doc_id", title: str | None = None, opening: str | None = None, auto_stats: bool = True, tokenizer: Callable | None = None) -> Index:
        """Replace or add documents; the statistics stay as they are without auto_stats. Returns the new version."""
        docs = df.select(F.col(doc_id).try_cast(self.doc_id_type()).alias("doc_id"), *self.fields, (F.col(title) if title else F.lit(None).cast("string")).alias("_title"), (F.col(opening) if opening else F.lit(None).cast("string")).alias("_opening"))
        docs = docs.where("doc_id is not null and cast(doc_id as string) <> ''").dropDuplicates(["doc_id"])
        return Index._write(self.spark, self.path, docs, self._side(), tokenizer, kept=self._without(docs.select("doc_id")), stats=auto_stats)

    def delete(self, ids: DataFrame, *, auto_stats: bool = False) -> Index:
        """Remove the documents whose id is in the first column."""
        gone = ids.select(F.col(ids.columns[0]).try_cast(self.doc_id_type()).alias("doc_id")).distinct()
        none = self.spark.createDataFrame([], f"doc_id {self.doc_id_type()}, {', '.join(f'{f} string' for f in self.fields)}, _title string, _opening string")
        return Index._write(self.spark, self.path, none, self._side(), kept=self._without(gone), stats=auto_stats)

    def rebuild_stats(self) -> Index:
        none = self.spark.createDataFrame([], f"doc_id {self.doc_id_type()}")
        return self.delete(none, auto_stats=True)

    def _side(self) -> dict:
        return {k: v for k, v in self.meta.items() if k not in ("version", "built_at", "stats_current")} | {"from": self.meta["version"]}

    def _without(self, ids: DataFrame) -> dict[str, DataFrame]:
        old = {n: self.table(n) for n in TABLES}
        return old | {n: old[n].join(ids, "doc_id", "left_anti") for n in ("postings", "doclens", "documents")}

    def drop_old_versions(self) -> None:
        p, fs = _path(self.spark, self.path)
        for s in fs.listStatus(p):
            if s.isDirectory() and s.getPath().getName() not in (self.meta["version"], "pointers"):
                remove(self.spark, s.getPath().toString())


def write_stats(spark: SparkSession, at: str, side: dict) -> None:
    """Field statistics, document frequencies with idf, and the vocabulary, from a version's postings and lengths."""
    fields = side["fields"]
    read = lambda name: spark.read.schema(schema_of(name, side["doc_id_type"], side["positions"])).parquet(f"{at}/{name}")
    lens = read("doclens")
    all_fields = spark.createDataFrame([(f,) for f in fields], "field string")
    got = lens.where("len > 0").groupBy("field").agg(F.count("*").alias("total_docs"), F.sum("len").alias("total_length"))
    all_fields.join(got, "field", "left").fillna(0).write.parquet(f"{at}/field_stats")
    totals = {r["field"]: r["total_docs"] for r in read("field_stats").collect()}
    term_docs = read("postings").groupBy("field", "term").agg(F.count("*").alias("doc_freq"))
    with_idf(term_docs, totals).repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(f"{at}/termstats")
    order = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), F.lit(i))])[F.col("field")]
    words = read("termstats").groupBy("term").agg(F.min(order).alias("first_field"))
    words.select("term", F.length("term").alias("len"), F.substring("term", 1, 1).alias("fc"), "first_field").write.parquet(f"{at}/vocabulary")
