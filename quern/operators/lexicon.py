"""Synonym groups and derivations from lexicon tables: synsets, word_synsets and derivations."""

from __future__ import annotations

import regex
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.sources.tables import table

# Senses of nouns come first, then verbs, adjectives, satellites, adverbs.
POS_OFFSET = {"n": 0, "v": 1000, "a": 2000, "s": 2500, "r": 3000}
_PLAIN = regex.compile(r"\p{L}+")


def symmetric_links(links: DataFrame, a: str, b: str) -> DataFrame:
    """word_a, word_b: plain words linked either way, both ways, once."""
    one = links.select(text.term(a).alias("word_a"), text.term(b).alias("word_b")).where("word_a <> '' and word_b <> '' and word_a <> word_b")
    return one.unionByName(one.select(F.col("word_b").alias("word_a"), F.col("word_a").alias("word_b"))).distinct()


def build_lexicon(senses: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """Tables of a lexicon. senses: synset_id, pos, word, sense_no, definition; links: word_a, word_b.

    Words of several parts, with hyphens or digits are left out.
    """
    rank = F.create_map(*[x for k, v in POS_OFFSET.items() for x in (F.lit(k), F.lit(v))])[F.col("pos")]
    plain = senses.withColumn("word", F.lower("word")).where(F.col("word").rlike(r"^\p{L}+$"))
    synsets = plain.groupBy(F.col("synset_id").alias("id"), "pos").agg(F.array_sort(F.collect_set("word")).alias("members"), F.first("definition", True).alias("definition"))
    words = plain.groupBy("word", "synset_id").agg(F.min(rank + F.col("sense_no")).alias("sense_order"))
    return {"synsets": synsets, "word_synsets": words, "derivations": symmetric_links(links, "word_a", "word_b").where(F.col("word_a").rlike(r"^\p{L}+$") & F.col("word_b").rlike(r"^\p{L}+$"))}


class Lexicon:
    """Look-ups for the words of queries; a lexicon that is absent answers with nothing."""

    def __init__(self, tables: dict[str, DataFrame] | None):
        self.tables = tables

    def ready(self) -> bool:
        return self.tables is not None

    def groups(self, words: Iterable[str], senses: int = 1) -> DataFrame:
        """word, members: the word and its synonyms in its first ``senses`` senses that have any."""
        spark = self.tables["synsets"].sparkSession
        asked = F.broadcast(spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string"))
        several = self.tables["synsets"].where("size(members) > 1").select(F.col("id").alias("synset_id"), "members")
        found = self.tables["word_synsets"].join(asked, "word").join(several, "synset_id")
        first = found.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy("sense_order", "synset_id"))).where(F.col("r") <= senses)
        return first.groupBy("word").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r", "members"))), lambda x: x["members"]))).alias("members"))

    def groups_for(self, words: Iterable[str], senses: int = 1) -> list[list[str]]:
        if not self.ready():
            return []
        got = {r["word"]: [m for m in r["members"] if m != r["word"]] for r in self.groups(words, senses).collect()}
        return [[w, *got[w]] for w in dict.fromkeys(words) if got.get(w)]

    def derivations_for(self, words: Iterable[str]) -> list[list[str]]:
        if not self.ready():
            return []
        spark = self.tables["derivations"].sparkSession
        asked = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word_a string")
        got = self.tables["derivations"].join(F.broadcast(asked), "word_a").groupBy("word_a").agg(F.array_sort(F.collect_set("word_b")).alias("d")).collect()
        found = {r["word_a"]: r["d"] for r in got}
        return [[w, *found[w]] for w in dict.fromkeys(words) if w in found]

    def verifier(self, words: Iterable[str]) -> Callable[[str, str], bool] | None:
        """Whether two words are linked, for the given words; nothing without a lexicon."""
        if not self.ready():
            return None
        links = {(w, d) for w, *ds in self.derivations_for(words) for d in ds}
        return lambda word, root: (word, root) in links

    @staticmethod
    def query_words(query: str, skip: Sequence[str] = ()) -> list[str]:
        """Words of a query that a lexicon may know: letters only, three or more, without operators."""
        return [w for w in dict.fromkeys(text.tokens_py(query)) if len(w) >= 3 and _PLAIN.fullmatch(w) and w not in skip]


def _derivations(spark: SparkSession, folder: str) -> DataFrame:
    return symmetric_links(table(spark, folder, "derivations"), "word_a", "word_b")


def _fan(spark: SparkSession, folder: str) -> DataFrame:
    """Words by number of derivations."""
    return _derivations(spark, folder).groupBy("word_a").agg(F.count("*").alias("links"), F.min("word_b").alias("first"))


QUERIES = {"derivation_links": _derivations, "derivation_fan": _fan}
_LINKS = f"one as (select {text.sql_term('word_a')} as a, {text.sql_term('word_b')} as b from derivations), links as (select a as word_a, b as word_b from one where a <> '' and b <> '' and a <> b union select b, a from one where a <> '' and b <> '' and a <> b)"
SQL = {"derivation_links": f"with {_LINKS} select word_a, word_b from links", "derivation_fan": f"with {_LINKS} select word_a, count(*) as links, min(word_b) as first from links group by word_a"}
