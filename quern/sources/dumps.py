"""Article dumps as newline-delimited JSON and lexicons as zip files of JSON."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "title string, namespace int, text string, opening_text string, page_id long"


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, opening, text of a dump (.json, .gz or .bz2) in which lines of metadata and of documents alternate.

    Only articles count: with a title, in namespace 0, with text and a page number above 0. A missing opening is the first 200
    characters of the text; lines that aren't JSON are left out.
    """
    rows = spark.read.text(path).select(F.from_json("value", ARTICLE).alias("a")).select("a.*")
    kept = rows.where("trim(title) <> '' and coalesce(namespace, 0) = 0 and trim(text) <> '' and page_id > 0")
    opening = F.coalesce(F.nullif(F.trim("opening_text"), F.lit("")), F.substring("text", 1, 200))
    return kept.select(F.col("page_id").alias("doc_id"), "title", opening.alias("opening"), "text")


def read_lexicon_zip(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """senses and links, as build_lexicon takes them, of a zip with synset files (noun.*, verb.*, adj.*, adv.*) and entries-*.json.

    A lexicon is dictionary-sized and read on the driver.
    """
    members: dict[str, dict] = {}
    senses, links, word_of_sense = [], [], {}
    with zipfile.ZipFile(path) as z:
        for name in sorted(z.namelist()):
            base = name.rsplit("/", 1)[-1]
            if base.endswith(".json") and base.split(".")[0] in ("noun", "verb", "adj", "adv"):
                members |= json.loads(z.read(name))
        related = []
        for name in sorted(z.namelist()):
            if name.rsplit("/", 1)[-1].startswith("entries-"):
                for word, parts in json.loads(z.read(name)).items():
                    for pos, entry in parts.items():
                        for i, sense in enumerate(entry.get("sense", [])):
                            word_of_sense[sense.get("id")] = word
                            synset = sense.get("synset")
                            definition = (members.get(synset, {}).get("definition") or [None])[0]
                            senses.append((synset, pos[:1], word, i, definition))
                            related += [(word, other) for kind in ("derivation", "pertainym") for other in sense.get(kind, [])]
        links = [(word, word_of_sense[other]) for word, other in related if other in word_of_sense]
    return spark.createDataFrame(senses, "synset_id string, pos string, word string, sense_no int, definition string"), spark.createDataFrame(links, "word_a string, word_b string")


def read_word_list(path: str) -> list[str]:
    """A JSON array of words, such as stopwords."""
    with open(path, encoding="utf-8") as f:
        return [str(w) for w in json.load(f)]
