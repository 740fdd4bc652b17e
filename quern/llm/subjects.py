"""Problem 10: the subject areas of each document.

Normalised document vectors are clustered by bisecting k-means over all distinct texts. Each leaf of the tree is
labelled: its discriminative terms are held against those of hand-labelled documents, and the labelled documents in it
count. Labels do no more than that: a term's subjects are the mixture of the leaves that have it, a sentence's subject
is that of its terms' leaf mixtures, and a document has the subjects of a sufficient part of its sentences.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.scratch import Scratch

BITS = 20
DEPTH = 8
DIMENSIONS = 1024
POWER_PASSES, MEAN_PASSES = 2, 4
FEW_ENTRIES = 1_000_000
LANGUAGES = 64
RAREST = 0.1
LABEL_ROWS = 200_000
MOST_SUBJECTS = 64
LEAF_TERMS = 25
LEAST_EVIDENCE = 1.2
CLEAR = 0.25

TAG = re.compile(r"<[/!?]?[A-Za-z-][^<>]*>")
BREAK = re.compile(r"\n+|(?<=[.!?])\s+")
FURNITURE = re.compile(r"[|»{}]|\[\[|\]\]")
DIGIT = re.compile(r"\d")


def sentences(whole: str | None) -> list[list[str]]:
    """Folded words of each sentence. Markup is left out, and lines that are lists of links; so are words with digits."""
    raw = whole or ""
    if "&" in raw:
        raw = html.unescape(raw)
    if "<" in raw:
        raw = TAG.sub("\n", raw)
    kept = [s for s in BREAK.split(raw.replace("\xa0", " ")) if s and not FURNITURE.search(s)]
    out = []
    # folded in one piece; no sentence has a line break in it
    for line in text.separated_py("\n".join(kept)).split("\n"):
        words = line.split()
        if words and DIGIT.search(line):
            words = [w for w in words if not DIGIT.search(w)]
        if words:
            out.append(words)
    return out


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)


def _encode(bits: int):
    """Terms are numbered by their hash: key of the whole wording, distinct terms of each sentence of three words or more, and the document's terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                flat, sizes, per_doc, keys = [], [], [], []
                for d in part.column("text").to_pylist():
                    found = sentences(d)
                    per_doc.append(len(found))
                    sizes += map(len, found)
                    for s in found:
                        flat += s
                    keys.append(hashlib.blake2b("\n".join(map(" ".join, found)).encode("utf-8", "replace"), digest_size=16).digest())
                term = np.zeros(0, np.int64)
                if flat:
                    codes, words = pd.factorize(np.array(flat, object))
                    term = (pd.util.hash_array(words, categorize=False) >> np.uint64(64 - bits)).astype(np.int64)[codes]
                sizes, per_doc = np.array(sizes, np.int64), np.array(per_doc, np.int64)
                doc_of_sentence = np.repeat(np.arange(len(per_doc)), per_doc)
                long_ = sizes >= 3
                place = np.cumsum(long_) - 1
                kept = np.repeat(long_, sizes)
                said = np.unique((np.repeat(place, sizes)[kept] << bits) | term[kept])
                inner = _lists(np.bincount(said >> bits, minlength=int(long_.sum())), pa.array((said & (1 << bits) - 1).astype(np.int32)))
                outer = _lists(np.bincount(doc_of_sentence[long_], minlength=len(per_doc)), inner)
                pairs, counts = np.unique((np.repeat(doc_of_sentence, sizes) << bits) | term, return_counts=True)
                n = np.bincount(pairs >> bits, minlength=len(per_doc))
                terms, counts = _lists(n, pa.array((pairs & (1 << bits) - 1).astype(np.int32))), _lists(n, pa.array(counts.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), pa.array(keys, pa.binary()), outer, terms, counts], names=["id", "lang", "key", "said", "terms", "counts"])

    return run


@dataclass
class Vocabulary:
    """Statistics of the terms (hash numbers) over distinct texts."""

    docs: np.ndarray  # texts with the term
    langs: list[str]
    shares: np.ndarray  # language x term: the part of the language's texts that have it; one row for all texts if no language is large
    weight: np.ndarray  # near 0 for words that every text of a language may have
    home: np.ndarray  # the row of shares in which a term is commonest


def read_vocabulary(texts: DataFrame, bits: int = BITS) -> Vocabulary:
    """texts: lang, terms of each distinct text. A term's weight is the logarithm of its rarity in the language in which it is commonest, RAREST at most: rarer words are names.

    Languages are the LANGUAGES largest groups of lang with at least 50 texts. To the driver: a number for each term's hash and language.
    """
    sizes = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().where("count >= 50").orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    langs = sorted(sizes)
    number = {g: i for i, g in enumerate(langs)}
    lang = F.create_map(*[x for g, i in number.items() for x in (F.lit(g), F.lit(i))])[F.col("lang")] if langs else F.lit(None).cast("int")
    rows = texts.select(F.coalesce(lang, F.lit(-1)).alias("g"), F.explode("terms").alias("t")).groupBy("t", "g").agg(F.count("*").alias("n")).toArrow()
    t, g, n = rows["t"].to_numpy(), rows["g"].to_numpy(), rows["n"].to_numpy().astype(np.float32)
    docs = np.bincount(t, n, 1 << bits).astype(np.float32)
    found = np.zeros((max(1, len(langs)), 1 << bits), np.float32)
    if langs:
        found[g[g >= 0], t[g >= 0]] = n[g >= 0]
        size = np.array([sizes[x] for x in langs], np.float32)[:, None]
    else:
        found[0] = docs
        size = np.float32(texts.count())
    shares = (found + 1) / (size + 1)
    # a few texts of a small group, perhaps wrongly marked, don't make a word common
    common = np.where(found >= 5, shares, shares.min(0))
    weight = np.log(1 / np.clip(common.max(0), RAREST, 1.0))
    return Vocabulary(docs, langs, shares, weight, common.argmax(0))


def _vectors(b: pa.RecordBatch, places: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of a batch's documents as (row, place, value): weighted terms at hashed places, with hashed signs."""
    terms = b.column("terms")
    offsets = terms.offsets.to_numpy()
    t = terms.values.to_numpy()[offsets[0] : offsets[-1]]
    c = b.column("counts").values.to_numpy()[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
    value = np.log1p(c) * factors[t]
    says = value != 0
    row, place, value = row[says], places[t[says]], value[says]
    norm = np.sqrt(np.bincount(row, value * value, b.num_rows))
    return row, place, value / norm[row]


class Tree:
    """Bisecting k-means: node k has the children 2k and 2k + 1; for each node that was split, the vector on whose side a document is right."""

    def __init__(self):
        self.split: dict[int, np.ndarray] = {}

    def nodes(self, n: int, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The leaf of each of n vectors."""
        at = np.ones(n, np.int64)
        open_ = np.ones(n, bool)
        while True:
            known = {k: i for i, k in enumerate(k for k in np.unique(at[open_]).tolist() if k in self.split)}
            if not known:
                return at
            which = np.full(at.max() + 1, -1)
            which[list(known)] = list(known.values())
            side = _dots(n, row, place, value, np.stack([self.split[k] for k in known]), which[at])
            open_ = which[at] >= 0
            at = np.where(open_, 2 * at + (side > 0), at)


def _dots(n: int, row: np.ndarray, place: np.ndarray, value: np.ndarray, vectors: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Product of each row with the vector that it is for; rows for none (-1) get 0."""
    of = which[row]
    own = of >= 0
    return np.bincount(row[own], value[own] * vectors[of[own], place[own]], n)


@dataclass
class Sums:
    """Of some rows on one side of a direction: how many, their entries, the sum of their places along it, of the vectors, and of the vectors times their places."""

    n: int = 0
    entries: int = 0
    along: float = 0.0
    total: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS))

    def add(self, n: int, entries: int, along: float, total: np.ndarray, spread: np.ndarray) -> None:
        self.n, self.entries, self.along = self.n + n, self.entries + entries, self.along + along
        self.total, self.spread = self.total + total, self.spread + spread


def _side_sums(found: dict[tuple[int, int], Sums], n: int, x: tuple, node: np.ndarray, directions: dict[int, np.ndarray], power: bool) -> None:
    """Adds to found, for each node with a direction and each side of it, the sums of n vectors that are in the nodes given; the spread only with power."""
    row, place, value = x
    keys = sorted(directions)
    which = np.full(max(keys[-1], int(node.max(initial=0))) + 1, -1)
    which[keys] = np.arange(len(keys))
    of = which[node]
    along = _dots(n, *x, np.stack([directions[k] for k in keys]), of)
    cell = np.where(of >= 0, 2 * of + (along > 0), -1)
    number = np.bincount(cell[cell >= 0], minlength=2 * len(keys))
    scale = np.bincount(cell[cell >= 0], along[cell >= 0], 2 * len(keys))
    here = cell[row]
    own = here >= 0
    entries = np.bincount(here[own], minlength=2 * len(keys))
    at = here[own] * DIMENSIONS + place[own]
    total = np.bincount(at, value[own], 2 * len(keys) * DIMENSIONS).reshape(-1, DIMENSIONS)
    spread = np.bincount(at, value[own] * along[row[own]], 2 * len(keys) * DIMENSIONS).reshape(-1, DIMENSIONS) if power else total
    for c in np.flatnonzero(number).tolist():
        found.setdefault((keys[c // 2], c % 2), Sums()).add(int(number[c]), int(entries[c]), float(scale[c]), total[c], spread[c])


def split_nodes(sums: Callable, nodes: list[int], least: int) -> dict[int, tuple[np.ndarray, int, int]]:
    """For each of the nodes that can be split the vector on whose side a row is right, and the entries of either side; nodes of fewer than twice ``least`` rows can't.

    sums: function from directions of nodes, and whether spreads are wanted, to the Sums of either side. A split begins along the direction of the greatest spread
    (power iteration) and goes on with passes of spherical 2-means.
    """
    unit = lambda v: v / (np.linalg.norm(v) + 1e-12)
    directions = {k: unit(np.random.default_rng(k).standard_normal(DIMENSIONS)) for k in nodes}
    centres: dict[int, np.ndarray] = {}
    for _ in range(POWER_PASSES):
        if not directions:
            return {}
        found = sums(directions, True)
        whole = {k: [found[k, s] for s in (0, 1) if (k, s) in found] for k in directions}
        directions = {k: d for k, d in directions.items() if sum(p.n for p in whole[k]) >= 2 * least}
        for k in directions:
            centres[k] = sum(p.total for p in whole[k]) / sum(p.n for p in whole[k])
            # (x - c) summed with its place along d as weight: the centre's own place cancels
            directions[k] = unit(sum(p.spread for p in whole[k]) - sum(p.along for p in whole[k]) * centres[k])
    splits = {k: unit(centres[k] + 0.1 * d) - unit(centres[k] - 0.1 * d) for k, d in directions.items()}
    if not splits:
        return {}
    for _ in range(MEAN_PASSES):
        found = sums(splits, False)
        splits = {k: unit(found[k, 1].total) - unit(found[k, 0].total) if (k, 0) in found and (k, 1) in found else s for k, s in splits.items()}
    found = sums(splits, False)
    return {k: (v, found[k, 0].entries, found[k, 1].entries) for k, v in splits.items() if all((k, s) in found and found[k, s].n >= min(least, 5) for s in (0, 1))}


_SUMS = "node long, side int, n long, entries long, along double, total binary, spread binary"
_SUMS_ARROW = pa.schema([("node", pa.int64()), ("side", pa.int32()), ("n", pa.int64()), ("entries", pa.int64()), ("along", pa.float64()), ("total", pa.binary()), ("spread", pa.binary())])


def _sums_out(found: dict[tuple[int, int], Sums]) -> Iterator[pa.RecordBatch]:
    rows = [{"node": k, "side": s, "n": x.n, "entries": x.entries, "along": x.along, "total": x.total.tobytes(), "spread": x.spread.tobytes()} for (k, s), x in found.items()]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_SUMS_ARROW)


def _task_sums(tree_of, hashed_of, directions_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], Sums] = {}
        for b in batches:
            for i in range(0, b.num_rows, 5000):
                part = b.slice(i, 5000)
                x = _vectors(part, *hashed_of.value)
                _side_sums(found, part.num_rows, x, tree_of.value.nodes(part.num_rows, *x), *directions_of.value)
        yield from _sums_out(found)

    return run


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of tasks become one for each node and side."""
    found: dict[tuple[int, int], Sums] = {}
    for b in batches:
        for r in b.to_pylist():
            found.setdefault((r["node"], r["side"]), Sums()).add(r["n"], r["entries"], r["along"], np.frombuffer(r["total"]), np.frombuffer(r["spread"]))
    yield from _sums_out(found)


def _grow_small(hashed_of, least: int, depth: int):
    """Subtrees of the nodes whose rows, sorted by node, a task gets; it holds the vectors of one node at a time, whose number is bounded."""

    def subtree(top: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, n = [], 0
        for p in parts:
            row, place, value = _vectors(p, *hashed_of.value)
            xs.append((row.astype(np.int32) + np.int32(n), place.astype(np.int32), value.astype(np.float32)))
            n += p.num_rows
        todo, split = [(top, n, *(np.concatenate(a) for a in zip(*xs)))], {}
        while todo:
            node, n, row, place, value = todo.pop()
            if node >= 1 << depth:
                continue
            whole = np.bincount(place, value, DIMENSIONS)

            def sums(directions: dict[int, np.ndarray], power: bool) -> dict[tuple[int, int], Sums]:
                along = np.bincount(row, value * directions[node].astype(np.float32)[place], n)
                side = along > 0
                there = side[row]
                right = np.bincount(place, value * there, DIMENSIONS)
                spread = np.bincount(place, value * along.astype(np.float32)[row], DIMENSIONS) if power else whole
                n1, e1 = int(side.sum()), int(there.sum())
                # the spread is that of both sides, given with the one that has rows
                sides = [(n - n1, len(row) - e1, float(along[~side].sum()), whole - right), (n1, e1, float(along[side].sum()), right)]
                first = 0 if n > n1 else 1
                return {(node, s): Sums(*x, spread if s == first else np.zeros(DIMENSIONS)) for s, x in enumerate(sides) if x[0]}

            for v, *_ in split_nodes(sums, [node], least).values():
                split[node] = v
                side = np.bincount(row, value * v.astype(np.float32)[place], n) > 0
                for s in (0, 1):
                    mine = side == s
                    own = mine[row]
                    todo.append((2 * node + s, int(mine.sum()), (np.cumsum(mine, dtype=np.int32) - np.int32(1))[row[own]], place[own], value[own]))
        if split:
            yield pa.RecordBatch.from_arrays([pa.array(list(split), pa.int64()), pa.array([v.tobytes() for v in split.values()], pa.binary())], names=["node", "split"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, parts = None, []
        for b in batches:
            nodes = b.column("node").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)] if len(nodes) else []
            for a, z in zip(cuts, cuts[1:]):
                if parts and nodes[a] != node:
                    yield from subtree(node, parts)
                    parts = []
                node = int(nodes[a])
                parts.append(b.slice(a, z - a))
        if parts:
            yield from subtree(node, parts)

    return run


def bisect(texts: DataFrame, hashed: tuple, least: int, few: int = FEW_ENTRIES, depth: int = DEPTH) -> Tree:
    """The tree over all texts (key, terms, counts).

    A node of more than ``few`` entries of vectors is split by passes over the texts whose sums are added up on executors, so that the driver gets two rows
    for each open node, 2^depth at most; smaller nodes' texts are brought together, and a task grows the subtree. Both ways are the same algorithm.
    """
    spark = texts.sparkSession
    sc = spark.sparkContext
    tree, hashed_of = Tree(), sc.broadcast(hashed)
    vectors = texts.select("terms", "counts")

    def sums(directions: dict[int, np.ndarray], power: bool) -> dict[tuple[int, int], Sums]:
        sent = [sc.broadcast(tree), sc.broadcast((directions, power))]
        rows = vectors.mapInArrow(_task_sums(sent[0], hashed_of, sent[1]), _SUMS).repartition("node", "side").mapInArrow(_add_sums, _SUMS).collect()
        for x in sent:
            x.unpersist()
        return {(r["node"], r["side"]): Sums(r["n"], r["entries"], r["along"], np.frombuffer(r["total"]), np.frombuffer(r["spread"])) for r in rows}

    entries = vectors.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    small, open_ = [], {1: entries}
    while open_:
        small += [k for k, n in open_.items() if n <= few]
        got = split_nodes(sums, [k for k, n in open_.items() if n > few and k < 1 << depth], least)
        tree.split |= {k: v for k, (v, _, _) in got.items()}
        open_ = {2 * k + s: n for k, (_, *sides) in got.items() for s, n in enumerate(sides)}
    if small:
        tree_of = sc.broadcast(tree)
        placed = texts.mapInArrow(_leaves(tree_of, hashed_of, ("key", "terms", "counts")), "leaf long, key binary, terms array<int>, counts array<int>").withColumnRenamed("leaf", "node")
        here = placed.where(F.col("node").isin(small)).repartition("node").sortWithinPartitions("node", "key")
        for r in here.mapInArrow(_grow_small(hashed_of, least, depth), "node long, split binary").collect():  # 2^depth rows at most
            tree.split[r["node"]] = np.frombuffer(r["split"])
        tree_of.unpersist()
    hashed_of.unpersist()
    return tree


def _leaves(tree_of, hashed_of, kept: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                leaf = tree_of.value.nodes(part.num_rows, *_vectors(part, *hashed_of.value))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *(part.column(c) for c in kept)], names=["leaf", *kept])

    return run


@dataclass
class SubjectModel:
    subjects: list[str]
    slot: np.ndarray  # of each term's hash: its place in evidence, 0 for terms that speak for nothing
    evidence: np.ndarray  # place x subject: logarithm of how much likelier the subject is, given the term


def _gains(sent):
    """How much each term of a leaf sets it apart from the same languages elsewhere: words that any text of them may have are no commoner in the leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, present, shares, docs, in_lang = sent.value
        for b in batches:
            at = np.searchsorted(leaves, b.column("leaf").to_numpy())
            term = np.searchsorted(present, b.column("t").to_numpy())
            mix = (in_lang + 1e-6) / (in_lang + 1e-6).sum(1, keepdims=True)
            usual = (mix[at] * shares[:, term].T).sum(1)
            inside = (b.column("n").to_numpy() + 0.1) / (docs[at] + 1)
            gain = inside * np.log(inside / usual)
            yield pa.RecordBatch.from_arrays([b.column("leaf"), b.column("t"), pa.array(gain)], names=["leaf", "t", "gain"]).filter(pa.array(gain > 0))

    return run


def fit(texts: DataFrame, vocabulary: Vocabulary, labels: DataFrame, subjects: list[str], n_texts: int, depth: int = DEPTH, few: int = FEW_ENTRIES) -> SubjectModel:
    """Tree, leaf labels and the terms' subjects. texts: key, lang, terms, counts of distinct texts, so copies don't make a term speak for the subject of one; labels: key, subject.

    A term's subjects are those of the leaves that have it, and nothing else: with a tree of one leaf no term says anything.
    """
    spark = texts.sparkSession
    sc = spark.sparkContext
    size, k = len(vocabulary.docs), len(subjects)
    rng = np.random.default_rng(7)
    hashed = (rng.integers(0, DIMENSIONS, size).astype(np.int32), (rng.choice([-1.0, 1.0], size) * vocabulary.weight**2).astype(np.float32))
    tree = bisect(texts, hashed, max(10, n_texts // 1000), few, depth)
    sent = [sc.broadcast(tree), sc.broadcast(hashed)]
    number = {s: i for i, s in enumerate(subjects)}
    with Scratch(spark, "subject-leaves") as scratch:
        leaf = scratch.write(texts.select("key", "lang", "terms", "counts").mapInArrow(_leaves(*sent, ("key", "lang", "terms")), "leaf long, key binary, lang string, terms array<int>"))
        sizes = leaf.groupBy("leaf", F.when(F.col("lang").isin(vocabulary.langs), F.col("lang")).alias("lang")).count().collect()  # at most 2^depth x (LANGUAGES + 1)
        known = labels.select("key", "subject").distinct()  # of a bounded number of label rows
        share = known.join(known.groupBy("key").agg(F.count("*").alias("of")), "key").select("key", "subject", (1.0 / F.col("of")).alias("share"))
        labelled = scratch.write(leaf.join(F.broadcast(share), "key"))
        by_subject = labelled.select("subject", "share", F.explode("terms").alias("t")).groupBy("subject", "t").agg(F.sum("share").alias("n")).toArrow()
        subject_of_leaf = labelled.groupBy("leaf", "subject").agg(F.sum("share").alias("n")).collect()
        counts = scratch.write(leaf.select("leaf", F.explode("terms").alias("t")).groupBy("leaf", "t").agg(F.count("*").alias("n")))
        leaves = np.array(sorted({r["leaf"] for r in sizes}), np.int64)
        row = {v: i for i, v in enumerate(leaves.tolist())}
        tongue = {g: i for i, g in enumerate(vocabulary.langs)}
        docs, in_lang = np.zeros(len(leaves)), np.zeros((len(leaves), len(vocabulary.shares)))
        for r in sizes:
            docs[row[r["leaf"]]] += r["count"]
            if not tongue or r["lang"] in tongue:
                in_lang[row[r["leaf"]], tongue.get(r["lang"], 0)] += r["count"]
        present = np.flatnonzero(vocabulary.docs)
        sent.append(sc.broadcast((leaves, present, vocabulary.shares[:, present], docs, in_lang)))
        gains = counts.mapInArrow(_gains(sent[-1]), "leaf long, t int, gain double")
        ranked = gains.withColumn("r", F.row_number().over(_by_gain())).where(F.col("r") <= LEAF_TERMS)
        top = ranked.select("leaf", "t", "gain").collect()  # at most 2^depth x LEAF_TERMS
        mixture = _name_leaves(row, top, by_subject, subject_of_leaf, number, size)
        # a term's subjects: the mixture of its leaves
        parts = spark.createDataFrame([(int(v), [float(x) for x in mixture[i]]) for v, i in row.items()], "leaf long, mix array<double>")
        said = counts.join(F.broadcast(parts), "leaf").groupBy("t").agg(*(F.sum(F.col("n") * F.get("mix", F.lit(s))).alias(f"s{s}") for s in range(k))).toArrow()  # at most 2^bits rows
    for x in sent:
        x.unpersist()
    prior = mixture.T @ docs / docs.sum()
    term = said["t"].to_numpy()
    from_leaves = np.stack([said[f"s{s}"].to_numpy() for s in range(k)])
    given = (from_leaves + prior[:, None]) / (from_leaves.sum(0) + 1)
    evidence = np.log((given + 0.01) / (prior[:, None] + 0.01)) * (vocabulary.docs[term] / (vocabulary.docs[term] + 5))
    # a term speaks for a subject only if it closes a quarter of the gap to certainty from the subject's share, that of the term's language too:
    # words that frame any text lie over the subjects as its texts do, however many these are
    of_lang = mixture.T @ in_lang
    of_lang = (of_lang + prior[:, None]) / (of_lang.sum(0) + 1)
    base = np.maximum(prior[:, None], of_lang[:, vocabulary.home[term]])
    clear = np.flatnonzero((given >= base + CLEAR * (1 - base)).any(axis=0))
    slot = np.zeros(size, np.int32)
    slot[term[clear]] = np.arange(1, len(clear) + 1)
    return SubjectModel(subjects, slot, np.concatenate([np.zeros((1, k)), np.clip(evidence[:, clear].T, -1, 4)]))


def _by_gain():
    return Window.partitionBy("leaf").orderBy(F.desc("gain"), "t")


def _name_leaves(row: dict[int, int], top: list, by_subject: pa.Table, subject_of_leaf: list, number: dict[str, int], size: int) -> np.ndarray:
    """Subjects of each leaf, summing to 1: what its discriminative terms say, as two documents, and the labelled documents in it."""
    k = len(number)
    n_label = np.zeros((k, size), np.float32)
    n_label[[number[v] for v in by_subject["subject"].to_pylist()], by_subject["t"].to_numpy()] = by_subject["n"].to_numpy()
    by_label = np.zeros((len(row), k))
    for r in subject_of_leaf:
        by_label[row[r["leaf"]], number[r["subject"]]] = r["n"]
    labels_of = by_label.sum(0)
    prior = (labels_of + 1) / (labels_of.sum() + k)
    named = np.zeros((len(row), k))
    for r in top:
        mine = n_label[:, r["t"]]
        base = (mine.sum() + 0.5) / (labels_of.sum() + 1)
        named[row[r["leaf"]]] += r["gain"] * np.maximum(np.log((mine + 2 * base) / (labels_of + 2) / base), 0)
    named = named**2
    whole = named.sum(1, keepdims=True)
    named = np.where(whole > 0, named / np.maximum(whole, 1e-300), prior)
    return (by_label + 2 * named) / (by_label.sum(1, keepdims=True) + 2)


def _judge(model_of, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subjects, slot, evidence = model_of.value
        k = len(subjects)
        for b in batches:
            said = b.column("said")
            docs = said.offsets.to_numpy()
            ends = said.values.offsets.to_numpy()[docs[0] : docs[-1] + 1]
            terms = said.values.values.to_numpy()[ends[0] : ends[-1]]
            n = np.diff(docs)
            of_doc = np.repeat(np.arange(b.num_rows), n)
            place = slot[terms]
            says = np.flatnonzero(place)
            sentence = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[says]
            own = evidence[place[says]]
            score = np.stack([np.bincount(sentence, own[:, s], len(ends) - 1) for s in range(k)], axis=1)
            best, most = score.argmax(1), score.max(1)
            about = np.flatnonzero(most > LEAST_EVIDENCE)
            counts = np.bincount(of_doc[about] * k + best[about], minlength=b.num_rows * k).reshape(b.num_rows, k)
            part = counts / np.maximum(n, 1)[:, None]
            # one sentence is enough in a text of up to three, if none is about anything else more
            enough = (counts >= 2) | ((counts == 1) & (n <= 3)[:, None] & (counts == counts.max(1, keepdims=True)))
            rows, which = np.nonzero((part >= share) & enough)
            ids = b.column("id")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array([subjects[s] for s in which], pa.string()), pa.array(part[rows, which]), pa.array(counts[rows, which].astype(np.int32)), pa.array(n[rows].astype(np.int32))], names=["id", "subject", "share", "about", "of"])

    return run


def document_subjects(documents: DataFrame, doc: str, whole_text: str, lang: str, labels: DataFrame, subjects: list[str], share: float = 0.25, depth: int = DEPTH, bits: int = BITS, label_rows: int = LABEL_ROWS, few: int = FEW_ENTRIES) -> DataFrame:
    """doc, subject, share, about, of: the subjects of each document, the sentences about each and all its sentences.

    labels: the columns doc and subject of hand-labelled documents; subjects of other names are left out, and of more than label_rows
    rows those with the smallest hash name the leaves. Sentences of fewer than three words, markup and lists of links aren't counted.
    Texts that are null, blank or on no subject have no row; without labels or documents there are none. Repeated rows of a document are
    judged each. The lang column may be null or wrong here and there: it only groups what words are frequent in.
    depth: levels of the tree, 2^depth leaves at most. bits: of the words' hash; words of one hash are taken for one.
    """
    if len(subjects) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    spark = documents.sparkSession
    kind = dict(documents.dtypes)[doc]
    found_schema = f"id {kind}, subject string, share double, about int, of int"
    given = documents.select(F.col(doc).alias("id"), F.substring(F.lower(F.trim(F.coalesce(F.col(lang), F.lit("")))), 1, 2).alias("lang"), F.col(whole_text).alias("text"))
    known = labels.select(F.col(doc).alias("id"), text.trim(text.fold("subject")).alias("subject")).where(F.col("subject").isin(subjects)).distinct()
    with Scratch(spark, "subjects") as scratch:
        encoded = scratch.write(given.mapInArrow(_encode(bits), f"id {kind}, lang string, key binary, said array<array<int>>, terms array<int>, counts array<int>"))
        texts = scratch.write(encoded.where("size(terms) > 0").groupBy("key").agg(F.mode("lang", True).alias("lang"), F.first("terms").alias("terms"), F.first("counts").alias("counts")))
        some = scratch.write(known.orderBy(F.xxhash64("id"), "id", "subject").limit(label_rows))
        n_texts = texts.count()
        if n_texts and not some.isEmpty():
            vocabulary = read_vocabulary(texts, bits)
            labelled = encoded.select("id", "key").join(F.broadcast(some), "id").select("key", "subject")
            model = fit(texts, vocabulary, labelled, subjects, n_texts, depth, few)
            model_of = spark.sparkContext.broadcast((model.subjects, model.slot, model.evidence))
            found = encoded.select("id", "said").mapInArrow(_judge(model_of, share), found_schema)
        else:
            found = spark.createDataFrame([], found_schema)
        found = scratch.write(found, keep=True)
    return found.withColumnRenamed("id", doc)
