"""Ranked search: queries are planned on the driver, and one DataFrame plan retrieves, scores and presents all of a batch.

Rows of the plan carry query_id, so a thousand queries cost one scan of the postings. A query's terms are a small table
that is joined by broadcast, up to a checked number of rows.
"""

from __future__ import annotations

import functools
import html
import operator
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, fields, replace

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.words import decode_positions, encode_positions, risky_roots, root_words
from quern.plans.expand import MASK_BITS, Options, Plan, plan_queries
from quern.plans.index import FORMAT, Index
from quern.plans.query import ALGORITHMS, Knobs, Profile, normalizer
from quern.plans.shards import is_plain, top_hits
from quern.plans.small import small_table
from quern.scratch import Scratch

EQUALITIES, RANGES = 200, 64
CONTEXT_DOCS = 2000
PLAIN = ("bm25", "bm25+cov", "dfr", "cover", "idf", "freq")
NEAR = ("bm25", "bm25+cov", "bm25f", "dfr")

TERM_SCHEMA = (
    "query_id long, field string, term string, boost double, idf double, concept string, cap double, wild boolean, top_idf double, cov long, grp long, need long, opt boolean, orig boolean, slot long, field_no int, weight double, "
    # what holds for the whole query or for its field
    "algo string, total_weight double, k1 double, b double, delta double, rrf_k double, prox double, tf_log boolean, n double, avgdl double, total double, plain_total double, field_b double"
)
QUERY_SCHEMA = "query_id long, base double, span double, half double, partial double, concepts int"


@dataclass
class Result:
    """hits: query_id, rank, doc_id, score, title, field_scores, matches, snippet, of the page (bm25f has no field scores: 0). plans: how each query was understood."""

    hits: DataFrame
    scored: DataFrame
    plans: list[Plan]
    page: DataFrame  # what hits presents

    def totals(self) -> DataFrame:
        """query_id, algo, total, page, per_page, pages, capped, truncated of every query."""
        spark = self.hits.sparkSession
        rows = [(p.query_id, p.algo, p.options.page, p.options.per_page, p.profile.candidate_limit, p.truncated) for p in self.plans]
        asked = spark.createDataFrame(rows, "query_id long, algo string, page int, per_page int, cap long, truncated boolean")
        n = self.scored.groupBy("query_id").agg(F.count("*").alias("total"))
        out = asked.join(n, "query_id", "left").fillna(0, ["total"])
        return out.select("query_id", "algo", "total", "page", "per_page", F.greatest(F.lit(1), F.ceil(F.col("total") / F.col("per_page"))).alias("pages"), ((F.col("cap") > 0) & (F.col("total") >= F.col("cap"))).alias("capped"), "truncated")

    def diagnostics(self) -> list[dict]:
        """What was made of each query; the lists are those of the plan."""
        out = []
        for p in self.plans:
            q = p.parsed
            widening = [e for e in p.diag.get("expansions", []) if e["class"] in ("stem", "synonym", "derivation", "morph", "fuzzy") and e["from"] not in q.required]
            out.append({
                "query": {"typed_optional": p.typed, "required": q.required, "excluded": q.excluded, "req_phrases": q.required_phrases, "exc_phrases": q.excluded_phrases, "numeric_exact": [t for t in p.typed if any(c.isdigit() for c in t)]},
                "algo": {"requested": p.options.algo, "resolved": p.algo} | p.diag.get("auto", {}),
                "expansions": p.diag.get("expansions", []), "wildcards": p.diag.get("wildcards", {}), "typo_swaps": p.diag.get("typo_swaps", []),
                "dropped": p.diag.get("dropped", {}), "truncated": p.truncated, "positional_phrases": p.diag.get("positional", False), "widening": len(widening),
            })
        return out


class Searcher:
    """Search over an opened index."""

    ALGOS, TOKENIZER_DEFAULT, TOKENIZER_FOLDED = ALGORITHMS, FORMAT[False], FORMAT[True]
    tokenize = staticmethod(text.tokens_py)
    fold_diacritics = staticmethod(text.fold_py)
    encode_positions, decode_positions = staticmethod(encode_positions), staticmethod(decode_positions)
    root_words, risky_root_candidates = staticmethod(root_words), staticmethod(risky_roots)

    def __init__(self, index: Index, profile: Profile | None = None):
        self.index, self.profile = index, profile or Profile()
        Knobs().with_(self.profile.ranking)

    def settings(self) -> dict:
        return {"path": self.index.path, "folds_diacritics": self.folds_diacritics(), "fields": self.index.get_fields(), "positions": self.index.positions, "profile": self.profile.as_dict(), "ranking": Knobs().with_(self.profile.ranking).__dict__}

    def folds_diacritics(self) -> bool:
        return self.index.folded

    def _split(self, options: dict) -> tuple[Options, Profile]:
        own = {f.name for f in fields(Options)}
        profile = self.profile
        changes = {k: v for k, v in options.items() if k not in own}
        if "ranking" in changes:
            changes["ranking"] = {**profile.ranking, **changes["ranking"]}
        chosen = Options(**{k: v for k, v in options.items() if k in own})
        chosen = replace(chosen, confidence=min(100, max(0, int(chosen.confidence))), page=max(1, int(chosen.page)), per_page=max(1, int(chosen.per_page)))
        return chosen, profile.with_(changes)

    def search(self, query: str, **options) -> Result:
        return self.search_batch([query], **options)

    def search_batch(self, queries: Iterable[str], **options) -> Result:
        """Search for many queries at once; query_id is a query's place in the list."""
        chosen, profile = self._split(options)
        plans = plan_queries(self.index, list(enumerate(queries)), chosen, profile, self._vouch(chosen))
        return run(self.index, plans)

    def best(self, queries: Sequence[str], algos: Sequence[str], depth: int, **options) -> DataFrame:
        """query_id, algo, rank, doc_id, title, score of the first documents of each query by each algorithm.

        As ``search_batch`` with each algorithm, but queries are planned once and plain ones share one pass over the postings for all algorithms.
        """
        chosen, profile = self._split(options | {"page": 1, "per_page": depth})
        plan = lambda ids, algo: plan_queries(self.index, [(i, queries[i]) for i in ids], replace(chosen, algo=algo), profile, self._vouch(chosen))
        plans = [p for p in plan(range(len(queries)), "bm25") if p.weights and not p.parsed.empty]
        plain = [p for p in plans if "auto" not in algos and is_plain(self.index, p, algos)]
        done = {p.query_id for p in plain}
        rest = [p.query_id for p in plans if p.query_id not in done]
        parts = [top_hits(self.index, plain, algos, depth)] if plain else []
        columns = "query_id", "algo", "rank", "doc_id", "score"
        for a in algos if rest else ():
            hits = run(self.index, plan(rest, a)).page
            parts.append(hits.withColumn("algo", F.lit(a)).select(*columns))
        if not parts:
            return run(self.index, []).hits.select("query_id", F.lit("").alias("algo"), "rank", "doc_id", "title", "score")
        hits = functools.reduce(DataFrame.unionByName, parts)
        titles = self.index.table("documents").select("doc_id", "title")
        return hits.join(titles, "doc_id", "left").select("query_id", "algo", "rank", "doc_id", F.coalesce("title", F.col("doc_id").cast("string")).alias("title"), F.round("score", 4).alias("score"))

    def _vouch(self, options: Options):
        def ratios(pairs: Sequence[tuple[Plan, str]]) -> dict[tuple[int, str], float]:
            """Of the documents of a word, the share that has another word of its query in the same field."""
            if not pairs:
                return {}
            spark = self.index.spark
            rows = [(p.query_id, t, f) for p, t in pairs for f in p.weights]
            others = [(p.query_id, t, f, o) for p, t in pairs for f in p.weights for o in {*p.parsed.required, *p.typed} - {t}]
            w = small_table(spark, rows, "query_id long, term string, field string")
            o = small_table(spark, others, "query_id long, word string, field string, term string")
            postings = read_terms(self.index, [*((f, t) for _, t, f in rows), *((f, o) for _, _, f, o in others)]).select("field", "term", "doc_id")
            own = postings.join(w, ["field", "term"]).select("query_id", "field", F.col("term").alias("word"), "doc_id")
            own = own.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "word", "field").orderBy("doc_id"))).where(F.col("r") <= CONTEXT_DOCS).drop("r")
            near = postings.join(o, ["field", "term"]).select("query_id", "field", "word", "doc_id").distinct().withColumn("hit", F.lit(1))
            share = own.join(near, ["query_id", "field", "word", "doc_id"], "left").groupBy("query_id", "word").agg((F.count("hit") / F.count("*")).alias("share"))
            return {(r["query_id"], r["word"]): r["share"] for r in share.collect()}

        return ratios


def _bit(i: int) -> int:
    return 1 << i if i < MASK_BITS else 0


def _term_rows(index: Index, p: Plan) -> list[tuple]:
    """A row for each field and term that a query looks up."""
    terms: dict[str, int] = {}
    for t in dict.fromkeys([*p.parsed.required, *p.original]):
        terms[t] = _bit(len(terms))
    cov = dict(terms)
    n = len(terms)
    for key in [*("ow:" + w for w in p.parsed.optional_prefixes), *("rw:" + w for w in p.parsed.required_prefixes)]:
        for t in p.wild.get(key, ()):
            if key.startswith("rw:") or p.concept_of.get(t) == key:
                cov[t] = _bit(n)
        n += 1
    if len(p.groups) > MASK_BITS:
        raise ValueError(f"more than {MASK_BITS} required words")
    grp: dict[str, int] = {}
    for i, g in enumerate(p.groups.values()):
        for t in g:
            grp[t] = grp.get(t, 0) | 1 << i
    need = (1 << len(p.groups)) - 1
    slot: dict[str, int] = {}
    for i, forms in enumerate(p.slots.values()):
        for t in forms:
            slot[t] = slot.get(t, 0) | _bit(i)
    heavy = [f for f in p.profile.heavy_fields if f in p.weights]
    light = [f for f in p.weights if f not in heavy]
    opt_fields = light if p.options.two_phase and heavy and light else list(p.weights)
    wild = {t for v in p.wild.values() for t in v}
    typed = {*p.parsed.required, *p.original}
    # bm25f takes the rarity in the field in which the term is most frequent
    top = {}
    for t in {t for f in p.weights for t in p.df.get(f, {})}:
        f = max(p.weights, key=lambda f: p.df[f].get(t, 0))
        top[t] = p.idf[f].get(t, 0.0)
    rows = []
    k = p.knobs
    all_terms = [t for f in p.weights for t in (*p.required_terms, *p.by_field.get(f, []))]
    query = (p.algo, sum(p.weights.values()), float(k.k1), float(k.b), float(k.delta), float(k.rrf_k), float(k.proximity_weight) if len(typed) >= 2 and p.algo in NEAR else 0.0, k.freq_tf_log)
    for i, (f, w) in enumerate(p.weights.items()):
        optional = set(p.by_field.get(f, []))
        n, length = index.field_stats.get(f, (0, 0))
        n = max(1, n)
        own = (float(n), max(1.0, length / n), *_totals(p, all_terms if p.algo == "bm25f" else [*p.required_terms, *p.by_field.get(f, [])]), float(p.profile.field_b.get(f, k.b)))
        for t in dict.fromkeys([*p.required_terms, *p.by_field.get(f, [])]):
            concept = p.concept_of.get(t, "t:" + t) if p.expanded and p.knobs.concept_coverage else "t:" + t
            cap = p.concept_weight.get(concept, p.boost(t))
            is_wild = t in wild and p.concept_of.get(t, "").startswith(("ow:", "rw:"))
            idf_concept = p.concept_of.get(t, "") if is_wild else concept
            rows.append((p.query_id, f, t, p.boost(t), p.idf.get(f, {}).get(t, 0.0), idf_concept if is_wild else concept, cap, is_wild, top.get(t, 0.0), cov.get(t, 0), grp.get(t, 0), need, f in opt_fields and t in optional, t in typed, slot.get(t, 0) if f == p.profile.title_field else 0, i, w, *query, *own))
    return rows


def _totals(p: Plan, terms: Iterable[str]) -> tuple[float, float]:
    """Full weight of a list of terms: by concepts, and term by term."""
    seen, by_concept, plain = set(), 0.0, 0.0
    for t in dict.fromkeys(terms):
        plain += p.boost(t)
        key = p.concept_of.get(t, "t:" + t)
        if key not in seen:
            seen.add(key)
            by_concept += p.concept_weight.get(key, p.boost(t))
    return (by_concept if p.expanded and p.knobs.concept_coverage else plain), plain


def run(index: Index, plans: Sequence[Plan]) -> Result:
    """The DataFrame plan of a batch of planned queries."""
    spark = index.spark
    live = [p for p in plans if p.weights and not p.parsed.empty]
    for p in live:
        p.diag["positional"] = bool(index.positions and p.options.phrase_mode != "unordered")
    term_rows = [r for p in live for r in _term_rows(index, p)]
    qt = small_table(spark, term_rows, TERM_SCHEMA)
    q_rows = [(p.query_id, *map(float, (p.knobs.title_bonus_base, p.knobs.title_bonus_span, p.knobs.title_bonus_half, p.knobs.title_bonus_partial)), len(p.slots) if p.profile.title_field in p.weights else 0) for p in live]
    qs = small_table(spark, q_rows, QUERY_SCHEMA)
    postings = read_terms(index, ((r[1], r[2]) for r in term_rows)).select("field", "term", "doc_id", "freq", "len", "title_len")
    matched = postings.join(qt, ["field", "term"])
    kept = exclude(index, live, retrieve(live, matched))
    scored = score(index, live, matched, kept, qs)
    ordered = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("title_len"), "doc_id")))
    options, length = (plans[0].options, plans[0].knobs.snippet_length) if plans else (Options(), 300)
    # plain numbers, so that each task keeps no more of a query than the page needs
    page = ordered.where((F.col("rank") <= options.page * options.per_page) & (F.col("rank") > (options.page - 1) * options.per_page))
    return Result(present(index, page, length), ordered.select("query_id", "doc_id", "score", "rank"), list(plans), page)


def read_terms(index: Index, asked: Iterable[tuple[str, str]]) -> DataFrame:
    """Postings among which are all of the given fields and terms: the scan reads those fields, and of the sorted files the row groups and pages that may have the terms.

    A few terms are compared with each; of more, sorted, the ranges of neighbours are.
    """
    pairs = set(asked)
    fields_, terms = sorted({f for f, _ in pairs}), sorted({t for _, t in pairs}, key=lambda t: t.encode())
    if not terms:
        return index.table("postings").where("false")
    term = F.col("term")
    if len(terms) <= EQUALITIES:
        some = [term == t for t in terms]
    else:
        size = -(-len(terms) // RANGES)
        some = [(term >= terms[i]) & (term <= terms[min(i + size, len(terms)) - 1]) for i in range(0, len(terms), size)]
    # as a balanced tree, so that many terms don't make a deep expression
    while len(some) > 1:
        some = [a | b for a, b in zip(some[::2], some[1::2])] + some[len(some) & ~1 :]
    return index.table("postings").where(F.col("field").isin(fields_) & some[0])


def _limit(p: Plan) -> int:
    return p.profile.phase1_limit if p.options.two_phase and any(f in p.weights for f in p.profile.heavy_fields) else p.profile.candidate_limit


def retrieve(plans: Sequence[Plan], matched: DataFrame) -> DataFrame:
    """query_id, doc_id of the candidates: all required groups present; of too many those with most typed words.

    Groups are bits, so any number of required words is one aggregate without an order of joins.
    """
    rows = matched.where("opt or grp > 0")
    keys = rows.groupBy("query_id", "doc_id").agg(F.bit_or("cov").alias("cov"), F.bit_or("grp").alias("grp"), F.max("need").alias("need"), F.bool_or("opt").alias("seed"), F.min(F.struct("field_no", "term")).alias("first"))
    cand = keys.where(F.col("grp").bitwiseAND(F.col("need")) == F.col("need"))
    broad = [p for p in plans if p.truncated]
    if broad:
        # all required words are broad: documents with an optional word, then a bounded sample of the rarest group's
        spark = matched.sparkSession
        anchors = small_table(spark, [(p.query_id, t, i) for p in broad for i, t in enumerate(p.groups[p.anchor])], "query_id long, term string, place int")
        first = matched.where("grp > 0").join(anchors, ["query_id", "term"]).select("query_id", "doc_id", "field", "place")
        first = first.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "field").orderBy("place", "doc_id"))).where(F.col("r") <= broad[0].profile.broad_cap)  # the same for the whole batch: a constant is applied before the shuffle, too
        sample = first.select("query_id", "doc_id").distinct().withColumn("sampled", F.lit(True))
        seeds = cand.where("seed").groupBy("query_id").agg(F.count("*").alias("seeds"))
        marks = small_table(spark, [(p.query_id, True, _limit(p)) for p in broad], "query_id long, broad boolean, cand_limit long")
        some = cand.join(sample, ["query_id", "doc_id"], "left").join(marks, "query_id", "left").join(seeds, "query_id", "left")
        few = (F.col("cand_limit") <= 0) | (F.coalesce("seeds", F.lit(0)) < F.col("cand_limit"))
        cand = some.where(F.col("broad").isNull() | F.col("seed") | (F.col("sampled") & few)).select("query_id", "doc_id", "cov", "first")
    limit = max((_limit(p) for p in plans), default=0)  # the options are the same for the whole batch
    if limit <= 0:
        return cand.select("query_id", "doc_id")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.bit_count("cov")), "first", "doc_id")
    return cand.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).select("query_id", "doc_id")


def exclude(index: Index, plans: Sequence[Plan], kept: DataFrame) -> DataFrame:
    """Candidates without those that excluded words, prefixes or phrases rule out, and with the required phrases only; after the prune, as exclusions don't count there."""
    spark = index.spark
    words = [(p.query_id, f, t) for p in plans for f in p.weights for t in p.excluded]
    if words:
        w = small_table(spark, words, "query_id long, field string, term string")
        kept = kept.join(read_terms(index, ((f, t) for _, f, t in words)).join(w, ["field", "term"]).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    starts = [(p.query_id, f, s, s[0]) for p in plans for f in p.weights for s in p.parsed.excluded_prefixes]
    if starts:
        w = small_table(spark, starts, "query_id long, field string, prefix string, fc string")
        of = [F.col("term").startswith(s) for s in sorted({s for _, _, s, _ in starts})]
        postings = index.table("postings").where(functools.reduce(operator.or_, of)).select("field", "term", "doc_id")
        hit = postings.withColumn("fc", F.substring("term", 1, 1)).join(w, ["field", "fc"]).where(F.col("term").startswith(F.col("prefix")))
        kept = kept.join(hit.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    phrases = [(p, excluded, i, g) for p in plans for excluded, gs in ((False, p.parsed.required_phrases), (True, p.parsed.excluded_phrases)) for i, g in enumerate(gs) if p.diag["positional"] or excluded]
    if phrases:
        # used three times from here on
        with Scratch(spark, "candidates") as scratch:
            kept = scratch.write(kept, keep=True)
        hits = phrase_hits(index, phrases, kept)
        out = hits.where("excluded").select("query_id", "doc_id")
        kept = kept.join(out, ["query_id", "doc_id"], "left_anti") if any(e for _, e, _, _ in phrases) else kept
        asked = {p.query_id: len(p.parsed.required_phrases) for p, e, _, _ in phrases if not e}
        if asked:
            found = hits.where("not excluded").groupBy("query_id", "doc_id").agg(F.count_distinct("phrase").alias("n"))
            need = small_table(spark, list(asked.items()), "query_id long, need long")
            ok = kept.join(need, "query_id", "left").join(found, ["query_id", "doc_id"], "left")
            kept = ok.where(F.col("need").isNull() | (F.col("n") == F.col("need"))).select("query_id", "doc_id")
    return kept


def phrase_hits(index: Index, phrases: Sequence[tuple], kept: DataFrame) -> DataFrame:
    """query_id, doc_id, phrase, excluded: candidates with a phrase in one field.

    A word at place i of a phrase that stands at position p votes for a start at p - i; a start with a vote of every place
    is the phrase. Without positions, or unordered, all words in one field are enough.
    """
    spark = index.spark
    rows = [(p.query_id, f, t, i, j, excluded, len(g), p.diag["positional"]) for p, excluded, i, g in phrases for f in p.weights for j, t in enumerate(g)]
    w = small_table(spark, rows, "query_id long, field string, term string, phrase int, place int, excluded boolean, n int, ordered boolean")
    pos = F.col("pos") if index.positions else F.array(F.lit(0))
    near = read_terms(index, ((r[1], r[2]) for r in rows)).withColumn("pos", pos).select("field", "term", "doc_id", "pos").join(w, ["field", "term"]).join(kept, ["query_id", "doc_id"], "left_semi")
    starts = near.withColumn("start", F.explode(F.when(F.col("ordered"), F.transform("pos", lambda p: p - F.col("place"))).otherwise(F.array(F.lit(0)))))
    got = starts.groupBy("query_id", "doc_id", "field", "phrase", "excluded", "start", "n").agg(F.count_distinct("place").alias("places"))
    return got.where("places = n").select("query_id", "doc_id", "phrase", "excluded").distinct()


def score(index: Index, plans: Sequence[Plan], matched: DataFrame, kept: DataFrame, qs: DataFrame) -> DataFrame:
    """query_id, doc_id, score (0 to 100), title_len, matches of the kept documents with a score above 0.

    All aggregates are over query and document, with more keys or fewer, so one shuffle serves them.
    """
    algos = {p.algo for p in plans}
    rows = matched.join(kept, ["query_id", "doc_id"], "left_semi").withColumn("dl", F.col("len").cast("double"))
    rows = rows.repartition("query_id", "doc_id")
    docs = _document_scores(rows)
    if "bm25f" in algos:
        own = _bm25f_scores(rows.where("algo = 'bm25f'")).withColumnRenamed("raw", "joined")
        docs = docs.join(own, ["query_id", "doc_id"], "left").withColumn("raw", F.when(F.col("algo") == "bm25f", F.col("joined")).otherwise(F.col("raw"))).drop("joined")
    if "rrf" in algos:
        docs = _fuse(docs)
    title = next((p.profile.title_field for p in plans), None)
    if title != index.meta.get("title"):
        lengths = index.table("doclens").where(F.col("field") == title).select("doc_id", F.col("len").alias("title_len"))
        docs = docs.drop("title_len").join(lengths, "doc_id", "left")
    whole = docs.join(qs, "query_id")
    share = F.least(F.lit(1.0), F.col("concepts") / F.greatest(F.lit(1), F.coalesce("title_len", F.lit(0))))
    bonus = F.when((F.col("concepts") == 0) | (F.col("slots") == 0), 1.0).when(F.col("slots") >= F.col("concepts"), F.col("base") + F.col("span") * share * share).when(F.col("slots") * 2 >= F.col("concepts"), F.col("half")).otherwise(F.col("partial"))
    final = whole.withColumn("score", F.col("raw") * F.col("near") * bonus).where("score > 0").select("query_id", "doc_id", "score", "title_len", "matches", "field_scores")
    if plans and all(_limit(p) > 0 for p in plans):
        # a query has a bounded number of candidates; its ranks need them in one place anyway
        best = F.max("score").over(Window.partitionBy("query_id"))
    else:
        final = final.join(final.groupBy("query_id").agg(F.max("score").alias("best")), "query_id")
        best = F.col("best")
    return final.withColumn("score", F.round(F.col("score") / best * 100.0, 6)).select("query_id", "doc_id", "score", "title_len", "matches", "field_scores")


def term_score(algo: str) -> Column:
    """What a matched term adds to its field's score, by algorithm."""
    tf, dl = F.col("freq").cast("double"), F.col("dl")
    if algo == "bm25":
        norm = tf * (F.col("k1") + 1) / (tf + F.col("k1") * (1 - F.col("b") + F.col("b") * dl / F.col("avgdl")))
        return F.col("idf") * (norm + F.col("delta")) * F.col("boost")
    if algo == "dfr":
        tfn = tf * F.log2(1 + F.col("avgdl") / F.greatest(F.lit(1.0), dl))
        info = F.greatest(F.lit(0.0), -F.log2((tfn + 0.5) / (F.col("n") + 1)))
        return info * (tfn / (tfn + 1)) * F.col("boost")
    if algo == "freq":
        return F.when(F.col("tf_log"), F.log1p(tf)).otherwise(tf) * F.col("boost")
    return F.col("idf") * F.col("boost")


def _document_scores(rows: DataFrame) -> DataFrame:
    """One row for each query and document: raw score (the weighted mean of field scores), cover for fusion, near, slots, matches.

    A concept counts once for coverage. near: how densely pairs of typed words stand in the fields, as a factor from 1 on; slots: typed
    words that the title has in any form.
    """
    a = F.col("algo")
    value = F.when(a.isin("bm25", "bm25+cov", "rrf"), term_score("bm25")).when(a == "dfr", term_score("dfr")).when(a == "freq", term_score("freq")).when((a == "idf") & ~F.col("wild"), term_score("idf")).otherwise(0.0)
    keys = ["query_id", "doc_id", "field"]
    # constant for a query and field, so any row's value will do; max keeps to hash aggregation
    same = ["total_weight", "weight", "total", "plain_total", "rrf_k", "prox", "dl", "title_len"]
    typed = F.when(F.col("orig"), F.col("freq"))
    concept = rows.groupBy(*keys, "algo", "concept").agg(
        F.sum(value).alias("v"), F.max(F.when((a == "idf") & F.col("wild"), term_score("idf"))).alias("rarest"), F.max(F.least("boost", "cap")).alias("held"), F.sum("boost").alias("plain"),
        F.collect_list(typed).alias("f"), F.collect_list("term").alias("terms"), F.bit_or("slot").alias("slot"), *(F.max(c).alias(c) for c in same),
    )
    fields_ = concept.groupBy(*keys, "algo").agg(
        F.sum(F.col("v") + F.coalesce("rarest", F.lit(0.0))).alias("v"), F.sum("held").alias("held"), F.sum("plain").alias("plain"),
        F.flatten(F.collect_list("f")).alias("f"), F.array_sort(F.flatten(F.collect_list("terms"))).alias("terms"), F.bit_or("slot").alias("slot"), *(F.max(c).alias(c) for c in same),
    )
    cov = F.when(F.col("total") > 0, F.col("held") / F.col("total")).otherwise(0.0)
    plain_cov = F.when(F.col("plain_total") > 0, F.col("plain") / F.col("plain_total")).otherwise(0.0)
    s = F.when(a == "cover", 100.0 * cov).when(a == "bm25+cov", F.col("v") * (1 + cov * cov)).otherwise(F.col("v"))
    n = F.size("f")
    dense = (F.col("prox") > 0) & (F.col("dl") >= 2) & (n >= 2)
    pair = lambda x, y: F.col("weight") / (1 + F.col("dl") / (x + y))
    with_later = lambda x, i: F.aggregate(F.slice("f", i + 2, n), F.lit(0.0), lambda t, y: t + pair(x, y))
    pairs = F.when(dense, F.aggregate(F.transform("f", with_later), F.lit(0.0), lambda t, v: t + v)).otherwise(0.0)
    ready = fields_.select("query_id", "doc_id", "field", "algo", "rrf_k", "prox", "total_weight", "title_len", "terms", "slot", (F.col("weight") * s).alias("s"), F.round(F.when(a == "bm25f", 0.0).otherwise(s), 4).alias("own"), (F.col("weight") * 100.0 * plain_cov).alias("c"), pairs.alias("pairs"), F.when(dense, n * (n - 1) / 2).otherwise(0.0).alias("k"))
    docs = ready.groupBy("query_id", "doc_id", "algo").agg(
        F.max("rrf_k").alias("rrf_k"), F.max("title_len").alias("title_len"), (F.sum("s") / F.max("total_weight")).alias("raw"), (F.sum("c") / F.max("total_weight")).alias("cover"), F.max("prox").alias("prox"), F.sum("pairs").alias("pairs"), F.sum("k").alias("k"),
        F.bit_count(F.bit_or("slot")).alias("slots"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "terms")))).alias("matches"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "own")))).alias("field_scores"),
    )
    near = F.when(F.col("k") > 0, 1 + F.col("prox") * F.least(F.lit(1.0), F.col("pairs") / F.col("k"))).otherwise(1.0)
    return docs.select("query_id", "doc_id", "algo", "rrf_k", "title_len", "raw", "cover", near.alias("near"), "slots", "matches", "field_scores")


def _bm25f_scores(rows: DataFrame) -> DataFrame:
    """Frequencies of the fields joined before they saturate."""
    norm = F.col("freq") / (1 + F.col("field_b") * (F.col("dl") / F.col("avgdl") - 1))
    terms = rows.groupBy("query_id", "doc_id", "concept", "term").agg(F.sum(F.col("weight") * norm).alias("tf"), *(F.max(c).alias(c) for c in ("boost", "cap", "top_idf", "total", "k1", "delta")))
    value = F.col("top_idf") * (F.col("tf") * (F.col("k1") + 1) / (F.col("k1") + F.col("tf")) + F.col("delta")) * F.col("boost")
    concepts = terms.groupBy("query_id", "doc_id", "concept").agg(F.sum(value).alias("v"), F.max(F.least("boost", "cap")).alias("held"), F.max("total").alias("total"))
    docs = concepts.groupBy("query_id", "doc_id").agg(F.sum("v").alias("v"), F.sum("held").alias("held"), F.max("total").alias("total"))
    cov = F.when(F.col("total") > 0, F.col("held") / F.col("total")).otherwise(0.0)
    return docs.select("query_id", "doc_id", (F.col("v") * (1 + cov * cov)).alias("raw"))


def _fuse(raw: DataFrame) -> DataFrame:
    """Reciprocal ranks by bm25 and by coverage, for the queries that ask for them; ties go to the smaller document."""
    fused = raw.where("algo = 'rrf'")
    for name in ("raw", "cover"):
        fused = fused.withColumn(f"by_{name}", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(name, 6)), "doc_id")))
    fused = fused.withColumn("raw", 1.0 / (F.col("rrf_k") + F.col("by_raw")) + 1.0 / (F.col("rrf_k") + F.col("by_cover")))
    return raw.where("algo <> 'rrf'").unionByName(fused.select(*raw.columns))


_WORD = regex.compile(r"[\p{L}\p{N}\p{M}']+")


def mark_snippet(opening: str | None, terms: Iterable[str], normalize, length: int = 300) -> str:
    """Beginning of a text, escaped, with the words marked that are a matched term in the index's form."""
    terms = set(terms)
    opening = opening or ""
    shown, out, at = opening[:length], [], 0
    for m in _WORD.finditer(shown):
        out.append(html.escape(shown[at : m.start()], quote=True))
        word, forms = html.escape(m[0], quote=True), normalize(m[0])
        out.append(f"<mark>{word}</mark>" if len(forms) == 1 and forms[0] in terms else word)
        at = m.end()
    return "".join(out) + html.escape(shown[at:], quote=True) + ("…" if len(opening) > length else "")


def present(index: Index, page: DataFrame, length: int) -> DataFrame:
    """Titles and marked openings, for the page's documents only."""
    docs = index.table("documents").select("doc_id", "title", "opening")
    shown = page.join(docs, "doc_id", "left")
    normalize = normalizer(index.folded)

    @F.pandas_udf("string")
    def snippet(opening: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([mark_snippet(o, t if t is not None else (), normalize, length) for o, t in zip(opening, terms)], dtype=object)

    words = F.flatten(F.map_values("matches"))
    return shown.select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"), F.coalesce("title", F.col("doc_id").cast("string")).alias("title"), "field_scores", "matches", snippet("opening", words).alias("snippet"))
