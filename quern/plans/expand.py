"""From queries to the terms that are looked up: stems, synonyms, morphology, spelling, prefixes, cuts and routing.

A batch of queries is planned together: each look-up in the index is one job for the whole batch, and what comes
back is bounded by the caps per word or prefix. The result is query-sized.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.words import morph_forms, osa_column, risky_roots, root_words
from quern.plans.index import Index
from quern.plans.query import ALGORITHMS, QUESTION_WORDS, Knobs, ParsedQuery, Profile, normalizer, parse
from quern.plans.small import small_table

_NUMBER = regex.compile(r"\p{N}")
MASK_BITS = 62


@dataclass(frozen=True)
class Options:
    """What one search asks for, beyond its query."""

    algo: str = "bm25"
    fields: dict[str, float] | None = None
    confidence: int = 100
    page: int = 1
    per_page: int = 20
    stopwords: Sequence[str] = ()
    synonyms: Sequence[Sequence[str]] = ()
    derivations: Sequence[Sequence[str]] = ()
    stemming: bool = False
    two_phase: bool = False
    phrase_mode: str = "auto"


@dataclass
class Plan:
    """One query on its way through the stages."""

    query_id: int
    query: str
    parsed: ParsedQuery
    options: Options
    profile: Profile
    knobs: Knobs
    weights: dict[str, float]
    algo: str
    pending: str | None = None  # algorithm to take if there is no sign of a typing error
    typed: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)
    original: list[str] = field(default_factory=list)  # optional words and their stems
    groups: dict[str, list[str]] = field(default_factory=dict)  # required groups: one form of each must occur
    slots: dict[str, list[str]] = field(default_factory=dict)  # title slots: forms of each typed word
    excluded: list[str] = field(default_factory=list)
    boosts: dict[str, float] = field(default_factory=dict)
    concept_of: dict[str, str] = field(default_factory=dict)
    concept_weight: dict[str, float] = field(default_factory=dict)
    expanded: bool = False
    fuzzy: dict[str, float] = field(default_factory=dict)
    promoted: dict[str, str] = field(default_factory=dict)
    wild: dict[str, set[str]] = field(default_factory=dict)  # prefix key -> completions
    by_field: dict[str, list[str]] = field(default_factory=dict)
    df: dict[str, dict[str, int]] = field(default_factory=dict)
    idf: dict[str, dict[str, float]] = field(default_factory=dict)
    truncated: bool = False
    anchor: str | None = None
    diag: dict = field(default_factory=dict)

    def boost(self, term: str) -> float:
        return self.boosts.get(term, 1.0)

    def claim(self, term: str, concept: str) -> None:
        """The first concept that has a form keeps it."""
        self.concept_of.setdefault(term, concept)

    def note(self, term: str, origin: str, kind: str) -> None:
        self.diag.setdefault("expansions", []).append({"term": term, "from": origin, "class": kind, "boost": round(self.boost(term), 3)})

    @property
    def required_terms(self) -> list[str]:
        return list(dict.fromkeys(t for g in self.groups.values() for t in g))


def begin(index: Index, query_id: int, query: str, options: Options, profile: Profile, normalize: Callable | None = None) -> Plan:
    """Everything that needs no look-up."""
    knobs = Knobs().with_(profile.ranking)
    if options.algo not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {options.algo!r}; there are {ALGORITHMS}")
    weights = dict.fromkeys(index.get_fields(), 1.0) if options.fields is None else {f: float(w) for f, w in options.fields.items() if w and w > 0}
    unknown = sorted(set(weights) - set(index.fields))
    if unknown:
        raise ValueError(f"unknown fields {unknown}; the index has {index.get_fields()}")
    parsed = parse(query, normalizer(index.folded, profile.term_normalizer), profile.compound_numbers, profile.strict_sanitize)
    p = Plan(query_id, query, parsed, options, profile, knobs, weights, options.algo, boosts=dict(parsed.boosts))
    _route(p)
    p.typed = [t for t in parsed.optional if t not in set(options.stopwords)]
    p.optional = list(p.typed)
    p.excluded = root_words(parsed.excluded) if options.stemming else list(parsed.excluded)
    _stem(p)
    for prefix, typed in (("r:", parsed.required), ("o:", p.typed)):
        for t in typed:
            p.concept_weight[prefix + t] = p.boost(t)
            for form in p.slots[prefix + t]:
                p.claim(form, prefix + t)
    p.groups = {t: p.slots["r:" + t] for t in parsed.required}
    p.original = list(p.optional)
    _widen(p)
    return p


def _route(p: Plan) -> None:
    """auto by the query's shape, which stopwords don't change; spelling may overrule it later."""
    if p.algo != "auto":
        return
    words = [*p.parsed.required, *p.parsed.optional]
    if p.parsed.required_prefixes or p.parsed.optional_prefixes:
        p.algo = p.knobs.auto_wildcard_algo
        return
    shape = p.knobs.auto_question_algo if QUESTION_WORDS & set(words) else p.knobs.auto_single_word_algo if len(set(words)) == 1 else p.knobs.auto_default_algo
    if p.options.confidence < 100:
        p.pending = shape
    else:
        p.algo = shape


def _stem(p: Plan) -> None:
    knobs, known = p.knobs, {*p.parsed.required, *p.typed}
    verify = p.profile.stem_verifier
    for prefix, typed in (("r:", p.parsed.required), ("o:", p.typed)):
        for t in typed:
            forms = [t]
            if p.options.stemming:
                found = [(v, knobs.stem_boost) for v in root_words([t])[1:]]
                if verify is not None:
                    found += [(v, knobs.derivation_boost) for v in risky_roots(t) if v not in [f for f, _ in found] and verify(t, v)]
                for v, discount in found:
                    forms.append(v)
                    fresh = v not in known and (prefix == "r:" or v not in p.optional)
                    if fresh:
                        p.boosts[v] = discount * p.boost(t)
                        if prefix == "o:":
                            p.optional.append(v)
                    if fresh or prefix == "r:":
                        p.expanded = True
                    p.note(v, t, "stem")
            p.slots[prefix + t] = forms


def _widen(p: Plan) -> None:
    """Synonyms and derivations of the optional words."""
    for t in list(p.optional):
        group = next((g for g in p.options.synonyms if t in g), ())
        for s in group:
            if s not in p.optional and s not in p.excluded:
                p.optional.append(s)
                p.boosts.setdefault(s, p.boost(t))
                p.claim(s, p.concept_of.get(t, "o:" + t))
                p.expanded = True
                p.note(s, t, "synonym")
    for head, *rest in (g for g in p.options.derivations if g):
        if head not in p.optional:
            continue
        for d in rest:
            if d not in p.optional and d not in p.parsed.required and d not in p.excluded:
                p.optional.append(d)
                p.boosts[d] = p.knobs.derivation_boost * p.boost(head)
                p.claim(d, p.concept_of.get(head, "o:" + head))
                p.expanded = True
                p.note(d, head, "derivation")


def morph(index: Index, plans: Sequence[Plan]) -> None:
    """Longer forms of the typed words that the vocabulary has; one look-up for the batch."""
    wanted = {f for p in plans if p.options.stemming for t in (*p.parsed.required, *p.typed) for f in morph_forms(t)}
    if not wanted:
        return
    found = {r["term"] for r in _lookup(index, wanted, index.table("vocabulary").select("term")).collect()}
    for p in plans:
        if not p.options.stemming:
            continue
        for t in (*p.parsed.required, *p.typed):
            for f in sorted(f for f in morph_forms(t) if f in found):
                if f not in p.optional and f not in p.parsed.required:
                    p.optional.append(f)
                    p.boosts[f] = p.knobs.morph_boost
                    p.claim(f, p.concept_of.get(t, "o:" + t))
                    p.expanded = True
                    p.note(f, t, "morph")


def _lookup(index: Index, terms: Iterable[str], table: DataFrame) -> DataFrame:
    terms = sorted(set(terms))
    if len(terms) <= 500:
        return table.where(F.col("term").isin(terms))
    return table.join(small_table(index.spark, [(t,) for t in terms], "term string"), "term", "left_semi")


def fuzzy_candidates(vocabulary: DataFrame, words: DataFrame, cap: int) -> DataFrame:
    """word, term, distance: vocabulary terms within each word's budget (columns word, budget).

    Candidates share the first letter and differ in length by the budget at most. Plain edit distance decides; one edit more is
    accepted if swapped neighbours explain it. Per word the first ``cap`` by length, first field and term count; the word itself is always there.
    """
    w = words.select("word", "budget", F.substring("word", 1, 1).alias("fc"), F.length("word").alias("n"))
    near = vocabulary.join(F.broadcast(w), "fc").where(F.col("len").between(F.col("n") - F.col("budget"), F.col("n") + F.col("budget")))
    plain = near.withColumn("c", F.levenshtein("word", "term")).where(F.col("c") <= F.col("budget") + 1)
    exact = plain.withColumn("distance", F.when(F.col("c") <= F.col("budget"), F.col("c")).otherwise(osa_column(F.col("word"), F.col("term")))).where(F.col("distance") <= F.col("budget"))
    order = Window.partitionBy("word", F.col("distance") == 0).orderBy("len", "first_field", "term")
    # a constant limit on the rank is applied before the shuffle, too; the word itself is alone in its part
    return exact.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(1, cap)).where((F.col("distance") == 0) | (F.col("r") <= cap)).select("word", "term", "distance", "len", "first_field")


def spelling(index: Index, plans: Sequence[Plan]) -> None:
    """Spelling variants of typed optional words; numbers are exact."""
    for confidence, cap in {(p.options.confidence, p.profile.max_fuzzy) for p in plans}:
        some = [p for p in plans if (p.options.confidence, p.profile.max_fuzzy) == (confidence, cap)]
        words = sorted({t for p in some for t in p.typed if not _NUMBER.search(t)})
        found: dict[str, list] = {}
        if confidence < 100 and words:
            rows = [(t, max(1, math.floor(len(t) * (100 - confidence) / 100))) for t in words]
            got = fuzzy_candidates(index.table("vocabulary"), small_table(index.spark, rows, "word string, budget int"), cap)
            for r in sorted(got.collect(), key=lambda r: (r["len"], r["first_field"], r["term"])):
                found.setdefault(r["word"], []).append((r["term"], r["distance"]))
        for p in some:
            by_origin: dict[str, list[str]] = {}
            for t in p.typed:
                if confidence >= 100 or _NUMBER.search(t):
                    p.fuzzy[t] = 1.0
                    continue
                for v, d in found.get(t, []):
                    value = p.knobs.fuzzy_decay**d
                    if v not in p.fuzzy:
                        by_origin.setdefault(t, []).append(v)
                    p.fuzzy[v] = max(p.fuzzy.get(v, 0.0), value)
                    p.claim(v, p.concept_of.get(t, "o:" + t))
                    p.expanded |= v != t
            p.diag["_variants"] = by_origin


def correct(index: Index, plans: Sequence[Plan], vouch: Callable[[Sequence[Plan]], dict]) -> None:
    """Rare typed words whose variant is far commoner give way to it, unless the other words vouch for them; and auto is settled."""
    fuzzy = [p for p in plans if p.options.confidence < 100]
    df = term_stats(index, {t for p in fuzzy for t in (*p.fuzzy, *p.typed)}) if fuzzy else {}
    total = {id(p): {t: sum(df.get((f, t), (0, 0.0))[0] for f in p.weights) for t in (*p.fuzzy, *p.typed)} for p in fuzzy}
    suspects: dict[int, dict[str, tuple[str, int]]] = {}
    for p in fuzzy:
        for t, variants in p.diag["_variants"].items():
            best = max((v for v in variants if v != t), key=lambda v: total[id(p)][v], default=None)
            if best is not None and total[id(p)][best] > 0:
                suspects.setdefault(id(p), {})[t] = (best, total[id(p)][best])
    firing = [(p, t) for p in fuzzy for t, (best, n) in suspects.get(id(p), {}).items() if 0 < (own := total[id(p)][t]) and (p.knobs.swap_orig_df_max <= 0 or own <= p.knobs.swap_orig_df_max) and n >= p.knobs.typo_swap_ratio * own]
    ratios = vouch([(p, t) for p, t in firing if p.knobs.swap_context_check > 0 and {*p.parsed.required, *p.typed} - {t}]) if firing else {}
    for p in fuzzy:
        swaps = []
        for t, (best, n) in suspects.get(id(p), {}).items():
            own = total[id(p)][t]
            if (p, t) in [(q, w) for q, w in firing]:
                ratio = ratios.get((p.query_id, t))
                if ratio is not None and ratio >= p.knobs.swap_context_check:
                    swaps.append({"typed": t, "promoted": None, "typed_df": own, "promoted_df": n, "blocked_by_context": round(ratio, 3)})
                    continue
                p.fuzzy[t] = 0.3
            elif not (own == 0 and 0 < p.knobs.swap_zero_df_promote <= n):
                continue
            p.fuzzy[best] = 1.0
            swaps.append({"typed": t, "promoted": best, "typed_df": own, "promoted_df": n})
            if best not in p.parsed.required and best not in p.original:
                p.promoted[best] = t
        p.diag["typo_swaps"] = swaps
        if p.pending is not None:
            doubtful = {*p.promoted.values(), *(t for t in p.typed if total[id(p)][t] == 0)}
            typo = bool(doubtful) and len(doubtful) / max(1, len(set(p.typed))) >= p.knobs.auto_typo_fraction
            p.algo = p.knobs.auto_typo_algo if typo else p.pending
            p.diag["auto"] = {"typo_evidence": typo, "suspects": sorted(doubtful), "typed_words": max(1, len(set(p.typed)))}
    for p in plans:
        for t, value in p.fuzzy.items():
            p.boosts[t] = p.boost(t) * value
        for origin, variants in p.diag.pop("_variants", {}).items():
            for v in variants:
                if v != origin:
                    p.note(v, origin, "fuzzy")
        for t, origin in p.promoted.items():
            home = next((k for k in ("o:" + origin, "r:" + origin) if k in p.slots), None) if p.knobs.title_promoted_as_form else None
            if home:
                p.slots[home] = [*p.slots[home], t]
            else:
                p.slots["p:" + t] = [t]


def prefix_completions(term_docs: DataFrame, prefixes: DataFrame, most_caps: int) -> DataFrame:
    """pid, field, term of the commonest completions of each prefix and field.

    prefixes: pid, field, prefix, most (documents of a completion at most, null for no limit), cap, budget (rows of all, 0 for
    no limit; the first completion is kept whatever it has). most_caps: the largest cap, a constant that limits what is shuffled and sorted.
    """
    p = prefixes.withColumn("fc", F.substring("prefix", 1, 1))
    t = term_docs.withColumn("fc", F.substring("term", 1, 1))
    fits = t.join(F.broadcast(p), ["field", "fc"]).where(F.col("term").startswith(F.col("prefix")) & (F.col("most").isNull() | (F.col("doc_freq") <= F.col("most"))))
    w = Window.partitionBy("pid", "field").orderBy(F.desc("doc_freq"), "term")
    ranked = fits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most_caps).where(F.col("r") <= F.col("cap"))
    summed = ranked.withColumn("rows", F.sum("doc_freq").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return summed.where((F.col("r") == 1) | (F.col("budget") <= 0) | (F.col("rows") <= F.col("budget"))).select("pid", "field", "term", "r")


def prefixes(index: Index, plans: Sequence[Plan]) -> None:
    """Completions of all prefixes of the batch."""
    totals = {f: n for f, (n, _) in index.field_stats.items()}
    asked: dict[tuple, int] = {}
    for p in plans:
        for prefix in (*p.parsed.required_prefixes, *p.parsed.optional_prefixes):
            for f in p.weights:
                n = totals.get(f, 0)
                most = int(n * p.profile.highfreq_cutoff) if n >= 100 and p.profile.highfreq_cutoff < 1 else None
                asked.setdefault((f, prefix, most, p.profile.max_wildcard, p.profile.wildcard_budget), len(asked))
    found: dict[tuple[int, str], list[str]] = {}
    if asked:
        rows = small_table(index.spark, [(i, *k) for k, i in asked.items()], "pid int, field string, prefix string, most long, cap int, budget long")
        for r in sorted(prefix_completions(index.table("termstats"), rows, max(k[3] for k in asked)).collect(), key=lambda r: (r["pid"], r["field"], r["r"])):
            found.setdefault((r["pid"], r["field"]), []).append(r["term"])
    for p in plans:

        def completions(prefix: str, f: str, p: Plan = p) -> list[str]:
            n = totals.get(f, 0)
            most = int(n * p.profile.highfreq_cutoff) if n >= 100 and p.profile.highfreq_cutoff < 1 else None
            return found.get((asked[f, prefix, most, p.profile.max_wildcard, p.profile.wildcard_budget], f), [])

        for prefix, boost in p.parsed.required_prefixes.items():
            key = "rw:" + prefix
            p.concept_weight[key] = boost
            terms = list(dict.fromkeys(t for f in p.weights for t in completions(prefix, f)))
            for t in terms:
                p.boosts.setdefault(t, boost)
                p.claim(t, key)
            p.groups[prefix + "*"] = terms
            p.wild[key] = set(terms)
        searched = [*p.fuzzy, *(t for t in p.optional if t not in p.typed)]
        for f in p.weights:
            p.by_field[f] = list(dict.fromkeys(searched))
            for prefix, boost in p.parsed.optional_prefixes.items():
                key = "ow:" + prefix
                p.concept_weight[key] = boost
                for t in completions(prefix, f):
                    p.boosts.setdefault(t, boost)
                    p.claim(t, key)
                    p.wild.setdefault(key, set()).add(t)
                    if t not in p.by_field[f]:
                        p.by_field[f].append(t)
        if p.wild:
            p.diag["wildcards"] = {k.split(":", 1)[1] + "*": {"count": len(v), "terms": sorted(v)[:10]} for k, v in p.wild.items()}


def term_stats(index: Index, terms: Iterable[str]) -> dict[tuple[str, str], tuple[int, float]]:
    """(field, term) -> (documents, idf), of query-sized lists of terms."""
    terms = set(terms)
    if not terms:
        return {}
    return {(r["field"], r["term"]): (r["doc_freq"], r["idf"]) for r in _lookup(index, terms, index.table("termstats")).select("field", "term", "doc_freq", "idf").collect()}


def weigh(index: Index, plans: Sequence[Plan]) -> None:
    """Document frequencies, the cuts of too frequent optional terms, and whether required words are all too broad."""
    stats = term_stats(index, {t for p in plans for t in (*p.required_terms, *(t for l in p.by_field.values() for t in l))})
    totals = {f: n for f, (n, _) in index.field_stats.items()}
    for p in plans:
        for f in p.weights:
            own = {t: stats[f, t] for t in (*p.required_terms, *p.by_field.get(f, [])) if (f, t) in stats}
            p.df[f] = {t: n for t, (n, _) in own.items()}
            p.idf[f] = {t: i for t, (_, i) in own.items()}
            n = totals.get(f, 0)
            if n < 100:
                continue
            typed = {*p.parsed.required, *p.original}
            common = math.inf if p.profile.highfreq_cutoff >= 1 else int(n * p.profile.highfreq_cutoff)
            noisy = max(1000, 3 * max((p.df[f].get(t, 0) for t in typed), default=0))
            wild = {t for k, v in p.wild.items() if k.startswith("ow:") for t in v}
            exempt = typed | wild | (set(p.promoted) if p.knobs.noise_exempt_promoted else set())
            kept = [t for t in p.by_field.get(f, []) if p.df[f].get(t, 0) <= common and (t in exempt or p.df[f].get(t, 0) <= noisy)]
            if dropped := [t for t in p.by_field.get(f, []) if t not in kept]:
                p.diag.setdefault("dropped", {})[f] = dropped
            p.by_field[f] = kept
        if p.groups and p.profile.broad_cap > 0 and p.profile.highfreq_cutoff < 1:
            rows = {k: sum(p.df[f].get(t, 0) for f in p.weights for t in g) for k, g in p.groups.items()}
            p.anchor = min(rows, key=rows.get)
            p.truncated = rows[p.anchor] > int(max((totals.get(f, 0) for f in p.weights), default=0) * p.profile.highfreq_cutoff)


def plan_queries(index: Index, queries: Sequence[tuple[int, str]], options: Options, profile: Profile, vouch: Callable) -> list[Plan]:
    plans = [begin(index, i, q, options, profile) for i, q in queries]
    live = [p for p in plans if p.weights and not p.parsed.empty]
    if live:
        morph(index, live)
        spelling(index, live)
        correct(index, live, vouch)
        prefixes(index, live)
        weigh(index, live)
    return plans
