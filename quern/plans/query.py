"""The query language, ranking knobs and profiles. Everything here is query-sized and stays on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace

import regex

from quern.functions import text

ALGORITHMS = ("auto", "bm25", "bm25+cov", "bm25f", "rrf", "dfr", "cover", "idf", "freq")
# Words that make a query a question, and the names and defaults of Knobs and Profile.
QUESTION_WORDS = frozenset(["how", "what", "which", "who", "whom", "whose", "when", "where", "why"])
FIELD_NAME = re.compile(r"[a-z][a-z0-9_]{0,30}")

_UNWANTED = regex.compile(r"""[^\p{L}\p{N}\p{M}\s'"*+^.:\-]""")
_PIECES = regex.compile(r'[+-]?"[^"]*"|\S+')
_COMPOUND = regex.compile(r"\p{N}+([.:/-]\p{N}+)+")
_BOOST = re.compile(r"\^(\d+(?:\.\d+)?)$")


@dataclass(frozen=True)
class Knobs:
    """Ranking constants."""

    k1: float = 1.5
    b: float = 0.75
    delta: float = 0.5
    rrf_k: float = 60
    proximity_weight: float = 0.3
    title_bonus_base: float = 1.5
    title_bonus_span: float = 1.5
    title_bonus_half: float = 1.3
    title_bonus_partial: float = 1.1
    fuzzy_decay: float = 0.5
    typo_swap_ratio: float = 10.0
    swap_context_check: float = 0.3
    swap_orig_df_max: int = 20
    swap_zero_df_promote: int = 100
    noise_exempt_promoted: bool = True
    title_promoted_as_form: bool = True
    freq_tf_log: bool = True
    concept_coverage: bool = True
    auto_typo_fraction: float = 0.0
    auto_wildcard_algo: str = "freq"
    auto_typo_algo: str = "freq"
    auto_question_algo: str = "freq"
    auto_single_word_algo: str = "freq"
    auto_default_algo: str = "cover"
    stem_boost: float = 0.8
    derivation_boost: float = 0.7
    morph_boost: float = 0.7
    snippet_length: int = 300

    def with_(self, changes: dict) -> Knobs:
        unknown = sorted(set(changes) - {f.name for f in fields(self)})
        if unknown:
            raise ValueError(f"unknown ranking knobs {unknown}; there are {sorted(f.name for f in fields(self))}")
        out = replace(self, **changes)
        for f in fields(self):
            if f.name.endswith("_algo") and getattr(out, f.name) not in ALGORITHMS[1:]:
                raise ValueError(f"{f.name} must be one of {ALGORITHMS[1:]}")
        return out


@dataclass(frozen=True)
class Profile:
    """What holds for a corpus; each search may override it."""

    title_field: str | None = "title"
    heavy_fields: tuple[str, ...] = ()
    field_b: dict[str, float] = field(default_factory=dict)
    candidate_limit: int = 5000
    phase1_limit: int = 1000
    highfreq_cutoff: float = 0.25
    max_fuzzy: int = 10
    max_wildcard: int = 100
    wildcard_budget: int = 200_000
    broad_cap: int = 20_000
    compound_numbers: str = "phrase"
    strict_sanitize: bool = True
    ranking: dict = field(default_factory=dict)
    stem_verifier: Callable[[str, str], bool] | None = None
    term_normalizer: Callable[[str], list[str]] | None = None

    def with_(self, changes: dict) -> Profile:
        unknown = sorted(set(changes) - {f.name for f in fields(self)})
        if unknown:
            raise ValueError(f"unknown options {unknown}")
        return replace(self, **changes)

    def as_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if not callable(v)}


@dataclass
class ParsedQuery:
    required: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)
    boosts: dict[str, float] = field(default_factory=dict)
    required_prefixes: dict[str, float] = field(default_factory=dict)
    excluded_prefixes: dict[str, float] = field(default_factory=dict)
    optional_prefixes: dict[str, float] = field(default_factory=dict)
    required_phrases: list[list[str]] = field(default_factory=list)
    excluded_phrases: list[list[str]] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        """Nothing that could be found: exclusions alone find nothing."""
        return not (self.required or self.optional or self.required_prefixes or self.optional_prefixes)


def parse(query: str | None, normalize: Callable[[str], list[str]], compound_numbers: str = "phrase", strict_sanitize: bool = True) -> ParsedQuery:
    """Buckets of a query: words, +required, -excluded, "phrases", pre* and word^boost. Null is the empty query.

    strict_sanitize deletes characters that mean nothing here, joining what stood around them; without it they separate.
    """
    out = ParsedQuery()
    buckets: dict[str, list[str]] = {"+": [], "-": [], "": []}
    prefixes = {"+": out.required_prefixes, "-": out.excluded_prefixes, "": out.optional_prefixes}
    cleaned = _UNWANTED.sub("" if strict_sanitize else " ", " ".join((query or "").lower().split()))
    for piece in _PIECES.findall(cleaned):
        sign = piece[0] if piece[0] in "+-" else ""
        body = piece[len(sign) :]
        if body.startswith('"') and body.endswith('"') and len(body) >= 2:
            words = normalize(body[1:-1])
            if sign == "-":
                if len(words) == 1:
                    buckets["-"] += words
                elif words:
                    out.excluded_phrases.append(words)
            else:
                buckets["+"] += words
                if len(words) >= 2:
                    out.required_phrases.append(words)
            continue
        boost = None
        if m := _BOOST.search(body):
            boost, body = float(m[1]), body[: m.start()]
        is_prefix = body.endswith("*")
        body = body.replace("*", "").replace("^", "").replace('"', "")
        if not is_prefix and compound_numbers == "phrase" and _COMPOUND.fullmatch(body):
            words = normalize(body)
            if len(words) >= 2:
                if sign == "-":
                    out.excluded_phrases.append(words)
                else:
                    buckets["+"] += words
                    out.required_phrases.append(words)
                    out.boosts |= {w: boost for w in words if boost is not None}
                continue
        words = normalize(body)
        if is_prefix and words:
            prefixes[sign].setdefault(words[-1], 1.0 if boost is None else boost)
            words = words[:-1]
        buckets[sign] += words
        out.boosts |= {w: boost for w in words if boost is not None}
    out.excluded = list(dict.fromkeys(buckets["-"]))
    out.required = [w for w in dict.fromkeys(buckets["+"]) if w not in out.excluded]
    out.optional = [w for w in dict.fromkeys(buckets[""]) if w not in out.excluded and w not in out.required]
    return out


def normalizer(folded: bool, custom: Callable[[str], list[str]] | None = None) -> Callable[[str], list[str]]:
    return custom or (lambda s: text.tokens_py(s, folded))
