"""Word forms and edit distances for query-sized data, and the distance as a Column expression."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, all tables up to MORPH_DOUBLED: irregular plurals; suffix rules in the order in which the first that fits is taken, and
# those that need a lexicon (a rule: suffix, least length of the word, what is put after the word without the suffix; "2" undoubles the end);
# letters that are doubled; endings of longer forms.
IRREGULAR = {"children": "child", "women": "woman", "men": "man", "people": "person", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose"}
RULES = [
    ("iness", 5, ["y"]), ("ness", 5, [""]), ("ies", 5, ["y"]), ("ves", 5, ["f", "fe"]), ("oes", 5, ["o"]), ("sses", 5, ["s", "ss"]), ("es", 5, ["e", ""]), ("s", 5, [""]),
    ("ing", 5, ["", "e", "2"]), ("ed", 5, ["", "e", "2"]), ("iful", 5, ["y"]), ("ful", 5, ["", "y"]), ("ation", 5, ["", "ate"]), ("ion", 5, ["", "e"]),
    ("ment", 7, [""]), ("ize", 7, [""]), ("ise", 7, [""]), ("ical", 5, ["ic", "y"]), ("al", 7, [""]),
]
RISKY = [("lity", 7, ["le"]), ("ity", 6, ["", "e"]), ("ily", 6, ["y"]), ("ly", 5, [""]), ("ous", 6, ["", "e"]), ("est", 6, ["", "e", "2"]), ("er", 5, ["", "e", "2"])]
DOUBLED = "bcdfghjklmnpqrstvwz"
MORPH = ["s", "es", "ed", "d", "ing", "er", "ers", "est", "ly", "ful", "ness", "ment", "tion", "sion", "ling", "lling", "al", "ial", "ual", "ous", "ious", "ity", "ety", "ize", "ise"]
MORPH_AFTER_E = ["ing", "ed", "er", "ers", "ation"]
MORPH_DOUBLED = ["ing", "ed", "er"]


def _forms(stem: str, endings: list[str]) -> list[str]:
    out = []
    for e in endings:
        if e == "2":
            if len(stem) >= 3 and stem[-1] == stem[-2] and stem[-1] in DOUBLED:
                out.append(stem[:-1])
        else:
            out.append(stem + e)
    return out


def root_words(words: list[str]) -> list[str]:
    """The words and, after them, the roots that the suffix rules give; words of up to four letters have none."""
    out = dict.fromkeys(words)
    for w in words:
        if w in IRREGULAR:
            made = [IRREGULAR[w]]
        elif len(w) <= 4:
            made = []
        else:
            made = next((_forms(w[: -len(s)], ends) for s, least, ends in RULES if len(w) >= least and w.endswith(s)), [])
        out |= dict.fromkeys(m for m in made if len(m) > 1)
    return list(out)


def risky_roots(word: str) -> list[str]:
    """Roots that are right only if a lexicon knows them; all rules that fit apply, but er not beside est."""
    out: dict[str, None] = {}
    for s, least, ends in RISKY:
        if word.endswith(s) and len(word) >= least and not (s == "er" and word.endswith("est")):
            out |= dict.fromkeys(f for f in _forms(word[: -len(s)], ends) if len(f) > 2 and f != word)
    return list(out)


def morph_forms(word: str) -> list[str]:
    """Longer forms of a word; only those in a vocabulary are words."""
    if len(word) < 3:
        return []
    out = [word + s for s in MORPH]
    if word.endswith("e"):
        out += [word[:-1] + s for s in MORPH_AFTER_E]
    if word[-1] in "bcdfghjklmnpqrstvwxyz":
        out += [word + word[-1] + s for s in MORPH_DOUBLED]
    return [w for w in dict.fromkeys(out) if w != word]


def osa(a: str, b: str) -> int:
    """Optimal string alignment: edits, and transpositions of neighbours, no substring edited twice."""
    # what both begin or end with costs nothing
    i, most = 0, min(len(a), len(b))
    while i < most and a[i] == b[i]:
        i += 1
    j = 0
    while j < most - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        two, one = one, now
    return one[-1]


def osa_column(a: Column, b: Column) -> Column:
    """The same for columns, in Arrow batches: built-in functions have no transpositions. For candidates that levenshtein has left."""

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else osa(p, q) for p, q in zip(x, y)], dtype="Int32")

    return distance(a, b)


def encode_positions(positions: list[int]) -> bytes:
    """Differences of ascending positions as variable-length integers of seven bits a byte, lowest first."""
    out, last = bytearray(), 0
    for p in positions:
        d, last = p - last, p
        while d > 127:
            out.append(d & 127 | 128)
            d >>= 7
        out.append(d)
    return bytes(out)


def decode_positions(data: bytes | None) -> list[int]:
    out, at, shift, value = [], 0, 0, 0
    for byte in data or b"":
        value |= (byte & 127) << shift
        if byte & 128:
            shift += 7
        else:
            at += value
            out.append(at)
            shift = value = 0
    return out
