"""The text forms in which everything is compared, as Column expressions and as DuckDB SQL.

folded: lower case, Latin letters without diacritics, ligatures spelled out, ASCII apostrophe deleted.
term: folded, punctuation to space, outer white space trimmed.
tokens: folded or only lower-cased, punctuation to space, split at white space.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCT = r"[\p{P}$+<=>^`|~]"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
MARKS = (0x0300, 0x036F)

# Letters that have no decomposition, and what they are spelled as.
UNDECOMPOSED = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ł": "l", "ŋ": "n", "ŧ": "t", "ƀ": "b", "ɨ": "i"}


def _bare(letter: str) -> str:
    parts = unicodedata.normalize("NFKD", letter)
    return "".join(UNDECOMPOSED.get(c, c) for c in parts if not MARKS[0] <= ord(c) <= MARKS[1])


def _letters() -> dict[str, str]:
    """Lower-case Latin letters to plain ones, by Unicode's decompositions."""
    spans = [*range(0xDF, 0x250), *map(ord, UNDECOMPOSED), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]
    pairs = {chr(c): _bare(chr(c)) for c in spans if chr(c) == chr(c).lower()}
    return {a: b for a, b in pairs.items() if a != b and re.fullmatch("[a-z]+", b)}


LETTERS = _letters()
ONE = {a: b for a, b in LETTERS.items() if len(b) == 1}
MANY = {a: b for a, b in LETTERS.items() if len(b) > 1}
_TABLE = str.maketrans(LETTERS)
_MARKS_RE = re.compile("[̀-ͯ]+")


def fold_py(text: str) -> str:
    """Folded form of one string, for query-sized data."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS_RE.sub("", text.translate(_TABLE))
    return text.replace("'", "")


def strip_diacritics(col: Column) -> Column:
    """Latin letters without diacritics, of text that is lower-cased already."""
    plain = F.translate(col, "".join(ONE), "".join(ONE.values()))
    for a, b in MANY.items():
        plain = F.replace(plain, F.lit(a), F.lit(b))
    plain = F.regexp_replace(plain, "[\\u0300-\\u036f]+", "")
    return F.when(col.rlike("[^\\x00-\\x7f]"), plain).otherwise(col)


def fold(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.replace(strip_diacritics(F.lower(col)), F.lit("'"), F.lit(""))


def trim(col: Column) -> Column:
    """Without outer white space, as Unicode has it."""
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def term(col: Column | str) -> Column:
    return trim(F.regexp_replace(fold(col), PUNCT, " "))


def phrase(col: Column | str) -> Column:
    """Folded, each run of white space one space, outer space trimmed; operators and word order stay."""
    return F.trim(F.regexp_replace(fold(col), f"{SPACE}+", " "))


def tokens(col: Column | str, folded: bool = True) -> Column:
    """Array of tokens; null text has none. Materialise it before using it more than once."""
    col = F.col(col) if isinstance(col, str) else col
    low = fold(col) if folded else F.replace(F.lower(col), F.lit("'"), F.lit(""))
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(low, F.lit("")), f"(?:{PUNCT}|{SPACE})+", " "), " "), "")


def _is_punctuation(c: str) -> bool:
    return unicodedata.category(c)[0] == "P" or c in "$+<=>^`|~"


# the steps of tokens as one table: marks and apostrophe go, punctuation separates; str.split knows the same white space
_PUNCTUATION = {c: " " for c in range(0x20000) if _is_punctuation(chr(c))} | {0x27: None}
_PLAIN_TABLE = str.maketrans(_PUNCTUATION)
_FOLD_TABLE = str.maketrans(_PUNCTUATION | {ord(a): b for a, b in LETTERS.items()} | dict.fromkeys(range(MARKS[0], MARKS[1] + 1)))


_OTHER = re.compile(r"[^a-z0-9\s]")


def separated_py(text: str, folded: bool = True) -> str:
    """A string in the form in which white space separates its tokens."""
    low, table = text.lower(), _FOLD_TABLE if folded else _PLAIN_TABLE
    if low.isascii():
        return low.translate(table)

    def other(m: re.Match) -> str:
        c = table.get(ord(m[0]), m[0])
        return c if isinstance(c, str) else ""

    # few characters of most texts are in the table
    return _OTHER.sub(other, low)


def tokens_py(text: str, folded: bool = True) -> list[str]:
    """The same list for one string."""
    return separated_py(text, folded).split()


def sql_fold(x: str) -> str:
    low = f"lower({x})"
    many = low
    for a, b in MANY.items():
        many = f"replace({many}, '{a}', '{b}')"
    plain = f"regexp_replace(translate({many}, '{''.join(ONE)}', '{''.join(ONE.values())}'), '[\\x{{0300}}-\\x{{036F}}]+', '', 'g')"
    return f"replace({plain}, '''', '')"


SQL_SPACE = r"[\s\p{Z}\x1c-\x1f\x{85}\x0b]"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_term(x: str) -> str:
    return sql_trim(f"regexp_replace({sql_fold(x)}, '{PUNCT}', ' ', 'g')")


def sql_phrase(x: str) -> str:
    return f"trim(regexp_replace({sql_fold(x)}, '{SQL_SPACE}+', ' ', 'g'))"


def sql_tokens(x: str, folded: bool = True) -> str:
    low = sql_fold(x) if folded else f"replace(lower({x}), '''', '')"
    return f"list_filter(string_split(regexp_replace(coalesce({low}, ''), '(?:{PUNCT}|{SQL_SPACE})+', ' ', 'g'), ' '), lambda t: t <> '')"
