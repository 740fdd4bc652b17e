import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.words import decode_positions, encode_positions, morph_forms, osa, osa_column, risky_roots, root_words
from quern.plans.query import Knobs, normalizer, parse

CASES = [
    ("Don't stop-go", ["dont", "stop", "go"]), ("Café Ñandú", ["cafe", "nandu"]), ("Straße Æsir œuvre þorn", ["strasse", "aesir", "oeuvre", "thorn"]), ("Việt Łódź", ["viet", "lodz"]),
    ("café", ["cafe"]), ("İstanbul", ["istanbul"]), ("Ελλάδα Москва 東京 हिन्दी", ["ελλάδα", "москва", "東京", "हिन्दी"]), ("a b c\u0085d", ["a", "b", "c", "d"]), ("", []), ("  ...  ", []), (None, []),
]


def test_tokens(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CASES)], "i int, s string")
    got = {r["i"]: r["t"] for r in df.select("i", text.tokens("s").alias("t")).collect()}
    for i, (s, want) in enumerate(CASES):
        assert got[i] == want
        assert text.tokens_py(s or "") == want


def test_unfolded_tokens_keep_accents(spark):
    df = spark.createDataFrame([("Café d'Or",)], "s string")
    assert df.select(text.tokens("s", False)).first()[0] == ["café", "dor"]


def test_forms(spark):
    df = spark.createDataFrame([("  O'Réal-ty  ", " +Foo\t  \"bar\" ")], "a string, b string")
    r = df.select(text.term("a"), text.phrase("b")).first()
    assert tuple(r) == ("oreal ty", '+foo "bar"')


def test_roots():
    assert root_words(["wolves", "running", "stories", "tables", "mice", "cats", "sing"])[7:] == ["wolf", "wolfe", "runn", "runne", "run", "story", "table", "tabl", "mouse"]
    assert "run" in root_words(["running"])
    assert root_words(["cat"]) == ["cat"]
    assert "happy" in risky_roots("happily") and risky_roots("cat") == []
    assert "making" in morph_forms("make") and "running" in morph_forms("run") and morph_forms("ab") == []


def test_distance(spark):
    pairs = [("ca", "abc", 3), ("abcd", "badc", 2), ("einstien", "einstein", 1), ("", "ab", 2), ("ab", "", 2), ("same", "same", 0)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    for r in df.select("d", osa_column(F.col("a"), F.col("b")).alias("got")).collect():
        assert r["d"] == r["got"]
    for a, b, d in pairs:
        assert osa(a, b) == d


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 1 << 20), unique=True))
def test_positions_round_trip(xs):
    assert decode_positions(encode_positions(sorted(xs))) == sorted(xs)
    assert decode_positions(None) == [] and decode_positions(b"") == []


def test_parser():
    n = normalizer(True)
    q = parse('+wolf -"big bad" "red hood" pre* a-b* 3.14 word^2.5 -cat AT&T -"one"', n)
    assert q.required == ["wolf", "red", "hood", "3", "14"] and q.optional == ["a", "word", "att"] and q.excluded == ["cat", "one"]
    assert q.excluded_phrases == [["big", "bad"]] and q.required_phrases == [["red", "hood"], ["3", "14"]]
    assert q.optional_prefixes == {"pre": 1.0, "b": 1.0} and q.boosts == {"word": 2.5}
    assert parse("AT&T", n, strict_sanitize=False).optional == ["at", "t"]
    assert parse("3.14", n, compound_numbers="words").required == []
    assert parse("a +a -b b 0", n).required == ["a"] and parse("a +a -b b 0", n).optional == ["0"]
    assert parse(None, n).empty and parse("-x", n).empty and parse("***^^", n).empty
    with pytest.raises(ValueError):
        Knobs().with_({"nonsense": 1})
    with pytest.raises(ValueError):
        Knobs().with_({"auto_default_algo": "auto"})
