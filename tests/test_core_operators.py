import pytest
from pyspark.sql import functions as F

from quern.operators.combine import combine_by_key
from quern.operators.doc_counts import count_differences
from quern.operators.skew import join_key_values
from quern.plans.live import live_postings, recorded_doc_freq


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_combine_matches_brute_force_with_a_hot_key(spark):
    data = [("hot" if i % 3 else f"k{i}", i % 7, float(i)) for i in range(3000)] + [(None, 1, None)]
    df = spark.createDataFrame(data, "k string, d int, v double").withColumn("k0", F.lit("clash")).withColumn("count", F.lit(9))
    got = {r["key"]: (r["n"], r["total"]) for r in combine_by_key(df, {"key": "k"}, {"n": ("count", F.lit(1)), "total": ("sum", "v")}).collect()}
    want = {}
    for k, _, v in data:
        n, t = want.get(k, (0, None))
        want[k] = (n + 1, t if v is None else (t or 0) + v)
    assert got == want


def test_combine_distinct_empty_and_errors(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, None)], "k string, d int")
    assert rows(combine_by_key(df.where("k is not null"), {"k": "k"}, {"n": ("count", F.lit(1))}, distinct={"d": "d"})) == [("a", 2)]
    assert combine_by_key(df.limit(0), {"k": "k"}, {"n": ("count", F.lit(1))}).count() == 0
    with pytest.raises(ValueError):
        combine_by_key(df, {"k": "k"}, {"m": ("median", "d")})
    with pytest.raises(ValueError):
        combine_by_key(df, {"k": "k"}, {"k": ("count", "d")})


@pytest.mark.parametrize("heaviest", [1, 2, 100])
def test_skew_join(spark, heaviest):
    left = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2), (None, 3), ("z", 4)], "k string, i int")
    right = spark.createDataFrame([("a", 50, "A"), ("b", 1, "B"), ("c", 1, "C")], "k string, n long, v string")
    got = rows(join_key_values(left, right, ["k"], "n", heaviest).select("k", "i", "v"))
    assert got == rows(left.join(right, "k").select("k", "i", "v"))


POSTINGS = "segment int, field string, term string, doc_id long, freq int, pos array<int>, loaded_at timestamp"


def test_live_postings(spark):
    import datetime as dt

    old, new = dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2)
    data = [
        (0, "title", "Café", 1, 2, [0], new), (0, "title", "Café", 1, 2, [0], new), (0, "title", "café", 1, 1, None, new), (0, "title", "old", 1, 5, [0], old),
        (0, "title", " - ", 1, 5, [0], new), (0, "title", "x", 1, 0, [0], new), (0, "title", "x", 1, None, [0], new), (0, "title", None, 1, 1, [0], new),
        (0, "opening", "gone", 2, 1, [0], new), (0, "opening", "y", None, 1, [0], new), (0, "opening", "late", 3, 1, [0], None), (1, "opening", "ok", 3, 4, [1], old),
    ]
    p = spark.createDataFrame(data, POSTINGS)
    lens = spark.createDataFrame([(1, 0), (1, 0), (3, 0), (None, 1)], "doc_id long, segment int")
    assert rows(live_postings(p, lens)) == [("opening", "ok", 3, 4), ("title", "cafe", 1, 3)]
    assert live_postings(p.limit(0), lens).count() == 0 and live_postings(p, lens.limit(0)).count() == 0
    stats = spark.createDataFrame([(0, "title", "Cafe", 1, 1.0), (0, "title", "Cafe", 1, 1.0), (1, "title", "left", 2, None), (0, "opening", "ok", None, None), (0, "opening", "", 5, None)], "segment int, field string, term string, doc_freq long, idf double")
    found = count_differences(live_postings(p, lens), recorded_doc_freq(stats))
    assert rows(found) == [("opening", "ok", 1, 0), ("title", "left", 0, 2)]


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from quern.scratch import root

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://a:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError):
            root(session(master))
    assert root(session("local[4]")).startswith("file://") and root(session("local")).startswith("file://")
