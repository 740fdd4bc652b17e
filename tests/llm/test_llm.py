import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quern.llm")

from quern.functions import text  # noqa: E402
from quern.llm.distinctive_terms import most_distinctive, term_scores, word_degrees  # noqa: E402
from quern.llm.heavy_hitters import PrefixSketch, heavy_hitters  # noqa: E402
from quern.llm.link_groups import link_groups  # noqa: E402
from quern.llm.mixing import fly, land, mix_sources, plan_shares, reached_shares, read_targets  # noqa: E402
from quern.llm.packing import MOST_CAPACITY, pack, plan_bins  # noqa: E402
from quern.llm.rank_sketch import RankSketch, merge_sketches, quantiles, relative_error, sketches  # noqa: E402
from quern.llm import subjects  # noqa: E402
from quern.llm.subjects import document_subjects, read_vocabulary, sentences  # noqa: E402
from quern.llm.term_frequencies import mark_terms, term_frequencies  # noqa: E402
from quern.scratch import Scratch  # noqa: E402
from quern.llm.token_counts import TOKENIZERS, encoder, token_count  # noqa: E402
from quern.llm.top_items import _top_of_file, cluster_by_group, skipped_row_groups, top_of_clustered, top_per_group  # noqa: E402


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


# 1


@pytest.mark.parametrize("leaf_rows", [5, 1000])
def test_term_frequencies(spark, leaf_rows):
    """Small leaves force splits by the term's bits and, for the hot term, by the record's."""
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.4 else f"t{rng.randrange(40)}", rng.randrange(60), rng.randrange(1, 4), "clash") for _ in range(600)]
    data += [(None, 1, 1, ""), ("noid", None, 5, ""), ("hot", 1, None, "")]
    df = spark.createDataFrame(data, "t string, d long, n int, radix string")
    vocabulary = spark.createDataFrame([("absent",), ("hot",), (None,)], "term string")
    got = {r["term"]: (r["occurrences"], r["doc_freq"]) for r in term_frequencies(df, "t", "d", "n", vocabulary, leaf_rows).collect()}
    want = {}
    for t, d, n, _ in data:
        if t is not None:
            c, ds = want.setdefault(t, [0, set()])
            want[t] = [c + (n or 0), ds | ({d} if d is not None else set())]
    assert got == {t: (c, len(ds)) for t, (c, ds) in want.items()} | {"absent": (0, 0)}


def test_a_hot_term_is_split_by_levels(spark, monkeypatch):
    """By its bits, by further bits, and by the record's: three jobs of writing, however many partitions are too large."""
    levels = []
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, *by, **k: (levels.append(by), write(self, df, *by, **k))[1])
    df = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 300)).alias("t"), "id")
    got = {r["term"]: r["doc_freq"] for r in term_frequencies(df, "t", "id", leaf_rows=100).collect()}
    assert got == {"hot": 1500} | {f"t{i}": 10 for i in range(1, 300, 2)}
    assert levels == [("part", "radix")] * 3 + [()]


def test_term_frequencies_empty_and_marks(spark):
    none = spark.createDataFrame([], "t string, d long")
    assert term_frequencies(none, "t", "d").count() == 0
    f = spark.createDataFrame([("a", 9, 2), ("b", 9, 3), ("c", 9, 6), ("d", 0, 0)], "term string, occurrences long, doc_freq long")
    assert {r["term"]: r["mark"] for r in mark_terms(f, 20).collect()} == {"a": "rare", "b": None, "c": "common", "d": "rare"}


# 2


def components(links):
    group = {}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        if a and b and a != b:
            group.setdefault(a, a), group.setdefault(b, b)
            x, y = sorted((root(a), root(b)))
            group[y] = x
    return sorted((w, root(w)) for w in group)


@pytest.mark.parametrize("kind", ["random", "chain", "star", "cycle"])
def test_link_groups(spark, kind):
    rng = random.Random(3)
    n = 60
    links = {
        "random": [(f"w{rng.randrange(90):03}", f"w{rng.randrange(90):03}") for _ in range(70)],
        "chain": [(f"c{i:03}", f"c{i + 1:03}") for i in range(n)],
        "star": [("m", f"s{i}") for i in range(n)] + [("é", "z"), ("z", "Z")],
        "cycle": [(f"k{i}", f"k{(i * 7 + 1) % n}") for i in range(n)],
    }[kind]
    links += [(None, "a"), ("", "b"), ("solo", "solo"), links[0], links[0][::-1]]
    df = spark.createDataFrame([(a, b, "x") for a, b in links], "a string, b string, c string")
    assert rows(link_groups(df, "a", "b")) == sorted(components(links), key=repr)


def test_link_groups_without_links(spark):
    df = spark.createDataFrame([(None, "a"), ("b", "b")], "a string, b string")
    assert link_groups(df, "a", "b").count() == 0 and link_groups(df.limit(0), "a", "b").columns == ["word", "group_word"]


# 3


@pytest.mark.parametrize("kind", ["lognormal", "ascending", "few"])
def test_rank_error_of_merged_sketches(kind):
    rng = np.random.default_rng(5)
    x = {"lognormal": rng.lognormal(size=200_000), "ascending": np.arange(200_000.0), "few": rng.integers(0, 9, 200_000).astype(float)}[kind]
    parts = [RankSketch() for _ in range(16)]
    for p, own in zip(parts, np.array_split(x, 16)):
        for y in np.array_split(own, 7):
            p.update(y)
    whole = RankSketch()
    for p in parts:
        whole.merge(RankSketch.from_bytes(p.to_bytes()))
    assert whole.n == len(x) and whole.low == x.min() and whole.high == x.max() and len(whole.to_bytes()) < 80_000
    s = np.sort(x)
    for q, v in zip((0.05, 0.5, 0.95, 0.99, 0.9999), whole.quantiles((0.05, 0.5, 0.95, 0.99, 0.9999))):
        below, upto = np.searchsorted(s, v, "left") / len(x), np.searchsorted(s, v, "right") / len(x)
        assert max(0, below - q, q - upto) <= relative_error() * (1 - q) + 3 * 0.084 / 50 * (q < 0.5) + 1e-5


def test_small_sketches_are_exact():
    s = RankSketch()
    assert s.quantiles([0.5]) == [None]
    s.update(np.array([5.0, 1.0, 3.0]))
    s.update(np.array([]))
    assert s.quantiles([0, 0.34, 0.5, 1]) == [1.0, 3.0, 3.0, 5.0]
    with pytest.raises(ValueError):
        s.merge(RankSketch(8))
    with pytest.raises(ValueError):
        RankSketch.from_bytes(b"\x09" + s.to_bytes()[1:])


@pytest.mark.parametrize("max_groups,fan_in", [(20_000, 64), (2, 2)])
def test_sketches_of_groups_and_days(spark, max_groups, fan_in):
    data = [("a" if i % 3 else "b", i % 2, float(i)) for i in range(900)] + [("a", 0, float("nan")), ("a", 0, None), (None, None, 7.0)]
    df = spark.createDataFrame(data, "k string, day int, v double").withColumn("part", F.lit("clash")).repartition(5)
    daily = merge_sketches(sketches(df, {"k": "k", "day": "day"}, "v", max_groups=max_groups), ["k", "day"], fan_in)
    got = {r["k"]: (r["n"], r["quantiles"][0]) for r in quantiles(merge_sketches(daily, ["k"]), ["k"], [0.5]).collect()}
    want = {k: sorted(v for x, _, v in data if x == k and v is not None and v == v) for k in ("a", "b", None)}
    for k, vs in want.items():
        assert got[k][0] == len(vs) and abs(np.searchsorted(vs, got[k][1]) - len(vs) / 2) <= 0.02 * len(vs) + 1
    assert quantiles(merge_sketches(sketches(df.limit(0), {"k": "k"}, "v"), ["k"]), ["k"], [0.5]).count() == 0


# 4


def brute_degrees(words, window):
    near = {}
    for i, a in enumerate(words):
        if a is not None:
            near.setdefault(a, set())
            for b in words[max(0, i - window + 1) : i + window]:
                if b is not None and b != a:
                    near[a].add(b)
    return {a: (words.count(a), len(s)) for a, s in near.items()}


def test_word_degrees_and_scores(spark):
    rng = random.Random(2)
    docs = {i: [rng.choice("abcdefgh") for _ in range(n)] for i, n in enumerate((0, 1, 5, 40, 400))} | {9: ["x", None, "x", "y"]}
    df = spark.createDataFrame([*docs.items(), (10, None), (None, ["q"])], "id long, w array<string>").withColumn("term", F.lit("clash"))
    got = word_degrees(df, "id", "w")
    for d, words in docs.items():
        assert {r["term"]: (r["freq"], r["degree"]) for r in got.where(F.col("id") == d).collect()} == brute_degrees(words, 4)
    scores = term_scores(got, "id", "term", "degree", 6)
    df_of = {t: sum(t in w for w in docs.values()) for t in "abcdefghxy"}
    for r in scores.collect():
        assert r["doc_freq"] == df_of[r["term"]] and r["score"] == pytest.approx(r["weight"] * math.log(6.5 / (r["doc_freq"] + 0.5) + 1), abs=1e-6)
    assert term_scores(got.limit(0), "id", "term", "degree", 0).count() == 0


def test_word_degrees_of_records_of_several_rows_and_columns(spark):
    parts = [(1, "x", "a b c".split()), (1, "x", "b c d".split()), (1, "y", "a a b".split()), (2, "x", "a b c".split()), (1, "x", "a b c".split())]
    got = rows(word_degrees(spark.createDataFrame(parts, "id long, f string, w array<string>"), ["id", "f"], "w", 2))
    assert got == sorted([(1, "x", "a", 2, 1), (1, "x", "b", 3, 2), (1, "x", "c", 3, 2), (1, "x", "d", 1, 1), (1, "y", "a", 2, 1), (1, "y", "b", 1, 1), (2, "x", "a", 1, 1), (2, "x", "b", 1, 2), (2, "x", "c", 1, 1)], key=repr)


def test_scores_within_fields(spark):
    w = spark.createDataFrame([(1, "x", "a", 2), (1, "y", "a", 3), (2, "x", "a", 1), (2, None, "a", 1)], "id long, f string, t string, w int")
    got = {(r["id"], r["f"]): r["doc_freq"] for r in term_scores(w, "id", "t", "w", 2, within=["f"]).collect()}
    assert got == {(1, "x"): 2, (2, "x"): 2, (1, "y"): 1}


def test_most_distinctive_ties(spark):
    s = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (1, "c", 1.0), (2, "z", 0.0)], "id long, term string, score double")
    assert rows(most_distinctive(s, "id")) == [(1, "a", 2.0), (2, "z", 0.0)]


# 5


def test_heavy_hitters(spark):
    rng = random.Random(4)
    data = [(i, "top" if i % 3 == 0 else f"mid{i % 40}" if i % 3 == 1 else f"rare{rng.randrange(10**9)}") for i in range(6000)]
    data += data[:2000] + [(None, "top"), (None, "top"), (-1, None)]
    df = spark.createDataFrame(data, "id long, q string").withColumn("v", F.lit("clash"))
    counts = {}
    for i, q in {(i, q) for i, q in data if i is not None and q is not None}:
        counts[q] = counts.get(q, 0) + 1
    counts["top"] += 2
    total = sum(counts.values())
    got = {r["value"]: (r["count"], r["total"]) for r in heavy_hitters(df, "q", 0.005, once_by="id").collect()}
    assert got == {q: (n, total) for q, n in counts.items() if n >= 0.005 * total} and len(got) > 20
    assert heavy_hitters(df.limit(0), "q", 0.01).count() == 0 and heavy_hitters(df.where("q is null"), "q", 0.01).count() == 0
    assert rows(heavy_hitters(df, "q", 0.3), "value") == [("top",)]
    # a smaller share takes more counters, down to a limit
    assert {r["value"] for r in heavy_hitters(df, "q", 0.0005, once_by="id").collect()} == {q for q, n in counts.items() if n >= 0.0005 * total}
    for share in (0, 1e-9, 2):
        with pytest.raises(ValueError):
            heavy_hitters(df, "q", share)


def test_sketch_adds_up():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    whole, a, b = PrefixSketch(), PrefixSketch(), PrefixSketch()
    ones = np.ones(len(h), np.int64)
    whole.add(h, ones), a.add(h[:2000], ones[:2000]), b.add(h[2000:], ones[2000:])
    for x, y, z in zip(whole.counts, a.counts, b.counts):
        assert (x == y + z).all()
    other = PrefixSketch()
    other.load(list(whole.slices()))
    assert all((x == y).all() for x, y in zip(whole.counts, other.counts))


# 6


@pytest.mark.parametrize("n", [1, 3, 50])
def test_top_per_group(spark, n, monkeypatch):
    monkeypatch.setattr("quern.llm.top_items.ROW_GROUP_BYTES", 2048)
    rng = random.Random(6)
    data = [("f", "hot" if rng.random() < 0.4 else f"t{rng.randrange(30)}", rng.choice([1.0, 1.0, 2.0, 5.0, float(i % 17)]), i) for i in range(4000)]
    data += [("f", None, 1.0, 1), (None, None, 2.0, 2), ("f", "odd", None, 1), ("f", "odd", float("nan"), 0), ("f", "odd", 1.0, None), ("f", "odd", 1.0, 7), ("f", "dup", 1.0, 5), ("f", "dup", 1.0, 5)]
    df = spark.createDataFrame(data, "field string, t string, s double, i long").withColumn("g", F.lit("clash"))
    got = rows(top_per_group(df, ["field", "t"], "s", "i", n))
    want, key = [], lambda r: ((r[2] is None, -(r[2] or 0)), (r[3] is None, r[3] or 0))
    clean = [(f, t, None if s is None or s != s else s, i) for f, t, s, i in data]
    for g in {(f, t) for f, t, *_ in clean}:
        want += [(*g, r[3], r[2]) for r in sorted((r for r in clean if r[:2] == g), key=key)[:n]]
    assert got == sorted(want, key=repr)


def test_top_of_nothing(spark):
    df = spark.createDataFrame([], "g string, s double, i long")
    assert top_per_group(df, ["g"], "s", "i", 3).count() == 0
    with pytest.raises(ValueError):
        top_per_group(df, ["g"], "s", "i", 0)


# 8


@pytest.mark.parametrize("capacity", [10, 100, 4096])
def test_plan_bins(capacity):
    rng = random.Random(capacity)
    histogram = {}
    for _ in range(3000):
        s = min(capacity, max(1, int(rng.expovariate(5 / capacity)) + 1))
        histogram[s] = histogram.get(s, 0) + 1
    runs, bins = plan_bins(histogram, capacity)
    fill, placed = [0] * bins, {}
    for size, a, b, first, per in runs:
        assert a == placed.get(size, 0)
        placed[size] = b
        for r in range(b - a):
            fill[first + r // per] += size
    assert placed == histogram and max(fill) <= capacity and min(fill) > 0
    least = math.ceil(sum(s * n for s, n in histogram.items()) / capacity)
    assert bins <= 11 / 9 * least + 1
    assert plan_bins({}, capacity) == ([], 0)


def test_pairs_are_as_many_as_can_be():
    for sizes in itertools.combinations_with_replacement([4, 5, 6, 7, 8, 9], 5):
        histogram = {s: sizes.count(s) for s in set(sizes)}
        _, bins = plan_bins(histogram, 11)
        # brute force over pairings
        best = len(sizes)
        for k in (1, 2):
            for pairs in itertools.combinations(itertools.combinations(range(5), 2), k):
                used = [i for p in pairs for i in p]
                if len(set(used)) == 2 * k and all(sizes[a] + sizes[b] <= 11 for a, b in pairs):
                    best = min(best, 5 - k)
        assert bins == best


def test_pack(spark, monkeypatch):
    monkeypatch.setattr("quern.llm.packing.ROWS_PER_TASK", 7)
    rng = random.Random(8)
    data = [(i, rng.choice([3, 3, 3, rng.randrange(1, 400)])) for i in range(300)] + [(300, 0), (301, None), (302, -4), (None, 5), (7, 3), (7, 3), (303, 1000)]
    df = spark.createDataFrame(data, "id long, n int").withColumn("bin", F.lit("clash"))
    out = pack(df, "id", "n", [(1, 100), (2, 1000)]).collect()
    for p, c in ((1, 100), (2, 1000)):
        own = [r for r in out if r["pack_id"] == p]
        fill, got = {}, {}
        for r in own:
            if r["bin_id"] is not None:
                fill[r["bin_id"]] = fill.get(r["bin_id"], 0) + r["size"]
            got.setdefault(r["id"], []).append(r)
        assert max(fill.values()) <= c and set(fill) == set(range(len(fill)))
        assert len(fill) <= 1.25 * sum(fill.values()) / c + 2
        for i in {i for i, _ in data}:
            want = sorted(max(0, n or 0) for j, n in data if j == i)
            assert sum(r["size"] for r in got[i]) == sum(want)
            if len(want) == 1:
                parts = sorted(got[i], key=lambda r: r["part"])
                assert len(parts) == max(1, math.ceil(want[0] / c)) and [r["first_token"] for r in parts] == [k * c for k in range(len(parts))]
        assert [r["bin_id"] for r in got[300] + got[301] + got[302]] == [None] * 3
    assert pack(df.limit(0), "id", "n", [(1, 10)]).count() == 0 and pack(df, "id", "n", []).count() == 0
    for capacity in (0, MOST_CAPACITY + 1):
        with pytest.raises(ValueError):
            pack(df, "id", "n", [(1, capacity)])


def test_a_large_capacity_is_packed_in_single_units(spark):
    n = [50_001, 49_999, 70_000, 30_000, 99_999, 1]
    out = pack(spark.createDataFrame(list(enumerate(n)), "id long, n int"), "id", "n", [(1, 100_000)]).collect()
    assert len({r["bin_id"] for r in out}) == 3 and sorted(r["size"] for r in out) == sorted(n)


def test_token_counts(spark):
    texts = [None, "", "hello world", "naïve   café\n\n", "x" * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        got = [r[0] for r in df.select(token_count("t", name)).collect()]
        assert got[:2] == [0, 0] and got[2] in (2, 3) and got[4] > 10
    both = [len(encoder(f"{TOKENIZERS}/{n}")(texts[3])) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json")]
    assert both[0] == both[1]
    with pytest.raises(ValueError):
        encoder("none.txt")


# 9


def test_flight_keeps_sums():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 10, 1001):
        t, p = rng.integers(1, 500, n).astype(float), np.full(n, 0.37)
        q = fly(t, p, rng)
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs(q @ t - p @ t) < 1e-3
        done = land(t, p, rng)
        assert set(done) <= {0.0, 1.0}
        if n > 100:
            assert abs(done @ t - p @ t) <= 500
    chosen = np.mean([fly(np.array([3.0, 1, 4, 1, 5]), np.full(5, 0.4), np.random.default_rng(s))[:3] for s in range(3000)], axis=0)
    assert np.abs(chosen - 0.4).max() < 0.04  # chances are kept on average


def test_plan_shares():
    got = plan_shares([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)], {"a": 1000, "b": 50})
    assert got["a"] == (525.0, 0.525) and got["b"] == (315.0, 2.0) and got["c"][1] == 0.0


def test_mix_sources(spark, monkeypatch):
    rng = random.Random(9)
    data = [(i, "big" if i % 3 else "small" if i % 2 else "tiny", rng.randrange(1, 300), 1) for i in range(4000)] + [(5000, None, 10, 1), (5001, "big", None, 1), (5002, "big", 0, 1), (5003, "unwanted", 50, 1), (5004, "big", 60_000, 1)]
    df = spark.createDataFrame(data, "id long, src string, n int, copies int").repartition(6)
    targets = read_targets(spark.createDataFrame([("big", 0.2, 1), ("small", 0.5, 4), ("tiny", 0.29, 2), ("tiny", 0.29, 2), ("none", 0.01, 3), (None, 1.0, 1), ("bad", -1.0, None)], "s string, w double, m int"), "s", "w", "m")
    assert ("bad", 0.0, 1) in targets and len(targets) == 5
    out = mix_sources(df, "id", "src", "n", targets, total=300_000)
    got = {r["id"]: r["copies"] for r in out.collect()}
    assert len(got) == len(data) == out.count()
    assert [got[i] for i in (5000, 5001, 5002, 5003)] == [0] * 4
    have = {s: sum(n or 0 for _, x, n, _ in data if x == s) for s in ("big", "small", "tiny")}
    for s, share, repeats in (("big", 0.2, 1), ("small", 0.5, 4), ("tiny", 0.29, 2)):
        use = min(300_000 * share / have[s], repeats)
        mixed = sum(got[i] * (n or 0) for i, x, n, _ in data if x == s)
        assert {got[i] for i, x, n, _ in data if x == s and n} <= {math.floor(use), math.ceil(use)}
        assert abs(mixed - use * have[s]) <= 300
    report = {r["src"]: r for r in reached_shares(out, "src", "n", targets).collect()}
    assert abs(sum(r["reached_share"] for r in report.values()) - 1) < 1e-9 and report["none"]["records"] == 0 and report["small"]["most_copies"] <= 4
    assert {r["id"]: r["copies"] for r in mix_sources(df.repartition(3), "id", "src", "n", targets, total=300_000).collect()} == got
    monkeypatch.setattr("quern.llm.mixing.BUCKET_ROWS", 300)
    few = mix_sources(df, "id", "src", "n", targets, total=300_000)
    assert few.where("src = 'small'").agg(F.abs(F.sum(F.expr("n * copies")) - min(150_000, 4 * have["small"]))).first()[0] <= 300
    empty = mix_sources(df.limit(0), "id", "src", "n", targets)
    assert empty.count() == 0 and reached_shares(empty, "src", "n", targets).count() == 5
    assert {r["copies"] for r in mix_sources(df, "id", "src", "n", []).collect()} == {0}


# 10


def test_sentences():
    got = sentences("<p>Caf&eacute; opens. It&nbsp;closes at 9!</p> <p>Home | Help</p>\n[[Category:X]] {{stub}}\n\nMore text")
    assert got == [["cafe", "opens"], ["it", "closes", "at"], ["more", "text"]]
    assert sentences(None) == [] == sentences("  \n ")
    assert sentences(f"one <a href='{'x' * 5000}'> two <b> 3 < 4 and 5 > 2") == [["one"], ["two"], ["and"]]


def test_row_groups_of_a_full_group_are_skipped(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows_ = [("a", float(s), s) for s in range(9, 3, -1)] + [("b", 2.0, 1), ("c", 1.0, 1)]
    path = str(tmp_path / "f.parquet")
    pq.write_table(pa.table({"g": [r[0] for r in rows_], "s": [r[1] for r in rows_], "i": [r[2] for r in rows_]}), path, row_group_size=2)
    seen = {}
    got = [r for b in _top_of_file("file://" + path, 2, seen) for r in b.to_pylist()]
    assert [(r["g"], r["s"]) for r in got] == [("a", 9.0), ("a", 8.0), ("b", 2.0), ("c", 1.0)]
    assert seen == {"row_groups": 4, "skipped": 2, "rows": 8, "rows_read": 4}


def test_most_of_a_large_group_is_never_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quern.llm.top_items.ROW_GROUP_BYTES", 4096)
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 997)).alias("g"), (F.xxhash64("id") % 1000).alias("s"), "id")
    uri = f"file://{tmp_path}/clustered"
    cluster_by_group(df, ["g"], "s", "id", uri)
    r = skipped_row_groups(spark, uri, 3).agg(*(F.sum(c).alias(c) for c in ("row_groups", "skipped", "rows", "rows_read"))).first()
    assert r["rows"] == 60_000 and 0 < r["skipped"] < r["row_groups"] and r["rows_read"] < 50_000
    for n in (1, 3):
        assert rows(top_of_clustered(spark, uri, {"g": "string"}, "s", "id", n)) == rows(top_per_group(df, ["g"], "s", "id", n))


def test_document_subjects_on_made_texts(spark):
    words = {"birds": "wing feather nest beak egg flight song perch".split(), "cars": "wheel engine brake road tyre gear clutch driver".split(), "bread": "flour yeast oven dough crust loaf bake knead".split()}
    rng = random.Random(10)

    def sentence(s):
        return f"The {rng.choice(words[s])} is near the {rng.choice(words[s])} with a {rng.choice(words[s])}."

    filler = "This page was last seen on a day in the year."
    docs, labels, truth = [], [], {}
    for i in range(420):
        a, b = rng.sample(list(words), 2)
        kind = i % 4
        parts = [sentence(a) for _ in range(6)] + {0: [], 1: [sentence(b) for _ in range(5)], 2: [sentence(b)], 3: [filler] * 2}[kind]
        rng.shuffle(parts)
        docs.append((i, " ".join(parts), "en"))
        truth[i] = {a, b} if kind == 1 else {a}
        if i % 6 == 0:
            labels += [(i, s.upper() + " ") for s in truth[i]]
    docs += [(1000, None, "en"), (1001, " ", None), (1002, " ".join([filler] * 8), "en"), (1003, "wing", "en")]
    df = spark.createDataFrame(docs, "id long, text string, lang string").withColumn("subject", F.lit("clash"))
    known = spark.createDataFrame([*labels, (None, "birds"), (3, None), (5, "unknown")], "id long, subject string")
    got = {}
    for r in document_subjects(df, "id", "text", "lang", known, sorted(words)).collect():
        got.setdefault(r["id"], set()).add(r["subject"])
    held = [i for i in truth if i % 6]
    assert sum(got.get(i) == truth[i] for i in held) / len(held) >= 0.9
    assert not {1000, 1001, 1002} & set(got)
    assert document_subjects(df.limit(0), "id", "text", "lang", known, sorted(words)).count() == 0
    assert document_subjects(df, "id", "text", "lang", known.limit(0), sorted(words)).count() == 0


def made_text(rng, subject):
    return " ".join(f"The {rng.choice('abcdefgh')}{subject} is near the {rng.choice('abcdefgh')}{subject} with a {rng.choice('abcdefgh')}{subject}." for _ in range(6))


@pytest.mark.parametrize("third", ["copies", "subject"])
def test_document_subjects_where_one_text_or_subject_is_a_third(spark, third):
    rng = random.Random(11)
    subjects = [f"{a}olo" for a in "bdfgklmprs"]
    docs = [(i, made_text(rng, s := subjects[0] if third == "subject" and i % 3 == 0 else rng.choice(subjects)), "en", s) for i in range(400)]
    if third == "copies":
        docs += [(1000 + i, docs[1][1], "en", docs[1][3]) for i in range(200)]
    df = spark.createDataFrame(docs, "id long, text string, lang string, truth string").drop("truth")
    known = spark.createDataFrame([(i, s) for i, _, _, s in docs if i < 400 and i % 5 == 0], "id long, subject string")
    got = {}
    for r in document_subjects(df, "id", "text", "lang", known, subjects).collect():
        got.setdefault(r["id"], set()).add(r["subject"])
    assert sum(got.get(i) == {s} for i, _, _, s in docs) / len(docs) >= 0.95


def subject_case(spark):
    rng = random.Random(12)
    names = [f"{a}olo" for a in "bdfgkl"]
    docs = [(i, made_text(rng, rng.choice(names)), "en") for i in range(300)]
    truth = {i: next(s for s in names if s in t) for i, t, _ in docs}
    known = spark.createDataFrame([(i, truth[i]) for i in truth if i % 5 == 0], "id long, subject string")
    return spark.createDataFrame(docs, "id long, text string, lang string"), known, names, truth


@pytest.mark.parametrize("few", [1_000_000, 2000, 0])
def test_subjects_come_through_the_leaves_of_the_tree(spark, few):
    """With one leaf there are none, whatever the labels say; passes over all texts and subtrees grown in tasks do the same."""
    df, known, names, truth = subject_case(spark)
    found = lambda **k: [(r["id"], r["subject"]) for r in document_subjects(df, "id", "text", "lang", known, names, few=few, **k).collect()]
    if few:
        assert found(depth=0) == []
    got = found(depth=5)
    assert sum(truth[i] == s for i, s in got) >= 0.97 * len(truth) and len(got) <= 1.03 * len(truth)


def test_words_of_one_hash_are_taken_for_one(spark):
    df, known, names, truth = subject_case(spark)
    got = {r["id"]: r["subject"] for r in document_subjects(df, "id", "text", "lang", known, names, bits=12).collect()}
    assert sum(got.get(i) == s for i, s in truth.items()) >= 0.9 * len(truth)
    with pytest.raises(ValueError):
        document_subjects(df, "id", "text", "lang", known, [str(i) for i in range(65)])


def test_splits_have_four_passes_of_means():
    assert subjects.MEAN_PASSES >= 4


def test_vocabulary_has_every_word_and_a_small_language(spark):
    texts = spark.range(14_000).select(F.when(F.col("id") < 60, "xx").otherwise("en").alias("lang"), F.when(F.col("id") < 1, F.array(F.lit(1), F.lit(2))).when(F.col("id") < 60, F.array(F.lit(2))).otherwise(F.array(F.lit(3))).alias("terms"))
    v = read_vocabulary(texts, 4)
    assert v.langs == ["en", "xx"] and v.docs[[1, 2, 3]].tolist() == [1, 60, 13_940] and v.docs.sum() == 14_001
    assert v.weight[2] == 0 == v.weight[3] and v.weight[1] > 2


def test_queries_run_on_the_smallest_tables(spark, small):
    from quern.llm.queries import QUERIES, SQL

    assert set(SQL) <= set(QUERIES) and {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 10)} <= set(QUERIES)
    for name in ("p1_found", "p6_found"):
        assert QUERIES[name](spark, small).count() > 0
    assert text.term is not None
