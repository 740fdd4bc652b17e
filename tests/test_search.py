import math
import random

import pytest
from pyspark.sql import functions as F

from quern.plans.index import Index
from quern.plans.query import Profile
from quern.plans.small import small_table
from quern.search import Searcher, mark_snippet, read_terms
from quern.plans.query import normalizer

FILL = "harbour"


def build(spark, tmp_path, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, title string, body string")
    return Index.build(df, str(tmp_path / "index"), ["title", "body"], title="title", opening="body", **options)


def found(result):
    return [r["doc_id"] for r in result.scored.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """143 documents, so that the cut of frequent words is live."""
    rows = [f"lantern {FILL} extra"] * 12 + [f"paprika {FILL}"] * 8 + [f"paprika papyrus {FILL}"] * 4 + [f"paper {FILL}", f"lantren {FILL}", f"007 {FILL}", f"0 42 {FILL}"] + [FILL] * 115
    return build(spark, tmp_path_factory.mktemp("cut"), [(i, f"number {i}", b) for i, b in enumerate(rows)])


@pytest.fixture(scope="module")
def phrases(spark, tmp_path_factory):
    docs = [(1, "green tea", "a pot of green tea"), (2, "green", "tea"), (3, "pot", "green pot tea"), (4, "cup", "tea"), (5, "echo", "ping ping pong"), (6, "echo", "pong ping x ping"), (7, "well-known", "a well-known thing"), (8, "scatter", "known but not well")]
    both = {}
    for positions in (True, False):
        both[positions] = Searcher(build(spark, tmp_path_factory.mktemp(f"p{positions}"), docs, positions=positions))
    return both


def test_bm25_by_hand(spark, tmp_path):
    ix = build(spark, tmp_path, [(1, "x", "apple apple pear"), (2, "y", "pear"), (3, "z", "plum pear plum plum")])
    r = Searcher(ix, Profile(title_field=None)).search("apple pear", fields={"body": 1}, ranking={"proximity_weight": 0})
    n, avg = 3, 8 / 3
    idf = lambda df: math.log((n + 0.5) / (df + 0.5) + 1)
    part = lambda tf, dl, df: idf(df) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg)) + 0.5)
    want = {1: part(2, 3, 1) + part(1, 3, 3), 2: part(1, 1, 3), 3: part(1, 4, 3)}
    got = {x["doc_id"]: x["score"] for x in r.scored.collect()}
    for d in want:
        assert got[d] == pytest.approx(want[d] / max(want.values()) * 100, abs=1e-4)


def test_errors_and_empty_queries(spark, cut, tmp_path):
    s = Searcher(cut)
    for bad in ({"algo": "best"}, {"fields": {"nose": 1}}, {"ranking": {"k9": 1}}, {"colour": "red"}):
        with pytest.raises(ValueError):
            s.search("lantern", **bad)
    with pytest.raises(ValueError):
        Index.open(spark, str(tmp_path / "none"))
    for q in ("", None, f"-{FILL}", "!!!", "+-*^", "nosuchword"):
        r = s.search(q)
        assert found(r) == [] and r.hits.count() == 0
        assert r.totals().first()["total"] == 0
    assert s.search("lantern", fields={"body": 0}).hits.count() == 0


def test_cut_exclusion_and_broad_words(cut):
    s = Searcher(cut)
    assert len(found(s.search("lantern"))) == 12
    assert found(s.search(FILL)) == []  # in every document
    assert found(s.search(f"lantern -{FILL}")) == []
    r = s.search(f"+{FILL}", broad_cap=20)
    assert r.plans[0].truncated and 0 < len(found(r)) <= 40
    r = s.search(f"+lantern {FILL}")
    assert not r.plans[0].truncated and len(found(r)) == 12
    body = {"fields": {"body": 1}}
    assert found(s.search("0", **body)) == [27] and found(s.search("007", confidence=50, **body)) == [26]


def test_prefixes(cut):
    s = Searcher(cut)
    assert len(found(s.search("pap*"))) == 13
    assert len(found(s.search("pap*", max_wildcard=1))) == 12
    assert len(found(s.search("pap*", wildcard_budget=1))) == 12 and len(found(s.search("pap*", wildcard_budget=0))) == 13
    assert len(found(s.search("pap*", candidate_limit=5))) == 5
    assert found(s.search("pap* -papr*")) == [24]
    assert found(s.search("pap*", algo="idf"))[0] == 24  # the rarest completion counts, once
    assert set(found(s.search(f"+papy* {FILL}"))) == {20, 21, 22, 23}


def test_spelling_and_routes(cut):
    s = Searcher(cut)
    r = s.search("lantren", algo="auto", confidence=85, ranking={"swap_context_check": 0})
    assert r.plans[0].diag["typo_swaps"][0]["promoted"] == "lantern" and r.plans[0].algo == "freq"
    assert len(found(r)) == 13 and found(r)[-1] == 25
    assert len(found(s.search("lantrn", confidence=85))) >= 12
    assert found(s.search("lantrn")) == []
    assert s.search("how paprika", algo="auto").plans[0].algo == "freq"
    assert s.search("paprika lantern", algo="auto", confidence=85).plans[0].algo == "cover"
    assert s.search("pap*", algo="auto", ranking={"auto_wildcard_algo": "idf"}).plans[0].algo == "idf"


def test_stems_synonyms_derivations(spark, tmp_path):
    ix = build(spark, tmp_path, [(1, "wolves", "wolves running"), (2, "wolf", "a wolf runs"), (3, "canine", "canine creature"), (4, "music", "musician")])
    s = Searcher(ix)
    assert set(found(s.search("+wolves", stemming=True))) == {1, 2} and found(s.search("+wolves")) == [1]
    assert set(found(s.search("wolf", synonyms=[["wolf", "canine"]]))) == {2, 3}
    assert set(found(s.search("wolf -canine", synonyms=[["wolf", "canine"]]))) == {2}
    assert found(s.search("music", derivations=[["music", "musician"]], fields={"body": 1})) == [4]
    assert "running" in {e["term"] for e in s.search("runn", stemming=True).plans[0].diag.get("expansions", [])}
    assert found(s.search("the wolf", stopwords=["the"])) == [2]


def test_phrases(phrases):
    with_pos, without = phrases[True], phrases[False]
    assert found(with_pos.search('"green tea"')) == [1]
    assert set(found(without.search('"green tea"'))) == {1, 2, 3} == set(found(with_pos.search('"green tea"', phrase_mode="unordered")))
    assert set(found(with_pos.search('tea -"green tea"'))) == {2, 3, 4}
    assert set(found(without.search('tea -"green tea"'))) == {2, 4}
    assert found(with_pos.search('"ping ping pong"')) == [5]
    assert found(with_pos.search("well-known -scatter")) == [7] and found(with_pos.search('"well-known"')) == [7]
    for q in ("green", "tea pot", "ping -pong"):
        assert found(with_pos.search(q)) == found(without.search(q))


@pytest.mark.parametrize("algo", ["bm25", "bm25+cov", "bm25f", "rrf", "dfr", "cover", "idf", "freq"])
def test_every_algorithm_prefers_the_titled_document(phrases, algo):
    assert found(phrases[True].search("green tea", algo=algo))[0] == 1


def test_batch_equals_single_searches(cut):
    s = Searcher(cut)
    queries = ["lantern", "paprika papyrus", f"+lantern {FILL}", "pap*", "", "-x", "paper -paprika"]
    batch = s.search_batch(queries)
    rows = {}
    for r in batch.scored.collect():
        rows.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    for i, q in enumerate(queries):
        one = sorted((r["rank"], r["doc_id"], r["score"]) for r in s.search(q).scored.collect())
        assert sorted(rows.get(i, [])) == one


def test_knobs_change_scores_not_matches(phrases):
    s = phrases[True]
    a, b = s.search("green tea"), s.search("green tea", ranking={"k1": 0.3, "title_bonus_base": 1.0})
    assert set(found(a)) == set(found(b))


def test_pages_matches_and_snippets(cut, phrases):
    s = Searcher(cut)
    first, second = (s.search("lantern", per_page=5, page=p).hits.orderBy("rank").collect() for p in (1, 2))
    assert [r["rank"] for r in first] == [1, 2, 3, 4, 5] and [r["rank"] for r in second] == [6, 7, 8, 9, 10]
    assert "<mark>lantern</mark>" in first[0]["snippet"] and first[0]["matches"] == {"body": ["lantern"]}
    t = s.search("lantern", per_page=5).totals().first()
    assert (t["total"], t["pages"], t["capped"]) == (12, 3, False)
    assert mark_snippet("<b> don't & Café", ["dont", "cafe"], normalizer(True)) == "&lt;b&gt; <mark>don&#x27;t</mark> &amp; <mark>Café</mark>"
    assert mark_snippet("x" * 400, [], normalizer(True)).endswith("…") and mark_snippet(None, [], normalizer(True)) == ""


def test_index_contract(spark, tmp_path):
    df = spark.createDataFrame([("1", "first", ["Already", "split"], 2), ("1", "second", ["no"], 1), ("", "x", None, 3), (None, "y", None, 4), ("z", "bad id", None, 5)], "key string, title string, words array<string>, at int")
    ix = Index.build(df, str(tmp_path / "i"), ["title", "words"], doc_id="key", title="title", order_by="at", meta={"owner": "tests"})
    assert ix.read_meta("owner") == "tests" and ix.read_meta("none") is None and ix.doc_id_type() == "bigint"
    assert found(Searcher(ix).search("second")) == [1] and found(Searcher(ix).search("first")) == []
    with pytest.raises(ValueError):
        Index.build(df, str(tmp_path / "i"), ["title"], doc_id="key")
    for bad in (["Title"], ["1a"], [], ["a" * 40]):
        with pytest.raises(ValueError):
            Index.build(df, str(tmp_path / "j"), bad, doc_id="key")
    assert [r[0] for r in ix.get_term_list("title").collect()] == ["second"] and ix.get_fields() == ["title", "words"]
    empty = Index.build(df.limit(0), str(tmp_path / "e"), ["title"], doc_id="key")
    assert found(Searcher(empty).search("anything +more pre* \"a b\"")) == []


def test_upsert_delete_and_statistics(spark, tmp_path):
    ix = build(spark, tmp_path, [(1, "a", "apple"), (2, "b", "pear")])
    new = spark.createDataFrame([(2, "b", "plum"), (3, "c", "apple plum")], "doc_id long, title string, body string")
    stale = ix.upsert(new, title="title", opening="body", auto_stats=False)
    assert stale.field_stats["body"] == (2, 2) and set(found(Searcher(stale).search("apple"))) == {1, 3}
    fresh = stale.rebuild_stats()
    assert fresh.field_stats["body"] == (3, 4) and found(Searcher(fresh).search("pear")) == []
    # an index that was built at once has the same tables
    whole = build(spark, tmp_path / "w", [(1, "a", "apple"), (2, "b", "plum"), (3, "c", "apple plum")])
    for name in ("postings", "doclens", "termstats", "vocabulary"):
        cols = [c for c in whole.table(name).columns if c != "pos"]
        assert sorted(map(tuple, fresh.table(name).select(cols).collect())) == sorted(map(tuple, whole.table(name).select(cols).collect()))
    gone = fresh.delete(spark.createDataFrame([(1,)], "x long"), auto_stats=True)
    assert found(Searcher(gone).search("apple")) == [3]
    assert found(Searcher(Index.open(spark, ix.path)).search("apple")) == [3]
    gone.drop_old_versions()
    assert found(Searcher(Index.open(spark, ix.path)).search("apple")) == [3]


def test_plan_keeps_the_scan_narrow(cut):
    plan = Searcher(cut).search("lantern").scored._jdf.queryExecution().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
    assert "pos#" not in plan.split("== Physical Plan ==")[1]


def test_two_phase(spark, tmp_path):
    ix = build(spark, tmp_path, [(1, "apple", "x"), (2, "y", "apple")])
    s = Searcher(ix, Profile(heavy_fields=("body",)))
    assert found(s.search("apple", two_phase=True)) == [1] and set(found(s.search("apple"))) == {1, 2}
    assert set(found(s.search("+apple", two_phase=True))) == {1, 2}


def test_searches_read_only_row_groups_that_may_have_their_terms(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}word" for a in "abcdefghijklmnop" for b in "abcdefghij"]
    ix = build(spark, tmp_path, [(i, f"t{i}", " ".join(rng.choices(vocabulary, k=60))) for i in range(1500)])

    def read(pairs):
        """Pushed filters, and rows that the scan gave out; a plan without exchange is its own final plan."""
        df = read_terms(ix, pairs)
        assert df.count() <= ix.table("postings").count()
        plan = df._jdf.queryExecution().executedPlan()
        plan.execute().count()
        leaf = plan.collectLeaves().head()
        return leaf.toString(), leaf.metrics().apply("numOutputRows").value()

    every = ix.table("postings").where("field = 'body'").count()
    text_, rows_ = read([("body", "aaword"), ("body", "abword")])
    assert "PushedFilters" in text_ and "EqualTo(term" in text_ and "field" in text_.split("PartitionFilters", 1)[1].split("]")[0]
    assert rows_ <= every / 3
    text_, rows_ = read([("body", f"a{b}{i}") for b in "abcdefghij" for i in ["word", *range(30)]])
    assert "GreaterThanOrEqual(term" in text_ and rows_ <= every / 2
    assert read_terms(ix, []).count() == 0


def test_ranges_of_many_terms_hold_each(spark, cut, monkeypatch):
    monkeypatch.setattr("quern.search.EQUALITIES", 1)
    monkeypatch.setattr("quern.search.RANGES", 2)
    assert len(found(Searcher(cut).search("lantern paprika paper", fields={"body": 1.0}))) == 25


def test_pointers_are_never_overwritten(spark, tmp_path):
    ix = build(spark, tmp_path, [(1, "a", "one"), (2, "b", "two")])
    df = spark.createDataFrame([(3, "c", "three")], "doc_id long, title string, body string")
    first = ix.upsert(df, title="title", opening="body")
    # a writer that had read the version before is refused, and a reader still sees the last one
    with pytest.raises(RuntimeError):
        ix.upsert(df, title="title", opening="body")
    assert Index.open(spark, ix.path).meta["version"] == first.meta["version"] != ix.meta["version"]
    # the tables of the version that was open before are still there, and a pointer without content counts for nothing
    assert ix.table("documents").count() == 2
    (tmp_path / "index" / "pointers" / "000000000003").write_text("")
    assert Index.open(spark, ix.path).meta["version"] == first.meta["version"]
    assert Index.open(spark, ix.path).delete(df.select("doc_id")).table("documents").count() == 2


def test_too_large_batches_are_refused(spark, monkeypatch):
    monkeypatch.setattr("quern.plans.small.BROADCAST_ROWS", 3)
    assert small_table(spark, [(1,)] * 3, "x long").count() == 3
    with pytest.raises(ValueError):
        small_table(spark, [(1,)] * 4, "x long")


def test_a_word_in_most_documents(spark, tmp_path):
    """Ranks of a broad word's documents are limited before anything is shuffled."""
    ix = build(spark, tmp_path, [(i, f"t{i}", "common" + (" rare" if i % 100 == 0 else "")) for i in range(600)])
    r = Searcher(ix).search("+common rare", fields={"body": 1.0}, broad_cap=20)
    assert r.plans[0].truncated and sorted(found(r)) == sorted({*range(20), *range(0, 600, 100)})
    assert "WindowGroupLimit" in r.scored._jdf.queryExecution().toString()
