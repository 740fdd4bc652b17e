import pytest

import quern.search
from quern.operators import search_queries, study
from quern.operators.search_queries import WEIGHTS, document_index
from quern.plans import shards
from quern.plans.index import Index
from quern.plans.query import Profile
from quern.search import Searcher
from quern.sources.tables import table

ASKED = ["orchestra melody", "+electron laboratory cell", "libretto -melody", "electron^2 cell electron", "the", "nothinglikeit", "", 'cell "no such words"', "orch* melody", "fjord volley podium isotope", '"of the"', 'the -"of the"', '"the orchestra" "of the"', '"orchestra of the"']


@pytest.mark.parametrize("limit", [5000, 4])
def test_best_is_batch_search(spark, small, limit, monkeypatch):
    monkeypatch.setattr(shards, "RANGE_POSTINGS", 150)
    monkeypatch.setattr(shards, "PART_ROWS", 12)
    s = Searcher(document_index(spark, small), Profile(candidate_limit=limit))
    got = {(r["query_id"], r["algo"], r["rank"]): (r["doc_id"], r["title"], r["score"]) for r in s.best(ASKED, study.CONCRETE, 3, fields=WEIGHTS).collect()}
    want = {}
    for a in study.CONCRETE:
        hits = s.search_batch(ASKED, algo=a, per_page=3, fields=WEIGHTS).hits
        want |= {(r["query_id"], a, r["rank"]): (r["doc_id"], r["title"], r["score"]) for r in hits.collect()}
    assert len(want) > 40 and got == want


@pytest.mark.parametrize("query", ["leaf tea", '"tea leaf"', 'leaf -"tea leaf"', '"tea tea"', '"leaf tea leaf"', "+leaf -old", "tea*", "+lea* tea", "missing leaf", '"missing leaf"'])
def test_best_with_operators(spark, tmp_path, query):
    texts = ["tea leaf", "leaf tea", "tea tea leaf", "old leaf", "leaf tea leaf tea", "tea", None, "teas leafy old"]
    df = spark.createDataFrame([(i, f"title {i % 3}", t) for i, t in enumerate(texts)], "doc_id long, title string, body string")
    s = Searcher(Index.build(df, str(tmp_path / "i"), ["title", "body"], title="title"))
    got = [tuple(r) for r in s.best([query], ["bm25"], 10).orderBy("rank").select("rank", "doc_id", "title", "score").collect()]
    want = [tuple(r) for r in s.search_batch([query], algo="bm25", per_page=10).hits.orderBy("rank").select("rank", "doc_id", "title", "score").collect()]
    assert got == want


def test_throughput_is_one_pass(spark, small, monkeypatch):
    ran, real = [], quern.search.run
    monkeypatch.setattr(quern.search, "run", lambda *a: ran.append(1) or real(*a))
    monkeypatch.setattr(search_queries, "PART", 3)
    log = spark.createDataFrame([(50 * i, q) for i, q in enumerate(["orchestra", "+electron cell", '"orchestra melody"', "cell -electron", "orch*", "the", "zz"])], "id long, query string")
    monkeypatch.setattr(search_queries, "table", lambda s, folder, name: log if name == "search_log" else table(s, folder, name))
    got = {r["query"]: r["doc_id"] for r in search_queries.batch_throughput(spark, small).collect()}
    assert not ran
    s = Searcher(document_index(spark, small))
    asked = sorted(got)
    want = {asked[r["query_id"]]: r["doc_id"] for r in s.search_batch(asked, fields=WEIGHTS, per_page=1).hits.collect()}
    assert got == want and len(got) > 3


def test_best_of_nothing(spark, small):
    s = Searcher(document_index(spark, small))
    assert s.best([], ["bm25"], 3).collect() == [] and s.best(["", "nothinglikeit"], ["bm25", "rrf"], 3).collect() == []


def test_study_asks_all_algorithms_in_one_batch(spark, small, monkeypatch):
    planned, real = [], quern.search.plan_queries
    monkeypatch.setattr(quern.search, "plan_queries", lambda *a, **k: planned.append(1) or real(*a, **k))
    s = Searcher(document_index(spark, small))
    r = study.run_study(s, [("orchestra melody", "x", ["none"]), ("electron", "y", ["none"])], fields=WEIGHTS)
    assert len(planned) == 1 and r.count() == 2 * len(study.CONCRETE)


def test_run_diff_is_one_study(spark, small, monkeypatch):
    planned, real = [], quern.search.plan_queries
    monkeypatch.setattr(quern.search, "plan_queries", lambda *a, **k: planned.append(1) or real(*a, **k))
    d = study.QUERIES["run_diff"](spark, small)
    assert len(planned) == 1 and {r["algo"] for r in d.collect()} <= {"any"}
