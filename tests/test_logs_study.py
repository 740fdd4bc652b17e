import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from quern.operators import logs, study
from quern.operators.lexicon import Lexicon, build_lexicon
from quern.plans.index import Index
from quern.search import Searcher
from quern.sources.dumps import read_articles, read_lexicon_zip, read_word_list
from quern.streaming.ingest import index_stream, log_windows


def test_lexicon(spark, tmp_path):
    path = tmp_path / "lex.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("noun.animal.json", json.dumps({"s1": {"members": ["hound", "dog"], "definition": ["a canine"]}, "s2": {"members": ["cad", "hound"], "definition": ["a rogue"]}}))
        z.writestr("entries-d.json", json.dumps({"dog": {"n": {"sense": [{"id": "dog1", "synset": "s1"}]}}, "hound": {"n": {"sense": [{"id": "hound1", "synset": "s1", "derivation": ["dog1"]}, {"id": "hound2", "synset": "s2"}]}}, "cad": {"n": {"sense": [{"id": "cad1", "synset": "s2"}]}}, "hot dog": {"n": {"sense": [{"id": "h", "synset": "s1"}]}}}))
    lex = Lexicon(build_lexicon(*read_lexicon_zip(spark, str(path))))
    assert lex.groups_for(["hound", "none"], 1) == [["hound", "dog"]] and sorted(lex.groups_for(["hound"], 2)[0]) == ["cad", "dog", "hound"]
    assert lex.derivations_for(["dog"]) == [["dog", "hound"]] and lex.verifier(["dog"])("dog", "hound") and not lex.verifier(["dog"])("dog", "cad")
    assert Lexicon(None).groups_for(["dog"]) == [] and Lexicon(None).verifier(["dog"]) is None
    assert Lexicon.query_words('+Dogs -"big cats" a 12 x1y') == ["dogs", "big", "cats"]


def test_articles(spark, tmp_path):
    lines = [{"index": 1}, {"title": "A", "namespace": 0, "text": "long " * 100, "page_id": 1}, {"title": "B", "namespace": 0, "text": "t", "opening_text": "o", "page_id": 2}, {"title": "C", "namespace": 1, "text": "t", "page_id": 3}, {"title": " ", "text": "t", "page_id": 4}, {"title": "D", "text": "", "page_id": 5}, {"title": "E", "text": "t", "page_id": 0}]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    got = {r["doc_id"]: r["opening"] for r in read_articles(spark, str(tmp_path / "d.json")).collect()}
    assert set(got) == {1, 2} and len(got[1]) == 200 and got[2] == "o"
    (tmp_path / "w.json").write_text('["the", "of"]')
    assert read_word_list(str(tmp_path / "w.json")) == ["the", "of"]


def test_reports_of_dirty_and_empty_logs(spark):
    one = {"id": 1, "ts": dt.datetime(2020, 1, 1), "query": " Tea ", "algo": "AUTO ", "algo_resolved": "bm25", "total": 0, "page": 1, "elapsed": 0.5, "cached": 0, "two_phase": 1, "exhaustive": 0, "stemming": 1, "confidence": 85, "synonyms": 0, "mem_kb": 5, "diag": '{"classes": {"stem": 2}}'}
    log = spark.createDataFrame([one, one, one | {"id": 2, "query": None, "elapsed": float("nan"), "diag": None}, one | {"id": None, "query": "tea", "elapsed": -1.0, "cached": 1}], logs.LOG_SCHEMA)
    assert tuple(logs.kpis(log).first()) == (3, 3, 0.5, 1)
    assert [tuple(r) for r in logs.routes(log).collect()] == [("auto > bm25", 3, 0.5)]
    assert [tuple(r) for r in logs.common(log).collect()] == [("tea", 2, 0.0)]
    assert [tuple(r) for r in logs.expansion_classes(log).collect()] == [("stem", 4, 2)]
    for f in (logs.kpis, logs.mode_means, logs.routes, logs.builds, logs.zero_results, logs.common, logs.slowest, logs.recent, logs.corpora, logs.expansion_classes, logs.timing):
        f(log.limit(0)).collect()
    assert log_windows(log).where("start is not null").agg(F.sum("searches")).first()[0] >= 2


def test_study(spark):
    s = spark.createDataFrame([("q1", "a", "x", 1, "T"), ("q1", "a", "y", 4, "U"), ("q2", "b", "x", None, None), ("q2", "b", "y", 2, "V"), ("q3", "ambiguous", "x", 1, "W")], "query string, category string, algo string, rank long, top1 string")
    got = {(r["category"], r["algo"]): r["mrr"] for r in study.mrr_by_category(s).collect()}
    assert got == {("a", "x"): 1.0, ("a", "y"): 0.25, ("b", "x"): 0.0, ("b", "y"): 0.5, ("ambiguous", "x"): 1.0}
    assert {r["algo"]: r["mrr"] for r in study.mrr_macro(s).collect()} == {"x": 0.5, "y": 0.375}
    assert {r["query"]: (r["top1"], r["votes"], r["agree"]) for r in study.consensus(s).collect()} == {"q1": ("T", 1, False), "q2": ("V", 1, True), "q3": ("W", 1, True)}
    d = study.run_diff(s.where("algo = 'x'").withColumn("algo", F.lit("z")), s.where("algo = 'y'").withColumn("algo", F.lit("z")))
    assert {r["query"]: r["state"] for r in d.collect()} == {"q1": "worse", "q2": "better", "q3": "gone"}


def test_study_runs_saves_and_loads(spark, tmp_path):
    df = spark.createDataFrame([(1, "green tea", "leaf"), (2, "black tea", "leaf leaf")], "doc_id long, title string, body string")
    s = Searcher(Index.build(df, str(tmp_path / "i"), ["title", "body"], title="title"))
    r = study.run_study(s, [("green tea", "name", ["green tea"]), ("leaf", "topic", ["black tea"]), ("nothing", "none", ["x"])], ["bm25", "freq"])
    study.save_run(r, str(tmp_path / "run"))
    back = study.load_run(spark, str(tmp_path / "run"))
    assert {(x["query"], x["algo"]): x["rank"] for x in back.collect()}[("green tea", "bm25")] == 1
    assert {r["state"] for r in study.run_diff(r, back).collect()} == {"same"}


def test_cache(spark, tmp_path):
    df = spark.createDataFrame([(i, f"tea {i}", "leaf") for i in range(5)], "doc_id long, title string, body string")
    s = Searcher(Index.build(df, str(tmp_path / "i"), ["title", "body"], title="title"))
    c = logs.ResultCache(spark, str(tmp_path / "c"), newest=1)
    k = c.key("tea", {"page": 2, "algo": "bm25"}, "v1")
    assert k == c.key("tea", {"page": 1, "algo": "bm25"}, "v1") != c.key("tea", {"algo": "freq"}, "v1")
    assert c.get(k) is None
    c.put(k, s.search("tea", per_page=200))
    c.put("other", s.search("leaf"))
    assert len(c.get(k, 1, 3)) == 3 and len(c.get(k, 2, 3)) == 2
    c.evict(str(tmp_path / "c2"))
    assert c.get(k) is None and c.get("other") is not None


def test_streamed_index_equals_built(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", f"word{i % 3} tea") for i in range(9)], "doc_id long, title string, body string")
    Index.build(df.limit(0), str(tmp_path / "i"), ["title", "body"], title="title")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index_stream(stream, str(tmp_path / "i"), str(tmp_path / "cp"), title="title").awaitTermination(180)
    ix = Index.open(spark, str(tmp_path / "i")).rebuild_stats()
    assert ix.field_stats["body"] == (9, 18)
    assert len(Searcher(ix).search("word1").scored.collect()) == 3
