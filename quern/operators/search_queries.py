"""Registered searches, each with the SQL that it is held against."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.words import osa_column
from quern.plans.expand import begin, fuzzy_candidates
from quern.plans.index import Index
from quern.plans.oracle import INDEX, Search, Term, search_sql
from quern.plans.query import Profile
from quern.plans.small import small_table
from quern.scratch import root
from quern.search import Searcher
from quern.sources.tables import table

PART = 25_000
WEIGHTS = {"title": 3.0, "opening": 2.0, "body": 1.0}
_opened: dict[tuple[str, str], Index] = {}


def document_index(spark: SparkSession, folder: str) -> Index:
    """Index of title, opening and whole text of the documents, built once in a session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _opened:
        path = f"{root(spark)}/index-{spark.sparkContext.applicationId}-{len(_opened)}"
        docs = table(spark, folder, "documents").select("doc_id", "title", "opening", F.col("text").alias("body"))
        _opened[key] = Index.build(docs, path, list(WEIGHTS), title="title", opening="opening")
    return _opened[key]


def _search(query: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        own = {"fields": WEIGHTS} | options
        r = Searcher(document_index(spark, folder)).search(query, **own)
        return r.scored.select("doc_id", F.round("score", 3).alias("score"))

    return run


def _table(name: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: document_index(spark, folder).table(name).select(*columns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tok_terms": lambda spark, folder: table(spark, folder, "documents").select("doc_id", F.size(text.tokens("text", False)).alias("plain"), F.size(text.tokens("text")).alias("folded")),
    "fold_terms": lambda spark, folder: table(spark, folder, "unique_terms").select(text.fold("term").alias("folded"), text.term("term").alias("term")),
    "postings": _table("postings", "field", "term", "doc_id", "freq"),
    "positions": lambda spark, folder: document_index(spark, folder).table("postings").select("field", "term", "doc_id", F.element_at("pos", 1).alias("first"), F.element_at("pos", -1).alias("last"), F.size("pos").alias("n")),
    "doclens": _table("doclens", "field", "doc_id", "len"),
    "field_stats": _table("field_stats", "field", "total_docs", "total_length"),
    "termstats_idf": lambda spark, folder: document_index(spark, folder).table("termstats").select("field", "term", "doc_freq", F.round("idf", 6).alias("idf")),
    "vocabulary": _table("vocabulary", "term", "len", "fc"),
    "index_stats": lambda spark, folder: document_index(spark, folder).get_stats(),
    "frequent_words": lambda spark, folder: document_index(spark, folder).frequent_words(),
}
SQL: dict[str, str] = {
    "tok_terms": f"select doc_id, len({text.sql_tokens('text', False)}) as plain, len({text.sql_tokens('text')}) as folded from documents",
    "fold_terms": f"select {text.sql_fold('term')} as folded, {text.sql_term('term')} as term from unique_terms",
    "postings": f"with {INDEX} select field, term, doc_id, freq from post",
    "positions": f"with {INDEX} select field, term, doc_id, pos[1] as first, pos[-1] as last, len(pos) as n from post",
    "doclens": f"with {INDEX} select field, doc_id, len from lens",
    "field_stats": f"with {INDEX} select field, count(*) filter (len > 0) as total_docs, sum(len)::bigint as total_length from lens group by field",
    "termstats_idf": f"with {INDEX} select field, term, df as doc_freq, round(idf, 6) as idf from ts",
    "vocabulary": f"with {INDEX} select distinct term, length(term) as len, left(term, 1) as fc from ts",
    "frequent_words": f"with {INDEX} select distinct ts.term from ts join fst on ts.field = fst.field where df > 0.3 * n",
    "index_stats": f"with {INDEX} select field, any_value(docs) as docs, any_value(tokens) as tokens, count(distinct term) as terms, count(*) as postings from post join (select field, count(*) filter (len > 0) as docs, sum(len)::bigint as tokens from lens group by field) using (field) group by field",
}


def _add(name: str, query: str, sql: Search | str, **options) -> None:
    QUERIES[name] = _search(query, **options)
    SQL[name] = sql if isinstance(sql, str) else search_sql(sql)


# Scorers: typed words with a boost, and a synonym that is a form of one of them.
_SYN = {"synonyms": [["libretto", "overture"]]}
for _algo in ("bm25", "bm25+cov", "bm25f", "rrf", "dfr", "cover", "idf", "freq"):
    _add(
        {"freq": "freq_log", "bm25+cov": "bm25_cov"}.get(_algo, _algo), "microscope scoreboard^2 libretto",
        Search(_algo, [Term("microscope", concept="o:microscope", slot=0), Term("scoreboard", 2.0, "o:scoreboard", slot=1), Term("libretto", concept="o:libretto", slot=2), Term("overture", concept="o:libretto", orig=False, slot=None)], slots=3),
        algo=_algo, **_SYN,
    )
_three = lambda **k: [Term("microscope", slot=0, **k), Term("scoreboard", slot=1, **k), Term("libretto", slot=2, **k)]
_add("freq_raw", "microscope scoreboard libretto", Search("freq", _three(), slots=3, tf_log=False), algo="freq", ranking={"freq_tf_log": False})
_add("weighted_fields", "microscope libretto", Search("bm25", [Term("microscope", slot=0), Term("libretto", slot=1)], {"opening": 5.0, "body": 0.5}), fields={"opening": 5.0, "body": 0.5, "title": 0.0})
_add("field_b", "microscope scoreboard libretto", Search("bm25f", _three(), slots=3, field_b={"title": 0.2, "body": 0.9}), algo="bm25f", field_b={"title": 0.2, "body": 0.9})
_add("title_bonus_off", "microscope scoreboard libretto", Search("bm25", _three(), title=False), title_field=None)
_add("proximity_off", "microscope scoreboard libretto", Search("bm25", _three(), slots=3, proximity=False), ranking={"proximity_weight": 0})

# Boolean layer
_pair = lambda a, b, **k: [Term(a, concept="r:" + a, slot=0, group=0, opt=False), Term(b, concept="r:" + b, slot=1, group=1, opt=False)]
_add("required_and", "+orchestra +melody", Search("bm25", _pair("orchestra", "melody"), groups=2, slots=2))
_add("required_or_group", "+orchestras", Search("cover", [Term("orchestras", concept="r:orchestras", slot=0, group=0, opt=False), Term("orchestra", 0.8, "r:orchestras", 1.0, orig=False, opt=False, slot=0, group=0)], groups=1, slots=1), algo="cover", stemming=True)
_add("excluded", "orchestra melody -trumpet", Search("bm25", [Term("orchestra", slot=0), Term("melody", slot=1)], slots=2, excluded=["trumpet"]))
_add("optional_boost", "+orchestra melody^3 trumpet^0.5", Search("bm25", [Term("orchestra", concept="r:orchestra", slot=0, group=0, opt=False), Term("melody", 3.0, slot=1), Term("trumpet", 0.5, slot=2)], groups=1, slots=3))
_add("mixed_required", "+kept libretto scoreboard", Search("cover", [Term("kept", concept="r:kept", slot=0, group=0, opt=False), Term("libretto", slot=1), Term("scoreboard", slot=2)], groups=1, slots=3), algo="cover", broad_cap=0)


def _completions(prefix: str, key: str, cov: int, grp: int, cap: int = 100, budget: int = 200_000) -> str:
    opt = "false" if grp else "true"
    got = f"""select field, term from (select field, term, rn, sum(df) over (partition by field order by df desc, term rows unbounded preceding) as cum from (select ts.field, term, df, row_number() over (partition by ts.field order by df desc, term) as rn
      from ts join fst on ts.field = fst.field where term like '{prefix}%' and (n < 100 or df <= floor(n * 0.25)) and ts.field in (select field from w)) where rn <= {cap}) where rn = 1 or {budget} <= 0 or cum <= {budget}"""
    rows = f"select field, term from ({got})" if not grp else f"select w.field, x.term from w cross join (select distinct term from ({got})) x"
    return f"select field, term, 1.0::double, '{key}', 1.0::double, true, {cov}::bigint, {grp}::bigint, {opt}, false, 0::bigint from ({rows})"


_add("prefix_opt", "libretto orch*", Search("bm25", [Term("libretto", slot=0)], slots=1, extra_terms=_completions("orch", "ow:orch", 2, 0)))
_add("prefix_idf", "orch*", Search("idf", [], extra_terms=_completions("orch", "ow:orch", 1, 0)), algo="idf")
_add("prefix_req", "libretto +mel*", Search("freq", [Term("libretto", slot=0)], groups=1, slots=1, extra_terms=_completions("mel", "rw:mel", 2, 1)), algo="freq")
_add("prefix_exc", "orchestra -mel*", Search("bm25", [Term("orchestra", slot=0)], slots=1, drop="and doc_id not in (select doc_id from post where term like 'mel%')"))
_add("prefix_budget", "c*", Search("freq", [], extra_terms=_completions("c", "ow:c", 1, 0, 20, 300)), algo="freq", max_wildcard=20, wildcard_budget=300)


def _adjacent(words: list[str]) -> str:
    tests = " and ".join(f"list_contains(p{i}.pos, x + {i})" for i in range(1, len(words)))
    joins = " ".join(f"join post p{i} on p{i}.doc_id = p0.doc_id and p{i}.field = p0.field and p{i}.term = '{w}'" for i, w in enumerate(words) if i)
    return f"select p0.doc_id from (select *, unnest(pos) as x from post where term = '{words[0]}') p0 {joins} where {tests}"


_known = [Term(t, concept="r:" + t, slot=i, group=i, opt=False) for i, t in enumerate(("well", "known", "quartet"))]
_add("phrase_req", '"well known quartet"', Search("bm25", _known, groups=3, slots=3, drop=f"and doc_id in ({_adjacent(['well', 'known', 'quartet'])})"), broad_cap=0)
_add("phrase_exc", 'quartet -"well known quartet"', Search("bm25", [Term("quartet", slot=0)], slots=1, drop=f"and doc_id not in ({_adjacent(['well', 'known', 'quartet'])})"))
_add("phrase_repeated", '"parser parser parser"', Search("cover", [Term("parser", concept="r:parser", slot=0, group=0, opt=False)], groups=1, slots=1, drop=f"and doc_id in ({_adjacent(['parser'] * 3)})"), algo="cover")
_add("phrase_unordered", 'quartet -"tempo plans"', Search("bm25", [Term("quartet", slot=0)], slots=1, drop="and doc_id not in (select a.doc_id from post a join post b on a.doc_id = b.doc_id and a.field = b.field and a.term = 'tempo' and b.term = 'plans')"), phrase_mode="unordered")
_add("compound_number", "86-percent 12.5", Search("bm25", [Term("12", concept="r:12", slot=0, group=0, opt=False), Term("5", concept="r:5", slot=1, group=1, opt=False), Term("86", slot=2), Term("percent", slot=3)], groups=2, slots=4, drop=f"and doc_id in ({_adjacent(['12', '5'])})"))

# Cuts and prunes
_add("highfreq_cut", "the libretto and", Search("bm25", [Term("the", slot=0), Term("libretto", slot=1), Term("and", slot=2)], slots=3))
_add("coverage_prune", "orchestra melody trumpet libretto", Search("bm25", [Term(t, slot=i) for i, t in enumerate(("orchestra", "melody", "trumpet", "libretto"))], slots=4, limit=25), candidate_limit=25)
_add("two_phase", "orchestra melody trumpet libretto", Search("bm25", [Term(t, slot=i) for i, t in enumerate(("orchestra", "melody", "trumpet", "libretto"))], slots=4, limit=15, light=("title", "opening")), two_phase=True, heavy_fields=("body",), phase1_limit=15)
_add(
    "broad_sample", "+the libretto",
    Search("freq", [Term("the", concept="r:the", slot=0, group=0, opt=False), Term("libretto", slot=1)], groups=1, slots=2, sample="and (seed or doc_id in (select doc_id from (select doc_id, row_number() over (partition by field order by doc_id) as rn from post where term = 'the') where rn <= 10))"),
    algo="freq", broad_cap=10,
)

# Expansion
_add("stem_expand", "orchestras libretto", Search("bm25+cov", [Term("orchestras", concept="o:orchestras", slot=0), Term("libretto", concept="o:libretto", slot=1), Term("orchestra", 0.8, "o:orchestras", 1.0, slot=0), Term("librettos", 0.7, "o:libretto", 1.0, orig=False, slot=None)], slots=2), algo="bm25+cov", stemming=True)
_add("synonym_expand", "libretto", Search("cover", [Term("libretto", concept="o:libretto", slot=0), Term("overture", concept="o:libretto", orig=False, slot=None), Term("sonata", concept="o:libretto", orig=False, slot=None)], slots=1), algo="cover", synonyms=[["sonata", "libretto", "overture"]])
_add("derivation_expand", "music", Search("bm25f", [Term("music", concept="o:music", slot=0), Term("musician", 0.7, "o:music", 1.0, orig=False, slot=None), Term("melody", 0.7, "o:music", 1.0, orig=False, slot=None)], slots=1), algo="bm25f", derivations=[["music", "musician", "melody"]])
_add("fold_search", "Médaille ÉPICE", Search("bm25", [Term("medaille", slot=0), Term("epice", slot=1)], slots=2))


def _fuzzy(words: list[tuple[str, int]]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        asked = spark.createDataFrame(words, "word string, budget int")
        return fuzzy_candidates(document_index(spark, folder).table("vocabulary"), asked, 1_000_000).select("word", "term", "distance")

    return run


QUERIES["fuzzy_lev1"] = _fuzzy([("orchestra", 1), ("libretos", 1), ("scoreboard", 2)])
SQL["fuzzy_lev1"] = f"""with {INDEX}, v as (select distinct term from ts), q(word, budget) as (values ('orchestra', 1), ('libretos', 1), ('scoreboard', 2)),
d as (select word, term, budget, levenshtein(word, term) as l, damerau_levenshtein(word, term) as o from q join v on left(term, 1) = left(word, 1) and abs(length(term) - length(word)) <= budget)
select word, term, (case when l <= budget then l else o end)::int as distance from d where case when l <= budget then l else o end <= budget"""


def fuzzy_osa(spark: SparkSession, folder: str) -> DataFrame:
    """Every vocabulary word of two letters or more against itself with the two neighbours in its middle swapped."""
    v = document_index(spark, folder).table("vocabulary").where("len >= 2").select("term", F.expr("int(len / 2)").alias("i"))
    swapped = F.expr("concat(left(term, i - 1), substring(term, i + 1, 1), substring(term, i, 1), substring(term, i + 2))")
    return v.select("term", swapped.alias("other")).select("term", "other", osa_column(F.col("term"), F.col("other")).alias("distance"))


QUERIES["fuzzy_osa"] = fuzzy_osa
# two swapped neighbours are one edit, unless they are equal
SQL["fuzzy_osa"] = f"with {INDEX}, v as (select distinct term, length(term) // 2 as i from ts where length(term) >= 2), p as (select term, left(term, i - 1) || substr(term, i + 1, 1) || substr(term, i, 1) || substr(term, i + 2) as other from v) select term, other, (term <> other)::int as distance from p"


def _plans(queries: list[str], **options) -> Callable[[SparkSession, str], DataFrame]:
    """What a batch of queries was resolved to: algorithm and expansions."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        r = Searcher(document_index(spark, folder)).search_batch(queries, **options)
        rows = [(p.query, p.algo, e["term"], e["from"], e["class"], e["boost"]) for p in r.plans for e in p.diag.get("expansions", [])] + [(p.query, p.algo, None, None, None, None) for p in r.plans if not p.diag.get("expansions")]
        return spark.createDataFrame(rows, "query string, algo string, term string, origin string, class string, boost double")

    return run


_ROUTES = ["how does gravity work", "guitar", "orch*", "guitar notary", "guiatr notary", "xqzzt guitar", "+guitar notary"]


def auto_route(spark: SparkSession, folder: str) -> DataFrame:
    """Algorithms that queries are routed to: questions, single words, prefixes and typing errors to freq, the rest to cover."""
    return _plans(_ROUTES, algo="auto", confidence=85)(spark, folder).select("query", "algo").distinct()


QUERIES["auto_route"] = auto_route
SQL["auto_route"] = "select * from (values " + ", ".join(f"('{q}', '{'cover' if q.endswith('guitar notary') else 'freq'}')" for q in _ROUTES) + ") v(query, algo)"
QUERIES["morph_expand"] = _plans(["conduct player", "+sing"], stemming=True)


def context_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """How far other words of a query vouch for each of its words."""
    s = Searcher(document_index(spark, folder))
    options, profile = s._split({"fields": WEIGHTS})
    plans = [begin(s.index, i, q, options, profile) for i, q in enumerate(("guitar orchestra melody", "judge felony", "parser xqzzt"))]
    got = s._vouch(options)([(p, t) for p in plans for t in p.typed])
    return spark.createDataFrame([(q, w, round(x, 6)) for (q, w), x in got.items()], "query_id long, word string, ratio double")


QUERIES["context_ratio"] = context_ratio
SQL["context_ratio"] = f"""with {INDEX}, q(query_id, word) as (values (0, 'guitar'), (0, 'orchestra'), (0, 'melody'), (1, 'judge'), (1, 'felony'), (2, 'parser'), (2, 'xqzzt')),
own as (select q.*, field, doc_id from q join post on term = word)
select o.query_id, o.word, round(avg(case when exists (select 1 from q x join post p on p.term = x.word where x.query_id = o.query_id and x.word <> o.word and p.field = o.field and p.doc_id = o.doc_id) then 1.0 else 0.0 end), 6) as ratio from own o group by all"""


def noise_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that each cut drops, for words next to the limits."""
    r = Searcher(document_index(spark, folder)).search_batch(["the and libretto", "one two orchestra", "page"], fields=WEIGHTS)
    rows = [(p.query_id, f, t) for p in r.plans for f, ts in p.diag.get("dropped", {}).items() for t in ts]
    return spark.createDataFrame(rows, "query_id long, field string, term string")


QUERIES["noise_cut"] = noise_cut
SQL["noise_cut"] = f"""with {INDEX}, q(query_id, term) as (values (0, 'the'), (0, 'and'), (0, 'libretto'), (1, 'one'), (1, 'two'), (1, 'orchestra'), (2, 'page'))
select query_id, ts.field, q.term from q join ts on ts.term = q.term join fst on fst.field = ts.field where n >= 100 and df > floor(n * 0.25)"""


def sample_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Ten titles drawn at random, the same each time."""
    docs = document_index(spark, folder).table("documents").where("trim(title) <> ''")
    return docs.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-7"))), "doc_id").limit(10).select("doc_id", "title")


QUERIES["sample_titles"] = sample_titles
SQL["sample_titles"] = "select doc_id, title from documents where trim(title) <> '' order by md5(doc_id::varchar || '-7'), doc_id limit 10"


def field_scores(spark: SparkSession, folder: str) -> DataFrame:
    """What each field of the first page contributes."""
    hits = Searcher(document_index(spark, folder)).search("microscope scoreboard libretto", algo="cover", fields=WEIGHTS).hits
    return hits.select("doc_id", F.explode("field_scores").alias("field", "score")).withColumn("score", F.round("score", 3))


QUERIES["field_scores"] = field_scores
SQL["field_scores"] = search_sql(Search("cover", _three(), slots=3), f"select f.doc_id, d.field, round(100 * held / total, 3) as score from (select *, row_number() over (order by score desc, title_len nulls last, doc_id) as rank from final) f join fld d on d.doc_id = f.doc_id join tot on tot.field = d.field where rank <= 20")

# Pages
_LIBRETTO = Search("bm25", _three(), slots=3)


def page2(spark: SparkSession, folder: str) -> DataFrame:
    return Searcher(document_index(spark, folder)).search("microscope scoreboard libretto", fields=WEIGHTS, page=2, per_page=10).hits.select("rank", "doc_id", F.round("score", 3).alias("score"))


def page_with_titles(spark: SparkSession, folder: str) -> DataFrame:
    return Searcher(document_index(spark, folder)).search("microscope scoreboard libretto", fields=WEIGHTS, per_page=10).hits.select("rank", "doc_id", "title", F.explode("matches").alias("field", "terms")).select("rank", "doc_id", "title", "field", F.concat_ws(" ", "terms").alias("terms"))


def total_count(spark: SparkSession, folder: str) -> DataFrame:
    return Searcher(document_index(spark, folder)).search_batch(["microscope scoreboard libretto", "+orchestra +melody", "-melody"], fields=WEIGHTS).totals().select("query_id", "total", "pages")


def snippet(spark: SparkSession, folder: str) -> DataFrame:
    return Searcher(document_index(spark, folder)).search("libretto", fields=WEIGHTS).hits.select("doc_id", "snippet")


QUERIES |= {"page2": page2, "page_with_titles": page_with_titles, "total_count": total_count, "snippet": snippet}
_ORDER = "row_number() over (order by score desc, title_len nulls last, doc_id) as rank"
SQL["page2"] = search_sql(_LIBRETTO, f"select rank, doc_id, round(score, 3) as score from (select *, {_ORDER} from final) where rank between 11 and 20")
SQL["page_with_titles"] = search_sql(_LIBRETTO, f"select rank, f.doc_id, coalesce(d.title, f.doc_id::varchar) as title, r.field, string_agg(distinct r.term, ' ' order by r.term) as terms from (select *, {_ORDER} from final) f join documents d on d.doc_id = f.doc_id join r on r.doc_id = f.doc_id where rank <= 10 group by all")
SQL["total_count"] = f"""select 0 as query_id, (select count(*) from ({SQL["title_bonus_off"]})) as total, greatest(1, ceil((select count(*) from ({SQL["title_bonus_off"]})) / 20))::bigint as pages
union all select 1, (select count(*) from ({SQL["required_and"]})), greatest(1, ceil((select count(*) from ({SQL["required_and"]})) / 20))::bigint union all select 2, 0, 1"""


def batch_throughput(spark: SparkSession, folder: str) -> DataFrame:
    """The best document of each distinct query among the log's rows whose id is divisible by 50, in batches of PART queries."""
    log = table(spark, folder, "search_log").where("id % 50 = 0").select(text.phrase("query").alias("q")).where("q <> ''")
    asked = [r["q"] for r in log.distinct().orderBy("q").collect()]
    searcher, found = Searcher(document_index(spark, folder)), []
    for i in range(0, max(1, len(asked)), PART):
        part = asked[i : i + PART]
        names = small_table(spark, list(enumerate(part)), "query_id long, query string")
        found.append(searcher.best(part, ["bm25"], 1, fields=WEIGHTS).join(names, "query_id").select("query", "doc_id", F.round("score", 3).alias("score")))
    return functools.reduce(DataFrame.unionByName, found)


QUERIES["batch_throughput"] = batch_throughput
QUERIES["typo_swap"] = _plans(["guiatr melody", "rhytmh", "orchestar tempo"], algo="auto", confidence=80)
