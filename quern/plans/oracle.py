"""The same searches as one SQL text for another engine, from hand-written term lists; for checking results only."""

from __future__ import annotations

from dataclasses import dataclass, field

from quern.functions import text

FIELDS = {"title": "title", "opening": "opening", "body": "text"}

INDEX = (
    "tok as ("
    + " union all ".join(f"select doc_id, '{f}' as field, {text.sql_tokens(c)} as w from documents" for f, c in FIELDS.items())
    + """),
words as (select doc_id, field, unnest(w) as term, unnest(range(len(w))) as p from tok),
post as (select field, term, doc_id, count(*) as freq, list(p order by p) as pos from words group by field, term, doc_id),
lens as (select doc_id, field, len(w) as len from tok),
fst as (select field, greatest(1, count(*) filter (len > 0)) as n, coalesce(sum(len), 0) as total from lens group by field),
ts as (select p.field, p.term, count(*) as df, ln((any_value(n) + 0.5) / (count(*) + 0.5) + 1) as idf from post p join fst f on p.field = f.field group by p.field, p.term)"""
)


@dataclass
class Term:
    """A looked-up term; the concept is the typed word that it is a form of."""

    term: str
    boost: float = 1.0
    concept: str | None = None
    cap: float | None = None
    orig: bool = True
    opt: bool = True
    slot: int | None = 0
    group: int | None = None
    cov: int | None = None


@dataclass
class Search:
    algo: str
    terms: list[Term]
    weights: dict[str, float] = field(default_factory=lambda: {"title": 3.0, "opening": 2.0, "body": 1.0})
    groups: int = 0
    slots: int = 0
    excluded: list[str] = field(default_factory=list)
    extra_terms: str = ""  # SQL of further rows (field, term, boost, concept, cap, wild, cov, grp, opt, orig, slot)
    drop: str = ""  # SQL condition on doc_id of kept documents
    limit: int = 5000
    light: tuple[str, ...] = ()
    cutoff: float = 0.25
    field_b: dict[str, float] = field(default_factory=dict)
    tf_log: bool = True
    title: bool = True
    proximity: bool = True
    sample: str = ""


def _values(s: Search) -> str:
    rows = []
    typed: list[str] = []
    for t in s.terms:
        if t.orig:
            typed.append(t.term)
    for t in s.terms:
        cov = 1 << typed.index(t.term) if t.orig else 0
        concept = t.concept or "t:" + t.term
        cap = t.boost if t.cap is None else t.cap
        rows.append(f"('{t.term}', {t.boost}::double, '{concept}', {cap}::double, false, {cov if t.cov is None else t.cov}::bigint, {0 if t.group is None else 1 << t.group}::bigint, {str(t.opt).lower()}, {str(t.orig).lower()}, {0 if t.slot is None else 1 << t.slot}::bigint)")
    return "select * from (values " + ", ".join(rows) + ") v(term, boost, concept, cap, wild, cov, grp, opt, orig, slot)" if rows else "select '' as term, 1.0::double as boost, '' as concept, 1.0::double as cap, false as wild, 0::bigint as cov, 0::bigint as grp, false as opt, false as orig, 0::bigint as slot where false"


def search_sql(s: Search, select: str = "select doc_id, round(score, 3) as score from final") -> str:
    """All documents found with their scores; select: what to make of the table final (doc_id, score, title_len)."""
    w = ", ".join(f"('{f}', {x}::double, {i}, {s.field_b.get(f, 0.75)}::double)" for i, (f, x) in enumerate(s.weights.items()))
    total_weight = sum(s.weights.values())
    need = (1 << s.groups) - 1
    light = ", ".join(f"'{f}'" for f in s.light or s.weights)
    excluded = ", ".join(f"'{t}'" for t in s.excluded) or "''"
    bm25 = "idf * (freq * 2.5 / (freq + 1.5 * (0.25 + 0.75 * dl / avgdl)) + 0.5) * boost"
    tfn = "(freq * log2(1 + avgdl / greatest(1, dl)))"
    value = {
        "bm25": bm25, "bm25+cov": bm25, "rrf": bm25, "cover": "0.0", "idf": "case when wild then 0.0 else idf * boost end",
        "dfr": f"greatest(0, -log2(({tfn} + 0.5) / (n + 1))) * ({tfn} / ({tfn} + 1)) * boost",
        "freq": "ln(1 + freq) * boost" if s.tf_log else "freq * boost",
    }.get(s.algo, "0.0")
    per_field = {"cover": "100 * held / total", "bm25+cov": "v * (1 + (held / total) * (held / total))"}.get(s.algo, "v")
    limit = f"limit {s.limit}" if s.limit > 0 else ""
    plain = f"""con as (select doc_id, field, concept, sum({value}) as v, {"max(case when wild then idf * boost end)" if s.algo == "idf" else "0"} as rarest, max(least(boost, cap)) as held, sum(boost) as plain, any_value(weight) as weight from r group by all),
fld as (select c.doc_id, c.field, sum(v) + sum(coalesce(rarest, 0)) as v, sum(held) as held, sum(plain) as plain, any_value(weight) as weight from con c group by all),
raw0 as (select doc_id, sum(weight * {per_field}) / {total_weight}::double as raw, sum(weight * 100 * plain / plain_total) / {total_weight}::double as cov from fld f join tot t on f.field = t.field group by doc_id)"""
    if s.algo == "bm25f":
        plain = """tv as (select doc_id, r.term, concept, sum(weight * freq / (1 + field_b * (dl / avgdl - 1))) as tf, any_value(boost) as boost, any_value(cap) as cap from r group by all),
top as (select term, arg_max(idf, df * 100 - field_no) as idf from qt group by term),
tc as (select doc_id, concept, sum(top.idf * (tf * 2.5 / (1.5 + tf) + 0.5) * boost) as v, max(least(boost, cap)) as held from tv join top on tv.term = top.term group by all),
all_tot as (select sum(cap) as total from (select concept, any_value(cap) as cap from qt where score group by concept)),
raw0 as (select doc_id, sum(v) * (1 + (sum(held) / any_value(total)) * (sum(held) / any_value(total))) as raw, 0 as cov from tc, all_tot group by doc_id)"""
    fuse = "raw as (select doc_id, raw from raw0)"
    if s.algo == "rrf":
        fuse = """raw as (select doc_id, 1 / (60.0::double + row_number() over (order by round(raw, 6) desc, doc_id)) + 1 / (60.0::double + row_number() over (order by round(cov, 6) desc, doc_id)) as raw from raw0)"""
    typed = sum(t.orig for t in s.terms)
    near = "near as (select null::bigint as doc_id, 1.0 as near where false)"
    if s.proximity and typed >= 2 and s.algo in ("bm25", "bm25+cov", "bm25f", "dfr"):
        near = """near as (select a.doc_id, 1 + 0.3 * least(1, sum(a.weight / (1 + a.dl / (a.freq + b.freq))) / count(*)) as near from r a join r b on a.doc_id = b.doc_id and a.field = b.field and a.term < b.term
  where a.orig and b.orig and a.dl >= 2 group by a.doc_id)"""
    slots = s.slots if s.title else 0
    share = f"least(1, {slots} / greatest(1, coalesce(l.len, 0)))"
    bonus = f"case when {slots} = 0 or coalesce(hit, 0) = 0 then 1.0 when hit >= {slots} then 1.5 + 1.5 * {share} * {share} when hit * 2 >= {slots} then 1.3 else 1.1 end"
    return f"""with {INDEX},
w(field, weight, field_no, field_b) as (values {w}),
q0 as ({_values(s)}),
q1 as (select w.field, q0.* from w cross join q0 {f"union all {s.extra_terms}" if s.extra_terms else ""}),
qt as (select q1.*, w.weight, w.field_no, w.field_b, ts.df, ts.idf, true as score from q1 join w on q1.field = w.field left join ts on q1.field = ts.field and q1.term = ts.term join fst on fst.field = q1.field
       where grp > 0 or {s.cutoff} >= 1 or n < 100 or coalesce(ts.df, 0) <= floor(n * {s.cutoff})),
m as (select qt.*, p.doc_id, p.freq from post p join qt on p.field = qt.field and p.term = qt.term),
cand0 as (select doc_id, bit_or(cov) as cov, bit_or(grp) as grp, min((field_no, term)) as first, bool_or(opt and field in ({light})) as seed from m where grp > 0 or opt and field in ({light}) group by doc_id),
cand as (select doc_id from cand0 where grp & {need} = {need} {s.sample} order by bit_count(cov) desc, first, doc_id {limit}),
kept as (select doc_id from cand where doc_id not in (select doc_id from post where term in ({excluded}) and field in (select field from w)) {s.drop}),
tot as (select field, sum(cap) as total, any_value(plain_total) as plain_total from (select field, concept, any_value(cap) as cap from qt group by field, concept) a join (select field, sum(boost) as plain_total from qt group by field) b using (field) group by field),
r as (select m.*, l.len::double as dl, f.n, greatest(1, f.total / f.n)::double as avgdl from m join kept using (doc_id) join lens l on l.doc_id = m.doc_id and l.field = m.field join fst f on f.field = m.field),
{plain},
{fuse},
{near},
title as (select doc_id, bit_count(bit_or(slot)) as hit from r where field = 'title' and slot > 0 group by doc_id),
whole as (select raw.doc_id, raw * coalesce(near, 1) * {bonus} as score, l.len as title_len from raw left join near using (doc_id) left join title using (doc_id) left join lens l on l.doc_id = raw.doc_id and l.field = 'title'),
final as (select doc_id, round(score / (select max(score) from whole) * 100, 6) as score, title_len from whole where score > 0)
{select}"""
