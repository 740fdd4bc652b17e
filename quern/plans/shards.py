"""Many plain queries in one pass: postings packed by ranges of documents, and each range scored query by query in NumPy.

The rows of (query, document) of a batch are never shuffled: a range of documents counts its candidates by class first, the
classes of all ranges give each query's cut, and each range then scores what is left and passes on its best. The results are those of
``quern.search.run``, which does the queries that ``is_plain`` refuses.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.expand import Plan
from quern.plans.index import Index
from quern.plans.small import small_table
from quern.scratch import Scratch

#: Postings of a range, about; the packed range and its values are in a worker's memory at once.
RANGE_POSTINGS = 2_500_000
#: Rows of terms of the queries that are scored in one go.
PART_ROWS = 200_000
#: Algorithms that don't look at concepts, so that prefixes and other forms change nothing for them.
BY_TERM = {"bm25", "dfr", "freq"}
#: Scores are ranked to 6 decimals of 100; documents that lie closer may change places.
CLOSE = 1.1e-8
NO_CUT = 1 << 30


def is_plain(index: Index, p: Plan, algos: Sequence[str]) -> bool:
    """Whether ``top_hits`` can do a planned query."""
    return bool(
        index.doc_id_type() == "bigint" and index.meta.get("title") == p.profile.title_field and not p.options.two_phase and not p.truncated and p.profile.candidate_limit > 0 and p.knobs.freq_tf_log and all(0 <= b <= 1 for b in (p.knobs.b, *p.profile.field_b.values()))
        and not p.parsed.excluded_prefixes and (index.positions and p.options.phrase_mode != "unordered" or not (p.parsed.required_phrases or p.parsed.excluded_phrases)) and (set(algos) <= BY_TERM or not (p.expanded or p.wild))
    )


def _bounds(index: Index, n: int) -> list[int]:
    """First ids of n ranges of about as many documents each, but the first."""
    if n < 2:
        return []
    at = index.table("documents").agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("at")).first()["at"]
    return sorted(set(at or []))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: documents, their title lengths, and the postings by code and document, with the places of those that phrases need."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    column = lambda name, kind: np.concatenate([b.column(name).fill_null(-1).to_numpy(zero_copy_only=False) for b in held]).astype(kind, copy=False)
    shard, code, doc, freq, length, title = column("shard", np.int32), column("code", np.int32), column("doc_id", np.int64), column("freq", np.int32), column("len", np.int32), column("title_len", np.int32)
    places = pa.chunked_array([b.column("pos") for b in held]).combine_chunks()
    held.clear()
    for s in np.unique(shard):
        own = np.flatnonzero(shard == s)
        docs, first, loc = np.unique(doc[own], return_index=True, return_inverse=True)
        order = np.argsort(code[own].astype(np.int64) * len(docs) + loc)
        o = own[order]
        there = places.take(pa.array(o))
        counts = there.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
        parts = [docs, title[own[first]], code[o], loc[order].astype(np.int32), freq[o], length[o], counts, there.flatten().to_numpy(zero_copy_only=False).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts)], names=["shard", "docs", "titles", "code", "loc", "freq", "len", "counts", "places"])


PACKED = "shard int, docs binary, titles binary, code binary, loc binary, freq binary, len binary, counts binary, places binary"


class _Range:
    """One packed range, opened."""

    def __init__(self, row: dict, n_codes: int):
        self.shard = row["shard"]
        self.docs, self.titles = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["titles"], np.int32)
        code, self.loc, self.freq, self.len = (np.frombuffer(row[k], np.int32) for k in ("code", "loc", "freq", "len"))
        self.start = np.searchsorted(code, np.arange(n_codes + 1)).tolist()
        self.code, self.places = code, np.frombuffer(row["places"], np.int32)
        self.counts = np.frombuffer(row["counts"], np.int32)
        self.place = np.cumsum(self.counts, dtype=np.int64) - self.counts if len(self.places) else None
        self.cov, self.grp = np.zeros(len(self.docs), np.int64), np.zeros(len(self.docs), np.int64)
        self.first, self.pos, self.bad = np.full(len(self.docs), -1, np.int16), np.full(len(self.docs), -1, np.int32), np.zeros(len(self.docs), bool)


def _ranges(batches: Iterator[pa.RecordBatch], n_codes: int) -> Iterator[_Range]:
    for b in batches:
        for i in range(b.num_rows):
            yield _Range({n: b.column(n)[i].as_py() for n in b.schema.names}, n_codes)


def _candidates(r: _Range, q: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places of a query's candidates in the range, by id, and their classes: most typed words first, then the first field and term."""
    none = np.zeros(0, np.int64)
    lists = [(k, c, g, r.loc[r.start[code] : r.start[code + 1]]) for k, c, g, code in q["seek"] if r.start[code] < r.start[code + 1]]
    if not lists:
        return none, none
    for k, c, g, d in lists:  # the first in order comes last and stays
        if c:
            r.cov[d] |= c
        if g:
            r.grp[d] |= g
        r.first[d] = k
    found = np.flatnonzero(r.first >= 0) if len(lists) > 1 else lists[0][3]
    cand = found[(r.grp[found] & q["need"]) == q["need"]] if q["need"] else found
    classes = (64 - np.bitwise_count(r.cov[cand]).astype(np.int64)) * q["n_seek"] + r.first[cand]
    r.cov[found], r.grp[found], r.first[found] = 0, 0, -1
    return cand, classes


def _count(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """query_id, class, shard, n of the queries that may have more candidates than they may keep."""
    batch = shared.value
    for r in _ranges(batches, batch["n_codes"]):
        ids, classes, ns = [], [], []
        for q in batch["queries"]:
            if q["many"]:
                n = np.bincount(_candidates(r, q)[1])
                at = np.flatnonzero(n)
                ids.append(np.full(len(at), q["id"], np.int64))
                classes.append(at)
                ns.append(n[at])
        if ids:
            ids, classes, ns = map(np.concatenate, (ids, classes, ns))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(classes.astype(np.int64)), pa.array(np.full(len(ids), r.shard, np.int32)), pa.array(ns.astype(np.int64))], names=["query_id", "class", "shard", "n"])


def _values(r: _Range, batch: dict) -> dict[str, np.ndarray]:
    """What a posting adds, without the term's rarity and boost."""
    field = batch["field_of"][r.code]
    tf, dl = r.freq.astype(np.float64), r.len.astype(np.float64)
    n, avg, own_b = batch["n"][field], batch["avgdl"][field], batch["field_b"][field]
    k1, b, algos, out = batch["k1"], batch["b"], batch["algos"], {}
    if algos & {"bm25", "bm25+cov", "rrf"}:
        out["bm25"] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg)) + batch["delta"]
    if "dfr" in algos:
        tfn = tf * np.log2(1 + avg / np.maximum(1.0, dl))
        out["dfr"] = np.maximum(0.0, -np.log2((tfn + 0.5) / (n + 1))) * (tfn / (tfn + 1))
    if "freq" in algos:
        out["freq"] = np.log1p(tf)
    if "bm25f" in algos:
        out["bm25f"] = batch["weight"][field] * (tf / (1 + own_b * (dl / avg - 1)))
    return out


def _with_phrase(r: _Range, phrase: list[tuple[int, ...]], size: int) -> np.ndarray:
    """Which of the documents that ``pos`` numbers have the phrase, given by its codes in each field: a word at place i that stands at p votes for a start at p - i."""
    out = np.zeros(size, bool)
    for codes in phrase:
        starts = None
        for i, c in enumerate(codes):
            s, e = (r.start[c], r.start[c + 1]) if c >= 0 else (0, 0)
            at = s + np.flatnonzero(r.pos[r.loc[s:e]] >= 0)
            n = r.counts[at]
            if not n.sum():
                starts = None
                break
            flat = np.repeat(r.place[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            votes = np.repeat(r.pos[r.loc[at]].astype(np.int64), n) << 32 | (r.places[flat].astype(np.int64) + len(codes) - i)
            starts = np.unique(votes) if starts is None else np.intersect1d(starts, votes)
        if starts is not None:
            out[starts >> 32] = True
    return out


def _score(r: _Range, values: dict[str, np.ndarray], batch: dict, q: dict) -> tuple | None:
    """Places of the kept documents, their scores by algorithm, and for rrf: by bm25, by coverage, and the factor."""
    kept, classes = _candidates(r, q)
    cls, shard, most = q["cut"]
    if cls < NO_CUT and len(kept):
        keep = classes < cls
        if r.shard < shard:
            keep |= classes == cls
        elif r.shard == shard:
            keep[np.flatnonzero(classes == cls)[:most]] = True
        kept = kept[keep]
    if q["excluded"] and len(kept):
        gone = [r.loc[r.start[c] : r.start[c + 1]] for c in q["excluded"]]
        for d in gone:
            r.bad[d] = True
        kept = kept[~r.bad[kept]]
        for d in gone:
            r.bad[d] = False
    size = len(kept)
    if not size:
        return None
    r.pos[kept] = np.arange(size, dtype=np.int32)
    if q["phrases"]:
        ok = np.ones(size, bool)
        for excluded, phrase in q["phrases"]:
            ok &= _with_phrase(r, phrase, size) != excluded
        r.pos[kept] = -1
        kept = kept[ok]
        size = len(kept)
        if not size:
            return None
        r.pos[kept] = np.arange(size, dtype=np.int32)
    algos, zero = batch["algos"], lambda: np.zeros(size)
    raw = {a: zero() for a in algos | ({"bm25"} if "rrf" in algos else set())}
    cover, pairs, k, slots, near_on = zero(), zero(), zero(), np.zeros(size, np.int64), q["prox"] > 0
    joined: dict[int, tuple] = {}
    by_cover = not algos <= BY_TERM
    for f, rows in q["fields"]:
        w = batch["weight"][f]
        v = {a: zero() for a in ("bm25", "dfr", "freq", "idf") if a in values or a == "idf" and a in algos}
        held, typed, dl, any_ = zero() if by_cover else None, [], zero(), False
        for code, idf, boost, orig, slot, term, top in rows:
            s, e = r.start[code], r.start[code + 1]
            if s == e:
                continue
            p = r.pos[r.loc[s:e]]
            on = np.flatnonzero(p >= 0)
            if not len(on):
                continue
            p, on, any_ = p[on], on + s, True
            if "bm25" in v:
                v["bm25"][p] += idf * values["bm25"][on] * boost
            if "dfr" in v:
                v["dfr"][p] += values["dfr"][on] * boost
            if "freq" in v:
                v["freq"][p] += values["freq"][on] * boost
            if "idf" in v:
                v["idf"][p] += idf * boost
            if "bm25f" in algos:
                if term not in joined:
                    joined[term] = (zero(), top, boost)
                joined[term][0][p] += values["bm25f"][on]
            if by_cover:
                held[p] += boost
            if slot:
                slots[p] |= slot
            if orig and near_on:
                x = zero()
                x[p] = r.freq[on]
                typed.append(x)
                dl[p] = r.len[on]
        if not any_:
            continue
        if by_cover:
            total, plain = q["total"][f], q["plain"][f]
            cov = held / total if total > 0 else zero()
            cover += w * 100.0 * (held / plain if plain > 0 else zero())
        for a in raw:
            if a in ("bm25", "dfr", "freq", "idf"):
                raw[a] += w * v[a]
            elif a == "bm25+cov":
                raw[a] += w * (v["bm25"] * (1 + cov * cov))
            elif a == "cover":
                raw[a] += w * (100.0 * cov)
        if len(typed) > 1:
            dense = dl >= 2
            for x, y in itertools.combinations(typed, 2):
                both = np.flatnonzero((x > 0) & (y > 0) & dense)
                pairs[both] += w / (1 + dl[both] / (x[both] + y[both]))
                k[both] += 1
    for a in raw:
        raw[a] /= batch["total_weight"]
    cover /= batch["total_weight"]
    if "bm25f" in algos:
        v, held = zero(), zero()
        for tf, top, boost in joined.values():
            on = tf > 0
            v[on] += (top * (tf * (batch["k1"] + 1) / (batch["k1"] + tf) + batch["delta"]) * boost)[on]
            held[on] += boost
        cov = held / q["total_f"] if q["total_f"] > 0 else zero()
        raw["bm25f"] = v * (1 + cov * cov)
    near = np.where(k > 0, 1 + q["prox"] * np.minimum(1.0, pairs / np.maximum(k, 1)), 1.0)
    titles = r.titles[kept]
    base, span, half, partial = batch["bonus"]
    concepts, n = q["concepts"], np.bitwise_count(slots).astype(np.int64)
    share = np.minimum(1.0, concepts / np.maximum(1, titles))
    bonus = np.where((concepts == 0) | (n == 0), 1.0, np.where(n >= concepts, base + span * share * share, np.where(n * 2 >= concepts, half, partial)))
    r.pos[kept] = -1
    scores = {a: raw[a] * (near if a in batch["near"] else 1.0) * bonus for a in algos if a != "rrf"}
    fused = (raw["bm25"], cover, bonus) if "rrf" in algos else None
    return kept, titles, scores, fused


def _best(score: np.ndarray, titles: np.ndarray, depth: int, close: float) -> np.ndarray:
    """Places of all that can be among the first: equal scores by length of title and place, those too close to tell all count."""
    live = np.flatnonzero(score > 0)
    if len(live) <= depth:
        return live
    s = score[live]
    least = np.partition(s, len(s) - depth)[len(s) - depth] - close
    live = live[s >= least]
    t = titles[live]
    live = live[np.lexsort((live, np.where(t < 0, NO_CUT, t), -score[live]))]
    s = score[live]
    begin = np.r_[True, s[1:] != s[:-1]]
    at = np.arange(len(live))
    return live[at - np.maximum.accumulate(np.where(begin, at, 0)) < depth]


def _rank(batches: Iterator[pa.RecordBatch], shared, depth: int) -> Iterator[pa.RecordBatch]:
    batch = shared.value
    names = sorted(batch["algos"])
    for r in _ranges(batches, batch["n_codes"]):
        values, out = _values(r, batch), []

        def flush(out: list, r: _Range = r) -> pa.RecordBatch:
            q, a, at, s, c, b = (np.concatenate(x) for x in zip(*out))
            t = r.titles[at]
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(a), pa.array(r.docs[at]), pa.array(s), pa.array(t, mask=t < 0), pa.array(c), pa.array(b)], names=["query_id", "a", "doc_id", "score", "title_len", "cover", "bonus"])

        rows = 0
        for q in batch["queries"]:
            got = _score(r, values, batch, q)
            if got is None:
                continue
            kept, titles, scores, fused = got
            for i, a in enumerate(names):
                if a == "rrf":
                    at, (s, c, b) = np.arange(len(kept)), fused
                else:
                    at = _best(scores[a], titles, depth, CLOSE * q["most"][a])
                    s, c, b = scores[a][at], np.zeros(len(at)), np.zeros(len(at))
                out.append((np.full(len(at), q["id"], np.int64), np.full(len(at), i, np.int32), kept[at], s, c, b))
                rows += len(at)
            if rows > 50_000:
                yield flush(out)
                out, rows = [], 0
        if out:
            yield flush(out)


def _query(index: Index, p: Plan, rows: list[tuple], codes: dict, algos: Sequence[str], bm25f_total: float) -> dict:
    """What the ranges need of a query. rows: those of ``search._term_rows``."""
    every, rows = rows, [r for r in rows if (r[1], r[2]) in codes]
    seek = sorted((r for r in rows if r[12] or r[10] > 0), key=lambda r: (r[15], r[2].encode()))
    terms = {t: i for i, t in enumerate(dict.fromkeys(r[2] for r in rows))}
    fields = [(f, [(codes[r[1], r[2]], r[4], r[3], r[13], r[14], terms[r[2]], r[8]) for r in g]) for f, g in itertools.groupby(rows, key=lambda r: r[15])]
    shape = {r[15]: r for r in every}
    k = p.knobs
    rare = max((sum(x[1] * x[2] for x in g) for _, g in fields), default=0.0)
    boosts = max((sum(x[2] for x in g) for _, g in fields), default=0.0)
    tops = sum({x[5]: x[6] * x[2] for _, g in fields for x in g}.values())
    prox = float(k.proximity_weight) if len({*p.parsed.required, *p.original}) >= 2 else 0.0
    widest = max((r[25] for r in rows), default=1.0)
    # no score of any range is above this
    factor = (1 + prox) * max(1.0, k.title_bonus_base + k.title_bonus_span, k.title_bonus_half, k.title_bonus_partial)
    cov = max((max(1.0, boosts / r[27]) if r[27] > 0 else 1.0 for r in rows), default=1.0)
    most = {"bm25": rare * (k.k1 + 1 + k.delta), "bm25+cov": rare * (k.k1 + 1 + k.delta) * (1 + cov * cov), "bm25f": tops * (k.k1 + 1 + k.delta) * (1 + cov * cov), "dfr": boosts * np.log2(2 * (widest + 1)), "freq": boosts * 22.0, "idf": rare, "cover": 100.0 * cov}
    return {
        "id": p.query_id, "need": every[0][11] if every else 0, "seek": [(i, r[9], r[10], codes[r[1], r[2]]) for i, r in reversed(list(enumerate(seek)))], "n_seek": max(1, len(seek)), "fields": fields,
        "excluded": [codes[f, t] for f in p.weights for t in p.excluded], "phrases": [(x, [tuple(codes.get((f, t), -1) for t in g) for f in p.weights]) for x, gs in ((False, p.parsed.required_phrases), (True, p.parsed.excluded_phrases)) for g in gs],
        "many": sum(p.df.get(r[1], {}).get(r[2], 0) for r in seek) > p.profile.candidate_limit, "cut": (NO_CUT, 0, 0),
        "total": {f: r[27] for f, r in shape.items()}, "plain": {f: r[28] for f, r in shape.items()}, "total_f": bm25f_total, "prox": prox, "concepts": len(p.slots), "most": {a: most[a] * factor for a in algos if a != "rrf"},
    }


def top_hits(index: Index, plans: Sequence[Plan], algos: Sequence[str], depth: int) -> DataFrame:
    """query_id, algo, rank, doc_id, score of the first depth documents of each plain query by each algorithm."""
    from quern.search import NEAR, _term_rows, _totals, read_terms

    spark = index.spark
    schema = "query_id long, algo string, rank int, doc_id long, score double"
    rows = {p.query_id: _term_rows(index, p) for p in plans}
    if not any(rows.values()):
        return spark.createDataFrame([], schema)
    # terms that a field hasn't are left out
    pairs = dict.fromkeys((f, t) for p in plans for f, d in p.df.items() for t in d)
    pairs |= dict.fromkeys((f, t) for p in plans for f in p.weights for t in p.excluded)
    in_phrases = {(f, t) for p in plans for f in p.weights for g in (*p.parsed.required_phrases, *p.parsed.excluded_phrases) for t in g}
    codes = {x: i for i, x in enumerate({**pairs, **dict.fromkeys(in_phrases)})}
    if not codes:
        return spark.createDataFrame([], schema)
    p0, weights = plans[0], plans[0].weights
    k, numbers = p0.knobs, {f: i for i, f in enumerate(weights)}
    stats = [index.field_stats.get(f, (0, 0)) for f in weights]
    parts: list[list[Plan]] = [[]]
    size = 0
    for p in plans:
        if parts[-1] and size + len(rows[p.query_id]) > PART_ROWS:
            parts.append([])
            size = 0
        parts[-1].append(p)
        size += len(rows[p.query_id])
    names = sorted(set(algos))
    same = {
        "algos": set(algos), "near": set(NEAR), "n_codes": len(codes), "field_of": np.array([numbers[f] for f, _ in codes], np.int32), "weight": np.array(list(weights.values())), "total_weight": sum(weights.values()),
        "n": np.array([float(max(1, n)) for n, _ in stats]), "avgdl": np.array([max(1.0, length / max(1, n)) for n, length in stats]), "field_b": np.array([float(p0.profile.field_b.get(f, k.b)) for f in weights]),
        "k1": float(k.k1), "b": float(k.b), "delta": float(k.delta), "bonus": (float(k.title_bonus_base), float(k.title_bonus_span), float(k.title_bonus_half), float(k.title_bonus_partial)),
    }

    with Scratch(spark, "ranges") as scratch:
        n_postings = sum({(f, t): n for p in plans for f, d in p.df.items() for t, n in d.items()}.values())
        bounds = _bounds(index, max(min(spark.sparkContext.defaultParallelism, 1 + n_postings // 20_000), -(-n_postings // RANGE_POSTINGS)))
        shard = F.lit(0)
        for b in bounds:
            shard = shard + (F.col("doc_id") >= b).cast("int")
        coded = small_table(spark, [(f, t, i, (f, t) in in_phrases) for (f, t), i in codes.items()], "field string, term string, code int, placed boolean")
        pos = F.when(F.col("placed"), F.col("pos")) if in_phrases else F.lit(None)
        own = read_terms(index, codes).join(coded, ["field", "term"]).select(shard.alias("shard"), "code", "doc_id", "freq", "len", "title_len", pos.cast("array<int>").alias("pos"))
        packed = scratch.write(own.repartitionById(len(bounds) + 1, F.col("shard")).mapInArrow(_pack, PACKED), keep=True)
        found = None
        for part in parts:
            queries = [_query(index, p, rows[p.query_id], codes, names, _totals(p, [t for f in p.weights for t in (*p.required_terms, *p.by_field.get(f, []))])[0]) for p in part]
            limit = p0.profile.candidate_limit
            if any(q["many"] for q in queries):
                shared = spark.sparkContext.broadcast(same | {"queries": queries})
                counts = packed.mapInArrow(lambda b, shared=shared: _count(b, shared), "query_id long, class long, shard int, n long")
                upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("query_id").orderBy("class", "shard").rowsBetween(Window.unboundedPreceding, 0)))
                cut = upto.where(F.col("upto") >= limit).groupBy("query_id").agg(F.min(F.struct("upto", "class", "shard", "n")).alias("m"))
                cuts = {r["query_id"]: (r["m"]["class"], r["m"]["shard"], limit - (r["m"]["upto"] - r["m"]["n"])) for r in cut.collect()}
                shared.unpersist()
                for q in queries:
                    q["cut"] = cuts.get(q["id"], q["cut"])
            shared = spark.sparkContext.broadcast(same | {"queries": queries})
            got = packed.mapInArrow(lambda b, shared=shared: _rank(b, shared, depth), "query_id long, a int, doc_id long, score double, title_len int, cover double, bonus double")
            found = got if found is None else found.unionByName(got)
    if "rrf" in algos:
        fused = found.where(F.col("a") == names.index("rrf"))
        for name in ("score", "cover"):
            fused = fused.withColumn(f"by_{name}", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(name, 6)), "doc_id")))
        fused = fused.withColumn("score", (1.0 / (float(k.rrf_k) + F.col("by_score")) + 1.0 / (float(k.rrf_k) + F.col("by_cover"))) * F.col("bonus"))
        found = found.where(F.col("a") != names.index("rrf")).unionByName(fused.select(*found.columns))
    own = Window.partitionBy("query_id", "a")
    scored = found.where("score > 0").withColumn("score", F.round(F.col("score") / F.max("score").over(own) * 100.0, 6))
    ranked = scored.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), F.asc_nulls_last("title_len"), "doc_id"))).where(F.col("rank") <= depth)
    algo = F.element_at(F.array(*map(F.lit, names)), F.col("a") + 1)
    return ranked.select("query_id", algo.alias("algo"), "rank", "doc_id", "score")
