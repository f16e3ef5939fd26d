"""Lexical search, collocations and nearest neighbours against brute force on small tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sigmeter.llm import collocations, lexical, neighbours

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

TEXTS = ["The red fox, the red fox! the RED fox", "", None, "red fox jumps", "x" * 30_000, "the " * 3000 + "end", "Ünïcode red\tfox  red fox",
         "no-break space stays", "red fox jumps", "a.b.c.d", "...", "the red fox jumps over the red fox"]


def terms_of(text):
    return re.findall(lexical.TERM, (text or "").translate(LOWER))


def brute_search(docs, items, top):
    bags = [(d, Counter(terms_of(t))) for d, t in docs if d is not None]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms_of(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, bag in bags:
            m = 100 - 50 + 50 * sum(bag.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m)) for t in terms if t in bag)
            if s > 0:
                scored.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_terms, bucket_rows", [(200_000, 2048), (3, 2)])
def test_search_equals_brute_force(spark, monkeypatch, block_terms, bucket_rows):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(lexical, "BUCKET_ROWS", bucket_rows)
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "red fox jumps"), (None, "red fox")]
    items = [(1, "Red fox"), (2, None), (3, ""), (4, "THE end jumps"), (5, "absent words"), (1, "over"), (None, "red"), (6, "space c x ünïcode")]
    d = spark.createDataFrame([(i, t, 7, 0.5) for i, t in docs], "doc_id long, text string, q int, score double")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    for top in (1, 3, 50):
        got = sorted(tuple(r) for r in lexical.search(d, q, top).collect())
        assert got == brute_search(docs, items, top)


def test_search_on_the_smallest_tables_and_on_empty_ones(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = sorted(tuple(r) for r in lexical.op11_lexical(spark, SF).collect())
    assert got == brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_bucket_bounds_lose_no_candidate():
    rng = np.random.default_rng(5)
    import pyarrow as pa

    rows = [np.sort(rng.choice(40, rng.integers(1, 20), False)).astype(np.int32) for _ in range(200)]
    impacts = [rng.integers(1, 1_000_000, len(r)).astype(np.int32) for r in rows]
    weights = rng.integers(0, 9000, 40)
    length = [math.sqrt(sum(weights[t] * float(x) ** 2 for t, x in zip(r, i))) for r, i in zip(rows, impacts)]
    bucket = lexical.Bucket(pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(length), pa.array([r.tobytes() for r in rows], pa.binary()),
                                                        pa.array([i.tobytes() for i in impacts], pa.binary())], names=["doc_id", "length", "terms", "impacts"]), 40)
    dense = np.zeros(40, np.int64)
    for size in (1, 5, 30):
        terms = np.array(sorted(rng.choice(40, size, False), key=lambda t: -weights[t]))
        exact = np.array([sum(int(weights[t]) * int(x) for t, x in zip(r, i) if t in set(terms.tolist())) for r, i in zip(rows, impacts)])
        for least in (1, int(np.median(exact)) + 1, int(exact.max()), int(exact.max()) + 1):
            at, score = lexical.candidates(bucket, terms, weights[terms], least, dense)
            assert sorted(at.tolist()) == np.flatnonzero(exact >= least).tolist() and (score == exact[at]).all()


def brute_collocations(docs, threshold, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        rows = []
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= threshold}
        inside = defaultdict(int)
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        for p, a in often.items():
            if 100 * inside[p] >= 100 * a:
                continue
            score, j = min((1000 * a * n[lang] // (c[p[:j]] * c[p[j:]]), j) for j in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:j]], c[p[j:]]))
        out += [(lang, r, p.decode(), -a, le, ri, n[lang], -s) for r, (s, a, p, le, ri) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("flush, part_mass, filter_words", [(3_000_000, 1 << 24, 1 << 22), (50, 64, 1)])
def test_collocations_equal_brute_force(spark, monkeypatch, flush, part_mass, filter_words):
    monkeypatch.setattr(collocations, "FLUSH", flush)
    monkeypatch.setattr(collocations, "PART_MASS", part_mass)
    monkeypatch.setattr(collocations, "FILTER_WORDS", filter_words)
    monkeypatch.setattr(collocations, "SLAB_BYTES", 200)
    docs = [(t, lang) for t in TEXTS for lang in ("en", None, "und", "de")] + [("of the red fox of the red fox of the", "en")] * 4
    frame = spark.createDataFrame([(i, t, lang, "x", 1) for i, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string, phrase string, a int")
    for threshold, top in ((3, 2000), (4, 3), (10_000, 5)):
        got = sorted(tuple(r) for r in collocations.collocations(frame, threshold, top).collect())
        assert got == brute_collocations(docs, threshold, top)


def test_collocations_of_nothing(spark):
    schema = "doc_id long, text string, lang string"
    assert collocations.collocations(spark.createDataFrame([], schema)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " .\t", "en")], schema), 1).count() == 0


@pytest.mark.parametrize("capacity", [40, 400, 4000])
def test_a_summary_keeps_what_is_frequent(capacity):
    rng = np.random.default_rng(capacity)
    values = rng.zipf(1.3, 60_000).astype(np.uint64) % np.uint64(1 << 20)
    summary = collocations.Summary(capacity, 30)
    for part in np.array_split(values, 57):
        p, c = np.unique(part, return_counts=True)
        summary.add([p], [c.astype(np.int64)])
    exact = Counter(values.tolist())
    assert {v for v, c in exact.items() if c >= 30} <= set(summary.survivors().tolist())
    assert summary.lost < 30
    assert all(0 <= exact[v] - c <= summary.lost for v, c in zip(summary.prints.tolist(), summary.counts.tolist()))


def brute_neighbours(rows, wanted, k):
    ok = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 4 and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for q in sorted({i for i, _ in ok} & set(wanted)):
        mine = [v for i, v in ok if i == q]
        best = {}
        for i, v in ok:
            if i != q:
                best[i] = min(best.get(i, math.inf), *(float(np.sqrt(((v - x) ** 2).sum())) for x in mine))
        out += [(q, r, i, d) for r, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k], 1)]
    return out


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(4).astype(np.float32)]) for i in range(40)]
    rows += [(40, None), (41, [0.0] * 4), (42, [1.0, None, 2.0, 3.0]), (43, [math.nan] * 4), (44, [math.inf, 0.0, 0.0, 0.0]), (45, [1.0, 2.0]), (None, [1.0] * 4), (46, [])]
    rows += [(i, rows[7][1]) for i in range(50, 80)] + [(7, rows[7][1]), (8, rows[9][1]), (9, rows[9][1])]
    frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, q int, score double")
    wanted = [0, 7, 8, 9, 40, 41, 42, 43, 44, 45, 46, 60]
    got = sorted(tuple(r) for r in neighbours.nearest_neighbours(frame, frame.filter(frame.vec_id.isin(wanted)), 5).collect())
    want = brute_neighbours(rows, wanted, 5)
    assert {r[0] for r in got} == {r[0] for r in want} and len(got) == len(want)
    hits = {(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}
    assert len(hits) >= 0.9 * len(want)
    exact = {(q, i): d for q, _, i, d in brute_neighbours(rows, wanted, 200)}
    assert all(abs(exact[(q, i)] - d) <= 1e-12 for q, _, i, d in got)
    assert [r for r in got if r[0] == 60] == [(60, r, i, 0.0) for r, i in enumerate([7, 50, 51, 52, 53], 1)]


def test_fewer_candidates_than_asked_are_all_returned(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(i, [float(i + 1), 1.0, 0.0, 0.0]) for i in range(6)]
    frame = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in neighbours.nearest_neighbours(frame, frame, 10).collect())
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in brute_neighbours(rows, range(6), 10)]
    assert neighbours.nearest_neighbours(frame.limit(0), frame).count() == 0
    assert neighbours.nearest_neighbours(frame, frame.limit(0)).count() == 0
    assert neighbours.nearest_neighbours(frame.limit(1), frame.limit(1)).count() == 0


def test_recall_and_split_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "DATA_BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = {r.vec_id: np.asarray(r.embedding, float) for r in t.collect()}
    got = defaultdict(list)
    for r in neighbours.op13_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in x if i % 100 == 0}
    found = 0
    for q, rows in got.items():
        near = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in x.items() if i != q)[:10]
        found += len({i for _, i in near} & {i for i, _ in rows})
        assert len(rows) == 10 and rows == sorted(rows, key=lambda r: (r[1], r[0]))
        assert all(abs(s - math.sqrt(((x[q] - x[i]) ** 2).sum())) < 1e-12 for i, s in rows)
    assert found >= 0.9 * 10 * len(got)


def test_probing_order_is_by_distance_to_walls():
    h = neighbours.Hashing(8, 4, 1.0, 81)
    x = np.random.default_rng(1).standard_normal((5, 8))
    names, score = h.probing(x, 1)
    assert names.shape == (5, 81) and (np.diff(score, axis=1) >= -1e-12).all()
    assert all(len(set(row)) == 81 for row in names.tolist())
    assert (names[:, 0] == h.names(np.floor(h.places(x, 1)), 1)).all()


def test_top_k_of_repeated_ids_and_ragged_vectors(spark):
    from sigmeter.llm import topk

    rng = np.random.default_rng(9)
    rows = [(i, [int(x) for x in rng.integers(-9, 9, 3)]) for i in range(30)]
    odd = [(31, [1, 2]), (32, [1, 2, 3, 4]), (33, None), (34, []), (None, [9, 9, 9]), (5, [100, 100, 100])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + rows + odd], "vec_id long, v array<long>, score int")
    kept = dict(rows)
    kept[5] = min(rows[5][1], [100, 100, 100], key=lambda v: np.array(v, "<i8").tobytes())
    got = [tuple(r) for r in topk.top_k(frame, frame.filter("vec_id % 10 IN (0, 5) OR vec_id > 30"), 4, pivots=3).orderBy("query_id", "rank").collect()]
    want = []
    for q in sorted(i for i in kept if i % 10 in (0, 5)):
        best = sorted((-sum(a * b for a, b in zip(kept[q], v)), i) for i, v in kept.items() if i != q)[:4]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == want
