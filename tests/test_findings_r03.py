"""One test per finding of the third review round: each failed before its change."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _scratch(spark):
    from sigmeter.session import shared_dir

    return set(os.listdir(shared_dir(spark)))


def test_roc_auc_moves_packed_counts_and_writes_no_row(spark):
    from sigmeter.operators import ranks as R

    rng = np.random.default_rng(5)
    rows = [(g, int(y), float(s)) for g, k in (("a", 900), ("b", 300)) for y, s in zip(rng.integers(0, 2, k), np.round(rng.normal(0, 2, k), 2))]
    rows += [(None, 1, 0.5), (None, 0, -0.0), (None, 0, 0.0), (None, 1, 0.0), ("one", 1, 0.3)]
    before = _scratch(spark)
    got = {r["g"]: r["roc_auc"] for r in R.roc_auc(spark.createDataFrame(rows, "g string, y_true int, p_up double"), ["g"]).collect()}
    assert _scratch(spark) == before
    for g in ("a", "b", None):
        pos, neg = ([s for h, y, s in rows if h == g and y == k] for k in (1, 0))
        assert got[g] == sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got["one"] is None


def test_rows_are_dealt_as_stored_columns(spark):
    from sigmeter.sources import predictions as P

    plan = P.scored(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RepartitionByExpression"):].splitlines()[0]
    assert "l_orderkey" in dealt and "sample_id" not in dealt


def test_smooth_area_equals_the_sum_by_row():
    from sigmeter.functions.scalar import harmonic_numbers
    from sigmeter.operators import selective as SEL

    rng = np.random.default_rng(3)
    table = rng.poisson(1.0, (40, 30)).astype(float)
    day, wrong = rng.integers(0, 40, 5000), rng.random(5000) < 0.4
    for start in (SEL.SMOOTH_FROM, 10**7):
        c0 = np.full(30, start) + rng.integers(0, 900, 30)
        covered = c0 + 9 * 10**5
        m = table[day].astype(int)
        ends = c0 + np.cumsum(m, 0)
        plain = [math.fsum(float(harmonic_numbers(np.array([covered[d]]))[0]) - h for r in np.flatnonzero(wrong)
                           for h in harmonic_numbers(np.arange(ends[r, d] - m[r, d], ends[r, d]))) for d in range(3)]
        assert np.allclose(SEL._smooth_area(table, day, wrong, c0, covered)[:3], plain, rtol=0, atol=1e-7)  # of about 2,000 rows


def test_grid_points_are_sought_in_draws_that_have_one():
    from sigmeter.operators import selective as SEL

    covered = np.full(4, 10_000)
    assert SEL._holds_grid_point(np.array([60, 40, 0, 2000]), np.array([450, 501, 500, 8000]), covered).tolist() == [0, 3]


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")


def test_two_dumps_ride_on_one_join_and_faults_raise(spark):
    from sigmeter.operators import joins as J

    cand = spark.createDataFrame([("a", 1, 0), ("b", 0, 1)], "sample_id string, y_true int, y_pred int")
    base = spark.createDataFrame([("a", 1, 1, 0), ("b", 0, 0, 0), ("c", 1, 1, 1)], "sample_id string, y_true int, x int, z int")
    out = J.align_baselines(cand, base, ["sample_id"], ["x", "z"])
    assert _joins(out) == 1
    assert {(r.sample_id, r.variant, r.base_pred) for r in out.collect()} == {("a", "x", 1), ("a", "z", 0), ("b", "x", 0), ("b", "z", 0)}
    for bad in (base.filter("sample_id <> 'a'"), base.union(base), base.withColumn("y_true", 1 - F.col("y_true"))):
        with pytest.raises(Exception, match="baseline alignment"):
            J.align_baselines(cand, bad, ["sample_id"], ["x", "z"]).collect()


def test_a_ranking_is_written_without_its_ties(spark):
    from sigmeter.operators import ranks as R

    df = spark.createDataFrame([("a", 0.9, "s1", 1), ("a", 0.9, "s0", 0), ("a", 0.5, "s2", 1)], "seed string, confidence double, sample_id string, correct int")
    got = R.confidence_rank(df, ["seed"], keep_tie=False)
    assert "sample_id" not in got.columns
    assert [(r.rk, r.correct) for r in got.orderBy("rk").collect()] == [(1, 0), (2, 1), (3, 1)]


def test_a_pair_leaves_few_parts_and_two_sets_of_a_bucket_are_no_crowd():
    """op8: copies that share most signatures came out of every part."""
    from sigmeter.llm import jaccard_join as J

    rng = np.random.default_rng(3)
    none = np.zeros(0, np.uint64)
    kinds = [np.unique(rng.integers(0, 2**63, n, np.uint64)) for n in (8, 30, 90, 300, 900, 2700)]
    texts = [s for s in kinds for _ in range(40)]
    dealt = J.Deal({t: n for s in texts for t, n in [(J.instances(len(s))[0], 40)]}, 8192)
    volume = np.zeros(dealt.parts)
    assert dealt.parts > 20
    for s in kinds:
        met = set()
        for t, sig in J.by_instance(s, none):
            part = dealt.part(np.full(len(sig), t), sig)
            volume += 40 * np.bincount(part.astype(int), minlength=dealt.parts)
            assert len(set(part.tolist())) <= dealt.load[t] / 8192 + 2
            met |= set(part.tolist())
        assert len(met) <= dealt.parts * 2 / 3
        assert (J.signatures(s, none) == np.concatenate([x for _, x in J.by_instance(s, none)])).all()
    assert volume.max() <= 1.5 * 8192
    base = kinds[3]
    for copies, crowded in ((2, {False}), (3, {True})):
        near = [np.sort(np.append(base, np.uint64(i + 1))) for i in range(copies)]
        one = J.Deal({J.instances(len(near[0]))[0]: copies})
        packed = list(J._pack(one, [J.by_instance(s, none) for s in near], np.array([(J.set_key(s),) for s in near], J.NAME)))
        ties = J._stars(J.pa.Table.from_batches(packed)).to_pydict()
        assert {frozenset(p) for p in zip(ties["a"], ties["b"])} >= {frozenset((min(map(J.set_key, near)), max(map(J.set_key, near))))}
        assert set(ties["crowded"]) >= crowded and (copies == 3 or True not in ties["crowded"])


def test_packing_evolves_as_long_as_it_gains(monkeypatch):
    """op7: evolution ended after three generations whatever they gained."""
    from sigmeter.llm import packing as K

    steps = []

    def child(giver, taker, size, capacity, rng):  # one sequence fewer in each of twenty generations, then none
        best = min(giver, taker, key=len)
        steps.append(len(best))
        return [best[0] + best[1], *best[2:]] if len(best) > 20 else best

    monkeypatch.setattr(K, "crossover", child)
    single = [[i] for i in range(40)]
    best = K.evolve([single, single, single], [10] * 40, 1024, np.random.default_rng(0), 3)[0]
    assert len(best) == 20 and len(steps) == 23
    assert sorted(i for b in best for i in b) == list(range(40))


def test_the_join_drops_the_token_tables_of_its_worker():
    """pipeline: workers that had packed kept their tokenizers and chunk tables through the join."""
    from sigmeter.llm import jaccard_join, packing

    packing.token_table(packing.default_tokenizer())
    assert packing.token_table.cache_info().currsize == 1
    assert list(jaccard_join._describe(iter(()))) == []
    assert packing.token_table.cache_info().currsize == 0


def test_counts_are_those_of_the_scored_rows_without_making_them(spark):
    """h13, h15, k8: each row was multiplied by families and seeds and grouped by block before it was counted."""
    from sigmeter.catalog import scoring as S
    from sigmeter.functions import confusion as C
    from sigmeter.sources import predictions as P

    for keys in (S.KEYS, ["period_id", "seed"], ["candidate_id", "ticker", "trading_day", "model_family", "prior"]):
        got = P.counted(spark, SF, keys, S.ALL)
        want = P.scored(spark, SF, S.ALL).groupBy(*keys).agg(*C.row_sums())
        assert got.schema.names == want.schema.names and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = P.counted(spark, SF, S.KEYS, S.ALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan
    assert "trading_day" not in S.h13(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_thresholds_are_the_first_digits_that_predict_up():
    from sigmeter.sources import predictions as P

    up = lambda k, e, y: (k / 2.0**52 + e * y) / (1 + e) >= 0.5
    for e in P.FAMILIES.values():
        for y in (0, 1):
            k = int(P.least_up(e, y), 16)
            assert up(k, e, y) and not up(k - 1, e, y)


def test_block_values_are_computed_once_for_the_bootstrap_of_their_mean(spark):
    """k8: sizes and places of the blocks each counted all predictions again."""
    from sigmeter.operators import resample as RS

    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("m", f"T{i % 3}", f"d{i:02d}", i / 10) for i in range(30)]
    v = spark.createDataFrame(rows, "model_family string, ticker string, trading_day string, value double").mapInArrow(watched, "model_family string, ticker string, trading_day string, value double")
    got = RS.bootstrap_mean_lcb(v, ["model_family"], 300, 7).collect()[0]
    assert seen.value == 30 and got.n_blocks == 30 and abs(got["mean"] - 1.45) < 0.1 and got.lcb < got["mean"]


def test_numbers_are_sought_only_where_their_marks_stand(spark):
    """r4: every pattern ran over every text, some four times, and counts per document were shuffled to be added up."""
    from sigmeter.catalog import closing as CL
    from sigmeter.operators import textqa as TX

    def plain(text):
        found, rest = [], text
        for pattern in TX.SCIENTIFIC:
            parts = F.arrays_zip(F.regexp_extract_all(rest, F.lit(pattern), 1).alias("m"), F.regexp_extract_all(rest, F.lit(pattern), 2).alias("e"))
            found.append(F.transform(parts, lambda p: TX.shifted(p["m"], p["e"])))
            rest = F.regexp_replace(rest, pattern, " ")
        found.append(F.transform(F.regexp_extract_all(rest, F.lit(TX.POWER_OF_TEN), 1), lambda e: TX.shifted(F.lit("1"), e)))
        rest = F.regexp_replace(F.regexp_replace(rest, TX.POWER_OF_TEN, " "), TX.RANGE_DASH, " ")
        for pattern in TX.THOUSANDS:
            rest = F.regexp_replace(rest, pattern, "")
        return F.concat(F.regexp_extract_all(rest, F.lit(TX.PLAIN), 0), *found)

    rng = np.random.default_rng(11)
    bits = ["1", "23", "004", ".5", ",234", "{,}567", "--", "–", "—", "e5", "E-3", "e", "\\times ", "\\cdot", "10^{-2}", "10^7", "+", "-", " ", "x", ". "]
    rows = [(i, "".join(rng.choice(bits, rng.integers(0, 9)))) for i in range(3000)] + [(-1, None), (-2, "no digit")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", F.array_sort(TX.written_numbers(F.col("text"))).alias("a"), F.array_sort(plain(F.col("text"))).alias("b")).collect()
    assert [r for r in got if (r.a or []) != (r.b or [])] == [] and sum(len(r.b or []) for r in got) > 3000
    assert "Aggregate [doc_id" not in CL.r4b(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_a_long_title_is_not_repeated_with_its_tokens(spark):
    """r5: each token of a title was shuffled with the whole title."""
    from sigmeter.operators import textqa as TX

    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abc"), rng.integers(1, 4))) for _ in range(25)]
    some = lambda n: [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 8)))) for i in range(n)]
    left, right = some(60), some(120) + [(900, " ".join(f"w{i}" for i in rng.integers(0, 10**9, 4000))), (901, ""), (902, None)]

    def matches(a, b):
        x, y = set(a.split()), set(b.split())
        return a in b or b in a or len(x & y) / len(x | y) >= 0.6

    def written():
        of = spark._jsc.sc().statusStore().executorList(False)
        return sum(of.apply(i).totalShuffleWrite() for i in range(of.size()))

    start = written()
    got = TX.title_pairs(spark.createDataFrame(left, "id long, title string"), spark.createDataFrame(right, "id long, title string")).collect()
    want = {(i, j) for i, a in left for j, b in right if b and matches(a, b)}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50
    assert written() - start < 2_000_000


def test_texts_go_to_workers_in_small_batches(spark):
    """pipeline: batches of 10,000 texts took some hundred MB of an executor outside its heap, in packing most."""
    from sigmeter.llm import jaccard_join, packing, quality

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    schema = "doc_id long, text string"
    docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 400) AS text")
    none = spark.createDataFrame([], schema)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    for step in (lambda: packing.pack(none), lambda: quality.Scorer(none), lambda: jaccard_join.one_per_class(none)):
        spark.conf.unset(name)
        try:
            step()
            assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).head()[0] < 5 << 19
        finally:
            spark.conf.unset(name)


def test_packing_in_small_batches_is_the_same(spark):
    """Held before as well: how rows are batched changes no piece."""
    from sigmeter.llm import packing

    docs = spark.range(0, 300, 1, 2).selectExpr("id AS doc_id", "repeat(concat('word ', id, ' '), 1 + id % 40) AS text")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = []
    for most in ("64m", "1000"):
        spark.conf.set(name, most)
        try:
            rows.append(sorted(map(tuple, packing.cut(docs).drop("uid").collect())))
        finally:
            spark.conf.unset(name)
    assert rows[0] == rows[1] and len({r[0] for r in rows[0]}) == 300


def test_a_token_table_keeps_no_second_tokenizer(monkeypatch):
    """pipeline: workers held the tokenizer beside the faster library that agrees with it."""
    import weakref

    import tokenizers

    from sigmeter.llm import packing

    real, made = tokenizers.Tokenizer, []

    class Seen:
        def __init__(self, path):
            self.own = real.from_file(path)
            made.append(weakref.ref(self))

        from_file = classmethod(lambda cls, path: cls(path))

        def __getattr__(self, name):
            return getattr(self.own, name)

    monkeypatch.setattr(tokenizers, "Tokenizer", Seen)
    packing.token_table.cache_clear()
    try:
        path = packing.default_tokenizer()
        table = packing.token_table(path)
        assert made and all(r() is None for r in made)
        special = [t.content for t in real.from_file(path).get_added_tokens_decoder().values()][:1]
        chunks = [" plain", " 12,345", *special]
        for some in (chunks[:2], chunks):
            assert table.encode([c.encode() for c in some]) == [real.from_file(path).encode(c, add_special_tokens=False).ids for c in some]
    finally:
        packing.token_table.cache_clear()


def test_workers_drop_what_other_stages_filled():
    """pipeline: power tables of the join stayed through packing, token tables through the quality classifier."""
    from sigmeter.llm import packing, quality, shingles

    shingles._power_tables(10)
    packing.token_table(packing.default_tokenizer())
    assert list(quality._vote(iter(()))) == []
    assert not shingles._TABLES and packing.token_table.cache_info().currsize == 0
    n = shingles._BLOCK + 5
    up, down = shingles._power_tables(n)
    assert len(up) == len(down) == n and not shingles._TABLES
    assert (up[1:] * down[1:] == 1).all()
