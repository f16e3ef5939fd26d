"""Brute-force versions, round trips and edge cases of the training-data operators."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigmeter.llm import exact_dedup, jaccard_join, language, licences, packing, pieces, pii, quality, topk, toxicity
from sigmeter.session import materialise

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("alpha", "be", "gam", "del", "eps", "zeta", "é", "Th") for b in ("ta", "ra", "no", "mi", "lo", "ke", "x", "ing")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows_of(texts):
    return [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    out = [None, "", "   ", "one", "One", "one two", "x" * 5000, "a b c d e", "A B C D E"]
    for _ in range(25):
        base = prose(rng, rng.randint(30, 200)).split()
        out.append(" ".join(base))
        for cut in (1, 2, 5, 12):
            near = list(base)
            for _ in range(cut):
                near[rng.randrange(len(near))] = rng.choice(WORDS)
            out.append(" ".join(near))
    shared = prose(rng, 40)
    out += [shared + " " + prose(rng, 60) for _ in range(30)]
    out += [out[9].upper(), out[9], out[9]]
    out.append(prose(rng, 40_000))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return materialise(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3), "test-docs")


@pytest.fixture(scope="module")
def empty(spark):
    return materialise(spark.createDataFrame([], SCHEMA), "test-empty")


# ---- exact dedup

def test_dedup_matches_grouping(docs, texts):
    got = {r["doc_id"]: r for r in exact_dedup.label(docs).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").translate(LOW)].append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), i == max(ids))
            assert r["digest"] == hashlib.sha256(t.encode()).hexdigest()


def test_dedup_tells_clashing_digests_apart(docs, texts):
    weak = lambda text: F.pmod(F.length(text), F.lit(3)).cast("string")
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.label(docs, weak).collect()}
    last = {(t or "").translate(LOW): i for i, t in enumerate(texts)}
    assert got == {i: last[(t or "").translate(LOW)] for i, t in enumerate(texts)}


def test_dedup_state_continues_over_batches(spark, docs, texts):
    path = exact_dedup.scratch_path(spark, "arrivals")
    exact_dedup.arrivals(docs.filter("doc_id % 2 = 0")).repartition(4).write.parquet(path)
    state = exact_dedup.scratch_path(spark, "state")
    exact_dedup.run_state(spark, path, state, bytes_per_trigger=1)
    exact_dedup.arrivals(docs.filter("doc_id % 2 = 1")).write.mode("append").parquet(path)
    n = exact_dedup.run_state(spark, path, state).toDF("digest", "keep", "n").agg(F.sum("n"), F.count("*")).first()
    assert tuple(n) == (len(texts), len({(t or "").translate(LOW) for t in texts}))


def test_dedup_repeated_rows_nulls_and_clashing_columns(spark):
    rows = [(1, "a", "k"), (1, "a", "k"), (None, "a", "k"), (None, None, "q"), (2, "", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    out = exact_dedup.dedup(df).collect()
    assert sorted((r["doc_id"], r["text"], r["digest"]) for r in out) == [(1, "a", "k"), (2, "", "q")]


def test_empty_tables(spark, empty):
    assert exact_dedup.label(empty).count() == 0
    assert jaccard_join.classes(empty).count() == 0
    assert pii.find_spans(empty).count() == 0
    assert pieces.encode_decode(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert quality.rejecting(empty).count() == 0
    assert licences.scan(empty).count() == 0
    assert language.predict(empty, language.train(empty)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.Scorer(toxicity.labelled(empty, labels)).score(empty).count() == 0


# ---- personal data

def brute_spans(t):
    out, t = [], t or ""
    base = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    for rank, (kind, pattern) in enumerate(base):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_pii_base_spans_match_plain_patterns(spark):
    rng = random.Random(1)
    parts = list("0123456789") * 3 + list(" -.@+()abZ_%é😀\n") + ["+1 (476) 555-6291", "4111 1111 1111 1111", "1.2.3.4", "a.b@c.de"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(800)] + [None, "", "9" * 20_000, "x@" * 5000, "1." * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_spans(df).collect():
        assert [(s.start, s.rank, s.kind, s.end) for s in r.pii_spans if s.rank < 4] == brute_spans(texts[r.doc_id])


def test_pii_mod_97_context_and_redaction(spark):
    df = spark.createDataFrame([(1, "IBAN GB82 WEST 1234 5698 7654 32 ok", 9), (2, "IBAN GB83 WEST 1234 5698 7654 32 ok", 9),
                                (3, "my ssn is 123-45-6789", 9), (4, "part 123-45-6789", 9), (5, None, None)], "doc_id long, text string, n_chars long")
    kinds = {r.doc_id: [s.kind for s in r.pii_spans] for r in pii.find_spans(df).collect()}
    assert kinds == {1: ["iban"], 2: [], 3: ["ssn"], 4: [], 5: []}
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(df).collect()}
    assert out[1] == ("IBAN [IBAN] ok", 14) and out[3] == ("my ssn is [SSN]", 15) and out[5] == (None, None)


def test_pii_every_number_of_a_list_shares_its_heading(spark):
    some = [f"{a}-{b}-{c}" for a, b, c in zip(range(123, 132), range(45, 54), range(6789, 6798))]
    texts = ["social security numbers: 123-45-6789, 234-56-7890", "social security numbers: " + ", ".join(some), "SSN\n" + "\n".join(f"{i}. {n}" for i, n in enumerate(some)),
             "parts: " + ", ".join(some), "the ssn 123-45-6789 is wanted" + " by nobody at all" * 9 + " as 234-56-7890"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.pii_spans if s.kind == "ssn"] for r in pii.find_spans(df).collect()}
    assert got == {0: ["123-45-6789", "234-56-7890"], 1: some, 2: some, 3: [], 4: ["123-45-6789"]}
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[0] == "social security numbers: [SSN], [SSN]"


def test_pii_account_numbers_end_where_they_end(spark):
    de, gb, xx = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "XX57 1234 5678 9012 345"
    texts = [f"IBAN {de} BIC COBADEFFXXX", f"IBAN {de.replace(' ', '')} BIC COBADEFFXXX", f"pay {de} EUR 250,00 or {gb} 2024-01-05", f"{xx} EUR", f"{de} {gb} {de} {gb}",
             f"AB12 3456 7890 1234 {de} TO", f"{de}x", f"{de[:-1]}1 BIC", f"é😀 {gb} Bic", f"{gb}9 EUR", None, de]
    want = [[de], [de.replace(" ", "")], [de, gb], [xx], [de, gb, de, gb], [de], [], [], [gb], [], [], [de]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.pii_spans if s.kind == "iban"] for r in pii.find_spans(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert {r.doc_id: r.text for r in pii.redact(df.filter("doc_id < 2")).collect()} == {0: "IBAN [IBAN] BIC COBADEFFXXX", 1: "IBAN [IBAN] BIC COBADEFFXXX"}


# ---- tokens and packing

ODD = [" ", "  ", "\n", " \n", "a", "the", "é", " ", " ", "\t", "'s", "12", "😀", "<|endoftext|>", "漢", "Z", "!!", "▁", "</s>", "\x00", "\x85"]


def odd_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [None, "", " ", "▁"]


def test_pieces_equal_the_library():
    codec = pieces.Codec(pieces.default_model())
    codec.ids.limit = 300  # the table starts anew many times
    for text, (ids, back) in zip(odd_texts(1500), codec.batch(pa.array(odd_texts(1500), pa.string()))):
        want, shown = codec.whole(text or "")
        assert list(ids) == list(want) and back == shown


def test_token_chunks_equal_the_library():
    from tokenizers import Tokenizer

    tok, table = Tokenizer.from_file(packing.default_tokenizer()), packing.token_table(packing.default_tokenizer())
    texts = odd_texts(1500)
    data, starts = packing.utf8(pa.array(texts, pa.string()))
    rows, place, before = table.cut(data, starts, packing.cut_at_space_before_word)
    ids, at = table.join(rows[place], before)
    for i, t in enumerate(texts):
        assert tok.encode(t or "", add_special_tokens=False).ids == ids[at[i]:at[i + 1]].tolist()


def test_packing_is_gapless_whole_and_tight(docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs, block=64).toPandas()
    for doc_id, own in rows.sort_values("piece").groupby("doc_id"):
        ids = np.array(tok.encode(texts[doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert own["start"].tolist() == np.cumsum([0, *own["length"][:-1]]).tolist() and own["length"].sum() == len(ids)
        assert (own["length"].iloc[1:] == 1024).all()
        assert own["ids_crc32"].tolist() == [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(own["start"], own["length"])]
    rows = rows.sort_values(["sequence_id", "offset"])
    per = rows.groupby("sequence_id")["length"]
    assert (rows["offset"] == per.cumsum() - rows["length"]).all() and per.sum().max() <= 1024
    size = [n for n in rows["length"] if n < 1024]
    alone = len(packing.fresh(size, 1024, np.random.default_rng(0), 0.0)) + int((rows["length"] == 1024).sum())
    assert rows["sequence_id"].nunique() <= alone + 2


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 600, 300).tolist()
    a, b = (packing.fresh(size, 1024, rng, x) for x in (0.0, 0.3))
    child = packing.crossover(a, b, size, 1024, rng)
    assert sorted(i for c in child for i in c) == list(range(300)) and max(sum(size[i] for i in c) for c in child) <= 1024


# ---- near duplicates

def brute_components(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= 75 * len(sets[i] | sets[j]) and shared:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join_matches_all_pairs(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(docs).collect()}
    assert got == brute_components(texts)


def test_one_document_of_each_component_stays(docs, texts):
    want = {c for _, c in brute_components(texts).values()}
    out = jaccard_join.one_per_class(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want


@pytest.mark.parametrize("domain", [0, 0.3, 0.8, 1.0])
def test_similar_sets_share_a_signature_whatever_is_frequent(domain):
    """``domain``: share of the shingles that are called frequent."""
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 4, 5, 7, 10, 20, 40, 90, 200, 333):
        for _ in range(12):
            base = rng.integers(0, 2**63, size * 2, np.uint64)
            a = np.unique(base[:size])
            k = int(size * rng.random() * 0.3)
            b = np.unique(np.concatenate([a[k:], base[size:size + int(k * rng.random())]]))
            if not len(b):
                continue
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 75 * (len(a) + len(b) - shared):
                pool = np.unique(np.concatenate([a, b]))
                frequent = np.sort(rng.choice(pool, int(domain * len(pool)), replace=False))
                assert np.intersect1d(jaccard_join.signatures(a, frequent), jaccard_join.signatures(b, frequent)).size


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 300, np.uint64))
    b = np.unique(np.concatenate([a[40:], rng.integers(0, 2**63, 10, np.uint64)]))
    x, y = (np.frombuffer(jaccard_join.sketch(s).tobytes(), np.uint64) for s in (a, b))
    assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("size", [5, 200, 256, 257, 1000, 4100])
def test_long_sketch_folds_to_the_short_one(size):
    s = np.unique(np.random.default_rng(size).integers(0, 2**63, size, np.uint64))
    own = jaccard_join.sketch(s).view(np.uint64)
    assert len(own) * 64 >= max(512, 2 * len(s))
    assert (np.bitwise_xor.reduce(own.reshape(-1, 8), axis=0) == jaccard_join.sketch(s, 8).view(np.uint64)).all()


def test_size_and_sketch_bounds_never_drop_a_link(spark):
    """Pairs on both sides of a doubling of the sketch, similar or not; every similar one must stay."""
    rng = np.random.default_rng(11)
    rows, pairs, similar = [], [], set()
    for i, size in enumerate([240, 250, 256, 300, 500, 512, 530, 1000, 1024, 1100] * 6):
        a = np.unique(rng.integers(0, 2**63, size, np.uint64))
        cut = int(size * rng.choice([0.0, 0.05, 0.13, 0.2, 0.6]))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, int(cut * rng.random()), np.uint64)]))
        for k, s in ((2 * i, a), (2 * i + 1, b)):
            rows.append((k, len(s), jaccard_join.sketch(s).tolist()))
        pairs.append((2 * i, 2 * i + 1))
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 75 * (len(a) + len(b) - shared):
            similar.add(pairs[-1])
    sizes = spark.createDataFrame(rows, "key long, n_shingles long, parity array<long>")
    kept = {(r["a"], r["b"]) for r in jaccard_join.bounded(spark.createDataFrame(pairs, "a long, b long"), sizes).collect()}
    assert similar and similar <= kept and len(kept) < len(pairs)


# ---- search

def test_top_k_matches_brute_force_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    vecs = rng.normal(0, 1, (300, 8)).round(2).tolist()
    vecs += [vecs[0]] * 60 + [None, [float("nan")] * 8, [None] + [0.0] * 7, [float("inf")] * 8]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, label int")
    data = topk.quantised(df)
    got = defaultdict(list)
    for r in topk.top_k(data, data.filter("vec_id % 20 = 0"), 20, pivots=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x = {i: [math.floor(64 * c) for c in v] for i, v in enumerate(vecs[:360])}
    for q in (i for i in x if i % 20 == 0):
        want = sorted(((sum(a * b for a, b in zip(x[q], x[j])), j) for j in x if j != q), key=lambda z: (-z[0], z[1]))[:20]
        assert got[q] == [(j, s) for s, j in want]
    assert len(got) == 18
    few = data.filter("vec_id < 5")
    assert topk.top_k(few, few, 20).count() == 20
    assert topk.top_k(few.limit(0), few, 20).count() == 0


def test_scores_beyond_float_precision_are_exact():
    q, x = np.array([[2**30 + 1, 3]]), np.array([[2**30 + 1, 5], [7, 2**30]])
    assert topk.scores(q, x).tolist() == [[(2**30 + 1) ** 2 + 15, 7 * (2**30 + 1) + 3 * 2**30]]
    with pytest.raises(OverflowError):
        topk.scores(np.array([[2**40]]), np.array([[2**40]]))


# ---- models

def test_code_lengths_equal_a_plain_model():
    texts = {"x": ["hello there the cat", "the hat"], "y": ["bonjour le chat", "élan la"]}
    counts = []
    for lang, own in texts.items():
        got = list(language._count(iter([pa.RecordBatch.from_arrays([pa.array([lang] * 2), pa.array(own)], names=["lang", "text"])])))[0]
        counts.append((np.asarray(got.column(1)).astype(np.uint32), np.asarray(got.column(2))))
    model = language.Model(list(texts), counts)

    def plain(lang, text):
        seen = [defaultdict(Counter) for _ in range(4)]
        for t in texts[lang]:
            b = (language.PAD + t).encode()
            for i in range(3, len(b)):
                for o in range(4):
                    seen[o][b[i - o:i]][b[i]] += 1
        b, bits = (language.PAD + text).encode(), 0.0
        for i in range(3, len(b)):
            for o in (3, 2, 1, 0, -1):
                if o < 0:
                    bits += 8
                    break
                c = seen[o].get(b[i - o:i])
                if c:
                    n, kinds = sum(c.values()), len(c)
                    if b[i] in c:
                        bits -= math.log2(c[b[i]] / (n + kinds))
                        break
                    bits -= math.log2(kinds / (n + kinds))
        return bits

    for t in ("the chat", "zzé le hello", "bonjour", "q"):
        data, _ = language._folded(pa.array([t]))
        assert np.allclose(model.code_lengths(data)[3:].sum(0), [plain(lang, t) for lang in texts], atol=1e-3)


def test_language_of_odd_texts(spark):
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 6)]
    rows += [(90, None, None, "s", 0), (91, "", "en", "s", 0), (92, "123 !!", None, "s", 0), (93, "le chat", None, "s", 0), (93, "le chat", None, "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r["doc_id"], r["lang_pred"]) for r in language.predict(df, language.train(df)).collect()]
    assert [g for g in got if g[0] >= 90] == [(90, "und"), (91, "und"), (92, "und"), (93, "fr"), (93, "fr")]
    assert {r["lang_pred"] for r in language.predict(df, None).collect()} == {"und"}


def test_em_finds_the_labellers_that_matter():
    rng = random.Random(2)
    counts = Counter()
    for _ in range(4000):
        bad = rng.random() < 0.15
        kind = rng.randrange(2)
        votes = ["g"] * 5
        if bad:
            votes[2 * kind] = votes[2 * kind + 1] = "b"
        if rng.random() < 0.1:
            votes[4] = "-"
        counts["".join(votes)] += 1
    post = quality.expectation_maximisation(sorted(counts.items()))
    assert post["ggggg"] > 0.9 and post["bbggg"] < 0.1 and post["ggbbg"] < 0.1


def test_quality_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(9)
    good = [prose(rng, 80) + "." for _ in range(60)]
    junk = ["!! ".join(w.upper() for w in prose(rng, 60).split()) for _ in range(12)] + ["%%% ".join(prose(rng, 60).split()) for _ in range(12)] + ["Und " * 90] * 4
    rows = [(i, t, "a", 1.0) for i, t in enumerate(good + junk + [None, "", " "])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality double")
    out = quality.rejecting(df)
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == df.columns and len(kept & set(range(60))) >= 59 and not kept & {88, 89, 90} and len(kept) <= 62


def test_toxicity_held_out_quality(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randint(20, 120)).split()
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(max(2, len(words) // 12)):
                words[rng.randrange(len(words))] = rng.choice(["grumph", "snarkel", "blorted", "blorting"])
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, None, int(toxic)))
    rows += [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0)]
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.Scorer(toxicity.labelled(docs, known)).score(docs).collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.3) == bool(y) for i, y in held) / len(held) > 0.97
    assert len(got) == 902 and 0 <= got[5000] <= 1 and got[5000] == got[5001]


def test_toxicity_without_two_classes(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], SCHEMA)
    known = spark.createDataFrame([(1, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.Scorer(toxicity.labelled(docs, known)).score(docs).collect()] == [0.0]


def test_licence_scan_matches_plain_dice(spark):
    texts = ["Some words.\nReleased under the MIT License.\nmore words here", "Licensed under CC BY-NC 4.0", "Licensed under the Apache Licence, Version 2.0", None, "", "no notice at all"]
    got = {r["doc_id"]: (r["licence"], r["n_matches"]) for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == ("MIT", 1) and got[1][0] == "CC-BY-NC-4.0" and got[3] == got[4] == got[5] == (None, 0)
    scanner = licences.Scanner(licences.TEMPLATES, 0.8)
    rng = random.Random(1)
    vocabulary = [w for _, t in licences.TEMPLATES for w in licences.WORD.findall(t.lower())]
    for _ in range(400):
        words = licences.WORD.findall(rng.choice(licences.TEMPLATES)[1].lower())
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        every = [(licences.dice(licences.bigrams(words), g), n) for _, n, g in scanner.made]
        top = max((e for e in every if e[0] >= 0.8), default=None)
        assert scanner.best(words) == top


def test_licence_notice_inside_other_text(spark):
    texts = ["All of the code in this folder was written by the team. Licensed under the Apache\nLicense, Version 2.0. Ask them for more\nif you need it.",
             "It is licensed under the Apache License, Version 2.0, and hosted by the team", "We think, as said before, that the code is released\n# under the MIT License and that this is fine",
             "The apache is a license to all of version two under the team", "Released under the MIT License. " * 400 + "x"]
    got = [(r["licence"], r["licences"], r["n_matches"]) for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [("Apache-2.0", ["Apache-2.0"], 1), ("Apache-2.0", ["Apache-2.0"], 1), ("MIT", ["MIT"], 1), (None, [], 0), ("MIT", ["MIT"], 1)]


def test_licence_windows_match_all_stretches():
    scanner, rng = licences.Scanner(licences.TEMPLATES, 0.8), random.Random(5)
    vocabulary = [w for _, t in licences.TEMPLATES for w in licences.WORD.findall(t.lower())]
    few = [t for t in licences.TEMPLATES if len(t[1].split()) < 25]
    for _ in range(60):
        words = licences.WORD.findall(rng.choice(few)[1].lower())
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words)), rng.choice(vocabulary))
        words = [rng.choice(vocabulary) for _ in range(4)] + words + [rng.choice(vocabulary) for _ in range(4)]
        every = [scanner.named(words[i:j]) for i in range(len(words)) for j in range(i + 2, len(words) + 1)]
        assert any(every) == bool(scanner.windows(words))


def test_licence_siblings_are_told_apart():
    scanner = licences.Scanner(licences.TEMPLATES, licences.THRESHOLD)
    full = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    short = "This work is licensed under the GNU {} License, version {}."
    cases = [(full.format("General Public", "2"), "GPL-2.0-or-later"), (full.format("General Public", "3"), "GPL-3.0-or-later"), (full.format("Affero General Public", "3"), "AGPL-3.0-or-later"),
             (full.format("Lesser General Public", "2.1"), "LGPL-2.1-or-later"), (full.format("Lesser General Public", "3"), "LGPL-3.0-or-later"), (short.format("Affero General Public", "3"), "AGPL-3.0"),
             (short.format("General Public", "3.0"), "GPL-3.0"), ("It is licensed under the GNU General Public License, version 3.0, as we hear, and it is hosted by the team of the day", "GPL-3.0"), (short.format("General Public", "4"), None), (short.format("Other Affero General Public", "2"), None), ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
             ("Licensed under CC BY-NC-SA 3.0.", "CC-BY-NC-SA-3.0"), ("Licensed under CC BY-NC 1.0.", None), ("Licensed under the Apache License, Version 3.0.", None)]
    for text, name in cases + [(t, n) for n, t in licences.TEMPLATES]:
        for around in (text, "We like it. " + text + " So do they, as we hear", text.replace(" ", "\n# ", 9)):
            assert scanner.scan(around)[1] == ([name] if name else []), around
