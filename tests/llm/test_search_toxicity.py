"""Operators 2 and 8."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("block", T.StringType())])
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("y", T.StringType())])


@pytest.mark.parametrize("bits,spread", [(64, 1.0), (40, 0.3), (128, 0.1)])
def test_top_k(spark, bits, spread, monkeypatch):
    from lookalike.llm import hamming_search

    monkeypatch.setattr(hamming_search, "BLOCK", 100)
    monkeypatch.setattr(hamming_search, "PACKET", 7)
    rng = np.random.default_rng(bits)
    base = rng.standard_normal((5, bits))
    v = base[rng.integers(0, 5, 400)] + spread * rng.standard_normal((400, bits))
    v[10:20] = v[0]
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)] + [(500, None, None)]
    df = spark.createDataFrame(rows, VECTORS)
    got = hamming_search.top_k(df, df.where("vec_id % 50 = 0"), 10).collect()
    code = v.astype(np.float32) > 0
    want = []
    for q in range(0, 400, 50):
        d = (code != code[q]).sum(axis=1)
        near = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        want += [(q, r + 1, int(i), int(d[i])) for r, i in enumerate(near)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_few_and_no_vectors(spark):
    from lookalike.llm.hamming_search import top_k

    df = spark.createDataFrame([(0, [1.0, -1.0], None), (1, [1.0], None), (2, [], None)], VECTORS)
    assert sorted(map(tuple, top_k(df, df.where("vec_id = 0")).collect())) == [(0, 1, 1, 0), (0, 2, 2, 1)]
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_block_max_is_exact():
    from lookalike.llm.toxicity import BlockMax

    rng = np.random.default_rng(1)
    rows = []
    for i in range(700):
        ids = np.sort(rng.choice(60, rng.integers(1, 12), replace=False))
        w = rng.random(len(ids))
        rows.append((i, int(rng.random() < 0.3), ids, w / np.sqrt((w * w).sum())))
    index = BlockMax(rows, 60)
    place = {int(x): k for k, x in enumerate(index.ids)}
    dense = np.zeros((700, 60))
    for i, _, ids, w in rows:
        dense[place[i], ids] = w
    for i, _, ids, w in rows[:150]:
        got_i, got_s = index.nearest(ids, w, 15)
        s = dense[:, ids] @ w
        want = np.lexsort((np.arange(700), -np.round(s, 12)))[:15]
        assert np.allclose(got_s, s[want]) and np.allclose(s[got_i], s[want])


def test_toxicity_on_held_out(spark, sf):
    from lookalike.llm.toxicity import toxicity_scores

    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity_scores(docs, labels).cache()
    assert got.count() == docs.count()
    r = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic"), F.min("score"), F.max("score")).first()
    print(r)
    assert r[0] > 0.95 and r[1] / max(1, r[2]) > 0.9 and r[1] / r[3] > 0.8 and 0 <= r[4] <= r[5] <= 1


def test_toxicity_edges(spark):
    from lookalike.llm.toxicity import toxicity_scores

    r = random.Random(1)
    rows = [(i, ("nasty " if i % 3 == 0 else "") + " ".join(r.choice("abcdef") for _ in range(5)), "z") for i in range(300)] + [(None, None, None), (900, "", None), (901, "nasty " * 50000, None), (901, "NASTY!", None)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows)
    assert {x.predicted for x in got if x.doc_id == 901} == {1} and {x.predicted for x in got if x.doc_id in (900, None)} == {0}
    assert all(x.predicted == int(x.doc_id % 3 == 0) for x in got if x.doc_id is not None and x.doc_id < 300)
    assert {x.score for x in toxicity_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity_scores(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("n", [40, 200])
def test_few_labels_part_the_texts(spark, n):
    """What counts as a telling term follows the size of the sample."""
    from lookalike.llm.toxicity import toxicity_scores

    r = random.Random(n)
    rows = [(i, ("nasty " if i % 2 else "kindly ") + " ".join(r.choice("abcdef") + r.choice("ghij") for _ in range(6)), None) for i in range(2 * n)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")
    got = toxicity_scores(spark.createDataFrame(rows, DOCS), labels).collect()
    assert all(x.predicted == x.doc_id % 2 for x in got) and max(len(x.evidence) for x in got) > 5


def test_scores_and_evidence_against_brute_force(spark):
    """Terms, cosines, votes and calibration computed plainly over dense vectors."""
    import zlib
    from collections import Counter

    from lookalike.llm import toxicity as t
    from lookalike.llm.calibrate import HIGH, LOW, STEP

    r = random.Random(4)
    bad, good = ["nasty", "vile", "foul"], ["kindly", "warm", "gentle"]
    say = lambda own, other: " ".join([r.choice(own) for _ in range(r.randint(0, 3))] + [r.choice(other) for _ in range(r.random() < 0.2)] + [r.choice("abcdef") + r.choice("gh") for _ in range(8)])
    rows = [(i, say(bad, good) if i % 2 else say(good, bad), None) for i in range(500)]
    marks = {i: i % 2 for i in range(400)}
    docs = spark.createDataFrame(rows, DOCS)
    got = {x.doc_id: x for x in t.toxicity_scores(docs, spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")).collect()}
    learned = [i for i in marks if zlib.crc32(str(i).encode()) % 5]
    split = {x.doc_id: x.s for x in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(4)) == 0).alias("s")).collect()}
    terms = {i: t._terms(text.encode()) for i, text, _ in rows}
    n1 = sum(marks[i] for i in learned)
    n0, n = len(learned) - n1, len(learned)
    a, b = Counter(), Counter()
    for i in learned:
        (b if marks[i] else a).update(terms[i].keys())
    chi = {w: n * (b[w] * n0 - a[w] * n1) ** 2 / (n0 * n1 * (a[w] + b[w]) * (n - a[w] - b[w])) for w in a.keys() | b.keys() if 3 <= a[w] + b[w] < n}
    chosen = [w for w, x in chi.items() if x > t.STRICT * np.log(len(chi))]
    assert {b"nasty", b"kindly"} <= set(chosen)
    m = np.array([[terms[i][w] for w in chosen] for i, _, _ in rows], float)
    m = np.log1p(m) * (np.log((1 + len(rows)) / (1 + (m > 0).sum(0))) + 1)
    size = np.sqrt((m * m).sum(1, keepdims=True))
    m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
    examples = [i for i in learned if not split[i]]
    base = np.mean([marks[i] for i in examples])
    blank = np.mean([marks[i] for i in examples if not m[i].any()] or [base])
    live = np.array([i for i in examples if m[i].any()])
    raw, least = {}, {}
    for i, *_ in rows:
        c = m[live] @ m[i]
        top = np.sort(c[c > 0])[::-1][: t.K]
        least[i] = top[-1] if len(top) else 2
        weight = lambda x: 1 / (0.1 + max(1 - x, 0))
        assert all(m[i] @ m[j] >= least[i] - 1e-9 for j in got[i].evidence) and len(got[i].evidence) == len(top)
        # the evidence is the k nearest (ties at the last place go to any); it gives the vote
        w = np.array([weight(m[i] @ m[j]) for j in got[i].evidence])
        raw[i] = ((w * [marks[j] for j in got[i].evidence]).sum() + t.PRIOR * blank) / (w.sum() + t.PRIOR) if len(w) else blank
    tests = [i for i in learned if split[i]]
    pools = []
    bins = {}
    for i in tests:
        k = int(np.floor((min(max(raw[i], LOW), HIGH) - LOW) / STEP + 1e-9))
        p = bins.setdefault(k, [0, 0])
        p[0] += marks[i]
        p[1] += 1
    for k in sorted(bins):
        pools.append([bins[k][0], bins[k][1], bins[k][1] * (LOW + (k + 0.5) * STEP)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last)]
    want = np.interp([raw[i] for i, *_ in rows], [p[2] / p[1] for p in pools], [p[0] / p[1] for p in pools])
    apart = np.abs(want - [got[i].score for i, *_ in rows])
    assert np.quantile(apart, 0.95) < 1e-2 and apart.max() < 0.1
