"""Steps whose work a task bounds, against plain forms."""

import numpy as np
from pyspark.sql import functions as F


def test_least_distances_by_products():
    from lookalike.operators.neighbours import apart, least_apart

    rng = np.random.default_rng(5)
    a, m = rng.standard_normal((1300, 64)) + 1000, rng.standard_normal((700, 64)) + 1000
    a[:50], a[50:90] = m[:50], m[100:140] + 1e-9
    assert (least_apart(a, m) == apart(a, m).min(axis=1)).all()


def test_fact_rows_are_placed_in_ranges(spark):
    from lookalike.operators.generate import fact_rows

    plan = spark.createDataFrame([("a", 25_000, 1_000_003), ("b", 3, 100), ("c", 0, 9), (None, 2, 7)], "period string, units long, target long")
    out = fact_rows(plan)
    assert "__part" in out._jdf.queryExecution().optimizedPlan().toString()  # no window holds a whole period
    got = {r.period: (r.n, r.d, r.t) for r in out.groupBy("period").agg(F.count("*").alias("n"), F.count_distinct("row_no").alias("d"), F.sum("cents").alias("t")).collect()}
    assert got == {"a": (25_000, 25_000, 1_000_003), "b": (3, 3, 100), None: (2, 2, 7)}


def test_least_distances_of_odd_vectors():
    from lookalike.operators.neighbours import apart, least_apart

    a, m = np.array([[1.0, np.inf], [0.0, 2.0]]), np.array([[0.0, 1.0], [5.0, 5.0]])
    assert (least_apart(a, m) == apart(a, m).min(axis=1)).all()


def test_leaks_in_texts_without_an_id(spark):
    from lookalike.operators.privacy import leak_scan

    texts = spark.createDataFrame([(1, "it says  secret phrase here"), (None, "a secret phrase"), (2, "secret phrases aside, ab c"), (3, None), (4, "secre")], "id long, text string")
    bad = spark.createDataFrame([("secret phrase",), (" ab c ",), ("no",), (None,), ("\U0001f600x\U0001f600",)], "v string")
    got = sorted(map(tuple, leak_scan(texts, "text", "id", bad, "v").collect()), key=str)
    assert got == sorted([(1, "secret phrase"), (None, "secret phrase"), (2, "secret phrase"), (2, "ab c")], key=str)


def test_trigrams_are_counted_by_runs(monkeypatch):
    from collections import Counter

    from lookalike.operators import text as X

    monkeypatch.setattr(X, "CHARS", 40)
    texts = ["", None, "ab", "abc", "abcabcab\x00\x00", "\U0001f600 \u00e9t\u00e9 " * 9, "xyz" * 4]
    got, sizes = Counter(), []
    for at, n, grams, owner in X._gram_slices(texts):
        sizes += n.tolist()
        got.update((at + int(i), g) for i, g in zip(owner, X._gram_texts(grams), strict=True))
    assert sizes == [len(x or "") for x in texts]
    assert got == Counter((i, x[k : k + 3]) for i, x in enumerate(texts) if x for k in range(len(x) - 2))


def test_copula_steps_stay_apart(spark):
    """Each normal probability is computed once a row, not once for each time the next step names it."""
    from lookalike.operators.models import Copula, sample_copula

    model = Copula(["a", "b"], {c: [float(i) for i in range(21)] for c in "ab"}, {"a": 0.1, "b": 0.0}, [[1.0, 0.5], [0.5, 1.0]])
    out = sample_copula(spark, model, 50)
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("exp(") <= 4 and out.count() == 50


def test_spread_vectors_are_shipped_in_groups(spark, monkeypatch):
    """Where bounds exclude nothing, a meeting of a packet and a block is a few bytes, and results are exact."""
    from lookalike.operators import neighbours as N

    for name, value in (("BLOCK", 40), ("PACKET", 25), ("PIVOTS", 15), ("GROUPS", 2)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(6)
    base, asked = rng.standard_normal((300, 32)), rng.standard_normal((100, 32))
    base[7] = np.inf
    rows = lambda m: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "key long, q array<double>")
    tree = N.Tree(rows(base), "q")
    packets = tree.packets(rows(asked))
    visits = tree.visits(packets)
    assert visits.columns == ["p", "b", "mask"] and 0 < visits.count() <= packets.count() * tree.blocks().count()
    assert packets.count() < 50
    got = dict(map(tuple, tree.nearest(rows(asked))[0].collect()))
    want = np.sqrt(((asked[:, None] - base[None]) ** 2).sum(-1)).min(1)
    assert got.keys() == set(range(100)) and all(abs(got[i] - want[i]) < 1e-12 for i in got)
