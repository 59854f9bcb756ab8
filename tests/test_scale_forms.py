"""Forms that hold at any size against plain ones."""

import random

import numpy as np
from pyspark.sql import functions as F


def near_rows(spark, m, more=()):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + list(more), "k long, v array<double>")


def test_nearest_is_exact(spark, monkeypatch):
    from lookalike.operators import neighbours as N

    for name, value in (("BLOCK", 20), ("PACKET", 7), ("PIVOTS", 7)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(3)
    hubs = rng.standard_normal((6, 8)) * 20
    base, asked = (hubs[rng.integers(0, 6, n)] + rng.standard_normal((n, 8)) for n in (400, 90))
    base[100:200] = base[0]  # copies
    asked[0] = base[5]
    got = dict(map(tuple, N.nearest(near_rows(spark, asked, [(9999, None)]), near_rows(spark, base, [(9999, None)]), "v", "k").collect()))
    want = np.sqrt(((asked[:, None] - base[None]) ** 2).sum(-1)).min(1)
    assert got.keys() == set(range(90)) and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    assert N.nearest(near_rows(spark, asked), near_rows(spark, base).limit(0), "v", "k").count() == 0
    tree = N.Tree(near_rows(spark, base), "v")
    assert tree.depth > 1 and sum(x.count() for x in tree.leaves) == 300
    assert max(r["count"] for x in tree.leaves for r in x.groupBy("cell").count().collect()) <= 20


def test_leaves_met_do_not_grow_with_the_table(spark, monkeypatch):
    """On clustered vectors a query meets about as many leaves in a table eight times as large."""
    from lookalike.operators import neighbours as N

    for name, value in (("BLOCK", 25), ("PACKET", 64), ("PIVOTS", 15)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(4)
    hubs = rng.standard_normal((12, 2)) * 50
    some = lambda n: hubs[rng.integers(0, 12, n)] + rng.standard_normal((n, 2))
    asked, met = some(60), []
    for n in (1200, 9600):
        tree = N.Tree(near_rows(spark, some(n)), "v")
        q = near_rows(spark, asked).select("k", "v").toDF("key", "q")
        met.append(tree.nearest(q)[1].count() / 60)
    assert met[1] < 1.6 * met[0] and met[1] < 0.02 * 9600 / 25, met


def test_running_sums(spark):
    from lookalike.sources.ranges import running_sums

    r = random.Random(1)
    data = [(g, float(v), r.randrange(9), 1) for g in ("a", "b", None) for v in r.sample(range(1000), 200)]
    got = running_sums(spark.createDataFrame(data, "g string, v double, x long, y long"), ["g"], "v", ["x", "y"]).collect()
    assert len(got) == len(data)
    for row in got:
        mine = [d for d in data if d[0] == row.g]
        assert row.upto_x == sum(d[2] for d in mine if d[1] <= row.v) and row.all_y == 200 and row.upto_y == sum(d[1] <= row.v for d in mine)


def test_correlations_with_nulls_and_constants(spark):
    from lookalike.operators.profile import correlations

    r = random.Random(2)
    data = [(x := 1e6 + r.random(), None if r.random() < 0.2 else 2 * x + r.random(), 7.0, float("nan") if i == 5 else r.random(), None) for i in range(500)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e double")
    want = df.where("b is not null").agg(F.round(F.corr("a", "b"), 6)).first()[0]
    assert [tuple(x) for x in correlations(df).collect()] == [("a", "b", want)]
    assert correlations(df.limit(0)).count() == correlations(df.select("a")).count() == 0


def test_leak_scan_finds_substrings(spark):
    from lookalike.operators.privacy import leak_scan

    texts = spark.createDataFrame([(1, "write to alice@x.com."), (2, "(Smith)  and\n Jones"), (3, None), (4, "")], "id long, text string")
    bad = spark.createDataFrame([("alice@x.com",), ("Smith",), ("Smith) and Jones",), ("ab",), (None,), ("nobody",)], "v string")
    got = sorted(map(tuple, leak_scan(texts, "text", "id", bad, "v").collect()))
    assert got == [(1, "alice@x.com"), (2, "Smith"), (2, "Smith) and Jones")]
    assert leak_scan(texts, "text", "id", bad.limit(0), "v").count() == 0


def test_row_digest_keeps_fields_apart(spark):
    from lookalike.operators.privacy import row_digest

    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string")
    assert df.select(row_digest(["x", "y"]).alias("h")).distinct().count() == 2


def test_exact_quantiles(spark):
    from lookalike.operators.fidelity import quantile_rmse, range_fidelity
    from lookalike.operators.profile import exact_quantiles, profile_numeric

    rng = np.random.default_rng(7)
    cols = {"even": rng.standard_normal(501), "ties": np.repeat([1.0, 2.0, 2.0, 9.0], 126)[:501], "one": np.full(501, 4.0)}
    data = [(*(float(v[i]) for v in cols.values()), None, None if i % 3 else i) for i in range(501)]
    df = spark.createDataFrame(data, "even double, ties double, one double, none double, some long").repartition(5)
    at = [0.0, 0.013, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r.column_name: r.q for r in exact_quantiles(df, {c: F.col(c) for c in df.columns}, at).collect()}
    want = cols | {"some": np.arange(0, 501, 3)}
    assert got.keys() == want.keys()
    for c, v in want.items():
        assert np.allclose(got[c], np.quantile(v, at), rtol=0, atol=1e-9)
    assert exact_quantiles(df.limit(0), {"even": F.col("even")}, at).count() == 0
    nulls = {r.column_name: r.median for r in profile_numeric(df).collect()}
    assert nulls["none"] is None and nulls["one"] == 4.0 and len(nulls) == 5
    assert {r.column_name: r.rmse for r in quantile_rmse(df, df, ["even", "none"]).collect()} == {"even": 0.0, "none": 0.0}
    assert {r.column_name: r.share for r in range_fidelity(df, df, ["one", "none"]).collect()} == {"one": 1.0, "none": None}
