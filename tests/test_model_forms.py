"""Operators without SQL against plain numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    z = rng.multivariate_normal([0, 0, 0], [[1, 0.8, 0], [0.8, 1, -0.3], [0, -0.3, 1]], 4000)
    m = np.column_stack([np.exp(z[:, 0]), 10 + 2 * z[:, 1], 5 * z[:, 2]])
    data = [(i, *map(float, r[:2]), None if i % 10 == 0 else float(r[2]), "ab"[int(r[1] > 10)]) for i, r in enumerate(m)]
    return z, m, spark.createDataFrame(data, "id long, a double, b double, c double, k string").cache()


def test_copula_keeps_marginals_ranks_and_nulls(spark, rows):
    from lookalike.operators.models import fit_copula, sample_copula

    z, m, df = rows
    model = fit_copula(df, ["a", "b", "c"])
    assert abs(model.correlation[0][1] - 0.8) < 0.03 and abs(model.null_rates["c"] - 0.1) < 1e-9
    assert np.allclose(model.grids["a"], np.percentile(m[:, 0], np.linspace(0, 100, 21)))
    got = sample_copula(spark, model, 6000).toPandas()
    assert sorted(got.row_id) == list(range(6000)) and abs(got.c.isna().mean() - 0.1) < 0.015
    for c, want in zip("ab", m.T):
        assert np.allclose(got[c].quantile([0.25, 0.5, 0.75]), np.quantile(want, [0.25, 0.5, 0.75]), rtol=0.08)
    ranks = got[["a", "b"]].rank().corr().iloc[0, 1]
    assert abs(ranks - 6 / np.pi * np.arcsin(0.4)) < 0.04
    again = sample_copula(spark, model, 1000, offset=5000).toPandas().set_index("row_id")
    assert again.sort_index().equals(got.set_index("row_id").loc[5000:].sort_index())


def test_imposed_correlation_keeps_both_columns(spark, rows):
    from lookalike.operators.generate import impose_correlation

    _, m, df = rows
    got = impose_correlation(df.select("id", "a", "b"), "a", "b", -0.6, "id").toPandas().sort_values("id")
    assert np.allclose(got.a, m[:, 0]) and np.allclose(np.sort(got.b), np.sort(m[:, 1]))
    assert abs(got[["a", "b"]].rank().corr().iloc[0, 1] + 0.6) < 0.05


def test_private_figures_near_the_true_ones(spark, rows):
    """With a budget that asks for hardly any noise the clipped figures are left; a small one shows."""
    from lookalike.operators import privacy as V

    _, m, df = rows
    bounds = {"a": (0.0, 10.0), "b": (2.0, 18.0)}
    x = np.column_stack([(m[:, i] - sum(bounds[c]) / 2) / ((bounds[c][1] - bounds[c][0]) / np.sqrt(12)) for i, c in enumerate(bounds)])
    x *= np.minimum(1, 3 / np.maximum(np.linalg.norm(x, axis=1), 1e-9))[:, None]
    s = x.T @ x
    want = s[0, 1] / np.sqrt(s[0, 0] * s[1, 1])
    at = lambda e, secret: V.dp_correlation(df, list(bounds), bounds, e, secret=secret)[0][1]
    assert abs(at(1e9, 1) - want) < 1e-6
    assert at(0.05, 1) != at(0.05, 2) and abs(at(0.05, 1) - want) > 1e-6
    model = V.fit_dp_copula(df, list(bounds), bounds, 1e9, secret=3)
    inside = np.clip(m[:, 1], *bounds["b"])
    assert np.allclose(model.grids["b"][5:16], np.percentile(inside, np.linspace(25, 75, 11)), atol=0.4)


def test_train_on_synthetic(spark, rows):
    from lookalike.operators import fidelity as D

    z, m, df = rows
    full = df.dropna()
    train, hold, syn = (full.where(F.col("id") % 3 == i) for i in range(3))
    p = {i: f.toPandas() for i, f in enumerate((train, hold, syn))}

    def r2(of):
        x, y = p[of][["a", "c"]].to_numpy(), p[of].b.to_numpy()
        mean, sd = x.mean(0), x.std(0)
        w = np.linalg.solve((n := (x - mean) / sd).T @ n + np.eye(2), n.T @ (y - y.mean()))
        t = p[1].b.to_numpy()
        return 1 - ((t - y.mean() - (p[1][["a", "c"]].to_numpy() - mean) / sd @ w) ** 2).sum() / (len(t) * t.var())

    got = D.tstr(train, hold, syn, ["a", "c"], "b").first()
    assert abs(got.synthetic_r2 - r2(2)) < 2e-3 and abs(got.real_r2 - r2(0)) < 2e-3
    acc = D.tstr_classifier(train, hold, syn, ["a", "c"], "k").first()
    assert acc.synthetic_accuracy > 0.75 and acc.real_accuracy > 0.75


def test_synthesizer_saved_and_loaded(spark, rows, tmp_path):
    from lookalike.operators import plugins as U

    syn, df = U.synthesizer("copula"), rows[2].select("a", "b")
    model = syn.fit(df)
    U.save_model(spark, model, f"file://{tmp_path}/model")
    loaded = U.load_model(spark, f"file://{tmp_path}/model")
    assert loaded == model
    assert syn.sample(spark, loaded, 50).collect() == syn.sample(spark, model, 50).collect()


def test_mimic_has_the_categories_and_ranges(spark, rows):
    from lookalike.operators.generate import mimic

    got = mimic(rows[2], 3000, "id").toPandas()
    want = rows[2].toPandas()
    assert sorted(got.id) == list(range(1, 3001)) and set(got.columns) == set(want.columns)
    assert abs((got.k == "a").mean() - (want.k == "a").mean()) < 0.04
    assert got.b.min() >= want.b.min() - 1e-5 and got.b.max() <= want.b.max() + 1e-5


def test_catalog_helpers(spark):
    from lookalike.operators import catalog as C
    from lookalike.operators.repair import PercentRule

    cols = spark.createDataFrame([("cities", "city_id", True), ("people", "id", True), ("people", "city_id", False), ("boxes", "box_id", True), ("visits", "people_id", False), ("visits", "box_id", False), ("visits", "nobody_id", False), ("boxes", "boxes_id", False)], "table_name string, column_name string, is_key boolean")
    assert sorted(map(tuple, C.infer_fks_by_name(cols).collect())) == [("people", "city_id", "cities", "city_id"), ("visits", "box_id", "boxes", "box_id"), ("visits", "people_id", "people", "id")]
    spec = spark.createDataFrame([("t", "user_uuid", "text", "sentence", None, None), ("t", "work_email", "text", None, None, None), ("t", "email", "foreign_key", None, None, None), ("t", "age", "int", None, None, None), ("t", "price", "float", None, 5.0, None), ("t", "page", "int", None, None, None)], "table_name string, column_name string, type string, text_type string, minimum double, maximum double")
    got = {r.column_name: (r.text_type, r.minimum, r.maximum) for r in C.fix_spec(spec).collect()}
    assert got == {"user_uuid": ("uuid", None, None), "work_email": ("email", None, None), "email": (None, None, None), "age": (None, 18.0, 80.0), "price": (None, 5.0, None), "page": (None, None, None)}
    review = C.categorical_review(spark.createDataFrame([("t", "a", "categorical", None), ("t", "b", "categorical", []), ("t", "c", "categorical", ["x"]), ("t", "d", "text", None)], "table_name string, column_name string, type string, choices array<string>"))
    assert sorted(r.column_name for r in review.collect()) == ["a", "b"]
    counts = spark.createDataFrame([("a", 10), ("b", 30), ("c", 0), ("d", 1)], "table_name string, row_count long")
    assert {r.table_name: r.planned_rows for r in C.scale_rows(counts, 82).collect()} == {"a": 20, "b": 60, "c": 0, "d": 2}
    assert C.detect_domain(["zzz"]) == "generic" and C.reference_table(spark, "generic", "nothing").count() == 0
    catalog = spark.createDataFrame([("t", "x", "int", False), ("t", "x_id", "int", False), ("t", "sent", "email", False), ("t", "u", "int", True)], "table_name string, column_name string, type string, unique boolean")
    rules = [("t", PercentRule(c, op, 1, p)) for c, op, p in (("x", ">", 50), ("x", ">", 101), ("x", "~", 5), ("y", "=", 5), ("x_id", "=", 5), ("sent", "=", 5), ("u", "=", 5))]
    assert [r.issue for r in C.check_rule(rules, catalog).collect()] == [None, "percent", "operator", "unknown column"] + ["protected column"] * 3
    prior = C.apply_priors(spark.createDataFrame([("price", "normal", None, None, None), ("unit_price", "normal", 3.0, None, None), ("qty", None, None, None, 2.0), ("odd", None, None, None, None)], "column_name string, distribution string, first double, second double, minimum double"), "ecommerce")
    assert {r.column_name: (r.distribution, r["first"], r.minimum, r.prior) for r in prior.collect()} == {"price": ("lognormal", 3.5, 0.99, True), "unit_price": ("normal", 3.0, None, False), "qty": ("poisson", 2.0, 2.0, True), "odd": (None, None, None, False)}
