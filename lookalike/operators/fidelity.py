"""How alike two tables are (H-20..H-38).  Values are counted before they are compared, so the
windows run over distinct values or bands, cut at ranges where there may be many (KS)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookalike.operators.models import all_nmi, discretize, quartile_edges
from lookalike.operators.profile import category_frequencies, correlations, exact_quantiles, numeric_columns, to_long, unpivoted
from lookalike.sources.io import written
from lookalike.sources.ranges import running_sums


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _sides(src: DataFrame, syn: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, a, b): counts of each value in both tables, in one pass."""
    one = unpivoted(src, cols).withColumn("s", F.lit(1))
    both = one.unionByName(unpivoted(syn, cols).withColumn("s", F.lit(0)))
    return both.where("value is not null").groupBy("column_name", "value").agg(F.sum("s").alias("a"), F.sum(1 - F.col("s")).alias("b"))


def ks(src: DataFrame, syn: DataFrame, columns: list[str], least: int = 5) -> DataFrame:
    """(column_name, similarity): one less the Kolmogorov-Smirnov distance (H-20)."""
    c = _sides(src, syn, columns).select("column_name", F.col("value").cast("double").alias("v"), "a", "b")
    gap = F.abs(F.try_divide("upto_a", "all_a") - F.try_divide("upto_b", "all_b"))
    g = running_sums(written(c), ["column_name"], "v", ["a", "b"]).withColumn("gap", gap).groupBy("column_name").agg(F.max("gap").alias("d"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return g.where((F.col("na") >= least) & (F.col("nb") >= least)).select("column_name", F.round(1 - F.col("d"), 6).alias("similarity"))


def tvd(src: DataFrame, syn: DataFrame, columns: list[str], limit: float = 0.15) -> DataFrame:
    """(column_name, tvd, similarity, passed) (H-21)."""
    c = _sides(src, syn, columns)
    per = Window.partitionBy("column_name")
    d = F.abs(F.col("a") / F.sum("a").over(per) - F.col("b") / F.sum("b").over(per))
    g = c.withColumn("d", d).groupBy("column_name").agg((F.sum("d") / 2).alias("x"))
    return g.select("column_name", F.round("x", 6).alias("tvd"), F.round(1 - F.col("x"), 6).alias("similarity"), (F.col("x") <= limit).alias("passed"))


def missing_similarity(src: DataFrame, syn: DataFrame, columns: list[str]) -> DataFrame:
    """One less the difference of null shares (H-22)."""
    rate = lambda df, n: to_long(df, {c: {n: F.avg(F.col(c).isNull().cast("double"))} for c in columns})
    return rate(src, "a").join(rate(syn, "b"), "column_name").select("column_name", F.round(1 - F.abs(F.col("a") - F.col("b")), 6).alias("similarity"))


def declared_nulls(df: DataFrame, declared: dict[str, float]) -> DataFrame:
    """(column_name, declared, actual) null shares (H-22)."""
    return to_long(df, {c: {"declared": F.max(F.lit(float(p))), "actual": F.round(F.avg(F.col(c).isNull().cast("double")), 6)} for c, p in declared.items()})


def corr_similarity(src: DataFrame, syn: DataFrame, columns: list[str]) -> DataFrame:
    """One less half the mean difference of the full correlation matrices (H-23)."""
    k = len(columns)
    a, b = correlations(src, columns), correlations(syn, columns).withColumnRenamed("correlation", "other")
    j = a.join(b, ["column_a", "column_b"])
    return j.agg(F.round(1 - F.coalesce(F.sum(F.abs(F.col("correlation") - F.col("other"))), F.lit(0.0)) * 2 / (k * k) / 2, 6).alias("similarity"))


def compare_distributions(src: DataFrame, syn: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """(metric, value, target, passed): means of the similarities against targets (H-24)."""
    mean = lambda df, n, t: df.agg(F.round(F.avg("similarity"), 6).alias("value")).select(F.lit(n).alias("metric"), "value", F.lit(t).alias("target"))
    parts = [mean(ks(src, syn, numbers), "ks", 0.85), mean(tvd(src, syn, categories), "tvd", 0.85), mean(missing_similarity(src, syn, numbers + categories), "missing", 0.90), mean(corr_similarity(src, syn, numbers), "correlation", 0.80)]
    return _union(parts).withColumn("passed", F.col("value") >= F.col("target"))


def quantile_rmse(src: DataFrame, syn: DataFrame, columns: list[str]) -> DataFrame:
    """Root mean square difference of 21 quantiles over the source's range (H-25)."""
    g = lambda df, n: exact_quantiles(df, {c: F.col(c) for c in columns}, [i / 20 for i in range(21)]).withColumnRenamed("q", n)
    names = src.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    j = names.join(g(src, "a"), "column_name", "left").join(g(syn, "b"), "column_name", "left")
    square = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("a")
    width = F.element_at("a", -1) - F.element_at("a", 1)
    return j.select("column_name", F.round(F.coalesce(F.try_divide(F.sqrt(square), width), F.lit(0.0)), 6).alias("rmse"))


def correlation_retention(src: DataFrame, syn: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """(parent, child, source, synthetic, retention): mutual information kept by each pair, in the
    source's bands (H-26)."""
    edges = quartile_edges(src, [c for c in columns if c in numeric_columns(src)])
    a = all_nmi(discretize(src, columns, edges), columns).select("parent", "child", F.col("nmi").alias("source"))
    b = all_nmi(discretize(syn, columns, edges), columns).select("parent", "child", F.col("nmi").alias("synthetic"))
    j = a.where(F.col("source") > least).join(b, ["parent", "child"])
    return j.withColumn("retention", F.round(F.least(F.lit(1.0), F.col("synthetic") / F.col("source")), 4))


def range_fidelity(src: DataFrame, syn: DataFrame, columns: list[str]) -> DataFrame:
    """Share of synthetic values within the source's 1 % and 99 % quantiles (H-27)."""
    q = {r.column_name: r.q for r in exact_quantiles(src, {c: F.col(c) for c in columns}, [0.01, 0.99]).collect()}
    none = [None, None]
    return to_long(syn, {c: {"share": F.round(F.avg(F.col(c).cast("double").between(F.lit(q.get(c, none)[0]), F.lit(q.get(c, none)[1])).cast("double")), 6)} for c in columns})


def vocabulary_fidelity(src: DataFrame, syn: DataFrame, columns: list[str]) -> DataFrame:
    """Share of synthetic values that the source knows (H-28)."""
    c = _sides(src, syn, columns)
    return c.groupBy("column_name").agg(F.round(F.try_divide(F.sum(F.when(F.col("a") > 0, F.col("b")).otherwise(0)).cast("double"), F.sum("b")), 6).alias("share"))


def source_fidelity(src: DataFrame, syn: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """(subject, measure, value, passed): mean difference in percent, overlap of the five top
    values, largest change of a correlation (H-30)."""
    m = lambda df, n: to_long(df, {c: {n: F.avg(c)} for c in numbers})
    delta = m(src, "a").join(m(syn, "b"), "column_name").select(F.col("column_name").alias("subject"), F.lit("mean_delta_pct").alias("measure"), F.round(F.abs(F.col("b") - F.col("a")) / F.greatest(F.abs("a"), F.lit(1e-9)) * 100, 4).alias("value"))
    top = lambda df: category_frequencies(df, categories, 1 << 30).withColumn("p", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))).where("p <= 5").select("column_name", "value")
    a, b = top(src), top(syn).withColumn("hit", F.lit(1))
    over = a.join(b, ["column_name", "value"], "left").groupBy("column_name").agg(F.round(F.count("hit") / F.count("*"), 4).alias("value")).select(F.col("column_name").alias("subject"), F.lit("top5_overlap").alias("measure"), "value")
    c = correlations(src, numbers).join(correlations(syn, numbers).withColumnRenamed("correlation", "o"), ["column_a", "column_b"])
    worst = c.agg(F.round(F.coalesce(F.max(F.abs(F.col("correlation") - F.col("o"))), F.lit(0.0)), 4).alias("value")).select(F.lit("table").alias("subject"), F.lit("correlation_delta").alias("measure"), "value")
    ok = F.when(F.col("measure") == "mean_delta_pct", F.col("value") <= 35).when(F.col("measure") == "top5_overlap", F.col("value") >= 0.4).otherwise(F.col("value") <= 0.35)
    return _union([delta, over, worst]).withColumn("passed", ok)


def business_fidelity(src: DataFrame, syn: DataFrame, group: str, value: str, flag: Column, least: int = 3) -> DataFrame:
    """(grp, mean_error, rate_error) of groups with enough rows on both sides (H-31)."""
    f = lambda df, n: df.groupBy(F.col(group).alias("grp")).agg(F.avg(value).alias(f"m{n}"), F.avg(flag.cast("double")).alias(f"r{n}"), F.count("*").alias(f"n{n}"))
    j = f(src, 1).join(f(syn, 2), "grp").where((F.col("n1") >= least) & (F.col("n2") >= least))
    err = F.least(F.lit(1.0), F.abs(F.col("m2") - F.col("m1")) / F.greatest(F.abs("m1"), F.lit(1e-9)))
    return j.select("grp", F.round(err, 6).alias("mean_error"), F.round(F.abs(F.col("r2") - F.col("r1")), 6).alias("rate_error"))


def categorical_drift(src: DataFrame, syn: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n) of values that the source does not have (H-32)."""
    return _sides(src, syn, columns).where("a = 0").select("column_name", "value", F.col("b").alias("n"))


def compare_readiness(src: DataFrame, syn: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """(severity, issue) of a side-by-side comparison (H-34)."""
    from lookalike.operators.validate import column_parity, parity_checks

    schema = column_parity(src, syn).where("not same").select(F.lit("blocker").alias("severity"), F.concat(F.lit("schema:"), "column_name").alias("issue"))
    empty = parity_checks(src, syn).where("empty").select(F.lit("blocker").alias("severity"), F.concat(F.lit("empty:"), "column_name").alias("issue"))
    new = categorical_drift(src, syn, categories).select("column_name").distinct().select(F.lit("warning").alias("severity"), F.concat(F.lit("novel:"), "column_name").alias("issue"))
    poor = ks(src, syn, numbers).where("similarity < 0.85").select(F.lit("warning").alias("severity"), F.concat(F.lit("ks:"), "column_name").alias("issue"))
    return _union([schema, empty, new, poor])


def ridge_r2(train: DataFrame, test: DataFrame, x: list[str], y: str, lam: float = 1.0) -> float:
    """R2 on test rows of a ridge fit on training rows: one aggregation of the Gram matrix (H-35)."""
    import numpy as np

    k = len(x)
    s = train.select(*x, y).dropna().agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)], F.avg(y).alias("my")).first()
    z = [(F.col(c) - F.lit(s[f"m{i}"])) / F.lit(s[f"s{i}"] or 1.0) for i, c in enumerate(x)]
    d = F.col(y) - F.lit(s["my"])
    g = train.select(*x, y).dropna().agg(*[F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)], *[F.sum(z[i] * d).alias(f"b{i}") for i in range(k)]).first()
    a = np.array([[g[f"g{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]) + lam * np.eye(k)
    w = np.linalg.solve(a, np.array([g[f"b{i}"] for i in range(k)]))
    guess = sum((z[i] * float(w[i]) for i in range(k)), F.lit(0.0))
    t = test.select(*x, y).dropna().agg(F.sum((d - guess) ** 2).alias("rss"), F.var_pop(y).alias("v"), F.count("*").alias("n")).first()
    return 1 - t.rss / (t.v * t.n) if t.n and t.v else 0.0


def tstr(real: DataFrame, holdout: DataFrame, syn: DataFrame, x: list[str], y: str) -> DataFrame:
    """Trained on synthetic against trained on real rows, both tested on held-out real rows (H-35)."""
    a, b = ridge_r2(syn, holdout, x, y), ridge_r2(real, holdout, x, y)
    return real.sparkSession.createDataFrame([(round(a, 4), round(b, 4), round(a / b, 4) if b > 1e-9 else 1.0)], "synthetic_r2 double, real_r2 double, ratio double")


def tstr_classifier(real: DataFrame, holdout: DataFrame, syn: DataFrame, x: list[str], y: str) -> DataFrame:
    """The same for a category, by logistic regression; accuracies (H-35)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    index = StringIndexer(inputCol=y, outputCol="_y", handleInvalid="skip").fit(real)
    ready = lambda df: VectorAssembler(inputCols=x, outputCol="_x").transform(index.transform(df.dropna(subset=[*x, y]))).select("_x", "_y")
    test = ready(holdout)
    acc = []
    for train in (syn, real):
        m = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=20, regParam=0.01).fit(ready(train))
        acc.append(m.transform(test).agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0] or 0.0)
    return real.sparkSession.createDataFrame([(round(acc[0], 4), round(acc[1], 4))], "synthetic_accuracy double, real_accuracy double")


def qa_report(tables: dict[str, DataFrame], source: dict[str, DataFrame], keys: dict[str, list[str]], edges: list, numbers: dict[str, list[str]], rules: dict[str, dict[str, str]]) -> DataFrame:
    """Check rows of keys, relations, ranges and business rules of a whole dataset (H-38)."""
    from lookalike.operators.gate import check
    from lookalike.operators.repair import check_rules
    from lookalike.operators.validate import fk_validity, pk_integrity

    parts = []
    for t, k in keys.items():
        pk = pk_integrity({t: tables[t]}, {t: k})
        parts.append(check(pk, "pk_unique", "integrity", F.col("duplicate_keys"), F.col("unique"), True, t, ",".join(k), 0.0))
    for e in edges:
        parts.append(check(fk_validity(tables, [e]), "fk_valid", "integrity", F.col("validity"), F.col("validity") == 1, True, e[0], e[1], 1.0))
    for t, cols in numbers.items():
        parts.append(check(range_fidelity(source[t], tables[t], cols), "range", "fidelity", F.col("share"), F.col("share") >= 0.9, False, t, F.col("column_name"), 0.9))
    for t, r in rules.items():
        parts.append(check(check_rules(tables[t], r), "rule", "business", F.col("compliance"), F.col("compliance") >= 0.95, False, t, F.col("rule"), 0.95))
    return _union(parts)
