"""Dependence and distribution models (D): discretisation, mutual information, conditionals,
encoders, Gaussian copula."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookalike.functions.rng import normal, uniform
from lookalike.operators.profile import exact_quantiles, group_quantiles, numeric_columns, suppress_rare

NULL_BAND = "∅"


def quartile_edges(df: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Quartiles of each column, equal ones once; all columns in one job."""
    if not columns:
        return {}
    q = exact_quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    return {r.column_name: sorted(set(r.q)) for r in q.collect()}


def discretize(df: DataFrame, columns: list[str], edges: dict[str, list[float]] | None = None) -> DataFrame:
    """Numbers with over four values to right-closed quartile bands, all else to strings (D-01)."""
    numbers = [c for c in columns if c in numeric_columns(df)]
    many = df.agg(*[F.count_distinct(c).alias(c) for c in numbers]).first() if numbers else {}
    bands = [c for c in numbers if many[c] > 4]
    edges = quartile_edges(df, [c for c in bands if not (edges or {}).get(c)]) | {c: e for c, e in (edges or {}).items() if e}
    out = {}
    for c in columns:
        if c in bands:
            e = edges[c]
            band: Column = F.lit(f"q{len(e)}")
            for i in range(len(e) - 1, -1, -1):
                band = F.when(F.col(c).cast("double") <= e[i], f"q{i}").otherwise(band)
            out[c] = F.when(F.col(c).isNull(), NULL_BAND).otherwise(band)
        else:
            out[c] = F.coalesce(F.col(c).cast("string"), F.lit(NULL_BAND))
    return df.withColumns(out)


def _nmi_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts: (by, a, b, n).  Mutual information over the smaller entropy."""
    key = by or [F.lit(1)]
    n = F.sum("n").over(Window.partitionBy(*key))
    pa, pb = F.sum("n").over(Window.partitionBy(*key, "a")), F.sum("n").over(Window.partitionBy(*key, "b"))
    j = counts.select(*by, "a", "b", "n", n.alias("t"), pa.alias("na"), pb.alias("nb"))
    p = F.col("n") / F.col("t")
    mi = F.sum(p * F.log(p / ((F.col("na") / F.col("t")) * (F.col("nb") / F.col("t")))))
    # each cell carries n/na of its row's entropy, so one aggregation gives both
    ha = -F.sum(p * F.log(F.col("na") / F.col("t")))
    hb = -F.sum(p * F.log(F.col("nb") / F.col("t")))
    least = F.least(ha, hb)
    return j.groupBy(*by).agg(F.when(least > 1e-12, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mi / least)), 6)).otherwise(F.lit(0.0)).alias("nmi"), F.max("t").alias("row_count"))


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information of two discretised columns (D-02)."""
    return _nmi_of_counts(df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")), [])


def all_nmi(df: DataFrame, columns: list[str]) -> DataFrame:
    """(parent, child, nmi, row_count) of each earlier and later column, counted in one pass."""
    pairs = F.array(*[F.struct(F.lit(p).alias("parent"), F.lit(c).alias("child"), F.col(p).alias("a"), F.col(c).alias("b")) for i, p in enumerate(columns) for c in columns[i + 1 :]])
    counts = df.select(F.explode(pairs).alias("x")).select("x.*").groupBy("parent", "child", "a", "b").agg(F.count("*").alias("n"))
    return _nmi_of_counts(counts, ["parent", "child"])


def dependency_graph(df: DataFrame, columns: list[str], least: float = 0.35, rows: int = 30) -> DataFrame:
    """Each column's best earlier column, if strong enough (D-03)."""
    strong = all_nmi(discretize(df, columns), columns).where((F.col("nmi") > least) & (F.col("row_count") >= rows))
    return strong.groupBy("child").agg(F.max_by("parent", F.struct("nmi", "parent")).alias("parent"), F.max("nmi").alias("nmi"))


def conditional_categorical(df: DataFrame, child: str, parents: list[str], least: int = 8) -> DataFrame:
    """P(child | context) for contexts with enough rows; context '*' is the marginal (D-04)."""
    ctx = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit(NULL_BAND)) for p in parents])
    value = F.coalesce(F.col(child).cast("string"), F.lit(NULL_BAND))
    one = df.groupBy(ctx.alias("context"), value.alias("value")).agg(F.count("*").alias("n"))
    every = one.groupBy(F.lit("*").alias("context"), "value").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("context"))
    out = one.unionByName(every).withColumn("t", total).where((F.col("t") >= least) | (F.col("context") == "*"))
    return out.select("context", "value", F.round(F.col("n") / F.col("t"), 6).alias("probability"))


def conditional_numeric(df: DataFrame, child: str, parents: list[str], least: int = 8, points: int = 21) -> DataFrame:
    """Quantile grid per context (D-05): (context, n, grid)."""
    ctx = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit(NULL_BAND)) for p in parents])
    counted = df.where(F.col(child).isNotNull()).groupBy(ctx.alias("context"), F.col(child).cast("double").alias("v")).count()
    found = group_quantiles(counted, ["context"], [i / (points - 1) for i in range(points)])
    return found.where(F.col("n") >= least).select("context", "n", F.transform("q", lambda x: F.round(x, 6)).alias("grid"))


def cross_table_conditionals(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, parent_cols: list[str], child_cols: list[str], least: float = 0.2, rows: int = 8) -> DataFrame:
    """Best parent attribute of each child attribute across a foreign key (D-06)."""
    p = discretize(parent, parent_cols).select(F.col(parent_key).alias("_k"), *[F.col(c).alias(f"p.{c}") for c in parent_cols])
    c = discretize(child, child_cols).select(F.col(child_key).alias("_k"), *[F.col(x).alias(f"c.{x}") for x in child_cols])
    pairs = F.array(*[F.struct(F.lit(a).alias("parent"), F.lit(b).alias("child"), F.col(f"`p.{a}`").alias("a"), F.col(f"`c.{b}`").alias("b")) for a in parent_cols for b in child_cols])
    counts = c.join(p, "_k").select(F.explode(pairs).alias("x")).select("x.*").groupBy("parent", "child", "a", "b").agg(F.count("*").alias("n"))
    strong = _nmi_of_counts(counts, ["parent", "child"]).where((F.col("nmi") > least) & (F.col("row_count") >= rows))
    return strong.groupBy("child").agg(F.max_by("parent", F.struct("nmi", "parent")).alias("parent"), F.max("nmi").alias("nmi"))


def fit_encoder(df: DataFrame, column: str, support: int = 20) -> DataFrame:
    """Bands (value, lo, hi) of the unit interval, the most frequent first (D-07)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.lit(column).alias("column_name"), F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return bands(suppress_rare(counts, support).select("value", F.col("n").cast("double").alias("w")))


def bands(weights: DataFrame) -> DataFrame:
    """Bands from (value, w), also for overridden weights (D-10)."""
    by = Window.orderBy(F.desc("w"), "value")
    total = F.sum("w").over(Window.partitionBy())
    upto = F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return weights.select("value", F.round((upto - F.col("w")) / total, 9).alias("lo"), F.round(upto / total, 9).alias("hi"))


def rebalance(weights: DataFrame, encoder: DataFrame) -> DataFrame:
    """Bands for given weights; every category of the encoder must be given (D-10)."""
    missing = encoder.join(weights, "value", "left_anti").limit(1).count()
    if missing:
        raise ValueError("weights are needed for all categories")
    return bands(weights)


def category_proportions(encoder: DataFrame) -> DataFrame:
    """Learned share of each category (D-11)."""
    return encoder.select("value", F.round(F.col("hi") - F.col("lo"), 6).alias("proportion"))


def encode(df: DataFrame, column: str, encoder: DataFrame, key: str) -> DataFrame:
    """Adds <column>_code, uniform within the value's band; unknown values take the rare band."""
    e = F.broadcast(encoder.select(F.col("value").alias("_v"), "lo", "hi"))  # at most the kept categories
    known = [r.value for r in encoder.select("value").collect()]
    v = F.when(F.col(column).cast("string").isin(known), F.col(column).cast("string")).otherwise("__RARE__")
    u = uniform(f"encode:{column}", key)
    return df.withColumn("_v", v).join(e, "_v", "left").withColumn(f"{column}_code", F.round(F.col("lo") + u * (F.col("hi") - F.col("lo")), 9)).drop("_v", "lo", "hi")


def decode(df: DataFrame, code: str, encoder: DataFrame, out: str) -> DataFrame:
    """Adds the value whose band holds the code."""
    rows = [(r.value, r.hi) for r in encoder.orderBy("lo").collect()]
    case = F.lit(rows[-1][0])
    for v, hi in rows[-2::-1]:
        case = F.when(F.col(code) < hi, v).otherwise(case)
    return df.withColumn(out, case)


def encode_number(c: str, df: DataFrame) -> Column:
    """Numbers as they are, booleans 0/1, times as epoch seconds (D-08)."""
    kind = df.schema[c].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_timestamp(F.col(c).cast("timestamp")).cast("double")
    return F.col(c).cast("double")


def decode_number(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return c >= 0.5
    return F.timestamp_seconds(c) if kind == "datetime" else F.round(c).cast("long") if kind == "integer" else c


@dataclass
class FeatureSpec:
    """Means and deviations of numbers, levels of categories; learned on training rows only."""

    numbers: list[tuple[str, float, float]]
    levels: list[tuple[str, list[str]]]


def fit_features(df: DataFrame, numbers: list[str], categories: list[str], most: int = 32) -> FeatureSpec:
    """Mixed-type encoder (D-12)."""
    s = df.agg(*[f(encode_number(c, df)).alias(f"{n}{i}") for i, c in enumerate(numbers) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if numbers else {}
    scaled = [(c, s[f"m{i}"] or 0.0, s[f"s{i}"] if s[f"s{i}"] and s[f"s{i}"] > 1e-12 else 1.0) for i, c in enumerate(numbers)]
    levels = []
    for c in categories:
        rows = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(most).collect()
        levels.append((c, [r.v for r in rows]))
    return FeatureSpec(scaled, levels)


def features(df: DataFrame, spec: FeatureSpec, name: str = "features") -> DataFrame:
    """Adds an array: z-scores, then one column per level."""
    cols = [F.coalesce((encode_number(c, df) - m) / s, F.lit(0.0)) for c, m, s in spec.numbers]
    cols += [F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)) for c, vs in spec.levels for v in vs]
    return df.withColumn(name, F.array(*cols))


# Acklam's rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(cs, x):
    return reduce(lambda acc, c: acc * x + c, cs[1:], F.lit(cs[0]))


def normal_quantile(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    q = p - 0.5
    r = q * q
    middle = _poly(_A, r) * q / (_poly(_B, r) * r + 1)
    lower, upper = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    tail = lambda z: _poly(_C, z) / (_poly(_D, z) * z + 1)
    return F.when(p < 0.02425, tail(lower)).when(p > 1 - 0.02425, -tail(upper)).otherwise(middle)


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17; error under 1e-7."""
    k = 1 / (1 + 0.2316419 * F.abs(x))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * k * _poly((1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530), k)
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def _position(value: Column, g: list[float]) -> Column:
    """Rank in [0, 1] of a value by the quantile grid, in the middle of ties."""
    n = len(g) - 1
    points = F.array(*[F.lit(float(e)) for e in g])
    below, upto = F.size(F.filter(points, lambda e: e < value)), F.size(F.filter(points, lambda e: e <= value))
    lo, hi = F.element_at(points, F.greatest(below, F.lit(1))), F.element_at(points, F.least(below + 1, F.lit(n + 1)))
    inside = (below - 1 + F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(0.0)) / n
    tied = (below + upto - 1) / (2.0 * n)
    return F.least(F.greatest(F.when(upto - below > 1, tied).otherwise(inside), F.lit(0.0005)), F.lit(0.9995))


@dataclass
class Copula:
    columns: list[str]
    grids: dict[str, list[float]]
    null_rates: dict[str, float]
    correlation: list[list[float]]


def fit_copula(df: DataFrame, columns: list[str]) -> Copula:
    """Gaussian copula: grids as marginals, correlation of normal scores (D-09).  The driver holds
    columns x columns numbers."""
    held = {r.column_name: r.q for r in exact_quantiles(df, {c: encode_number(c, df) for c in columns}, [i / 20 for i in range(21)]).collect()}
    first = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    grids = {c: list(held.get(c) or [0.0] * 21) for c in columns}
    # a step each, as the next one names its input many times: Spark does not put such steps into one another
    k = len(columns)
    z = df.select(*[F.coalesce(encode_number(c, df), F.lit(grids[c][10])).alias(f"v{i}") for i, c in enumerate(columns)])
    z = z.select(*[_position(F.col(f"v{i}"), grids[c]).alias(f"p{i}") for i, c in enumerate(columns)])
    z = z.select(*[normal_quantile(F.col(f"p{i}")).alias(f"z{i}") for i in range(k)])
    r = z.agg(*[F.corr(f"z{i}", f"z{j}").alias(f"r{i}_{j}") for i in range(k) for j in range(i)]).first() if k > 1 else {}
    corr = [[1.0] * k for _ in range(k)]
    for i in range(k):
        for j in range(i):
            v = r[f"r{i}_{j}"]
            corr[i][j] = corr[j][i] = 0.0 if v is None or math.isnan(v) else float(v)
    return Copula(columns, grids, {c: first[f"n{i}"] or 0.0 for i, c in enumerate(columns)}, corr)


def cholesky(matrix: list[list[float]]):
    """Lower factor; eigenvalues are lifted where the matrix is not positive definite."""
    import numpy as np

    m = np.array(matrix)
    w, v = np.linalg.eigh(m)
    m = v @ np.diag(np.maximum(w, 1e-8)) @ v.T
    d = np.sqrt(np.diag(m))
    return np.linalg.cholesky(m / np.outer(d, d))


def from_grid(u: Column, g: list[float]) -> Column:
    """Value at rank u by linear interpolation."""
    n = len(g) - 1
    points = F.array(*[F.lit(float(x)) for x in g])
    i = F.least(F.floor(u * n), F.lit(n - 1)).cast("int")
    lo, hi = F.element_at(points, i + 1), F.element_at(points, i + 2)
    return lo + (hi - lo) * (u * n - i)


def sample_copula(spark, model: Copula, n: int, lane: str = "copula", offset: int = 0) -> DataFrame:
    """n rows (row_id, columns...) with the model's ranks, marginals and null rates (G-14)."""
    low = cholesky(model.correlation)
    rows = spark.range(offset, offset + n).withColumnRenamed("id", "row_id")
    z = rows.select("row_id", *[normal(f"{lane}:{i}", "row_id").alias(f"_z{i}") for i in range(len(model.columns))])
    k = len(model.columns)
    # a step each, as in fit_copula
    x = z.select("row_id", *[sum((float(low[i][j]) * F.col(f"_z{j}") for j in range(i + 1)), F.lit(0.0)).alias(f"_x{i}") for i in range(k)])
    u = x.select("row_id", *[F.least(F.greatest(normal_cdf(F.col(f"_x{i}")), F.lit(0.0)), F.lit(1.0)).alias(f"_u{i}") for i in range(k)])
    out = []
    for i, c in enumerate(model.columns):
        value = from_grid(F.col(f"_u{i}"), model.grids[c])
        out.append(F.when(uniform(f"{lane}:null:{c}", "row_id") < model.null_rates[c], F.lit(None)).otherwise(F.round(value, 6)).alias(c))
    return u.select("row_id", *out)
