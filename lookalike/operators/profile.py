"""Profiles of tables: one aggregation for all columns, then a long result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookalike.functions.rng import uniform
from lookalike.sources.distinct import distinct_counts
from lookalike.sources.io import written
from lookalike.sources.ranges import running_sums

def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def to_long(df: DataFrame, aggs: dict[str, dict[str, Column]], by: list[str] | None = None) -> DataFrame:
    """One aggregation of {row name: {column: aggregate}}, unpivoted to a row per name."""
    names = list(aggs)
    flat = [a.alias(f"{i}.{k}") for i, n in enumerate(names) for k, a in aggs[n].items()]
    wide = df.groupBy(*(by or [])).agg(*flat)
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), *[F.col(f"`{i}.{k}`").alias(k) for k in aggs[n]]) for i, n in enumerate(names)])
    return wide.select(*(by or []), F.explode(rows).alias("r")).select(*(by or []), "r.*")


def physical_type(field: T.StructField) -> str:
    kind = field.dataType
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(kind, T.IntegralType):
        return "integer"
    return "float" if isinstance(kind, T.NumericType) else "string"


def profile_base(df: DataFrame, exact: bool = True) -> DataFrame:
    """Rows, nulls, null percentage, distinct values and their ratio to all rows (B-01)."""
    aggs = {c: {"row_count": F.count(F.lit(1)), "null_count": F.count_if(F.col(c).isNull())} | ({} if exact else {"distinct_count": F.approx_count_distinct(c, 0.01)}) for c in df.columns}
    long = to_long(df, aggs)
    if exact:
        long = long.join(F.broadcast(distinct_counts(df)), "column_name")  # a row a column
    return long.withColumns({
        "null_percentage": F.coalesce(F.round(F.try_divide(F.col("null_count") * 100.0, "row_count"), 6), F.lit(0.0)),
        "distinct_ratio": F.coalesce(F.round(F.try_divide(F.col("distinct_count").cast("double"), "row_count"), 6), F.lit(0.0)),
    })


def physical_types(df: DataFrame) -> DataFrame:
    """Physical type per column; fractional types without a fraction are integers (B-02)."""
    aggs = {}
    for f in df.schema:
        kind = physical_type(f)
        whole = F.coalesce(F.bool_and(F.col(f.name) == F.round(f.name)), F.lit(False)) if kind == "float" else F.lit(False)
        aggs[f.name] = {"inferred_dtype": F.when(F.count(f.name) == 0, "unknown").when(whole, "integer").otherwise(kind)}
    return to_long(df, aggs)


def group_quantiles(counted: DataFrame, by: list[str], at: list[float]) -> DataFrame:
    """(by, n, q): exact quantiles of each group's doubles ``v``, each there ``count`` times, linear
    between neighbours.

    Counts are added up over ranges of (group, value), so many small groups share a task and a large
    one is cut; only the rows that hold a wanted place go on."""
    placed = running_sums(written(counted), by, "v", ["count"])  # read several times
    place = lambda i: F.get(F.lit([float(p) for p in at]), i) * (F.col("all_count") - 1)
    held = lambda k: (k < F.col("upto_count")) & (k >= F.col("upto_count") - F.col("count"))
    numbers = F.array(*[F.lit(i) for i in range(len(at))])
    here = F.filter(numbers, lambda i: held(F.floor(place(i))) | held(F.ceil(place(i))))
    found = placed.where(F.size(here) > 0).select(*by, "v", "count", "upto_count", "all_count", F.explode(here).alias("i")).withColumn("at", place(F.col("i")))
    ends = found.groupBy(*by, "i", "at", "all_count").agg(F.max(F.when(held(F.floor("at")), F.col("v"))).alias("lo"), F.max(F.when(held(F.ceil("at")), F.col("v"))).alias("hi"))
    between = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((F.ceil("at") - F.col("at")) * F.col("lo") + (F.col("at") - F.floor("at")) * F.col("hi"))
    return ends.groupBy(*by).agg(F.max("all_count").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", between.alias("x")))), lambda r: r.x).alias("q"))


def exact_quantiles(df: DataFrame, values: dict[str, Column], at: list[float]) -> DataFrame:
    """(column_name, q): exact quantiles of doubles; none without values."""
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), v.cast("double").alias("v")) for n, v in values.items()])
    counted = df.select(F.explode(pairs).alias("p")).select("p.*").where("v is not null").groupBy("column_name", "v").count()
    return group_quantiles(counted, ["column_name"], at).select("column_name", "q")


def quantiles(df: DataFrame, values: dict[str, Column], at: list[float], exact: bool = True) -> DataFrame:
    """(column_name, q) by counts and ranges, or by sketches in one pass."""
    if exact:
        return exact_quantiles(df, values, at)
    points = F.array(*[F.lit(float(p)) for p in at])
    return to_long(df, {n: {"q": F.percentile_approx(v.cast("double"), points, F.lit(10000))} for n, v in values.items()})


def profile_numeric(df: DataFrame, exact: bool = True) -> DataFrame:
    """Minimum, maximum, mean, median, quartiles (B-03) and the p01/p99 bounds (B-04)."""
    cols = numeric_columns(df)
    long = to_long(df, {c: {"minimum": F.min(c).cast("double"), "maximum": F.max(c).cast("double"), "mean": F.round(F.avg(c), 6)} for c in cols})
    long = long.join(F.broadcast(quantiles(df, {c: F.col(c) for c in cols}, [0.01, 0.25, 0.5, 0.75, 0.99], exact)), "column_name", "left")
    named = {n: F.round(F.col("q")[i], 6) for i, n in enumerate(["lower_bound", "p25", "median", "p75", "upper_bound"])}
    return long.withColumns(named).drop("q")


def datetime_bounds(df: DataFrame, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Order statistics at floor(p * (n - 1)) of time columns (B-05).

    Values are counted, and the counts added up over ranges of values."""
    parts = []
    for c in time_columns(df):
        n = df.groupBy(F.col(c).alias("v")).count().where("v is not null")
        at = lambda p: F.min(F.when(F.col("upto_count") > F.floor(F.lit(p) * (F.col("all_count") - 1)), F.col("v")))
        row = running_sums(n, [], "v", ["count"]).agg(at(lower).alias("lower_bound"), at(upper).alias("upper_bound"))
        parts.append(row.select(F.lit(c).alias("column_name"), "lower_bound", "upper_bound"))
    return reduce(DataFrame.unionByName, parts)


def profile_strings(df: DataFrame) -> DataFrame:
    """Least, largest and mean length of string columns (B-06)."""
    size = F.char_length
    return to_long(df, {c: {"min_length": F.min(size(c)), "max_length": F.max(size(c)), "mean_length": F.round(F.avg(size(c)), 6)} for c in string_columns(df)})


#: Accepted time formats, in order of preference.
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy"]


def parsed_time(c: Column, formats: list[str] | None = None) -> Column:
    """First format that reads the trimmed text, else null."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats or TIME_FORMATS])


def date_parse_rate(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of non-null texts that read as times; null under the threshold (B-07)."""
    long = to_long(df, {c: {"n": F.count(c), "ok": F.count(parsed_time(F.col(c)))} for c in string_columns(df)})
    rate = F.try_divide(F.col("ok").cast("double"), "n")
    return long.select("column_name", F.when(rate >= threshold, F.round(rate, 6)).alias("parse_rate"), F.coalesce((rate >= threshold) & (rate < 1), F.lit(False)).alias("invalid_dates"))


def datetime_format(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The format that reads most values, and whether the column is date-like (B-37)."""
    long = to_long(df, {c: {"n": F.count(c), **{f"f{i}": F.count(F.try_to_timestamp(F.trim(c), F.lit(f))) for i, f in enumerate(TIME_FORMATS)}} for c in string_columns(df)})
    most = F.greatest(*[F.col(f"f{i}") for i in range(len(TIME_FORMATS))])
    best = F.coalesce(*[F.when((F.col(f"f{i}") == most) & (most > 0), F.lit(f)) for i, f in enumerate(TIME_FORMATS)])
    rate = F.coalesce(F.try_divide(most.cast("double"), "n"), F.lit(0.0))
    return long.select("column_name", F.when(rate >= threshold, best).alias("format"), F.round(rate, 6).alias("rate"), (rate >= threshold).alias("date_like"))


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value) of the columns as strings."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def category_frequencies(df: DataFrame, columns: list[str], most: int = 50) -> DataFrame:
    """Counts of the values of columns with at most ``most`` distinct ones (B-08)."""
    counted = unpivoted(df, columns).where("value is not null").groupBy("column_name", "value").count()
    few = counted.groupBy("column_name").agg(F.count("*").alias("k")).where(F.col("k") <= most)
    return counted.join(F.broadcast(few), "column_name").select("column_name", "value", F.col("count").alias("n"))


RARE = "__RARE__"


def suppress_rare(frequencies: DataFrame, support: int = 20) -> DataFrame:
    """Values under the support become one (B-09)."""
    return frequencies.withColumn("value", F.when(F.col("n") < support, RARE).otherwise(F.col("value"))).groupBy("column_name", "value").agg(F.sum("n").alias("n"))


def column_warnings(base: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Names of what looks wrong, comma-joined in fixed order (B-10)."""
    top = frequencies.groupBy("column_name").agg(F.max("n").alias("top"))
    j = base.join(top, "column_name", "left")
    said = [
        F.when((F.col("row_count") > 0) & (F.col("null_count") < F.col("row_count")) & (F.col("distinct_count") <= 1), "constant_column"),
        F.when((F.col("distinct_count") > 1) & (F.col("distinct_ratio") >= 0.95), "near_unique_column"),
        F.when((F.col("row_count") > 0) & (F.col("null_percentage") >= 50), "extreme_missingness"),
        F.when((F.col("distinct_count") > 1) & (F.col("top") / F.col("row_count") >= 0.95), "severe_category_imbalance"),
    ]
    return j.select("column_name", F.concat_ws(",", *said).alias("warnings"))


def masked(c: Column) -> Column:
    """First and last character kept; up to two characters all hidden (B-11)."""
    c = c.cast("string")
    n = F.char_length(c)
    return F.when(c.isNull(), "<null>").when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(c, 1, 1), F.repeat(F.lit("*"), n - 2), F.right(c, F.lit(1))))


def mask_examples(df: DataFrame, columns: list[str], n: int = 3) -> DataFrame:
    """The n least distinct values of each column, masked."""
    distinct = unpivoted(df, columns).where("value is not null").distinct()
    place = F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
    return distinct.withColumn("place", place).where(F.col("place") <= n).select("column_name", "place", masked(F.col("value")).alias("example"))


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson's r of each pair of numeric columns, undefined ones left out (B-12): sums of products
    of all pairs from one pass, over values less their column's mean."""
    cols = columns or numeric_columns(df)
    import numpy as np
    import pyarrow as pa

    doubles = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    means = doubles.agg(F.count(F.lit(1)), *[F.avg(c) for c in doubles.columns]).first()[1:]
    centre = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in means])
    names = ["i", "j", "n", "x", "y", "xx", "yy", "xy"]

    def run(batches):
        total = 0.0
        for batch in batches:
            live = np.column_stack([batch.column(k).is_valid().to_numpy(zero_copy_only=False) for k in range(len(cols))]).astype(np.float64)
            v = np.column_stack([batch.column(k).fill_null(0.0).to_numpy(zero_copy_only=False) for k in range(len(cols))])
            v = np.where(live > 0, v - centre, 0.0)
            total = total + np.stack([live.T @ live, v.T @ live, (v * v).T @ live, v.T @ v])
        if not np.isscalar(total):
            i, j = np.triu_indices(len(cols), 1)
            n, s, q, p = total
            arrays = [i, j, n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32) if k < 2 else a) for k, a in enumerate(arrays)], names)

    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double")
    sums = doubles.mapInArrow(run, "i int, j int, n double, x double, y double, xx double, yy double, xy double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names[2:]])
    c = sums.withColumns({"vx": F.expr("xx - x * x / n"), "vy": F.expr("yy - y * y / n")}).where("n > 1 and vx > 1e-10 * xx and vy > 1e-10 * yy")
    named = F.array(*[F.lit(x) for x in cols])
    return c.select(named[F.col("i")].alias("column_a"), named[F.col("j")].alias("column_b"), F.round(F.expr("(xy - x * y / n) / sqrt(vx * vy)"), 6).alias("correlation")).where("not isnan(correlation)")


def top_correlations(df: DataFrame, columns: int = 12, most: int = 20) -> DataFrame:
    """The strongest pairs among the first numeric columns (B-15)."""
    return correlations(df, numeric_columns(df)[:columns]).orderBy(F.desc(F.abs("correlation")), "column_a", "column_b").limit(most)


def pk_cross_check(df: DataFrame, key: list[str]) -> DataFrame:
    """Null and duplicate keys (B-13)."""
    nulls = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    groups = df.groupBy(*key).agg(F.count("*").alias("n"), F.max(nulls).alias("holed"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.when(F.col("holed"), F.col("n"))), F.lit(0)).alias("null_keys"), F.coalesce(F.sum(F.when(~F.col("holed"), F.col("n") - 1)), F.lit(0)).alias("duplicate_keys"))


def partial_profiles(df: DataFrame, by: Column, columns: list[str]) -> DataFrame:
    """A mergeable profile of each part (B-14, J-01): counts, extremes, sums, an HLL sketch."""
    aggs = {c: {"row_count": F.count(F.lit(1)), "null_count": F.count_if(F.col(c).isNull()), "minimum": F.min(F.col(c).cast("double")), "maximum": F.max(F.col(c).cast("double")), "total": F.sum(F.col(c).cast("double")), "sketch": F.hll_sketch_agg(F.col(c).cast("string"))} for c in columns}
    return to_long(df.withColumn("part", by), aggs, by=["part"])


def merge_profiles(parts: DataFrame) -> DataFrame:
    """Profiles of parts merged: exact but for the distinct estimate."""
    merged_ = parts.groupBy("column_name").agg(*[F.sum(c).alias(c) for c in ("row_count", "null_count")], F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"), F.sum("total").alias("total"), F.hll_union_agg("sketch").alias("sketch"))
    return merged_.select("column_name", "row_count", "null_count", "minimum", "maximum", F.round(F.try_divide("total", F.col("row_count") - F.col("null_count")), 4).alias("mean"), F.hll_sketch_estimate("sketch").alias("distinct_estimate"))


def missingness(base: DataFrame) -> DataFrame:
    """Columns with nulls, their mean and largest null share (B-16)."""
    return base.agg(F.count_if(F.col("null_count") > 0).alias("columns_with_nulls"), F.round(F.avg("null_percentage"), 6).alias("avg_null_percentage"), F.max("null_percentage").alias("max_null_percentage"))


def fit_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lognormal if positive and skewed, uniform if nearly constant, else normal (B-17)."""
    aggs = {}
    for c in columns:
        v = F.col(c).cast("double")
        aggs[c] = {"n": F.count(v).cast("double"), "minimum": F.min(v), "maximum": F.max(v), "mean": F.avg(v), "sd": F.stddev_samp(v), "g1": F.skewness(v), "mu": F.avg(F.when(v > 0, F.log(v))), "sigma": F.stddev_samp(F.when(v > 0, F.log(v)))}
    long = to_long(df, aggs)
    skew = F.col("g1") * F.sqrt(F.col("n") * (F.col("n") - 1)) / (F.col("n") - 2)
    family = F.when((F.col("minimum") > 0) & (skew > 1), "lognormal").when(F.col("sd") < 0.01, "uniform").otherwise("normal")
    out = long.withColumn("distribution", family)
    is_log = F.col("distribution") == "lognormal"
    return out.select("column_name", "distribution", F.round("minimum", 4).alias("minimum"), F.round("maximum", 4).alias("maximum"), F.round(F.when(is_log, F.col("mu")).otherwise(F.col("mean")), 4).alias("location"), F.round(F.when(is_log, F.col("sigma")).otherwise(F.col("sd")), 4).alias("scale"))


def infer_decimals(df: DataFrame, columns: list[str], key: list[str], n: int = 100) -> DataFrame:
    """Median digits after the dot over a seeded sample of values (B-18)."""
    from lookalike.sources.io import seeded_sample

    s = seeded_sample(df, key, n)
    digits = lambda c: F.char_length(F.regexp_replace(F.split_part(F.format_string("%.6f", F.col(c).cast("double")), F.lit("."), F.lit(2)), "0+$", ""))
    found = exact_quantiles(s, {c: digits(c) for c in columns}, [0.5])
    return to_long(s, {c: {"n": F.count(F.lit(1))} for c in columns}).join(found, "column_name", "left").select("column_name", F.col("q")[0].cast("int").alias("decimals"))


def fit_categorical(df: DataFrame, columns: list[str], most: int = 50) -> DataFrame:
    """The most frequent values with renormalised probabilities (B-19)."""
    counted = unpivoted(df, columns).where("value is not null").groupBy("column_name", "value").count()
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("count"), "value"))
    top = counted.withColumn("place", place).where(F.col("place") <= most)
    return top.select("column_name", "value", F.round(F.col("count") / F.sum("count").over(Window.partitionBy("column_name")), 6).alias("probability"))


def fit_date(df: DataFrame) -> DataFrame:
    """First, last and median time of time columns, as epoch seconds (B-20)."""
    second = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")).cast("double")
    ends = to_long(df, {c: {"first": F.min(second(c)), "last": F.max(second(c))} for c in time_columns(df)})
    middle = exact_quantiles(df, {c: second(c) for c in time_columns(df)}, [0.5])
    return ends.join(F.broadcast(middle), "column_name", "left").select("column_name", "first", "last", F.col("q")[0].alias("median"))  # a row a column


def column_kind(df: DataFrame) -> DataFrame:
    """boolean, date, id_like, numeric, categorical or text (B-21)."""
    j = profile_base(df).join(physical_types(df), "column_name")
    d, kind, ratio = F.col("distinct_count"), F.col("inferred_dtype"), F.col("distinct_ratio")
    hint = F.col("column_name").rlike("(?i)(^|_)(id|key)$|key$")
    out = (
        F.when((kind == "boolean") | (d == 2) & kind.isin("integer") & F.col("column_name").rlike("^(is|has)_"), "boolean")
        .when(kind == "datetime", "date").when(hint & kind.isin("integer", "string"), "id_like").when(kind.isin("integer", "float"), F.when((kind == "integer") & (d <= 10), "categorical").otherwise("numeric"))
        .when((d <= 50) | (ratio <= 0.05), "categorical").otherwise("text")
    )
    return j.select("column_name", out.alias("kind"))


def is_identifier(df: DataFrame) -> DataFrame:
    """Identifier by name, or a nearly unique integer (B-22)."""
    j = profile_base(df).join(physical_types(df), "column_name")
    named = F.col("column_name").rlike("(?i)(^|_)(id|uuid|guid)$|key$")
    return j.select("column_name", (named | (F.col("inferred_dtype") == "integer") & (F.col("distinct_ratio") >= 0.95)).alias("is_identifier"))


def is_text_heavy(df: DataFrame) -> DataFrame:
    """Long strings, or middling ones that hardly repeat, or text by name (B-23)."""
    j = profile_strings(df).join(profile_base(df), "column_name")
    named = F.col("column_name").rlike("(?i)description|comment|note|bio|summary|text")
    long = F.coalesce((F.col("mean_length") >= 40) | (F.col("mean_length") >= 20) & (F.col("distinct_ratio") >= 0.8), F.lit(False))
    return j.select("column_name", (named | long).alias("text_heavy"))


#: What a personal value looks like, in order of preference (B-24).
PII_VALUES = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "aadhaar": r"^[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}$",
    "cpf": r"^[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}$",
    "nin": r"^[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]$",
    "phone": r"^\+?[0-9][0-9 ().-]{7,18}[0-9]$",
}
PII_NAMES = {"email": "(?i)e_?mail", "ssn": "(?i)ssn|social_security", "aadhaar": "(?i)aadhaar", "cpf": "(?i)(^|_)cpf$", "nin": "(?i)(^|_)(nin|nino|national_insurance(_number|_no)?)$", "national_id": "(?i)national_id|passport|driving_licen[cs]e", "phone": "(?i)phone|mobile", "name": "(?i)(^|_)(name|full_?name|first_?name|last_?name)$"}


def pii_semantic(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Personal data by column name, else by the share of values of a shape (B-24)."""
    aggs = {c: {"n": F.count(c), **{k: F.count_if(F.col(c).rlike(p)) for k, p in PII_VALUES.items()}} for c in string_columns(df)}
    long = to_long(df, aggs)
    by_name = F.coalesce(*[F.when(F.col("column_name").rlike(p), F.lit(k)) for k, p in PII_NAMES.items()])
    by_value = F.coalesce(*[F.when((F.col("n") > 0) & (F.col(k) >= share * F.col("n")), F.lit(k)) for k in PII_VALUES])
    return long.select("column_name", by_name.alias("by_name"), by_value.alias("by_value"), F.coalesce(by_name, by_value).alias("semantic"))


#: Text roles by name, in order of preference (B-25).
TEXT_ROLES = [("email", "e_?mail"), ("phone", "phone|mobile"), ("url", "url|website|link"), ("first_name", "first_?name"), ("last_name", "last_?name|surname"), ("company", "company|organi[sz]ation"), ("product", "product|part|brand"), ("address", "address|street"), ("city", "city|town"), ("state", "state|province"), ("country", "country|nation"), ("job_title", "job|title"), ("description", "description|comment|summary|note|text"), ("name", "name"), ("status", "status|flag|segment|type|priority")]


def text_semantic(df: DataFrame) -> DataFrame:
    """Role of a string column by name, else by url, phone and email shares (B-25)."""
    aggs = {c: {"n": F.count(c), "url": F.count_if(F.col(c).rlike("^https?://")), "phone": F.count_if(F.col(c).rlike(PII_VALUES["phone"])), "email": F.count_if(F.col(c).rlike(PII_VALUES["email"]))} for c in string_columns(df)}
    named = F.coalesce(*[F.when(F.lower("column_name").rlike(p), F.lit(r)) for r, p in TEXT_ROLES])
    valued = F.coalesce(*[F.when((F.col("n") > 0) & (F.col(k) >= 0.8 * F.col("n")), F.lit(k)) for k in ("url", "phone", "email")])
    return to_long(df, aggs).select("column_name", F.coalesce(named, valued, F.lit("generic")).alias("role"))


def quantile_grid(df: DataFrame, columns: list[str], points: int = 21) -> DataFrame:
    """Quantiles at equal steps of numeric and time columns (B-26): (column_name, step, value)."""
    seconds = set(time_columns(df))
    values = {c: F.unix_timestamp(F.col(c).cast("timestamp")) if c in seconds else F.col(c) for c in columns}
    grids = exact_quantiles(df, values, [i / (points - 1) for i in range(points)])
    return grids.select("column_name", F.posexplode("q").alias("step", "value")).withColumn("value", F.round("value", 6))


#: Names of quasi-identifiers.
QUASI = "(?i)(age|gender|birth|zip|postal|city|state|nation|region|segment)"


def classify_sensitivity(df: DataFrame) -> DataFrame:
    """public, quasi_identifier, direct_identifier or free_text (B-27)."""
    j = profile_base(df).join(pii_semantic(df), "column_name", "left").join(is_text_heavy(df), "column_name", "left")
    out = F.when(F.col("semantic").isNotNull(), "direct_identifier").when(F.coalesce("text_heavy", F.lit(False)), "free_text").when(F.col("column_name").rlike(QUASI), "quasi_identifier").otherwise("public")
    return j.select("column_name", "semantic", out.alias("sensitivity"))


def cardinality_model(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, context: str | None = None) -> DataFrame:
    """Histogram of children per parent, childless parents too (B-28): (context, n_children, probability)."""
    n = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias("n"))
    ctx = F.col(context).cast("string") if context else F.lit("*")
    per = parent.select(F.col(parent_key).alias("_k"), ctx.alias("context")).join(n, "_k", "left").groupBy("context", F.coalesce("n", F.lit(0)).alias("n_children")).agg(F.count("*").alias("parents"))
    return per.withColumn("probability", F.round(F.col("parents") / F.sum("parents").over(Window.partitionBy("context")), 6))


def infer_fks(tables: dict[str, DataFrame], candidates: list[tuple[str, str, str, str]], unique: float = 0.95) -> DataFrame:
    """(child, child_column, parent, parent_column, parent_ratio, containment, is_fk) of candidate
    pairs: a nearly unique parent column that holds all child values (B-30)."""
    rows = []
    for child, cc, parent, pc in candidates:
        p = tables[parent].select(F.col(pc).alias("v"))
        ratio = p.agg((F.count_distinct("v") / F.count(F.lit(1))).alias("parent_ratio"))
        kids = tables[child].select(F.col(cc).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
        held = kids.join(p.where("v is not null").distinct().withColumn("hit", F.lit(1)), "v", "left").agg((F.sum(F.col("n") * F.coalesce("hit", F.lit(0))) / F.sum("n")).alias("containment"))
        rows.append(ratio.crossJoin(held).select(F.lit(child).alias("child"), F.lit(cc).alias("child_column"), F.lit(parent).alias("parent"), F.lit(pc).alias("parent_column"), F.round("parent_ratio", 6).alias("parent_ratio"), F.round("containment", 6).alias("containment")))
    return reduce(DataFrame.unionByName, rows).withColumn("is_fk", (F.col("parent_ratio") >= unique) & (F.col("containment") >= 1))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-insensitive fingerprint of a table: summed leading digits of row digests, fields
    led by their lengths so that none runs into the next (B-32)."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("~")) for c in columns]))
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def sanitize_profile(profile: DataFrame, sensitive: list[str]) -> DataFrame:
    """Extremes of every column and frequencies of sensitive ones removed (B-33)."""
    gone = F.col("column_name").isin(sensitive)
    return profile.withColumns({c: F.lit(None).cast("double") for c in ("minimum", "maximum")}).withColumn("value", F.when(gone, F.lit(None)).otherwise(F.col("value"))).withColumn("n", F.when(gone, F.lit(None)).otherwise(F.col("n")))


def table_report(df: DataFrame) -> DataFrame:
    """Per column type, null share, notes; deductions from a score of 100 (B-34)."""
    j = profile_base(df).join(physical_types(df), "column_name")
    notes = [F.when(F.col("null_percentage") > 20, "many_nulls"), F.when(F.col("distinct_count") <= 1, "constant"), F.when((F.col("distinct_ratio") < 1) & F.col("column_name").rlike("(?i)key$"), "repeated_key")]
    out = j.select("column_name", "inferred_dtype", "null_percentage", F.concat_ws(",", *notes).alias("notes"))
    minus = F.when(F.col("notes").contains("many_nulls"), 10).otherwise(0) + F.when(F.col("notes").contains("constant"), 5).otherwise(0) + F.when(F.col("notes").contains("repeated_key"), 8).otherwise(0)
    return out.withColumn("deduction", minus)


def sampled_kind(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Column kinds over a repeatable fraction of the rows."""
    return column_kind(df.where(uniform("kind", key) < fraction))
