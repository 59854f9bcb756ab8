"""Integrity of tables (H-01..H-19, H-29, H-33, H-43..H-46)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookalike.functions.checks import valid
from lookalike.operators.profile import physical_type, to_long

Edge = tuple[str, str, str, str]  # child, child column, parent, parent column


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def tables_present(spark, tables: dict[str, DataFrame], required: list[str]) -> DataFrame:
    """(table_name, present) (H-01)."""
    return spark.createDataFrame([(t, t in tables) for t in required], "table_name string, present boolean")


def pk_integrity(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """(table_name, row_count, null_keys, duplicate_keys, unique) of simple and composite keys (H-02, H-03)."""
    from lookalike.operators.profile import pk_cross_check

    parts = [pk_cross_check(tables[t], k).select(F.lit(t).alias("table_name"), "*") for t, k in keys.items()]
    return _union(parts).withColumn("unique", (F.col("null_keys") == 0) & (F.col("duplicate_keys") == 0))


def _edge_counts(tables: dict[str, DataFrame], e: Edge) -> DataFrame:
    """Counts per child value joined to parent keys: the child is aggregated before its shuffle,
    so one key in a third of the rows is one row."""
    child, cc, parent, pc = e
    kids = tables[child].groupBy(F.col(cc).alias("v")).agg(F.count("*").alias("n"))
    keys = tables[parent].select(F.col(pc).alias("v")).where("v is not null").distinct().withColumn("hit", F.lit(True))
    return kids.join(keys, "v", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def _named(df: DataFrame, e: Edge) -> DataFrame:
    return df.select(F.lit(e[0]).alias("child"), F.lit(e[1]).alias("child_column"), F.lit(e[2]).alias("parent"), "*")


def fk_orphans(tables: dict[str, DataFrame], edges: list[Edge]) -> DataFrame:
    """Rows whose non-null key has no parent (H-04)."""
    return _union([_named(_edge_counts(tables, e).agg(F.coalesce(F.sum(F.when(~F.col("hit") & F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("orphans")), e) for e in edges])


def fk_validity(tables: dict[str, DataFrame], edges: list[Edge]) -> DataFrame:
    """Share of rows with a parent, null keys being invalid (H-05)."""
    return _union([_named(_edge_counts(tables, e).agg(F.round(F.try_divide(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).cast("double"), F.sum("n")), 6).alias("validity")), e) for e in edges])


def orphan_severity(tables: dict[str, DataFrame], edges: list[Edge], limit: float = 0.01) -> DataFrame:
    """Share of distinct values without parent; an error above the limit (H-06)."""
    out = []
    for e in edges:
        a = _edge_counts(tables, e).where("v is not null").agg(F.round(F.coalesce(F.avg((~F.col("hit")).cast("double")), F.lit(0.0)), 6).alias("share"))
        out.append(_named(a.withColumn("severity", F.when(F.col("share") > limit, "error").when(F.col("share") > 0, "warning").otherwise("ok")), e))
    return _union(out)


def integrity_report(tables: dict[str, DataFrame], edges: list[Edge], most: int = 5) -> DataFrame:
    """Orphans and up to five of their values, ascending (H-45)."""
    out = []
    for e in edges:
        bad = _edge_counts(tables, e).where("not hit and v is not null")
        least = bad.orderBy("v").limit(most).agg(F.array_sort(F.collect_list(F.col("v").cast("long"))).alias("sample"))
        out.append(_named(bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).crossJoin(least), e))  # one row each
    return _union(out)


def validate_export(spark, path: str, expected: dict[str, int], keys: dict[str, list[str]], edges: list[Edge], columns: dict[str, list[str]]) -> DataFrame:
    """(table_name, check, ok) of written files (H-07)."""
    from lookalike.sources.io import row_counts, scan

    t = {n: scan(spark, f"{path}/{n}.parquet") for n in expected}
    want = spark.createDataFrame(list(expected.items()), "table_name string, expected long")
    rows = row_counts(t).join(want, "table_name").select("table_name", F.lit("row_count").alias("check"), (F.col("row_count") == F.col("expected")).alias("ok"))
    pk = pk_integrity(t, keys).select("table_name", F.lit("primary_key").alias("check"), F.col("unique").alias("ok"))
    fk = fk_validity(t, edges).select(F.col("child").alias("table_name"), F.lit("foreign_key").alias("check"), (F.col("validity") == 1).alias("ok"))
    cols = spark.createDataFrame([(n, "columns", set(c) <= set(t[n].columns)) for n, c in columns.items()], "table_name string, check string, ok boolean")
    return _union([rows, pk, fk, cols])


def constraint_compliance(df: DataFrame, constraints: list[dict]) -> DataFrame:
    """(constraint, violations, compliance) of range, enum, unique, conditional, temporal,
    arithmetic and max_children (H-08)."""
    from lookalike.operators.generate import safe_expression

    flags: dict[str, Column] = {}
    grouped: dict[str, DataFrame] = {}
    for c in constraints:
        n, kind = c["name"], c["kind"]
        if kind == "range":
            flags[n] = (F.col(c["column"]) < c["min"]) | (F.col(c["column"]) > c["max"])
        elif kind == "enum":
            flags[n] = ~F.col(c["column"]).isin(c["values"])
        elif kind == "temporal":
            flags[n] = F.col(c["later"]) < F.col(c["earlier"])
        elif kind == "conditional":
            flags[n] = safe_expression(c["when"], df.columns) & ~F.coalesce(safe_expression(c["then"], df.columns), F.lit(False))
        elif kind == "arithmetic":
            flags[n] = F.abs(F.col(c["column"]) - safe_expression(c["expression"], df.columns)) > c.get("tolerance", 0.01)
        elif kind == "unique":
            grouped[n] = df.groupBy(*c["columns"]).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
        elif kind == "max_children":
            grouped[n] = df.groupBy(c["column"]).count().agg(F.coalesce(F.sum(F.greatest(F.col("count") - c["max"], F.lit(0))), F.lit(0)).alias("violations"))
        else:
            raise ValueError(kind)
    total = df.agg(F.count("*").alias("n"))
    wide = df.agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(f"v{i}") for i, v in enumerate(flags.values())]) if flags else None
    parts = [wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(f"v{i}").alias("violations")) for i, n in enumerate(flags)])).alias("r")).select("r.*")] if flags else []
    parts += [g.select(F.lit(n).alias("constraint"), F.col("violations").cast("long").alias("violations")) for n, g in grouped.items()]
    return _union(parts).crossJoin(F.broadcast(total)).select("constraint", "violations", F.round(1 - F.try_divide(F.col("violations").cast("double"), "n"), 6).alias("compliance"))  # one row


def schema_match(df: DataFrame, spec: dict[str, dict]) -> DataFrame:
    """(column_name, present, nulls_ok, values_ok) against a declared spec (H-09)."""
    rows = []
    have = [c for c in spec if c in df.columns]
    aggs = {c: {"nulls": F.count_if(F.col(c).isNull()), "odd": F.count_if(F.col(c).isNotNull() & ~F.col(c).cast("string").isin([str(v) for v in spec[c]["values"]])) if spec[c].get("values") else F.lit(0)} for c in have}
    if have:
        nullable = F.coalesce(*[F.when(F.col("column_name") == c, F.lit(spec[c].get("nullable", True))) for c in have])
        rows.append(to_long(df, aggs).select("column_name", F.lit(True).alias("present"), (nullable | (F.col("nulls") == 0)).alias("nulls_ok"), (F.col("odd") == 0).alias("values_ok")))
    gone = [(c, False, False, False) for c in spec if c not in df.columns]
    if gone:
        rows.append(df.sparkSession.createDataFrame(gone, "column_name string, present boolean, nulls_ok boolean, values_ok boolean"))
    return _union(rows)


def schema_score(matched: DataFrame) -> DataFrame:
    good = F.col("present") & F.col("nulls_ok") & F.col("values_ok")
    return matched.agg(F.round(F.avg(good.cast("double")), 6).alias("score"))


def column_parity(src: DataFrame, syn: DataFrame) -> DataFrame:
    """(column_name, source_type, synthetic_type, same) (H-10)."""
    spark = src.sparkSession
    a = spark.createDataFrame([(f.name, physical_type(f)) for f in src.schema], "column_name string, source_type string")
    b = spark.createDataFrame([(f.name, physical_type(f)) for f in syn.schema], "column_name string, synthetic_type string")
    return a.join(b, "column_name", "full").withColumn("same", F.coalesce(F.col("source_type") == F.col("synthetic_type"), F.lit(False)))


def format_validity(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(column_name, checked, invalid) of typed identifiers (H-11)."""
    return to_long(df, {c: {"checked": F.count(c), "invalid": F.count_if(~valid(F.col(c), k))} for c, k in kinds.items()})


def type_adherence(df: DataFrame, kinds: dict[str, str], target: float = 0.999) -> DataFrame:
    """Share of typed values that are valid, against a target (H-12)."""
    a = format_validity(df, kinds).agg((1 - F.try_divide(F.sum("invalid").cast("double"), F.sum("checked"))).alias("s"))
    return a.select(F.round("s", 6).alias("score"), (F.col("s") >= target).alias("passed"))


#: Plausible ranges by column name, the first match counts (H-13).
RANGES = [("(?i)(^|_)age$", 0, 120), ("(?i)discount|tax", 0, 1), ("(?i)percent|pct", 0, 100), ("(?i)rating", 1, 5), ("(?i)quantity|qty", 0, 10000), ("(?i)price|amount|cost", 0, 1000000), ("(?i)latitude", -90, 90), ("(?i)longitude", -180, 180), ("(?i)year", 1900, 2100), ("(?i)month", 1, 12), ("(?i)hour", 0, 23), ("(?i)size", 0, 100000), ("(?i)credit_?score", 300, 850), ("(?i)score", 0, 100), ("(?i)(^|_)day(_of_month)?$", 1, 31), ("(?i)minute", 0, 59), ("(?i)(^|_)count$", 0, 1000000), ("(?i)duration", 0, 100000), ("(?i)linenumber", 1, 10000)]


def plausibility(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, issue): out of its name's range, all null, no variance (H-13)."""
    aggs = {c: {"n": F.count(c), "lo": F.min(F.col(c).cast("double")), "hi": F.max(F.col(c).cast("double")), "sd": F.stddev_pop(F.col(c).cast("double"))} for c in columns}
    low = F.coalesce(*[F.when(F.col("column_name").rlike(p), F.lit(float(a))) for p, a, _ in RANGES])
    high = F.coalesce(*[F.when(F.col("column_name").rlike(p), F.lit(float(b))) for p, _, b in RANGES])
    issue = F.when(F.col("n") == 0, "all_null").when((F.col("lo") < low) | (F.col("hi") > high), "out_of_range").when(F.coalesce(F.col("sd"), F.lit(0.0)) == 0, "no_variance").otherwise("ok")
    return to_long(df, aggs).select("column_name", issue.alias("issue"))


def validate_columns(df: DataFrame, amounts: list[str] = (), ages: list[str] = (), dates: list[str] = (), emails: list[str] = (), texts: list[str] = (), now: str = "2030-01-01") -> DataFrame:
    """(column_name, issue, n) of odd values; ``now`` is given, not read from a clock (H-14)."""
    issues = []
    for c in amounts:
        issues += [(c, "negative_amount", F.col(c) < 0), (c, "over_a_million", F.col(c) > 1_000_000)]
    for c in ages:
        issues += [(c, "age_out_of_bounds", (F.col(c) < 0) | (F.col(c) > 120))]
    for c in dates:
        issues += [(c, "before_1900", F.year(c) < 1900), (c, "far_future", F.col(c) > F.add_months(F.lit(now).cast("date"), 60))]
    for c in emails:
        issues += [(c, "bad_email", ~F.col(c).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))]
    for c in texts:
        issues += [(c, "empty_text", F.trim(c) == "")]
    wide = df.agg(*[F.count_if(F.coalesce(x, F.lit(False))).alias(f"i{k}") for k, (_, _, x) in enumerate(issues)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("issue"), F.col(f"i{k}").alias("n")) for k, (c, i, _) in enumerate(issues)])).alias("r")).select("r.*")


def temporal_checks(df: DataFrame, pairs: list[tuple[str, str]], births: list[str] = (), now: str = "2030-01-01") -> DataFrame:
    """(rule, n): later before earlier, births in the future (H-15)."""
    rules = [(f"{b} >= {a}", F.col(b) < F.col(a)) for a, b in pairs] + [(f"{c} in the past", F.col(c) > F.lit(now).cast("date")) for c in births]
    wide = df.agg(*[F.count_if(F.coalesce(x, F.lit(False))).alias(f"i{k}") for k, (_, x) in enumerate(rules)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"i{k}").alias("n")) for k, (n, _) in enumerate(rules)])).alias("r")).select("r.*")


def duplicate_checks(df: DataFrame, unique: list[str], row: list[str]) -> DataFrame:
    """(subject, duplicates) of unique columns and whole rows (H-16)."""
    from lookalike.operators.clean import duplicate_rows, identifier_report

    a = identifier_report(df, unique).select(F.col("column_name").alias("subject"), F.col("duplicate_values").alias("duplicates"))
    return a.unionByName(duplicate_rows(df, row).select(F.lit("row").alias("subject"), F.col("duplicate_rows").alias("duplicates")))


def series_properties(df: DataFrame, day: Column, value: str) -> DataFrame:
    """Lag-1 autocorrelation and slope over mean of a daily mean series; days without a value take
    the last one (H-17).  The window runs over days, not rows."""
    daily = df.groupBy(day.alias("d")).agg(F.avg(value).alias("v"))
    w = Window.orderBy("d")
    f = daily.withColumn("v", F.last("v", True).over(w)).withColumns({"prev": F.lag("v").over(w), "i": F.row_number().over(w).cast("double")})
    a = f.agg(F.count("*").alias("days"), F.round(F.corr("v", "prev"), 6).alias("lag1"), F.regr_slope("v", "i").alias("s"), F.avg("v").alias("m"))
    rel = F.try_divide(F.col("s"), F.abs("m"))
    return a.select("days", "lag1", F.round(rel, 8).alias("relative_slope"), F.coalesce(F.abs(rel * F.col("days")) > 0.2, F.lit(False)).alias("trending"))


def curve_check(df: DataFrame, period: Column, value: str, targets: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(period, actual, target, ok) of period sums (H-18)."""
    s = df.groupBy(period.alias("period")).agg(F.round(F.sum(value), 2).alias("actual"))
    return targets.join(s, "period", "left").select("period", F.coalesce("actual", F.lit(0.0)).alias("actual"), "target", (F.abs(F.coalesce("actual", F.lit(0.0)) - F.col("target")) <= tolerance).alias("ok"))


def fidelity_to_spec(df: DataFrame, bounds: dict[str, tuple[float, float]], choices: dict[str, list], fk: str) -> DataFrame:
    """(subject, measure, value): shares outside bounds and choices, variation of children per parent (H-29)."""
    wide = df.agg(*[F.round(F.avg(((F.col(c) < a) | (F.col(c) > b)).cast("double")), 6).alias(f"b{i}") for i, (c, (a, b)) in enumerate(bounds.items())], *[F.round(F.avg((~F.col(c).isin(v)).cast("double")), 6).alias(f"c{i}") for i, (c, v) in enumerate(choices.items())])
    rows = [F.struct(F.lit(c).alias("subject"), F.lit("outside_bounds").alias("measure"), F.col(f"b{i}").alias("value")) for i, c in enumerate(bounds)]
    rows += [F.struct(F.lit(c).alias("subject"), F.lit("unknown_choice").alias("measure"), F.col(f"c{i}").alias("value")) for i, c in enumerate(choices)]
    skew = df.groupBy(fk).count().agg(F.round(F.stddev_pop("count") / F.avg("count"), 6).alias("value")).select(F.lit(fk).alias("subject"), F.lit("children_cv").alias("measure"), "value")
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*").unionByName(skew)


def parity_checks(src: DataFrame, syn: DataFrame) -> DataFrame:
    """(column_name, source_null, synthetic_null, swing, empty) (H-33)."""
    cols = [c for c in src.columns if c in syn.columns]
    rate = lambda df, n: to_long(df, {c: {n: F.round(F.avg(F.col(c).isNull().cast("double")), 6)} for c in cols})
    j = rate(src, "source_null").join(rate(syn, "synthetic_null"), "column_name")
    return j.withColumns({"swing": F.round(F.abs(F.col("source_null") - F.col("synthetic_null")), 6), "empty": F.col("synthetic_null") == 1})


def locale_fit(df: DataFrame, country: tuple[str, str], cities: tuple[str, list[str]], phone: tuple[str, str]) -> DataFrame:
    """Shares of rows with the locale's country, cities and phone prefix, and whether they fit (H-46)."""
    a = df.agg(F.avg((F.col(country[0]) == country[1]).cast("double")).alias("a"), F.avg(F.col(cities[0]).isin(cities[1]).cast("double")).alias("b"), F.avg(F.startswith(phone[0], F.lit(phone[1])).cast("double")).alias("c"))
    return a.select(F.round("a", 6).alias("country_share"), F.round("b", 6).alias("city_share"), F.round("c", 6).alias("phone_share"), ((F.col("a") >= 0.8) & (F.col("b") >= 0.8) & (F.col("c") >= 0.95)).alias("fits"))


def data_card(tables: dict[str, DataFrame], planned: dict[str, int]) -> DataFrame:
    """(table_name, planned, actual, fulfilled, columns) (H-43)."""
    from lookalike.sources.io import row_counts

    spark = next(iter(tables.values())).sparkSession
    plan = spark.createDataFrame([(t, n, len(tables[t].columns)) for t, n in planned.items()], "table_name string, planned long, columns int")
    return row_counts(tables).join(plan, "table_name").select("table_name", "planned", F.col("row_count").alias("actual"), F.round(F.col("row_count") / F.col("planned"), 6).alias("fulfilled"), "columns")


def validate_spec(tables: dict[str, dict], edges: list[Edge]) -> list[tuple[str, str]]:
    """(subject, issue) of a declared spec: unknown tables or columns in relations, probabilities that
    do not fit their choices, cycles (H-44).  Looks at names and numbers of the spec only."""
    out = []
    for t, cols in tables.items():
        for c, p in cols.items():
            if p.get("probabilities") and (len(p["probabilities"]) != len(p.get("choices", ())) or abs(sum(p["probabilities"]) - 1) > 1e-6):
                out.append((f"{t}.{c}", "probabilities"))
            if p.get("type") == "foreign_key" and not any(e[0] == t and e[1] == c for e in edges):
                out.append((f"{t}.{c}", "no relationship"))
    for child, cc, parent, pc in edges:
        if cc not in tables.get(child, {}) or pc not in tables.get(parent, {}):
            out.append((f"{child}.{cc}", "unknown relation"))
    up = {t: {e[2] for e in edges if e[0] == t and e[2] != t} for t in tables}
    done: set[str] = set()
    while ready := {t for t in up if t not in done and up[t] <= done}:
        done |= ready
    return out + [(t, "cycle") for t in sorted(set(up) - done)]
