"""Cleaning (E): coercion, imputation, outlier flags and reports, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookalike.operators.profile import exact_quantiles, parsed_time, profile_base, string_columns


def approved_columns(df: DataFrame, approved: list[str]) -> DataFrame:
    """The approved columns that the table has (E-01)."""
    return df.select(*[c for c in df.columns if c in approved])


def exclusions(df: DataFrame, approved: list[str], decided: dict[str, str]) -> DataFrame:
    """(column_name, reason) of the columns left out (E-01)."""
    rows = [(c, decided.get(c, "not in contract")) for c in df.columns if c not in approved]
    return df.sparkSession.createDataFrame(rows, "column_name string, reason string")


def strip_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """White space at both ends of text columns removed, tabs and newlines too (E-02)."""
    return df.withColumns({c: F.regexp_replace(c, r"^[\s]+|[\s]+$", "") for c in columns or string_columns(df)})


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows less distinct rows, nulls being equal (E-03)."""
    g = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def identifier_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Duplicate non-null values of identifiers, which are never changed (E-04)."""
    base = profile_base(df.select(*columns))
    return base.select("column_name", (F.col("row_count") - F.col("null_count") - F.col("distinct_count")).alias("duplicate_values"))


def _scalar(df: DataFrame, c: Column):
    return df.agg(c.alias("v")).first()[0]


def quantiles_of(df: DataFrame, c: Column, at: list[float]) -> list[float] | None:
    """Exact quantiles of one column, by counts and ranges of values."""
    row = exact_quantiles(df, {"c": c}, at).first()
    return row.q if row else None


def median_of(df: DataFrame, c: Column) -> float | None:
    q = quantiles_of(df, c, [0.5])
    return q[0] if q else None


def clean_numeric(df: DataFrame, column: str, how: str = "median") -> DataFrame:
    """Text or numbers to double, what does not read and nulls to the median or mean (E-05).

    Adds <column>_failed: the value was there and did not read."""
    number = F.expr(f"try_cast(trim(cast(`{column}` as string)) as double)")
    fill = median_of(df, number) if how == "median" else _scalar(df, F.avg(number))
    return df.withColumn(f"{column}_failed", F.col(column).isNotNull() & number.isNull()).withColumn(column, F.coalesce(number, F.lit(fill)))


def iqr_bounds(df: DataFrame, column: str, k: float = 1.5) -> tuple[float | None, float | None]:
    q = quantiles_of(df, F.col(column), [0.25, 0.75])
    if not q:
        return None, None
    return q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])


def iqr_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Adds is_outlier: outside the quartiles by more than k ranges (E-06)."""
    lo, hi = iqr_bounds(df, column, k)
    return df.withColumn("is_outlier", F.coalesce((F.col(column) < F.lit(lo)) | (F.col(column) > F.lit(hi)), F.lit(False)))


def mode_of(df: DataFrame, column: str):
    """Most frequent value; the smallest among ties."""
    row = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).first()
    return row[0] if row else None


def clean_category(df: DataFrame, column: str, how: str = "mode", sentinel: str = "__MISSING__") -> DataFrame:
    """Nulls to the mode or to a sentinel (E-07)."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(mode_of(df, column) if how == "mode" else sentinel)))


def clean_datetime(df: DataFrame, column: str, formats: list[str] | None = None) -> DataFrame:
    """Texts of mixed formats to timestamps; adds <column>_failed (E-08)."""
    got = parsed_time(F.col(column), formats)
    return df.withColumn(f"{column}_failed", F.col(column).isNotNull() & got.isNull()).withColumn(column, got)


def cleaning_report(before: DataFrame, after: DataFrame, actions: dict[str, str]) -> DataFrame:
    """(column_name, action, nulls_before, nulls_after, changed) in one aggregation a side (E-09)."""
    cols = [c for c in before.columns if c in after.columns]
    b = profile_base(before.select(*cols)).select("column_name", F.col("null_count").alias("nulls_before"))
    a = profile_base(after.select(*cols)).select("column_name", F.col("null_count").alias("nulls_after"))
    said = F.coalesce(*[F.when(F.col("column_name") == c, F.lit(x)) for c, x in actions.items()], F.lit("none"))
    return b.join(a, "column_name").select("column_name", said.alias("action"), "nulls_before", "nulls_after", (F.col("nulls_before") - F.col("nulls_after")).alias("imputed"))
