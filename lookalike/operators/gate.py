"""Verdicts over check rows (H-19, H-36..H-47).

A check row is (name, dimension, table_name, column_name, critical, ran, status, metric, threshold)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECK = "name string, dimension string, table_name string, column_name string, critical boolean, ran boolean, status string, metric double, threshold double"


@dataclass(frozen=True)
class Thresholds:
    """What counts as good enough (H-42)."""

    tvd: float = 0.15
    quantile_rmse: float = 0.10
    near_duplicate: float = 0.05
    dcr_ratio: float = 0.90
    mia_auc: float = 0.60
    tstr: float = 0.80
    retention: float = 0.70
    exact_match: float = 0.001


def check(df: DataFrame, name: str, dimension: str, metric: Column, passed: Column, critical: bool = False, table: str = "", column: Column | str = "", threshold: float | None = None) -> DataFrame:
    """Check rows of a frame of figures."""
    col = column if isinstance(column, Column) else F.lit(column)
    return df.select(F.lit(name).alias("name"), F.lit(dimension).alias("dimension"), F.lit(table).alias("table_name"), col.alias("column_name"), F.lit(critical).alias("critical"), passed.isNotNull().alias("ran"), F.when(passed.isNull(), "NOT_MEASURED").when(passed, "PASS").otherwise(F.lit("FAIL" if critical else "WARN")).alias("status"), metric.cast("double").alias("metric"), F.lit(threshold).cast("double").alias("threshold"))


def all_checks(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def applicability(checks: DataFrame, needs: dict[str, list[str]], capabilities: list[str]) -> DataFrame:
    """Checks that need what the source lacks are not applicable (H-39)."""
    out = F.col("status")
    for name, asked in needs.items():
        if set(asked) - set(capabilities):
            out = F.when(F.col("name") == name, "NOT_APPLICABLE").otherwise(out)
    return checks.withColumn("status", out)


def verdict(checks: DataFrame) -> DataFrame:
    """FAIL if anything failed or a critical check was not measured; WARN if anything warns or is
    missing; else PASS.  With the names that block (H-40)."""
    live = F.col("status") != "NOT_APPLICABLE"
    bad = live & ((F.col("status") == "FAIL") | (F.col("critical") & ~F.col("ran")))
    warn = live & F.col("status").isin("WARN", "NOT_MEASURED")
    a = checks.agg(F.coalesce(F.max(bad), F.lit(False)).alias("b"), F.coalesce(F.max(warn), F.lit(False)).alias("w"), F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col("name")))), ",").alias("blocking"))
    return a.select(F.when(F.col("b"), "FAIL").when(F.col("w"), "WARN").otherwise("PASS").alias("verdict"), "blocking")


def release_decision(verdicts: DataFrame, mode: str, formal_dp: bool = False, masked: bool = True) -> DataFrame:
    """released by mode: learned models stay inside, mock data needs masking, a DP release needs
    formal privacy; none is released on FAIL (H-41)."""
    ok = {"LEARNED_RESTRICTED": F.col("verdict") != "FAIL", "MOCK_PRIVATE": (F.col("verdict") != "FAIL") & F.lit(masked), "DP_SHAREABLE": (F.col("verdict") == "PASS") & F.lit(formal_dp)}[mode]
    audience = {"LEARNED_RESTRICTED": "internal", "MOCK_PRIVATE": "partners", "DP_SHAREABLE": "public"}[mode]
    return verdicts.select("verdict", F.lit(mode).alias("mode"), ok.alias("released"), F.when(ok, audience).otherwise("none").alias("audience"))


def quality_score(issues: DataFrame) -> DataFrame:
    """100 less 10 per error, 3 per warning, 1 per note (H-19).  issues: (severity, n)."""
    minus = F.sum(F.when(F.col("severity") == "error", 10).when(F.col("severity") == "warning", 3).otherwise(1) * F.col("n"))
    return issues.agg(F.greatest(F.lit(0), F.lit(100) - F.coalesce(minus, F.lit(0))).cast("long").alias("score"))


def rule_pass_rate(evaluated: DataFrame) -> DataFrame:
    """Share of rules that passed (H-36)."""
    return evaluated.agg(F.count("*").alias("rules"), F.coalesce(F.round(F.avg(F.col("passed").cast("double")), 6), F.lit(1.0)).alias("pass_rate"))


def readiness(metrics: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Metrics against targets; PASS, REVIEW (within a tenth) or FAIL (H-37).  metrics: (name, value)."""
    goal = F.coalesce(*[F.when(F.col("name") == k, F.lit(v)) for k, v in targets.items()])
    j = metrics.withColumn("target", goal).where("target is not null")
    state = F.when(F.col("value") >= F.col("target"), "PASS").when(F.col("value") >= 0.9 * F.col("target"), "REVIEW").otherwise("FAIL")
    return j.withColumn("status", state)


def overall(ready: DataFrame) -> DataFrame:
    s = F.collect_set("status")
    return ready.agg(F.when(F.array_contains(s, "FAIL"), "FAIL").when(F.array_contains(s, "REVIEW"), "REVIEW").otherwise("PASS").alias("readiness"))


def validation_contract(checks: DataFrame) -> DataFrame:
    """Status of artifact, fidelity and privacy; results of written files outrank sampled ones (H-47)."""
    rank = F.when(F.col("dimension") == "export", 0).otherwise(1)
    best = checks.withColumn("_r", rank).groupBy("name", "table_name", "column_name").agg(F.min_by("status", "_r").alias("status"), F.min_by("dimension", "_r").alias("dimension"))
    lane = F.when(F.col("dimension").isin("export", "integrity", "schema"), "artifact").when(F.col("dimension") == "privacy", "privacy").otherwise("fidelity")
    s = F.collect_set("status")
    names = lambda st: F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == st, F.col("name")))), ",")
    return best.groupBy(lane.alias("lane")).agg(F.when(F.array_contains(s, "FAIL"), "FAIL").when(F.array_contains(s, "WARN") | F.array_contains(s, "NOT_MEASURED"), "REVIEW").otherwise("PASS").alias("status"), names("FAIL").alias("fail_reasons"), names("WARN").alias("review_reasons"))


Metric = Callable[[dict[str, DataFrame], dict[str, DataFrame]], DataFrame]
_METRICS: dict[str, Metric] = {}


def register_metric(name: str) -> Callable[[Metric], Metric]:
    """A metric plug-in gives check rows of (source, synthetic) tables (K-03)."""

    def add(fn: Metric) -> Metric:
        _METRICS[name] = fn
        return fn

    return add


def run_metrics(source: dict[str, DataFrame], synthetic: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """All registered metrics, or the named ones."""
    return all_checks([_METRICS[n](source, synthetic) for n in sorted(names or _METRICS)])
