"""Plug-ins (K): user functions, synthesizers, constraints.  Metrics are in gate.register_metric.

User functions are Python and so the slow path: they run on Arrow batches, never row by row."""

import json
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GENERATORS: dict[str, tuple[Callable, str]] = {}
_SYNTHESIZERS: dict[str, type] = {}
_CONSTRAINTS: dict[str, type] = {}


def register_generator(name: str, returns: str) -> Callable:
    """fn(pandas frame of row_id and siblings) -> values; keep it a function of its input (K-01)."""

    def add(fn: Callable) -> Callable:
        _GENERATORS[name] = (fn, returns)
        return fn

    return add


def generate_with(df: DataFrame, column: str, name: str, siblings: list[str]) -> DataFrame:
    fn, returns = _GENERATORS[name]

    @F.pandas_udf(returns)
    def run(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(fn(frame))

    return df.withColumn(column, run(F.struct(*siblings)))


def post_process(df: DataFrame, column: str, fn: Callable, returns: str) -> DataFrame:
    """fn(value) -> value over a column; nulls stay (K-02)."""
    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        return values.map(fn, na_action="ignore")

    return df.withColumn(column, run(column))


class Synthesizer(Protocol):
    """fit(df) gives a JSON-able model; sample(spark, model, n) gives rows (K-04)."""

    def fit(self, df: DataFrame) -> dict: ...

    def sample(self, spark: SparkSession, model: dict, n: int) -> DataFrame: ...


def register_synthesizer(name: str) -> Callable[[type], type]:
    def add(cls: type) -> type:
        _SYNTHESIZERS[name] = cls
        return cls

    return add


def synthesizer(name: str) -> Synthesizer:
    return _SYNTHESIZERS[name]()


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    """A model as JSON text in a table, never pickled (K-04)."""
    spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "model string").coalesce(1).write.mode("errorifexists").json(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.schema("model string").json(path).first().model)


def recommend(row_count: int, columns: int, private: bool) -> str:
    """Advice only: which synthesizer suits (K-04)."""
    return "dp_copula" if private else "copula" if row_count >= 30 and columns <= 200 else "marginals"


class Constraint(Protocol):
    """apply(df) repairs; validate(df) gives one row (violations) (K-05)."""

    def apply(self, df: DataFrame) -> DataFrame: ...

    def validate(self, df: DataFrame) -> DataFrame: ...


def register_constraint(name: str) -> Callable[[type], type]:
    def add(cls: type) -> type:
        _CONSTRAINTS[name] = cls
        return cls

    return add


def constraint(name: str, **args) -> Constraint:
    return _CONSTRAINTS[name](**args)


@register_synthesizer("copula")
class CopulaSynthesizer:
    def fit(self, df: DataFrame) -> dict:
        from lookalike.operators.models import fit_copula
        from lookalike.operators.profile import numeric_columns

        m = fit_copula(df, numeric_columns(df))
        return {"columns": m.columns, "grids": m.grids, "null_rates": m.null_rates, "correlation": m.correlation}

    def sample(self, spark: SparkSession, model: dict, n: int) -> DataFrame:
        from lookalike.operators.models import Copula, sample_copula

        return sample_copula(spark, Copula(**model), n)


@register_constraint("range")
class RangeConstraint:
    def __init__(self, column: str, lo: float, hi: float):
        self.column, self.lo, self.hi = column, lo, hi

    def apply(self, df: DataFrame) -> DataFrame:
        from lookalike.operators.repair import clip_range

        return clip_range(df, self.column, self.lo, self.hi)

    def validate(self, df: DataFrame) -> DataFrame:
        from lookalike.operators.repair import range_violations

        return range_violations(df, self.column, self.lo, self.hi)
