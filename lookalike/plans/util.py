"""What the query modules share: tables, perturbed tables and SQL templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.functions.rng import uniform, uniform_sql


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}
NUMERIC = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "events": ["event_id", "user_id", "value"],
}


def union_all(template: str, columns: list[str], **more) -> str:
    """The template once per column, with {c} the column's name."""
    return "\nunion all\n".join(template.format(c=c, **more) for c in columns)


def nullified(df: DataFrame, columns: list[str], key: str, rate: float = 0.1) -> DataFrame:
    return df.withColumns({c: F.when(uniform(f"null:{c}", key) < rate, F.lit(None)).otherwise(F.col(c)) for c in columns})


def nullified_sql(table: str, columns: list[str], key: str, rate: float = 0.1) -> str:
    said = ", ".join(f"case when {uniform_sql('null:' + c, key)} < {rate} then null else {c} end as {c}" for c in columns)
    return f"(select * replace ({said}) from {table})"


def halves(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A table and its look-alike: a hash split of the rows."""
    u = uniform("split", key)
    return df.where(u < 0.5), df.where(u >= 0.5)


def halves_sql(table: str, key: str) -> str:
    """CTEs src and syn."""
    u = uniform_sql("split", key)
    return f"src as (select * from {table} where {u} < 0.5), syn as (select * from {table} where {u} >= 0.5)"


def thirds(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    u = uniform("three", key)
    return df.where(u < 1 / 3), df.where((u >= 1 / 3) & (u < 2 / 3)), df.where(u >= 2 / 3)
