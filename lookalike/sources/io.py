"""Reading, sampling and writing tables (A)."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.functions.rng import SEED, uniform
from lookalike.sources.distinct import distinct_counts
from lookalike.sources.ranges import ranked


def scan(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A table by suffix; CSV and JSON want a schema (A-01)."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "json", "jsonl"):
        if schema is None:
            raise ValueError(f"a schema is needed to read {path}")
        reader = spark.read.schema(schema)
        return reader.csv(path, header=True) if kind == "csv" else reader.json(path)
    if kind == "orc":
        return spark.read.orc(path)
    return spark.read.parquet(path)


def discover(tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """(table_name, position, column_name, data_type, nullable, candidate_key, declared_key) (A-02)."""
    parts = []
    for t, df in tables.items():
        about = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.name in (keys or {}).get(t, ())).alias("declared_key")) for i, f in enumerate(df.schema)]
        named = df.agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(F.array(*about)).alias("r")).select("n", "r.*")
        key = F.col("n") == F.col("distinct_count")
        parts.append(named.join(F.broadcast(distinct_counts(df)), "column_name").select(F.lit(t).alias("table_name"), "position", "column_name", "data_type", key.alias("candidate_key"), "declared_key"))  # a row a column
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact row count of each table (A-03)."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t, df in tables.items()])


def seeded_sample(df: DataFrame, key: list[str], n: int, seed: int = SEED) -> DataFrame:
    """The n rows of least hash of (seed, key): the same rows on any cluster (A-04)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.withColumn("_h", digest).orderBy("_h", *key).limit(n).drop("_h")


def fraction_sample(df: DataFrame, fraction: float, key: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """A share of the rows; repeatable if a key is given (A-05)."""
    return df.where(uniform("sample", *key, seed=seed) < fraction) if key else df.sample(False, fraction, seed)


def cap_rows(df: DataFrame, cap: int, key: list[str], seed: int = SEED) -> DataFrame:
    """All rows, or a seeded sample if there are more than cap (A-06)."""
    return df if df.limit(cap + 1).count() <= cap else seeded_sample(df, key, cap, seed)


def reservoir(df: DataFrame, n: int, key: list[str], seed: int = SEED) -> DataFrame:
    """The n rows of least priority; merging two reservoirs is the same operation (A-07)."""
    return df.withColumn("priority", uniform("reservoir", *key, seed=seed)).orderBy("priority", *key).limit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of its own only in local mode."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lookalike-")
    return where


def written(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read from there, so that what is built on it neither
    computes it again nor depends on a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/lookalike-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def holdout_split(df: DataFrame, fraction: float, key: list[str], seed: int = SEED) -> DataFrame:
    """Adds is_train: a seeded permutation cut at 1 - fraction, a row on both sides at least;
    under four rows all train (A-08)."""
    n = df.count()
    cut = n if n < 4 else min(max(n - round(n * fraction), 1), n - 1)
    return ranked(df.withColumn("_u", uniform("holdout", *key, seed=seed)), ["_u", *key], "_rank").withColumn("is_train", F.col("_rank") <= cut).drop("_u", "_rank")


def write_csv(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of CSV files with header per table (A-09)."""
    for t, df in tables.items():
        df.write.mode("errorifexists").csv(f"{path}/{t}.csv", header=True)


def write_parquet(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """A folder of Parquet files per table (A-10)."""
    for t, df in tables.items():
        df.write.mode("errorifexists").partitionBy(*(partition_by or {}).get(t, [])).parquet(f"{path}/{t}.parquet", compression="snappy")


def write_jsonl(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of JSON lines per table (A-11)."""
    for t, df in tables.items():
        df.write.mode("errorifexists").json(f"{path}/{t}.json")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path, JVM view)"""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm


def staged_publish(spark: SparkSession, tables: dict[str, DataFrame], dest: str) -> None:
    """All tables or none: written aside, then renamed; an existing target is refused (A-12)."""
    fs, target, jvm = hadoop_path(spark, dest)
    if fs.exists(target):
        raise FileExistsError(dest)
    staging = f"{dest}.staging-{uuid.uuid4().hex}"
    try:
        write_parquet(tables, staging)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
            raise OSError(f"cannot rename to {dest}")
    except Exception:
        fs.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
        raise


def promote(spark: SparkSession, tables: dict[str, DataFrame], checks: DataFrame, dest: str) -> bool:
    """Publishes only if the verdict over the checks is PASS (A-13)."""
    from lookalike.operators.gate import verdict

    if verdict(checks).first().verdict != "PASS":
        return False
    staged_publish(spark, tables, dest)
    return True


def validate_write(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(table_name, expected, written, ok): rows read back, which must be equal (A-15)."""
    names = [r.table_name for r in expected.select("table_name").collect()]
    got = row_counts({t: scan(spark, f"{path}/{t}.parquet") for t in names}).withColumnRenamed("row_count", "written")
    return expected.withColumnRenamed("row_count", "expected").join(got, "table_name", "left").withColumn("ok", F.col("expected") == F.coalesce("written", F.lit(-1)))


def schema_compat(df: DataFrame, target: DataFrame) -> list[str]:
    """Columns that the target lacks (A-14); empty means the rows can be appended."""
    return [c for c in df.columns if c not in target.columns]
