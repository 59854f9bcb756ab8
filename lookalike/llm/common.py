"""What the operators of this subpackage share: tables, recovery points, keys, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that this session wrote, in order.
_WRITTEN: list[str] = []
#: Bytes of a side that may be broadcast once its size was measured.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session's cluster names it."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lookalike-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read from there: the cut survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/lookalike-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written; the tables that were written on the way are deleted, as nothing
    reads them any more."""
    before = len(_WRITTEN)
    out = written(make())
    for path in _WRITTEN[before:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _WRITTEN[before:-1]
    return out


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns _uid (long), _id, _text and, with carry, _rest (a struct of those columns): _uid is
    unique and orders as (id, text) does.

    It is the id itself where ids are unique and not null.  Otherwise rows are sorted by range
    and numbered, so that repeated rows and null ids stay documents of their own."""
    from pyspark.sql.types import IntegerType, LongType

    rest = [F.struct(*carry).alias("_rest")] if carry else []
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *rest)
    kept = ["_id", "_text", "_rest"] if carry else ["_id", "_text"]
    whole = isinstance(docs.schema[id_col].dataType, (LongType, IntegerType))
    odd = df.groupBy("_id").count().where("count > 1 or _id is null").limit(1).count() if whole else 1
    if not odd:
        return df.select(F.col("_id").cast("long").alias("_uid"), *kept)
    ranged = df.repartitionByRange(F.col("_id").asc_nulls_first(), "_text").sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text")
    return written(ranged.select(F.monotonically_increasing_id().alias("_uid"), *kept))


def joined_to_facts(rows: DataFrame, facts: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows with the one fact of their key; ``size`` says how many rows a fact has.

    Facts of keys that would fill half a task of the shuffle are broadcast, so that a key that a
    third of all rows share stays where it is: twice the number of shuffle partitions at most."""
    facts = written(facts)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max((facts.agg(F.sum(size)).first()[0] or 0) / (2 * parts), 1000)
    heavy = facts.where(F.col(size) > least)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(facts.where(F.col(size) <= least), key)
    return rows.join(F.broadcast(heavy), key).unionByName(rest)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an edge list by alternating large and small stars.

    Returns (node, root): root is the smallest node of its component; nodes without an edge
    have no row.  Each star step only shuffles edges, none needs a whole component in one task:
    neighbours are reduced to their minimum by aggregation before they are joined back."""
    spark = edges.sparkSession
    cur = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        # large star: every neighbour above u points at the least of u and its neighbours
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its lower neighbours point at the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        nxt = written(small.where("u <> v").distinct())
        same = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        was = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        cur = nxt
        if same == was:
            break
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
