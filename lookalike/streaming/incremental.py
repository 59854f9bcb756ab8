"""Incremental forms (J): mergeable operators as Structured Streaming queries.

Each takes a streaming table, runs it to its end and gives a static table that equals the batch
form.  A stream that never ends keeps its query; state is bounded by groups, not by rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.functions.rng import SEED, uniform
from lookalike.operators import profile as P
from lookalike.operators import semantics as S
from lookalike.operators.generate import assign_fk
from lookalike.operators.repair import PercentRule
from lookalike.sources.distinct import hashed_counts
from lookalike.sources.io import shared_dir
from lookalike.sources.ranges import ranked_in, running_sums


def shared(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream, with the schema of what is there.  A single file is streamed as
    the only match in its folder, which is what a file source reads."""
    from lookalike.sources.io import hadoop_path

    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    fs, where, _ = hadoop_path(spark, path)
    if fs.getFileStatus(where).isFile():
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def batches(sdf: DataFrame, handle, name: str) -> None:
    """Runs ``handle(df, batch id)`` on every micro-batch until the stream's present end.  Results
    are keyed by batch id, so a batch that runs again after a failure replaces itself."""
    q = sdf.writeStream.foreachBatch(handle).option("checkpointLocation", shared(sdf.sparkSession, f"{name}-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()


def _kept_all(sdf: DataFrame, name: str, parts: dict) -> dict[str, DataFrame]:
    """parts[x](df) of each batch for every x, written once per batch; each x's parts as one table."""
    path = shared(sdf.sparkSession, name)

    def handle(df: DataFrame, batch: int) -> None:
        for x, part in parts.items():
            part(df).write.mode("overwrite").parquet(f"{path}/{x}/batch={batch}")

    batches(sdf, handle, name)
    return {x: sdf.sparkSession.read.parquet(f"{path}/{x}").drop("batch") for x in parts}


def _kept(sdf: DataFrame, name: str, part) -> DataFrame:
    return _kept_all(sdf, name, {"part": part})["part"]


def profile_stream(sdf: DataFrame, columns: list[str]) -> DataFrame:
    """Merged profile: partial profiles per batch, distinct values by sketch (J-01)."""
    return P.merge_profiles(_kept(sdf, "profile", lambda df: P.partial_profiles(df, F.lit("batch"), columns)))


def infer_stream(sdf: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Semantic types of a stream's columns, as C-06 ranks them (J-02).

    Each batch leaves counters of its columns and counts of its hashed values; both add up over
    batches, so the result is the batch form's over all rows, whatever the batches were."""
    kept = _kept_all(sdf, "evidence", {"counters": S.counters, "values": hashed_counts})
    values = kept["values"].groupBy("column_name", "a", "b").agg(F.sum("n").alias("n"))
    return S.resolve_semantics(S.evidence_of(S.merged_counters(kept["counters"]), values, sdf.columns, key))


def validate_stream(sdf: DataFrame, parents: DataFrame, fk: str, parent_key: str, rules: dict[str, Column]) -> DataFrame:
    """(issue, n): rule violations and orphans added up over batches; the relation is checked by a
    join of each batch with the parents' keys (J-03)."""
    keys = parents.select(F.col(parent_key).alias("_k")).distinct().withColumn("_hit", F.lit(True))

    def part(df: DataFrame) -> DataFrame:
        j = df.join(keys, F.col(fk) == F.col("_k"), "left")
        flags = {**rules, "orphan": F.col(fk).isNotNull() & F.col("_hit").isNull()}
        wide = j.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
        return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("issue"), F.col(n).alias("n")) for n in flags])).alias("r")).select("r.*")

    return _kept(sdf, "issues", part).groupBy("issue").agg(F.sum("n").alias("n"))


class WindowedSums:
    """Event-time sums in append mode (J-03).

    A window is written to the Parquet sink once, when the watermark (the latest time seen less
    ``late``) has passed its end, and leaves the state; a later row of it is dropped and counted.
    Sink and checkpoint are folders that outlive a driver: another run with the same two goes on
    where the last one stopped."""

    def __init__(self, spark: SparkSession, sink: str, checkpoint: str):
        self.spark, self.sink, self.checkpoint = spark, sink, checkpoint

    def run(self, sdf: DataFrame, when: str, value: str, by: str, width: str = "1 day", late: str = "2 days") -> WindowedSums:
        """Takes in what the source has now."""
        agg = sdf.withWatermark(when, late).groupBy(F.window(when, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        rows = agg.select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n", F.round("total", 4).alias("total"))
        q = rows.writeStream.outputMode("append").format("parquet").option("path", self.sink).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        took = [(p["batchId"], p["numInputRows"]) for p in q.recentProgress]
        self.spark.createDataFrame(took, "batch long, n long").coalesce(1).write.mode("append").parquet(f"{self.checkpoint}-rows")
        return self

    def closed(self) -> DataFrame:
        """(start, by, n, total) of the windows that are final."""
        return self.spark.read.parquet(self.sink)

    def open(self) -> DataFrame:
        """(start, by, n) of the windows that still wait, from the state store."""
        state = self.spark.read.format("statestore").load(self.checkpoint)
        by = next(c for c in state.schema["key"].dataType.names if c != "window")
        return state.select(F.col("key.window.start").cast("timestamp_ntz").alias("start"), F.col(f"key.{by}").alias(by), F.col("value.count").alias("n"))

    def late_rows(self) -> int:
        """Rows that came after their window was closed: those taken in less those in a window."""
        took = self.spark.read.parquet(f"{self.checkpoint}-rows").groupBy("batch").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0]
        held = sum(df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (self.closed(), self.open()))
        return (took or 0) - held


def windowed_sums(sdf: DataFrame, when: str, value: str, by: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """The windows that a stream's watermark closes (J-03): (start, by, n, total)."""
    spark = sdf.sparkSession
    return WindowedSums(spark, shared(spark, "sums"), shared(spark, "sums-checkpoint")).run(sdf, when, value, by, width, late).closed()


def reservoir_stream(sdf: DataFrame, n: int, key: list[str], columns: list[str], seed: int = SEED) -> DataFrame:
    """The n rows of least priority: each batch keeps its own n, then the parts' n (J-04)."""
    def part(df: DataFrame) -> DataFrame:
        return df.select(*columns, uniform("reservoir", *key, seed=seed).alias("priority")).orderBy("priority", *key).limit(n)

    return _kept(sdf, "reservoir", part).orderBy("priority", *key).limit(n)


def rule_targets(df: DataFrame, chunk: Column, percent: float) -> DataFrame:
    """(chunk, n, want): rows of each chunk that a rule is to hold for, as differences of rounded
    running targets, so that all chunks together are exact (J-05)."""
    sizes = df.groupBy(chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    upto = lambda n: F.floor(F.lit(float(percent)) * n / 100 + 0.5).cast("long")
    return running_sums(sizes, [], "chunk", ["n"]).select("chunk", "n", (upto(F.col("upto_n")) - upto(F.col("upto_n") - F.col("n"))).alias("want"))


def apply_rule_chunks(df: DataFrame, chunk: Column, rule: PercentRule, key: str) -> DataFrame:
    """A percent rule that is exact over all chunks (J-05).

    One pass whatever the number of chunks: rows are ranked within all chunks at once, those that
    hold already first, and compared with a table of the chunks' targets."""
    rule.check(df, (key,))
    kept = df.withColumns({"_chunk": chunk, "_late": (~rule.holds()).cast("int"), "_u": uniform(f"rule:{rule.column}", key)})
    placed = ranked_in(kept, ["_chunk"], ["_late", "_u", key], "_rank")
    goals = rule_targets(df, chunk, rule.percent).select(F.col("chunk").alias("_of"), "want")
    j = placed.join(goals, F.col("_chunk").eqNullSafe(F.col("_of")))
    hit, late = F.col("_rank") <= F.col("want"), F.col("_late") == 1
    new = F.when(hit & late, rule.meet()).when(~hit & ~late, rule.alternate(key)).otherwise(F.col(rule.column))
    return j.withColumn(rule.column, new).select(*df.columns)


def chunk_evidence(df: DataFrame, chunk: Column, rules: list[PercentRule]) -> DataFrame:
    """(chunk, rule, hits, n) (J-06)."""
    wide = df.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n"), *[F.count_if(r.holds()).alias(f"h{i}") for i, r in enumerate(rules)])
    return wide.select("chunk", "n", F.explode(F.array(*[F.struct(F.lit(f"{r.column} {r.op} {r.value}").alias("rule"), F.col(f"h{i}").alias("hits")) for i, r in enumerate(rules)])).alias("r")).select("chunk", "r.*", "n")


def aggregate_evidence(parts: DataFrame, rules: list[PercentRule]) -> DataFrame:
    """Evidence of all chunks together: exact count or within a quarter point (J-06)."""
    goal = F.coalesce(*[F.when(F.col("rule") == f"{r.column} {r.op} {r.value}", F.lit(float(r.percent))) for r in rules])
    a = parts.groupBy("rule").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).withColumn("target", goal)
    actual = F.round(F.try_divide(F.col("hits") * 100.0, "n"), 4)
    return a.select("rule", "target", actual.alias("actual"), ((F.col("hits") == F.floor(F.col("n") * F.col("target") / 100 + 0.5)) | (F.abs(actual - F.col("target")) <= 0.25)).alias("passed"))


def clean_stream(sdf: DataFrame, column: str) -> DataFrame:
    """(column_name, row_count, null_count, failed) of a numeric coercion, added up over batches (J-08)."""
    number = F.expr(f"try_cast(trim(cast(`{column}` as string)) as double)")

    def part(df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("row_count"), F.count_if(F.col(column).isNull()).alias("null_count"), F.count_if(F.col(column).isNotNull() & number.isNull()).alias("failed"))

    return _kept(sdf, "clean", part).agg(*[F.sum(c).alias(c) for c in ("row_count", "null_count", "failed")]).select(F.lit(column).alias("column_name"), "*")


def assign_fk_stream(sdf: DataFrame, child_key: str, parent: DataFrame, parent_key: str, out: str) -> DataFrame:
    """Parent keys for a stream of child rows: each micro-batch draws from the keys that are there
    when it runs; while they do not change, the result is assign_fk's over all rows (J-07)."""
    return _kept(sdf, "keys", lambda df: assign_fk(df, child_key, parent, parent_key, out))
