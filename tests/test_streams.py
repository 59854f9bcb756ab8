"""Streams: event-time state with late rows and restarts, and semantic types."""

import datetime

import pytest
from pyspark.sql import functions as F

DAY = datetime.datetime(2024, 3, 1)


def at(day: float) -> datetime.datetime:
    return DAY + datetime.timedelta(days=day)


def test_late_rows_and_restart(spark, tmp_path):
    """Windows close once; rows within the delay count, later ones are dropped and told."""
    from lookalike.streaming.incremental import WindowedSums, stream

    source, schema = f"file://{tmp_path}/in", "ts timestamp, kind string, value double"
    put = lambda i, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}")
    sums = lambda: WindowedSums(spark, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").run(stream(spark, source, 1), "ts", "value", "kind")
    put(0, [(at(d + 0.5), "a", 1.0) for d in range(10)])  # the watermark ends at day 7.5
    first = sums()
    assert sorted(r.start for r in first.closed().collect()) == [at(d) for d in range(7)]
    assert first.late_rows() == 0 and first.open().count() == 3
    put(1, [(at(2.1), "a", 50.0), (at(2.2), "a", 50.0), (at(6.9), "b", 50.0), (at(8.5), "a", 7.0), (at(8.6), "b", 9.0), (at(12.5), "a", 1.0)])
    again = sums()  # another driver: nothing but the two folders is known
    closed = {(r.start, r.kind): (r.n, r.total) for r in again.closed().collect()}
    assert closed == {(at(d), "a"): (1, 1.0) for d in (*range(8), 9)} | {(at(8), "a"): (2, 8.0), (at(8), "b"): (1, 9.0)}
    assert again.closed().count() == len(closed)  # none twice
    assert again.late_rows() == 3
    assert sorted(map(tuple, again.open().collect())) == [(at(12), "a", 1)]
    assert sums().late_rows() == 3 and sums().closed().count() == len(closed)


@pytest.mark.parametrize("name", "customer orders events documents".split())
def test_stream_and_batch_give_the_same_types(spark, sf, tmp_path, name):
    from lookalike.operators.semantics import infer
    from lookalike.streaming.incremental import infer_stream, stream

    df = spark.read.parquet(f"{sf}/{name}.parquet").withColumns({"fixed": F.lit("x"), "none": F.lit(None).cast("string"), "whole": F.lit(2.0), "one_sided": F.when(F.rand(1) < 0.01, "rare").otherwise("usual")})
    df.repartition(5).write.parquet(f"file://{tmp_path}/t")
    df = spark.read.parquet(f"file://{tmp_path}/t")
    key = [df.columns[0]]
    want = sorted(map(tuple, infer(df, key).collect()))
    assert sorted(map(tuple, infer_stream(stream(spark, f"file://{tmp_path}/t", 2), key).collect())) == want


def test_rules_over_a_thousand_chunks(spark):
    """Exact in every chunk and over all of them, by a plan that does not grow with the chunks."""
    from lookalike.operators.repair import PercentRule
    from lookalike.streaming.incremental import apply_rule_chunks

    rule, sizes = PercentRule("kind", "=", "hit", 30.0, ("other", "more")), {}
    for chunks in (100, 1000):
        df = spark.range(6000).select("id", F.when(F.col("id") % 7 == 0, "hit").otherwise("none").alias("kind"), F.lit("kept").alias("said"))
        done = apply_rule_chunks(df, F.col("id") % chunks, rule, "id")
        sizes[chunks] = len(done._jdf.queryExecution().optimizedPlan().treeString().splitlines())
        rows = done.groupBy((F.col("id") % chunks).alias("c")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "hit").alias("h"), F.min("said").alias("said")).orderBy("c").collect()
        upto = before = 0
        for r in rows:
            upto += r.n
            now = int(upto * 0.3 + 0.5)
            assert r.h == now - before and r.said == "kept"
            before = now
        assert before == 1800 and len(rows) == chunks
    assert sizes[100] == sizes[1000]


def test_quantiles_of_a_hot_context(spark):
    """Half of the rows in one context, the others in many small ones."""
    import numpy as np

    from lookalike.operators.models import conditional_numeric

    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 300).cast("string"))).alias("ctx"), (F.xxhash64("id") % 1000 / 8).alias("v"))
    held: dict = {}
    for r in df.collect():
        held.setdefault(r.ctx, []).append(r.v)
    got = {r.context: (r.n, r.grid) for r in conditional_numeric(df, "v", ["ctx"]).collect()}
    assert got.keys() == held.keys()
    for c, values in held.items():
        assert got[c][0] == len(values) and np.allclose(got[c][1], np.percentile(values, np.linspace(0, 100, 21)), atol=1e-5)
