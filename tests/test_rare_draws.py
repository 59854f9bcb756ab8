"""Conditional draws where the rounded shares of a context end below one."""

from pyspark.sql import functions as F


def drawn(spark, model, contexts):
    from lookalike.operators import generate as G

    df = spark.range(200).select(F.col("id").alias("k"), F.element_at(F.array(*[F.lit(c) for c in contexts]), (F.col("id") % len(contexts) + 1).cast("int")).alias("c"))
    rows = G.sample_conditional(df, spark.createDataFrame(model, "context string, value string, probability double"), ["c"], "v", "k").collect()
    assert len(rows) == 200
    return {c: {r.v for r in rows if r.c == c} for c in contexts}


def test_draws_beyond_the_last_share_get_the_last_value(spark):
    model = [("*", "m", 1.0), ("x", "a", 0.3), ("x", "b", 0.3), ("y", "z", 1.0)]
    assert drawn(spark, model, ["x", "y"]) == {"x": {"a", "b"}, "y": {"z"}}


def test_draws_beyond_the_last_share_of_the_marginal(spark, monkeypatch):
    from lookalike.operators import generate as G

    model = [("*", "m", 0.2), ("*", "n", 0.2), ("x", "a", 1.0)]
    for rows in (G.MODEL_ROWS, 0):  # models that are broadcast, and that are joined
        monkeypatch.setattr(G, "MODEL_ROWS", rows)
        assert drawn(spark, model, ["x", "unknown", None]) == {"x": {"a"}, "unknown": {"m", "n"}, None: {"m", "n"}}


def test_cross_table_query_beyond_the_rounded_shares(spark, tmp_path):
    """g13 against its SQL: shares of a third end at 0.999999, order 495516 draws beyond them."""
    import duckdb

    from lookalike.plans import registry

    customer = spark.createDataFrame([(1, "A"), (2, "B")], "c_custkey long, c_mktsegment string")
    orders = spark.createDataFrame([(495516 + i, 1, "FOP"[i % 3]) for i in range(9)] + [(i, 2, "F") for i in range(9)], "o_orderkey long, o_custkey long, o_orderstatus string")
    for name, df in (("customer", customer), ("orders", orders)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = dict(map(tuple, registry.queries()["g13_sample_cross_table"](spark, str(tmp_path)).select("o_orderkey", "v").collect()))
    want = dict(con.execute(registry.oracle_sql()["g13_sample_cross_table"]).fetchall())
    assert got == want and got[495516] == "P" and len(got) == 18
