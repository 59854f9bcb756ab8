"""Global ranks and running sums with other columns kept, at several numbers of partitions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest


@pytest.fixture(params=[(4, True), (16, False), (200, True)], ids=str)
def session(spark, request):
    parts, adaptive = request.param
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("name", "keys"), [("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"])])
def test_ranks_with_all_columns(session, name, keys):
    from lookalike.functions.rng import uniform
    from lookalike.sources.ranges import ranked

    df = session.read.parquet(f"/root/testdata/sf0.1/{name}.parquet").withColumn("u", uniform("t", *keys))
    got = ranked(df, ["u", *keys])
    assert got.columns == [*df.columns, "rank"]
    from pyspark.sql import functions as F

    whole = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))  # every column is read
    u = np.sort(np.array([r.u for r in df.select("u").collect()]))
    n, least, most, distinct, same = got.agg(F.count("*"), F.min("rank"), F.max("rank"), F.count_distinct("rank"), whole).first()
    assert (n, least, most, distinct, same) == (len(u), 1, len(u), len(u), df.agg(whole).first()[0])
    some = [(r.u, r["rank"]) for r in got.where("rank % 997 = 0").select("u", "rank").collect()]
    assert all(u[i - 1] == v for v, i in some) and len(some) == len(u) // 997


def test_splits_keep_their_rows(spark):
    from lookalike.operators.repair import force_ratio
    from lookalike.sources.io import holdout_split

    df = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    split = Counter(r.is_train for r in holdout_split(df, 0.2, ["o_orderkey"]).collect())
    assert split == {True: 120_000, False: 30_000}
    forced = Counter(r.o_orderstatus for r in force_ratio(df, "o_orderstatus", {"A": 0.25, "B": 0.75}, "o_orderkey").collect())
    assert forced == {"A": 37_500, "B": 112_500}


def test_running_sums_of_groups(session):
    from lookalike.sources.ranges import ranked_in, running_sums

    r = random.Random(4)
    rows = [(g, v, r.randrange(9), f"kept {v}") for g in ["hot"] * 1 + [None, "", *"abcdefgh"] for v in range(3000 if g == "hot" else r.randrange(1, 40))]
    r.shuffle(rows)
    df = session.createDataFrame(rows, "g string, v int, x long, other string")
    groups = defaultdict(list)
    for g, v, x, other in sorted(rows, key=lambda t: t[1]):
        groups[g].append((v, x, other))
    want = set()
    for g, items in groups.items():
        upto, total = 0, sum(x for _, x, _ in items)
        for v, x, other in items:
            upto += x
            want.add((g, v, x, other, upto, total))
    assert {tuple(t) for t in running_sums(df, ["g"], "v", ["x"]).collect()} == want
    assert all(t.rank == t.v + 1 for t in ranked_in(df, ["g"], ["v"]).collect())


def test_order_of_odd_values(session):
    """Nulls first, NaN last, ties of the first column, times and long texts."""
    import datetime

    from lookalike.sources.ranges import ranked

    r = random.Random(5)
    values = [None, math.nan, math.inf, -math.inf, -0.5, 1e300, *(r.random() for _ in range(300))]
    day = datetime.datetime(2024, 10, 27)
    rows = [(v, day + datetime.timedelta(minutes=r.randrange(600)) if i % 7 else None, "x" * 400 + str(i), i) for i, v in enumerate(values)]
    df = session.createDataFrame(rows, "a double, t timestamp, s string, i int")
    for order in (["a", "i"], ["t", "s"]):
        want = [x.i for x in df.coalesce(1).sortWithinPartitions(*order).collect()]
        assert [x.i for x in sorted(ranked(df, order).collect(), key=lambda x: x.rank)] == want
    assert ranked(df.limit(0), ["i"]).count() == 0


def test_plan_size_and_broadcasts_are_bounded(spark):
    """What is broadcast has a row for each range, however many groups there are."""
    from pyspark.sql import functions as F

    from lookalike.sources.ranges import running_sums

    df = spark.range(200_000).select((F.col("id") % 50_000).alias("g"), F.col("id").alias("v"), F.lit(1).alias("x"))
    got = running_sums(df, ["g"], "v", ["x"]).agg(F.count("*").alias("n"), F.max("upto_x").alias("m"), F.min("all_x").alias("t"), F.max("all_x").alias("u")).first()
    assert tuple(got) == (200_000, 4, 4, 4)
