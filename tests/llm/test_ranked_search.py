"""Operator 12."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("text", "score", "rank", "row", "uid"))])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("text", "row", "terms", "bound"))])


def said(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def plain(docs, items, k):
    docs = [(i, Counter(said(lower(t)))) for i, t in docs]
    docs = [d for d in docs if d[1]]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in docs:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(said(lower(text))) if c[t])
            if score > 0:
                found.append((-score, doc is not None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("block_bytes", [300, 16 << 20])
def test_against_brute_force(spark, monkeypatch, block_bytes):
    from lookalike.llm import ranked_search as R

    monkeypatch.setattr(R, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(R, "PACKET_BYTES", 9000 if block_bytes == 300 else 1 << 20)
    r = random.Random(12)
    vocabulary = ["the", "The", "É", "é", "a1", "x-y", "don't", "日本", " ", *(f"w{int(r.paretovariate(0.7))}" for _ in range(400))]
    text = lambda n: r.choice([" ", "\n", ". "]).join(r.choice(vocabulary) for _ in range(n))
    docs = [(i, text(r.randrange(60))) for i in range(300)] + [(i, "one text of many copies") for i in range(300, 340)]
    docs += [(None, None), (341, None), (342, ""), (343, "..!"), (344, "the " * 5000 + "w1"), (345, text(30)), (345, text(30)), (346, text(20_000)), (None, "w1 w2 zebra")]
    items = [(i, text(r.randrange(1, 25))) for i in range(30)] + [(31, None), (32, ".."), (33, "unheard"), (34, "Many COPIES of many"), (34, "Many copies of"), (None, "zebra w2"), (36, "the")]
    wide = lambda rows, n: [(*x, *["odd"] * n) for x in rows]
    got = R.ranked(spark.createDataFrame(wide(docs, 4), DOCS).repartition(5), spark.createDataFrame(wide(items, 3), ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(plain(docs, items, 10))
    empty = spark.createDataFrame([], DOCS)
    assert R.ranked(empty, spark.createDataFrame(wide(items, 3), ITEMS)).count() == 0
    assert R.ranked(spark.createDataFrame(wide(docs[:9], 4), DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_search_stops_early_and_reads_no_further():
    """With one list that decides, the places read stay far above the lists' ends; ties are all found."""
    from lookalike.llm.ranked_search import best_positions

    n = 100_000
    rng = np.random.default_rng(12)
    lists = []
    for t in range(5):
        docs = np.sort(rng.choice(n, n // 2, replace=False)).astype(np.int32)
        impact = rng.integers(1, 1000, len(docs)) ** 2
        order = np.argsort(-impact, kind="stable").astype(np.int32)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        lists.append((docs, impact, rank, order))

    class Counted(np.ndarray):
        most = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Counted.most = max(Counted.most, at.stop)
            return super().__getitem__(at)

    watched = [(d, i, r, o.view(Counted)) for d, i, r, o in lists]
    weights, uids = [50, 40, 30, 20, 0 + 10], np.arange(n)[::-1].copy()
    total = np.zeros(n, np.int64)
    for (docs, impact, *_), w in zip(lists, weights, strict=True):
        total[docs] += w * impact
    top, scores = best_positions(watched, weights, 10, 0, n, uids)
    want = np.lexsort((uids, -total))[:10]
    assert list(top) == list(want) and list(scores) == list(total[want])
    assert Counted.most < n // 4
    top, scores = best_positions(lists, weights, 10, int(total[want][4]), n, uids)
    assert set(top) >= set(want[:5]) and scores.min() >= total[want][4]


def test_query_against_sql(spark, sf):
    import duckdb

    from lookalike.llm.ranked_search import SQL, op12_ranked_search

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = sorted(map(tuple, op12_ranked_search(spark, sf).collect()))
    assert got == sorted(con.execute(SQL).fetchall()) and len(got) > 100
