"""Operators 4 and 5."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("spans", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            grams[tuple(w[k : k + n])].add(str(i))
    out = []
    for d, t, *_ in docs:
        w = words(t)
        hit, named = [False] * len(w), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if who := grams.get(tuple(w[k : k + n])):
                    named |= who
                    hit[k : k + n] = [True] * n
        out.append((d, len(w), sum(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def made(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abÉé9") for _ in range(r.randint(1, 4))) for _ in range(40)]
    say = lambda n: r.choice([" ", "-", "\n"]).join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.choice([0, 1, 3, 10, 11, 30]))) for i in range(25)] + [(100, None), (10, "A!b"), (7, "...")]
    docs = []
    for i in range(80):
        t = say(r.randint(0, 30))
        if r.random() < 0.5:
            t += ", " + (r.choice(items)[1] or "").upper() + "; " + say(r.randint(0, 5))
        docs.append((i, t, "s", None))
    return docs + [(500, None, None, None), (501, "", "s", None), (3, docs[3][1], "s", None)], items


@pytest.mark.parametrize("seed,block", [(1, 4 << 20), (2, 4 << 20), (2, 200), (3, 1)])
def test_windows(spark, seed, block, monkeypatch):
    from lookalike.llm import inverted

    monkeypatch.setattr(inverted, "BLOCK_BYTES", block)
    docs, items = made(seed)
    docs += [(3, "another text of one id, " + (items[5][1] or ""), "s", None), (None, docs[0][1], None, None), (None, docs[7][1], None, None), (-(1 << 63) + 1, docs[8][1], None, None)]
    found = digested(inverted.contamination(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, ITEMS)))
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


def digested(found):
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0)


def test_long_text_and_index_of_all_words(spark):
    from lookalike.llm import inverted
    from lookalike.llm.common import keyed

    long = "lorem ipsum " * 300_000 + "a b c d e f g h i j"
    docs = [(1, long, None, None), (2, "x y z", None, None)]
    items = [(1, "q a b c d e f g h i j"), (2, "lorem " * 12)]
    df = spark.createDataFrame(docs, SCHEMA)
    assert sorted(map(tuple, digested(inverted.contamination(df, spark.createDataFrame(items, ITEMS))).collect()), key=str) == brute(docs, items)
    index = inverted.postings(keyed(df)).where("bucket >= 0").select(F.explode(F.arrays_zip("terms", "n")).alias("p"))
    counts = index.groupBy(F.col("p.terms").cast("string")).agg(F.sum("p.n")).collect()
    assert dict(map(tuple, counts)) == dict(Counter(words(long) + ["x", "y", "z"]))


def test_sql_agrees(spark, sf):
    import duckdb

    from lookalike.llm.inverted import SQL, op4_decontaminate

    for name in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {name} as select * from '{sf}/{name}.parquet'")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, op4_decontaminate(spark, sf).select(*cols).collect())) == sorted(duckdb.sql(SQL).select(*cols).fetchall())


def test_proximity_and_empty(spark):
    from lookalike.llm.inverted import contamination

    docs = spark.createDataFrame([(1, "one two x three four", None, None), (2, "one two three four", None, None), (None, "four three", None, None)], SCHEMA)
    item = spark.createDataFrame([(1, "one two three four")], ITEMS)
    near = {r.doc_id: bool(r.spans) for r in contamination(docs, item, slop=1).collect()}
    exact = {r.doc_id: bool(r.spans) for r in contamination(docs, item).collect()}
    assert near == {1: True, 2: True, None: False} and exact == {1: False, 2: True, None: False}
    assert contamination(docs.limit(0), item).count() == 0
    assert contamination(docs, item.limit(0)).where("size(spans) > 0").count() == 0


def check_bins(rows, docs, capacity, per_source):
    texts = {d: (t or "").lower().split() for d, t, *_ in docs}
    sources = {d: s or "" for d, _, s, *_ in docs}
    assert Counter((r.doc_id, r.part) for r in rows).most_common(1)[0][1] == 1
    total = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.n_words
        assert r.first_word == r.part * capacity
        if r.bin_id != "-1":
            bins[r.bin_id].append(r)
    assert {d: len(w) for d, w in texts.items()} == dict(total)
    for held in bins.values():
        assert sum(r.n_words for r in held) <= capacity
        assert len(held) == 1 or max(Counter(sources[r.doc_id] for r in held).values()) <= per_source
        assert len({" ".join(texts[r.doc_id]) for r in held}) == len(held)
    return bins


@pytest.mark.parametrize("per_source", [1, 2])
def test_bins(spark, per_source):
    from lookalike.llm.packing import pack

    r = random.Random(per_source)
    docs = [(i, "w " * r.choice([0, 5, 30, 100, 250]) + f"{r.randrange(150)}" * r.randint(0, 1), r.choice(["hot", "hot", "a", "b", None]), None) for i in range(400)]
    docs += [(900, None, None, None), (901, "", "a", None)]
    rows = pack(spark.createDataFrame(docs, SCHEMA), 100, per_source).collect()
    check_bins(rows, docs, 100, per_source)
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_best_fit_is_tightest():
    from lookalike.llm.packing import Bins

    b = Bins(10, 1)
    assert [b.put(7, 0, 0), b.put(5, 1, 1), b.put(4, 1, 2), b.put(3, 0, 3)] == [0, 1, 2, 1]
    assert b.put(3, 2, 3) == 0  # residual 3 fits exactly
    assert b.put(2, 3, 1) == 2  # bin 1 (residual 2) holds that cluster


def test_every_piece_went_to_the_tightest_bin(spark, monkeypatch):
    """Replays the packing: brute-force search for the tightest compatible bin at each step."""
    from lookalike.llm import packing

    r = random.Random(9)
    docs = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(r.choice([1, 5, 30, 70, 99, 130]))), r.choice(["hot", "hot", "hot", "a", "b", None]), None) for i in range(300)]
    docs += [(1000 + i, docs[i % 7][1].upper(), "copies", None) for i in range(40)]
    capacity, per_source = 100, 2
    got = {r.doc_id: r.bin_id for r in packing.pack(spark.createDataFrame(docs, SCHEMA), capacity, per_source).where("n_words < 100").collect()}
    rests = [(len(t.split()) % capacity, d, s or "", " ".join(t.lower().split())) for d, t, s, _ in docs if len(t.split()) % capacity]
    bins: dict = {}
    for size, doc, source, cluster in sorted(rests, key=lambda x: (-x[0], x[1])):
        fits = {b: left for b, (left, held) in bins.items() if left >= size and sum(x == source for x, _ in held) < per_source and all(c != cluster for _, c in held)}
        name = got[doc]
        assert (name in fits and fits[name] == min(fits.values())) if fits else name not in bins
        left, held = bins.get(name, (capacity, []))
        bins[name] = (left - size, [*held, (source, cluster)])
    assert len(got) == len(rests)
