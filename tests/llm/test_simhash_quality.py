"""Operators 6 and 9."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def test_hash_is_sparks(spark):
    from lookalike.llm.simhash import shingle_hashes

    want = spark.sql("select xxhash64('a b c') a, xxhash64('é f') b").first()
    assert shingle_hashes(b"A B\n c", 3) == [want.a % 2**64]
    assert shingle_hashes("é F".encode(), 3) == [want.b % 2**64]
    assert len(shingle_hashes(b"a b c d a b c", 3)) == 5 and shingle_hashes(b" ", 3) == []


def brute(rows, words=3):
    from lookalike.llm.simhash import shingle_hashes

    fps = []
    for _, t, _ in rows:
        h = shingle_hashes((t or "").encode(), words)
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((r[0], f"{fps[i]:016x}", low[find(i)]) for i, r in enumerate(rows))


def test_components(spark):
    from lookalike.llm.simhash import near_duplicates

    r = random.Random(3)
    vocab = ["".join(r.choice("ABcdé") for _ in range(r.randint(1, 5))) for _ in range(80)]
    docs = []
    for _ in range(150):
        if docs and r.random() < 0.7:
            w = r.choice(docs).split()
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
            docs.append(" ".join(w))
        else:
            docs.append(" ".join(r.choice(vocab) for _ in range(r.randint(0, 120))))
    rows = [(i * 2, t, "x") for i, t in enumerate(docs)] + [(999, None, None), (1000, "", None), (1001, " ", None), (4, docs[2], None)]
    r.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.drop("component_size").collect())) == brute(rows)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chain_of_fingerprints(spark):
    from lookalike.llm.common import components
    from lookalike.llm.simhash import links

    chain = [0]
    for i in range(40):
        chain.append(chain[-1] ^ (1 << i) ^ (1 << (i + 23)))
    fps = [x - 2**64 if x >= 2**63 else x for x in chain] + [-1]
    got = components(links(spark.createDataFrame([(x,) for x in fps], "fp long")), "a", "b").collect()
    assert len({x.root for x in got}) == 1 and {x.node for x in got} == set(fps[:-1])


def test_quality_on_held_out(spark, sf):
    from lookalike.llm.quality import quality_scores

    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_scores(docs, labels)
    assert got.count() == docs.count()
    hit = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.min("score"), F.max("score")).first()
    assert hit[0] > 0.95 and 0 <= hit[1] <= hit[2] <= 1


def test_quality_edges(spark):
    from lookalike.llm.quality import quality_scores

    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "x " * 50000, "c"), (2, "x " * 50000, "c")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_scores(docs, none).collect()} == {0.5}
    one = quality_scores(docs, spark.createDataFrame([(2, 1), (1, None)], "doc_id long, quality int")).collect()
    assert len(one) == 4
    assert quality_scores(docs.limit(0), none).count() == 0


def test_heavy_keys_are_not_shuffled_but_joined(spark):
    from lookalike.llm.common import joined_to_facts

    rows = spark.range(6000).select(F.when(F.col("id") < 4000, -1).otherwise(F.col("id") % 700).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("n > 2")
    got = joined_to_facts(rows, facts, "k", "n")
    assert sorted(map(tuple, got.select("k", "id", "n", "low").collect())) == sorted(map(tuple, rows.join(facts, "k").select("k", "id", "n", "low").collect()))


def test_quality_against_a_plain_fit(spark, sf):
    """Kernel features, ridge and isotonic curve fitted on all rows at once."""
    import math
    import zlib

    import numpy as np

    from lookalike.llm import quality as Q
    from lookalike.llm.calibrate import HIGH, LOW, STEP

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    given = [(r.doc_id, r.quality) for r in labels.collect() if r.quality is not None and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x = {d: np.array(Q.statistics(t.encode()), np.float32).astype(float) for d, t in texts.items()}
    a = np.array([x[d] for d, _ in given])
    y = np.array([q for _, q in given], float)
    mean, scale = a.mean(0), a.std(0)
    scale[scale <= 1e-9] = 1
    rng = np.random.default_rng(Q.SEED)
    w = rng.standard_normal((a.shape[1], Q.COMPONENTS)) / (Q.WIDTH * math.sqrt(a.shape[1]))
    shift = rng.uniform(0, 2 * math.pi, Q.COMPONENTS)
    z = lambda m: np.column_stack([np.cos((m - mean) / scale @ w + shift) * math.sqrt(2 / Q.COMPONENTS), np.ones(len(m))])
    beta = np.linalg.solve(z(a).T @ z(a) + Q.RIDGE * np.eye(Q.COMPONENTS + 1), z(a).T @ y)
    at = np.floor((np.clip(z(a) @ beta, LOW, HIGH) - LOW) / STEP)
    pools = [[y[at == b].sum(), (at == b).sum(), (at == b).sum() * (LOW + (b + 0.5) * STEP)] for b in np.unique(at)]
    k = 1
    while k < len(pools):  # pool adjacent violators, from the left
        if pools[k - 1][0] / pools[k - 1][1] >= pools[k][0] / pools[k][1]:
            pools[k - 1 : k + 1] = [[u + v for u, v in zip(pools[k - 1], pools[k])]]
            k = max(1, k - 1)
        else:
            k += 1
    ids = sorted(texts)
    want = np.interp(z(np.array([x[d] for d in ids])) @ beta, [p[2] / p[1] for p in pools], [p[0] / p[1] for p in pools])
    got = {r.doc_id: r.score for r in Q.quality_scores(docs, labels).collect()}
    apart = np.abs(np.array([got[d] for d in ids]) - want)
    assert np.quantile(apart, 0.95) < 1e-3 and apart.max() < 0.1  # a score on the border of a bin may fall to either side


def test_stage_joins_by_fingerprints(spark, sf, monkeypatch):
    """Without any band, fingerprints alone join long texts that differ by a word, and no others."""
    from lookalike.llm import simhash

    monkeypatch.setattr(simhash, "BANDS", 0)
    texts = [[f"t{k}w{i}" for i in range(900)] for k in range(12)]
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)] + [(100 + k, " ".join([*w[:400], "x", *w[401:]])) for k, w in enumerate(texts)]
    got = simhash.stage_simhash(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in got.collect()) == list(range(12))
