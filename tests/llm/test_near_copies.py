"""The pipeline's near-copy stage against brute-force Jaccard."""

import random

from pyspark.sql import functions as F

DOC = "doc_id long, text string"


def kept(rows):
    """Places of the rows that stay; ids may repeat or be null."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 10 * len(x & y) >= 8 * len(x | y) > 0:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted((min((x for x in g if x is not None), default=None) for g in groups.values()), key=str)


def test_stage_is_jaccard(spark, sf):
    from lookalike.llm.simhash import stage_simhash

    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(160):
        if docs and r.random() < 0.75:
            w = r.choice(docs).split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            docs.append(" ".join(w[: len(w) - r.randint(0, 6)] or w))
        else:
            docs.append(" ".join(r.choice(vocab) for _ in range(r.randint(3, 150))))
    rows = [(i, t) for i, t in enumerate(docs)] + [(500, None), (501, ""), (7, docs[7]), (None, docs[9].upper()), (None, "quite alone here"), (None, "also quite alone")]
    r.shuffle(rows)
    got = stage_simhash(spark, spark.createDataFrame(rows, DOC).repartition(3), sf)
    assert sorted((x.doc_id for x in got.collect()), key=str) == kept(rows)
    assert stage_simhash(spark, spark.createDataFrame([], DOC), sf).count() == 0


def test_star_and_chain(spark, sf):
    """Many copies of one text, and a chain whose ends are not alike."""
    from lookalike.llm.simhash import stage_simhash

    w = [f"a{i}" for i in range(200)]
    rows = [(i, " ".join(w[:i] + ["x"] + w[i + 1 :])) for i in range(1, 120)]
    v = [f"b{i}" for i in range(200)]
    for i in range(12):
        v[i * 15] = "y"
        rows.append((1000 + i, " ".join(v)))
    got = stage_simhash(spark, spark.createDataFrame(rows, DOC), sf).collect()
    assert sorted(x.doc_id for x in got) == kept(rows) == [1, 1000]


def test_edited_copies_do_not_pair_up(spark, sf, monkeypatch):
    """Copies that each differ from all others by more than 0.8 allows are not verified pair by pair."""
    from lookalike.llm import simhash

    seen, write = [], simhash.written

    def written(df):
        out = write(df)
        if df.columns == ["a", "b", "sim"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", written)
    r = random.Random(1)
    w = [f"a{i}" for i in range(150)]
    rows = [(0, " ".join(w))]
    for i in range(1, 120):
        v = list(w)
        for k in range(5):
            v[r.randrange(150)] = f"x{i}_{k}"
        rows.append((i, " ".join(v)))
    got = simhash.stage_simhash(spark, spark.createDataFrame(rows, DOC), sf)
    assert sorted((x.doc_id for x in got.collect()), key=str) == kept(rows)
    assert seen[1] < 500


def test_links_that_no_table_and_no_band_finds(spark, sf):
    """Pairs at 0.8 that neither a segment's table nor a band brings together, found by trying nine million."""
    from lookalike.llm import simhash

    rows = []
    for i, k in enumerate([100028600, 200798323, 300028386, 400090716, 500548859, 600038358, 700509423, 800109745]):
        w = [f"{j}w{k}" for j in range(14)]
        rows += [(2 * i, " ".join(w[:13])), (2 * i + 1, " ".join(w[:12] + w[13:]))]
    docs = spark.createDataFrame(rows, DOC)
    got = sorted(x.doc_id for x in simhash.stage_simhash(spark, docs, sf).collect())
    assert got == sorted(kept(rows)) == list(range(0, 16, 2))


def test_prefixes_alone_find_all_links(spark, sf, monkeypatch):
    """Without any table or band, with frequent shingles known or not: texts, copies of one line, short texts."""
    from lookalike.llm import simhash

    monkeypatch.setattr(simhash, "segment_stars", lambda each: each.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    monkeypatch.setattr(simhash, "BANDS", 0)
    r = random.Random(8)
    vocab, line = [f"w{i}" for i in range(300)], [f"line{i}" for i in range(12)]
    docs = []
    for _ in range(150):
        w = r.choice(docs).split() if docs and r.random() < 0.7 else [r.choice(vocab) for _ in range(r.randint(1, 90))]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocab)
        docs.append(" ".join(w + line if r.random() < 0.3 else w))
    rows = list(enumerate(docs))
    for share, known in ((16, 1 << 18), (1, 1 << 18), (1, 5)):
        monkeypatch.setattr(simhash, "SHARE", share)
        monkeypatch.setattr(simhash, "KNOWN", known)
        got = simhash.stage_simhash(spark, spark.createDataFrame(rows, DOC), sf)
        assert sorted(x.doc_id for x in got.collect()) == sorted(kept(rows))
