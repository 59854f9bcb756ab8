"""Operators 3 and 10 against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_key", T.StringType())])


def brute10(rows, length=100):
    rows = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1] or ""))
    first, out = {}, []
    data = [(r[1] or "").encode() for r in rows]
    for d, b in enumerate(data):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in first:
                gone[p : p + length] = b"\1" * length
            else:
                first[w] = (d, p)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((rows[d][0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute3(rows, words=35):
    docs = [(r[0], (r[1] or "").encode().split()) for r in rows]
    count = defaultdict(int)
    for _, w in docs:
        for p in range(len(w) - words + 1):
            count[tuple(w[p : p + words])] += 1
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - words + 1):
            if count[tuple(w[p : p + words])] > 1:
                gone[p : p + words] = [True] * words
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [say(r.randint(30, 120)) for _ in range(4)]
    docs = []
    for _ in range(n):
        kind = r.random()
        if docs and kind < 0.2:
            docs.append(r.choice(docs))
        elif docs and kind < 0.45:
            w = r.choice(docs).split()
            for _ in range(3):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            docs.append(" ".join(w))
        elif kind < 0.7:
            docs.append(say(r.randint(0, 60)) + "\n" + r.choice(shared) + "  " + say(r.randint(0, 60)))
        elif kind < 0.8:
            docs.append((r.choice(vocab) + " ") * r.randint(1, 300))
        else:
            docs.append(say(r.randint(0, 200)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot,least", [(2000, 64), (3, 64), (2000, 1), (2, 4)])
def test_against_brute_force(spark, seed, hot, least, monkeypatch):
    from lookalike.llm import repeats
    from lookalike.llm.phrase_automata import remove_phrases
    from lookalike.llm.suffix_dedup import remove_repeats

    monkeypatch.setattr(repeats, "HOT", hot)
    if least < 64:  # many anchors count as heavy
        monkeypatch.setattr(repeats, "SHARE", 2)
        monkeypatch.setattr(repeats, "LEAST", least)
        monkeypatch.setattr(repeats, "BATCH_BYTES", 3000)
        spark.conf.set("spark.sql.shuffle.partitions", "64")
    rows = [(i * 3, t, "x") for i, t in enumerate(corpus(seed))] + [(1000, None, None), (1001, "", None)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    try:
        assert sorted(map(tuple, remove_repeats(df).drop("kept_text").collect())) == sorted(brute10(rows))
        assert sorted(map(tuple, remove_phrases(df).drop("kept_text").collect())) == sorted(brute3(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_collision_is_not_a_repeat():
    """What the automaton does not meet twice is not marked, whatever the fingerprints say."""
    import numpy as np

    from lookalike.llm import phrase_automata

    one, two = (b" ".join(b"%s%d" % (c, i) for i in range(40)) for c in (b"a", b"b"))
    resolve = phrase_automata._resolver(35)
    args = lambda bodies: (bodies, np.array([1, 2]), np.array([6 << 2, 6 << 2]), np.zeros(2, bool), np.array([1, 1]))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(phrase_automata.P, "spans_hash", lambda c, a, b: np.arange(len(a), dtype=np.uint64) % np.uint64(6))
        assert len(resolve(*args([one, two]))[0]) == 0
    assert resolve(*args([one, one]))[0].tolist() == [1, 2]


def test_long_and_periodic_texts(spark):
    from lookalike.llm.phrase_automata import remove_phrases
    from lookalike.llm.suffix_dedup import remove_repeats

    rows = [(1, "a" * 20_000, None), (2, "word " * 5_000, None), (3, " ".join(str(i) for i in range(60_000)), None), (4, " ".join(str(i) for i in range(40_000, 70_000)), None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, remove_repeats(df).drop("kept_text").collect())) == sorted(brute10(rows))
    assert sorted(map(tuple, remove_phrases(df).drop("kept_text").collect())) == sorted(brute3(rows))


def test_repeated_and_null_ids(spark):
    from lookalike.llm.phrase_automata import remove_phrases
    from lookalike.llm.suffix_dedup import remove_repeats

    texts = corpus(5, 20)
    rows = [(i % 7 if i % 5 else None, t, None) for i, t in enumerate(texts)] + [(3, texts[0], None)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (r[0] is not None, *[x or 0 for x in r[:1]], *r[1:])
    assert sorted(map(tuple, remove_repeats(df).drop("kept_text").collect()), key=key) == sorted(brute10(rows), key=key)
    assert sorted(map(tuple, remove_phrases(df).drop("kept_text").collect()), key=key) == sorted(brute3(rows), key=key)


def test_empty(spark):
    from lookalike.llm.phrase_automata import remove_phrases
    from lookalike.llm.suffix_dedup import remove_repeats

    df = spark.createDataFrame([], SCHEMA)
    assert remove_repeats(df).count() == 0 and remove_phrases(df).count() == 0
