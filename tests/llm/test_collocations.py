"""Operator 13."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("text", "lang", "words", "id", "block"))])


def plain(docs, least, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    candidates = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    longer = Counter()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    rows = []
    for (lang, w), a in candidates.items():
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        if 100 * longer[lang, w] < 80 * a:
            rows.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out = []
    for lang in n:
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, i, *r[1:]) for i, r in enumerate(mine, 1)]
    return out


@pytest.mark.parametrize(("trie", "round_bytes", "block"), [(200_000, 64 << 20, 8 << 20), (9, 2000, 400)])
def test_against_brute_force(spark, monkeypatch, trie, round_bytes, block):
    from lookalike.llm import collocations as C

    monkeypatch.setattr(C, "TRIE", trie)
    monkeypatch.setattr(C, "ROUND", round_bytes)
    monkeypatch.setattr(C, "BLOCK_BYTES", block)
    r = random.Random(13)
    vocabulary = ["the", "The", "É", "é", "日本", "x-y", *(f"w{int(r.paretovariate(0.8))}" for _ in range(60))]
    fixed = ["new york city", "New York", "a a a a a", "to be or not to be", "\x1c odd\x85word"]
    sep = lambda: r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "! "])
    text = lambda n: "".join((r.choice(fixed) if r.random() < 0.2 else r.choice(vocabulary)) + sep() for _ in range(n))
    docs = [(r.choice(["en", "en", "de", None, "und", ""]), text(r.randrange(40))) for _ in range(250)]
    docs += [("en", None), ("fr", None), ("fr", ""), ("fr", "..!"), ("fr", "one"), ("en", text(5000)), *[("de", "exact copy of a text")] * 40]
    df = spark.createDataFrame([(None if i % 9 == 0 else i % 50, t, lang, "odd", "odd", "odd") for i, (lang, t) in enumerate(docs)], DOCS).repartition(3)
    for least, top in ((30, 2000), (4, 25)):
        got = C.collocations(df, least, 4, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == sorted(plain(docs, least, top))
    assert C.collocations(df.limit(0)).count() == 0


def test_tries_hold_their_phrases_and_no_others():
    from lookalike.llm.collocations import Trie

    r = np.random.default_rng(13)
    for k, size, words in ((2, 4000, 300), (3, 3000, 20), (4, 2000, 2000), (2, 1, 5)):
        some = np.unique(np.minimum(r.pareto(0.6, (size, k)) + 1, words).astype(np.int32), axis=0)
        r.shuffle(some)
        trie = Trie.of(some, np.arange(len(some)) * 7)
        text = np.minimum(r.pareto(0.5, 50_000), words + 50).astype(np.int32)
        state = trie.run(text, k)
        name = {tuple(p): i * 7 for i, p in enumerate(some.tolist())}
        want = [name.get(tuple(text[i : i + k].tolist()), -1) for i in range(len(text) - k + 1)]
        assert np.where(state > 0, trie.phrase[state], -1).tolist() == want


def test_query_against_sql(spark, sf):
    import duckdb

    from lookalike.llm.collocations import SQL, op13_collocations

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got = sorted(map(tuple, op13_collocations(spark, sf).collect()))
    assert got == sorted(con.execute(SQL).fetchall()) and len(got) > 20
