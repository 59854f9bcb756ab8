"""Odd rows of the operators: repeated and null ids, NaN, very long texts, ties, clashing names."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), *(T.StructField(n, T.StringType()) for n in ("x", "_d", "_uid", "shard", "rest", "bin", "cluster", "fp", "score"))])


def docs(spark, rows):
    return spark.createDataFrame([(*r, *["odd"] * 9) for r in rows], DOCS)


def test_pages_of_one_id_and_layout(spark):
    """Repeated rows, ties in the wrapper, null html and url."""
    from lookalike.llm.html_extract import main_text

    page = lambda i: f"<nav><a href=/>Home</a></nav><article><p>Text&amp;{i}</p><p>a\t b</p></article><footer>f</footer>"
    rows = [(i, "http://h.example/a", page(i), "odd", "odd") for i in (1, 1, 2)] + [(None, None, page(9), "odd", "odd"), (3, "http://h.example/b", None, None, None), (4, ":::", "", None, None)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string"))
    assert Counter((r.page_id, r.text) for r in got.collect()) == Counter([(1, "Text&1\n\na b")] * 2 + [(2, "Text&2\n\na b"), (None, "Text&9\n\na b"), (3, ""), (4, "")])


def test_codes_of_null_and_repeated_ids(spark):
    from lookalike.llm.hamming_search import top_k

    nan = float("nan")
    rows = [(0, [1.0, 1.0, -1.0], "a"), (1, [1.0, nan, -1.0], "b"), (1, [1.0, 1.0, -1.0], "c"), (None, [1.0, 1.0, -1.0], "d"), (2, None, "e"), (3, [-1.0, -1.0, 1.0], "f"), (4, [1.0, 1.0, -1.0], "g")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, packet string")
    got = sorted(map(tuple, top_k(df, df.where("vec_id = 0"), 4).collect()))
    assert got == [(0, 1, 1, 0), (0, 2, 4, 0), (0, 3, 1, 1), (0, 4, 3, 3)]


def test_very_long_texts(spark):
    from lookalike.llm.simhash import near_duplicates
    from lookalike.llm.phrase_automata import remove_phrases
    from lookalike.llm.suffix_dedup import remove_repeats

    r = random.Random(8)
    long = " ".join(f"w{r.randrange(10**9)}" for _ in range(250_000))  # some 2.7 MB
    df = docs(spark, [(1, long, "s"), (2, long, "s"), (3, "one " * 300_000, None), (4, "tail " + long[-5000:], "s")])
    near = {x.doc_id: x for x in near_duplicates(df).collect()}
    assert near[1].component_id == near[2].component_id == 1 and near[3].component_id == 3
    cut = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in remove_repeats(df).collect()}
    same = 5000 + (long[-5001] == " ")
    assert cut == {1: (len(long), 0, 0), 2: (len(long), len(long), 1), 3: (1_200_000, 1_200_000 - 4, 1), 4: (5005, same, 1)}
    said = {x.doc_id: (x.n_words, x.n_removed) for x in remove_phrases(df).collect()}
    assert said[1] == said[2] == (250_000, 250_000) and said[3] == (300_000, 300_000)
    whole = len(long[-5000:].split()) - (" " not in long[-5001:-4999])
    assert said[4][1] == whole


def test_packing_of_odd_rows(spark):
    """Each row of a repeated id is a document; copies never share a bin; long texts fill bins alone."""
    from lookalike.llm.packing import pack

    df = docs(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d", None), (None, "e f", "s"), (None, None, None), (2, "w " * 100_003, "s"), (3, " ", "s")])
    got = pack(df, 10, 2).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter({(1, 3): 2, (1, 1): 1, (None, 2): 1, (None, 0): 1, (2, 10): 10_000, (2, 3): 1, (3, 0): 1})
    assert len({r.bin_id for r in got if r.n_words == 3 and r.doc_id == 1}) == 2
    full = [r.bin_id for r in got if r.n_words == 10]
    assert len(set(full)) == len(full) and {r.bin_id for r in got if not r.n_words} == {"-1"}


def test_names_that_clash(spark):
    """Other columns are not looked at, whatever they are called."""
    from lookalike.llm.inverted import contamination
    from lookalike.llm.quality import quality_scores
    from lookalike.llm.simhash import near_duplicates
    from lookalike.llm.toxicity import toxicity_scores

    rows = [(i, f"text number {i} " * (i % 4), "s") for i in range(40)]
    odd = docs(spark, rows)
    bare = odd.select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2, i % 2, "odd") for i in range(40)], "doc_id long, quality int, toxic int, x string")
    items = spark.createDataFrame([(1, "text number 3", "odd")], "item_id long, text string, term string")
    for run in (lambda d: quality_scores(d, labels), lambda d: toxicity_scores(d, labels).drop("evidence"), near_duplicates, lambda d: contamination(d, items).drop("spans")):
        assert sorted(map(str, run(odd).collect())) == sorted(map(str, run(bare).collect()))


def test_fingerprint_by_hand(spark):
    """XXH64 with seed 42 of three-word shingles; a bit is one if over half of the hashes have it."""
    import xxhash

    from lookalike.llm.simhash import fingerprints

    texts = ["A b\tC d e", "b", "  ", None, "x y z x y z", "ÉA b\x0bc"]

    def plain(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
        w = [x for x in w if x]
        said = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in said]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = {r.doc_id: r.fp % 2**64 for r in fingerprints(docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)} and np.uint64(got[0]) > 0
