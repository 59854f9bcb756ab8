"""Operator 6: SimHash near-dedup with multi-index hashing.

A fingerprint is cut into two segments of 32 bits.  Each fingerprint probes the table with the
Hamming ball of radius one within each segment, the other segment as it is.  Fingerprints two
bits apart meet at the value between them, whether their bits differ in one segment or in both,
and a table entry holds 65 fingerprints at most, however many documents are alike.  What is
fetched is verified by complete distance against the entry's smallest fingerprint; the stars
that remain have the same components as all links, without any pair within a group.

Null and empty texts have fingerprint zero; repeated rows are linked; null ids get the
component's smallest id; an empty table gives no rows; other columns are not looked at.

The pipeline's stage has another contract, a similarity of texts: fingerprints that meet in a table of
one segment, verified on whole texts, bands of least hashes for what lies beyond their reach, and prefixes
of whole sets for every pair that both have left: see similar_texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from lookalike.llm.common import components, joined_to_facts, keyed, table, written

SEED = 42
RADIUS = 2
#: Of the pipeline's stage: its least Jaccard similarity; bands of least hashes, hashes in a band.
SIMILARITY, BANDS, ROWS = 0.8, 24, 4
#: Classes of shingles whose parities bound the difference of two sets.
PARITY = 1024
#: One text in SHARE tells frequent shingles, which COMMON texts there have at least; so many are known at
#: most.  They only steer the order in which prefixes take shingles, and results do not depend on it.
SHARE, COMMON, KNOWN = 16, 3, 1 << 18
#: Set bits of each byte value.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: bytes, words: int) -> list[int]:
    said = text.lower().split()
    if len(said) <= words:
        return [xxh64_intdigest(b" ".join(said), SEED)] if said else []
    joined = b" ".join(said)
    ends = list(accumulate((len(w) + 1 for w in said)))
    starts = [0, *ends[: len(said) - words]]
    return [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)]


def majority(hashes: list[int], sizes: list[int]) -> np.ndarray:
    """Fingerprints of texts that have so many of the hashes each."""
    n = len(sizes)
    count = np.asarray(sizes, np.int64)
    lanes = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    owner = np.repeat(np.arange(n) * 256, count)
    out = np.zeros(n, np.uint64)
    for lane in range(8):
        seen = np.bincount(owner + lanes[:, lane], minlength=n * 256).reshape(n, 256) @ _BITS
        bits = 2 * seen > count[:, None]
        out |= (bits @ (1 << np.arange(8))).astype(np.uint64) << np.uint64(8 * lane)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, hashes, sizes = [np.zeros(0, np.int64)], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                h = shingle_hashes(text or b"", words)
                hashes += h
                sizes.append(len(h))
                if len(hashes) > 100_000 or len(sizes) > 4000:
                    fps.append(majority(hashes, sizes))
                    hashes, sizes = [], []
            if sizes:
                fps.append(majority(hashes, sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fps))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): stars over distinct fingerprints ``fp`` with the components of all links."""
    flips = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)], F.lit(0).cast("long"))
    probes = fps.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("entry"))
    found = probes.withColumn("a", F.min("fp").over(Window.partitionBy("entry"))).select("a", F.col("fp").alias("b")).where("a <> b")
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, component_size."""
    marks = written(fingerprints(docs, words, id_col, text_col))
    each = marks.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    each = written(each)
    roots = components(links(each.select("fp")), "a", "b")
    joined = each.join(roots, each.fp == roots.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    whole = joined.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("component_size"))
    per_fp = joined.select("fp", "root", "n").join(whole, "root").drop("root")
    return joined_to_facts(marks, per_fp, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def _sketches(words: int):
    salt, odd = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32)
    odd |= np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, same, keys, fps, hashes, counts = [], [], [], [np.zeros(0, np.int64)], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                s = shingle_set(text, words)
                sizes.append(len(s))
                same.append(xxh3_128_digest(s.tobytes()))
                hashes.append(s)
                counts.append(len(s))
                if sum(counts) > 100_000 or len(counts) > 4000:
                    fps.append(majority(np.concatenate(hashes), counts))
                    hashes, counts = [], []
                h = (s >> np.uint64(32)).astype(np.uint32)
                least = [((h[i : i + 4096] ^ salt) * odd).min(axis=1) for i in range(0, len(h), 4096)]
                low = np.min(least, axis=0).reshape(BANDS, ROWS) if least else ()
                keys.append([xxh64_intdigest(x.tobytes(), b) - (1 << 63) for b, x in enumerate(low)])
            if counts:
                fps.append(majority(np.concatenate(hashes), counts))
            arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.concatenate(fps))]
            yield pa.RecordBatch.from_arrays(arrays, ["_uid", "_null", "_n", "_set", "_keys", "_fp"])

    return run


def segment_stars(each: DataFrame) -> DataFrame:
    """(a, b): stars of nodes whose fingerprints ``_fp`` meet in the table of one segment.

    A table's key is a segment of 32 bits; each fingerprint enters the Hamming ball of radius one, so
    segments two bits apart meet, whatever the other segment is: all fingerprints up to five bits apart
    do.  An entry gives a star around its smallest node, so no pair within an entry is made."""
    flips = F.array(*[F.lit(1 << i).cast("long") for i in range(32)], F.lit(0).cast("long"))
    parts = [F.col("_fp").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned("_fp", 32).bitwiseOR(F.lit(1 << 32))]
    ball = lambda part: F.transform(flips, lambda f: part.bitwiseXOR(f))
    probes = each.select("node", F.explode(F.concat(*[ball(p) for p in parts])).alias("entry"))
    least = probes.groupBy("entry").agg(F.min("node").alias("a"), F.count("*").alias("m")).where("m > 1").select("entry", "a")
    return probes.join(least, "entry").select("a", F.col("node").alias("b")).where("a <> b").distinct()


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, words).tobytes() for text in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "_s"])

    return run


def _parities(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                odd = np.bincount((shingle_set(text, words) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64()))], ["node", "_bits"])

    return run


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Jaccard similarity of the two sets of each row."""
    for batch in batches:
        out = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "sim"])


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, words) for text in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["token"])

    return run


def frequent_shingles(base: DataFrame, words: int) -> np.ndarray:
    """Hashes of frequent shingles, the rarest first, by a share of the texts."""
    some = base.where(F.pmod(F.xxhash64("_uid"), F.lit(SHARE)) == 0).select("_text")
    counts = written(some.mapInArrow(_shingles(words), "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON))
    least, total = COMMON, 0
    for n, tokens in sorted(map(tuple, counts.groupBy("n").agg(F.count("*")).collect()), reverse=True):
        total += tokens
        if total > KNOWN:
            least = n + 1
            break
    known = counts.where(F.col("n") >= least).toArrow().to_pydict()
    token = np.array(known["token"], np.int64).view(np.uint64)
    return token[np.lexsort((token, known["n"]))]


def needed(share: float, n):
    """The least whole number that is no less than that share of n."""
    return np.ceil(share * n - 1e-9).astype(np.int64)


def _prefixes(words: int, similarity: float, frequent: np.ndarray):
    """Of each set its first shingles, in one order for all sets: rare ones by hash, then frequent ones.
    So many are taken that two sets of that similarity share one of them."""
    by_hash = np.argsort(frequent)
    known = frequent[by_hash]

    def first(s: np.ndarray) -> np.ndarray:
        n = len(s) - int(needed(similarity, len(s))) + 1 if len(s) else 0
        if not len(known):
            return s[:n]
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        hit = known[at] == s
        return np.concatenate([s[~hit][:n], frequent[np.sort(by_hash[at[hit]])]])[:n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, roots = (batch.column(i).to_numpy() for i in (0, 1))
            tokens, sizes, start = [], [], 0
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                s = shingle_set(text, words)
                tokens.append(first(s))
                sizes.append(len(s))
                if sum(map(len, tokens)) > 200_000 or i + 1 == len(nodes):
                    took = np.array([len(x) for x in tokens], np.int64)
                    place = np.concatenate([np.arange(x) for x in took])
                    cols = [np.concatenate(tokens).view(np.int64), *(np.repeat(x, took) for x in (nodes[start : i + 1], roots[start : i + 1], np.array(sizes, np.int64))), place]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["token", "node", "root", "n", "place"])
                    tokens, sizes, start = [], [], i + 1

    return run


def prefix_pairs(nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, na, b, nb): pairs of nodes of unlike ``root`` whose sets may have that similarity, none left out.

    Sets of that similarity share a shingle of their prefixes, and the first that they share stands so
    early in both that what follows can still make up the shingles they must share; of the smaller set an
    even shorter prefix does.  A shingle all of whose nodes have one root gives no pair; else only nodes
    outside its largest root are paired with the others."""
    taken = nodes.select("_uid", "root", "_text").mapInArrow(_prefixes(words, similarity, frequent_shingles(nodes, words)), "token long, node long, root long, n long, place long")
    per = Window.partitionBy("token")
    mixed = taken.withColumns({"lo": F.min("root").over(per), "hi": F.max("root").over(per)}).where("lo <> hi").drop("lo", "hi")
    mixed = written(mixed)
    head = mixed.groupBy("token", "root").count().groupBy("token").agg(F.max(F.struct("count", "root")).alias("most"))
    mixed = mixed.join(head, "token").withColumn("out", F.col("root") != F.col("most.root")).drop("most")
    both = 2 * similarity / (1 + similarity)
    early = mixed.where(F.col("place") <= F.col("n") - F.ceil(both * F.col("n") - 1e-9))
    x = early.select("token", *[F.col(c).alias(f"x_{c}") for c in ("node", "root", "n", "place", "out")])
    y = mixed.select("token", *[F.col(c).alias(f"y_{c}") for c in ("node", "root", "n", "place", "out")])
    met = x.where("x_out").join(y, "token").unionByName(x.where("not x_out").join(y.where("y_out"), "token"))
    shared = F.ceil(similarity / (1 + similarity) * (F.col("x_n") + F.col("y_n")) - 1e-9)
    once = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_node") < F.col("y_node")))
    met = met.where((F.col("x_root") != F.col("y_root")) & once & (F.col("x_n") >= similarity * F.col("y_n") - 1e-9))
    met = met.where(F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place")) >= shared)
    return met.select(F.col("x_node").alias("a"), F.col("x_n").alias("na"), F.col("y_node").alias("b"), F.col("y_n").alias("nb")).distinct()


def similar_texts(base: DataFrame, words: int, similarity: float) -> DataFrame:
    """One row per component of texts whose shingle sets have that Jaccard similarity at least:
    kept, the _uid of the smallest id (a null one only where there is no other).

    base is common.keyed's.  Texts of equal sets count as one.  Most links are found by fingerprints that
    meet in a segment's table, and by bands of least hashes for texts of 0.8, which stand 8 to 11 bits
    apart: in either each is verified against the smallest of its entry, on whole sets.  Neither way
    promises all links, so prefixes of the sets then give every pair that may be left between two
    components, exactly.  The parities of shingles in PARITY classes part most of these (each that
    differs is a shingle that only one has); the others are verified on whole sets as well."""
    marks = base.select("_uid", F.col("_id").isNull().alias("_null"), "_text").mapInArrow(_sketches(words), "_uid long, _null boolean, _n long, _set binary, _keys array<long>, _fp long")
    first = F.min(F.when(~F.col("_null"), F.col("_uid")))
    each = marks.groupBy("_set", "_n", "_keys", "_fp").agg(F.coalesce(first, F.min("_uid")).alias("node"), first.isNull().alias("_null"))
    each = written(each.select("node", "_null", "_keys", "_fp"))
    members = each.select("node", F.explode("_keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("m")).where("m > 1").drop("m")
    banded = members.join(shared, "key").select(F.col("low").alias("a"), F.col("node").alias("b")).where("a <> b")
    stars = written(segment_stars(each).unionByName(banded).distinct())
    close = F.col("sim") >= similarity - 1e-12

    def texts_of(pairs: DataFrame) -> DataFrame:
        met = pairs.select(F.col("a").alias("_uid")).unionByName(pairs.select(F.col("b").alias("_uid"))).distinct()
        return base.join(met, "_uid", "left_semi").select("_uid", "_text")

    def both(pairs: DataFrame, facts: DataFrame, name: str) -> DataFrame:
        return pairs.join(facts.select(F.col("node").alias("b"), F.col(name).alias("_y")), "b").join(facts.select(F.col("node").alias("a"), F.col(name).alias("_x")), "a")

    def verified(pairs: DataFrame) -> DataFrame:
        sets = written(texts_of(pairs).mapInArrow(_sets(words), "node long, _s binary"))
        return written(both(pairs, sets, "_s").select("a", "b", "_x", "_y").mapInArrow(_apart, "a long, b long, sim double"))

    stars = verified(stars)
    roots = components(stars.where(close), "a", "b")
    nodes = each.select(F.col("node").alias("_uid")).join(roots.withColumnRenamed("node", "_uid"), "_uid", "left")
    nodes = base.join(nodes, "_uid").select("_uid", F.coalesce("root", "_uid").alias("root"), "_text")
    pairs = written(prefix_pairs(nodes, words, similarity))
    bits = written(texts_of(pairs).mapInArrow(_parities(words), "node long, _bits array<long>"))
    least = sum((F.bit_count(F.col("_x")[i].bitwiseXOR(F.col("_y")[i])) for i in range(PARITY // 64)), F.lit(0))
    fits = least <= (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-9
    rest = verified(written(both(pairs, bits, "_bits").where(fits).select("a", "b")))
    roots = components(stars.unionByName(rest).where(close), "a", "b")
    labelled = each.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return labelled.groupBy("root").agg(F.coalesce(F.min(F.when(~F.col("_null"), F.col("node"))), F.min("node")).alias("kept")).select("kept")


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word sets, a Jaccard similarity of 0.8 or more."""
    base = keyed(docs, carry=docs.columns)
    keep = similar_texts(base, 5, SIMILARITY).select(F.col("kept").alias("_uid"))
    return base.join(keep, "_uid", "left_semi").select("_rest.*")
