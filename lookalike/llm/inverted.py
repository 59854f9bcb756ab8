"""Operator 4: benchmark decontamination with a distributed positional inverted index.

``build`` stores the postings of all training words: texts are cut into blocks of about
BLOCK_BYTES, and each term of a block has the ascending list of its positions, coded as gaps;
documents of a block stand apart by more than a window.  The index is dealt by buckets of terms
and serves any test set.

A search needs no vocabulary on the driver.  Test items are joined to the counts of their words;
the rarest word of each window, joined to the index, says which blocks an item must visit.  A
block's postings and the items that visit it stream through one task, sorted by block: each
window's lists are shifted by the words' places and intersected, rarest first, until nothing or
all words are left.  With ``slop`` a word may stand so many words off its place, which gives
proximity matches.  What a task holds is one block and one item, whatever the size of the test set.

Nulls have no words; items without words match nothing; repeated items count once; repeated rows
and null ids are documents of their own; one very long text is a block of its own; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.llm import pieces as P
from lookalike.llm.common import keyed, table, written

#: Bytes of training texts in a block; buckets of terms; stretches of blocks that a bucket's rows are dealt to.
BLOCK_BYTES, BUCKETS, STRETCHES = 4 << 20, 64, 16
#: Intersections of a block that are remembered.
MEMO = 50_000
#: Separators, after lower-casing: all of ASCII but digits and letters.
_SEPARATE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

_NAMES = ["block", "bucket", "terms", "n", "lists", "docs", "sizes"]
_TYPES = [pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.binary()]


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_SEPARATE).split()


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _coded(step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): seven bits a byte, the lowest first; the top bit says that more follow."""
    size = 1 + sum((step >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(ends[-1], np.uint8)
    for k in range(5):
        live = np.flatnonzero(size > k)
        if not len(live):
            break
        out[ends[live] + k] = (step[live] >> 7 * k & 127) | np.where(size[live] > k + 1, 128, 0)
    return out, ends


def _opened(data: bytes) -> np.ndarray:
    """Positions of a coded list of gaps."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    first = np.flatnonzero(np.r_[True, x[:-1] < 128])
    place = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return np.cumsum(np.add.reduceat((x & 127) << 7 * place, first))


def build(base: DataFrame, gap: int) -> DataFrame:
    """The index of ``keyed`` texts: a row for each block and bucket of terms (by hash) with the
    terms, their numbers of postings and their lists.  A row of bucket -1 names the block's
    documents and their numbers of words.  ``block`` is the block's first _uid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = P.string_buffers(batch.column(1))
            uids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data = raw.tobytes()
            for i, j in P.slices(off, BLOCK_BYTES):
                codes, coded = _Codes(), []
                for k in range(i, j):
                    said = words_of(data[off[k] : off[k + 1]])
                    coded.append(np.fromiter(map(codes.__getitem__, said), np.int32, len(said)))
                sizes = np.array([len(c) for c in coded], np.int64)
                bucket_of = np.fromiter((crc32(t) % BUCKETS for t in codes), np.int64, len(codes))
                by_bucket = np.argsort(bucket_of, kind="stable")
                place = np.empty(len(codes), np.int32)
                place[by_bucket] = np.arange(len(codes))
                term = place[np.concatenate(coded)]
                pos = np.arange(len(term)) + np.repeat(np.arange(j - i) * gap, sizes)
                order = np.argsort(term.astype(np.uint16) if len(codes) < 65536 else term, kind="stable")
                pos, n = pos[order], np.bincount(term, minlength=len(codes))
                edge = np.cumsum(n) - n
                step = np.diff(pos, prepend=0)
                step[edge] = pos[edge]
                lists, ends = _coded(step)
                offsets = ends[np.append(edge, len(step))].astype(np.int32)
                buckets, start = np.unique(bucket_of[by_bucket], return_index=True)
                cut = pa.array(np.append(start, len(codes)), pa.int32())
                columns = (
                    pa.array(list(codes), pa.binary()).take(pa.array(by_bucket)),
                    pa.array(n, pa.int32()),
                    pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(lists.tobytes())]),
                )
                rows = len(buckets)
                about = [pa.array(np.full(rows, uids[i])), pa.array(buckets, pa.int32()), *(pa.ListArray.from_arrays(cut, c) for c in columns), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(about, _NAMES)
                named = [pa.array([x], t) for x, t in zip((uids[i], -1, None, None, None, uids[i:j].tobytes(), sizes.tobytes()), _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays(named, _NAMES)

    return base.select("_uid", "_text").mapInArrow(run, "block long, bucket int, terms array<binary>, n array<int>, lists array<binary>, docs binary, sizes binary")


def postings(base: DataFrame, window: int = 10, slop: int = 0) -> DataFrame:
    """The stored index, dealt by terms (and by stretches of blocks, as a term may be in all of them)."""
    rows = build(base, window + 2 * slop)
    return written(rows.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(STRETCHES))))


def _said(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(row, item, words): a row number of its own per item row with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item"), pa.array(words, pa.list_(pa.binary()))], ["row", "item", "words"])

    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "item", "text").mapInArrow(run, "row long, item string, words array<binary>").where("size(words) > 0"))


def _windows(counts: list[int], window: int) -> list[tuple[int, list[int]]]:
    """(start, places by rising count) of the windows whose words all occur."""
    size = min(window, len(counts))
    spans = range(len(counts) - size + 1)
    return [(s, sorted(range(size), key=lambda i: (counts[s + i], i))) for s in spans if all(counts[s : s + size])]


def _rarest(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms = [], []
            for row, words, counts in zip(batch.column("row").to_pylist(), batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                for t in {words[s + places[0]] for s, places in _windows(counts, window)}:
                    rows.append(row)
                    terms.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(terms, pa.binary())], ["row", "term"])

    return run


def _meeting(start: np.ndarray, pos: np.ndarray, shift: int, slop: int) -> np.ndarray:
    """The starts that have one of the positions at start + shift, slop aside."""
    k = np.searchsorted(pos, start + (shift - slop))
    return start[(k < len(pos)) & (pos[np.minimum(k, len(pos) - 1)] <= start + (shift + slop))]


def _search(window: int, gap: int, slop: int):
    """Rows come sorted by (block, kind): its documents (0), its postings (1), items (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lists, opened, memo = None, {}, {}, {}
        uids = begin = np.zeros(0, np.int64)
        for batch in batches:
            found: tuple[list, list, list, list] = ([], [], [], [])
            names = ("block", "kind", "term", "data", "sizes", "row", "words", "counts")
            for blk, kind, term, data, sizes, row, words, counts in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if blk != block:
                    block, lists, opened, memo = blk, {}, {}, {}
                if kind == 0:
                    uids, said = np.frombuffer(data, np.int64), np.frombuffer(sizes, np.int64)
                    begin = np.cumsum(said + gap) - said - gap
                    continue
                if kind == 1:
                    lists[term] = data
                    continue

                def positions(t, lists=lists, opened=opened):
                    if t not in opened:
                        opened[t] = _opened(lists[t])
                    return opened[t]

                for s, places in _windows(counts, window):
                    phrase = words[s : s + len(places)]
                    if any(t not in lists for t in phrase):
                        continue
                    a, *others = places
                    start = positions(phrase[a])
                    if others:  # windows that overlap share their two rarest words
                        key = (phrase[a], phrase[others[0]], others[0] - a)
                        if key not in memo:
                            if len(memo) >= MEMO:
                                memo.clear()
                            memo[key] = _meeting(start, positions(phrase[others[0]]), others[0] - a, slop)
                        start = memo[key]
                    for i in others[1:]:
                        if not len(start):
                            break
                        start = _meeting(start, positions(phrase[i]), i - a, slop)
                    if len(start):
                        d = np.searchsorted(begin, start, side="right") - 1
                        found[0].extend(uids[d].tolist())
                        found[1].extend(np.maximum(start - a - begin[d], 0).tolist())
                        found[2].extend([len(places)] * len(start))
                        found[3].extend([row] * len(start))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["_uid", "start", "size", "row"])

    return run


def matches(index: DataFrame, items: DataFrame, window: int = 10, slop: int = 0, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(_uid, start, size, item): every place in a document where a window of an item stands."""
    said = _said(items, item_col, item_text)
    wanted = said.select(F.explode("words").alias("term")).distinct()
    terms = index.where("bucket >= 0").select("block", F.explode(F.arrays_zip("terms", "n", "lists")).alias("p")).select("block", F.col("p.terms").alias("term"), F.col("p.n").alias("n"), F.col("p.lists").alias("data"))
    held = terms.join(wanted, "term", "left_semi")
    counts = held.groupBy("term").agg(F.sum("n").alias("count"))
    places = said.select("row", F.posexplode("words").alias("place", "term")).join(counts, "term", "left")
    per_item = places.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("count", F.lit(0)).alias("count")))).alias("c"))
    counted = written(said.join(per_item.select("row", F.col("c.count").alias("counts")), "row").select("row", "words", "counts"))
    visits = counted.mapInArrow(_rarest(window), "row long, term binary").join(terms.select("term", "block"), "term").select("row", "block").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    about = [F.lit(None).cast("long").alias("row"), none("array<binary>").alias("words"), none("array<bigint>").alias("counts")]
    lists = [index.where("bucket < 0").select("block", F.lit(0).alias("kind"), none("binary").alias("term"), F.col("docs").alias("data"), "sizes", *about), held.select("block", F.lit(1).alias("kind"), "term", "data", none("binary").alias("sizes"), *about)]
    guests = visits.join(counted, "row").select("block", F.lit(2).alias("kind"), *[none("binary").alias(c) for c in ("term", "data", "sizes")], "row", "words", "counts")
    rows = lists[0].unionByName(lists[1]).unionByName(guests).repartition("block").sortWithinPartitions("block", "kind")
    found = rows.mapInArrow(_search(window, window + 2 * slop, slop), "_uid long, start long, size long, row long")
    return written(found.join(said.select("row", "item"), "row").select("_uid", "start", "size", "item"))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uids, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(uids, np.int64)), pa.array(np.frombuffer(sizes, np.int64))], ["_uid", "n_words"])


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words lie in a span."""
    for batch in batches:
        hits = []
        for spans in batch.column("spans").to_pylist():
            end, total = 0, 0
            for s in sorted((x["start"], x["start"] + x["size"]) for x in spans or ()):
                total += max(0, s[1] - max(end, s[0]))
                end = max(end, s[1])
            hits.append(total)
        yield pa.RecordBatch.from_arrays([batch.column("_uid"), batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), batch.column("spans"), batch.column("items")], ["_uid", "doc_id", "n_words", "n_hit", "spans", "items"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, spans (start, size of each match), items."""
    base = keyed(docs, id_col, text_col)
    index = postings(base, window, slop)
    found = matches(index, items, window, slop, item_col, item_text)
    spans = found.select("_uid", "start", "size").distinct().groupBy("_uid").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    named = found.select("_uid", "item").distinct().groupBy("_uid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    sizes = index.where("bucket < 0").select("docs", "sizes").mapInArrow(_sizes, "_uid long, n_words long")
    whole = base.select("_uid", F.col("_id").cast("long").alias("doc_id")).join(sizes, "_uid").join(spans, "_uid", "left").join(named, "_uid", "left")
    schema = "_uid long, doc_id long, n_words long, n_hit long, spans array<struct<start: long, size: long>>, items array<string>"
    return whole.select("_uid", "doc_id", "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items")).mapInArrow(_covered, schema).drop("_uid")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items, named = F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", F.least("n_words", "n_hit").alias("n_hit"), n_items, named, (F.col("n_hit") > 0).alias("contaminated"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; each row is judged by itself."""
    base = keyed(docs, carry=docs.columns)
    dirty = matches(postings(base), table(spark, sf_dir, "benchmark")).select("_uid").distinct()
    return base.join(dirty, "_uid", "left_anti").select("_rest.*")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS phrase
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
p AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS phrase
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
m AS (SELECT r, k, n, item FROM p JOIN g USING (phrase, n)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS x FROM (SELECT DISTINCT r, k, n FROM m)) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)"""
