"""Operator 12: ranked lexical search by the Best Position Algorithm over blocks of documents.

``build`` stores an inverted index of all words of all texts: a block is some BLOCK_BYTES of text,
its row has the block's terms in order and for each its documents and occurrences.  The numbers of
documents and terms, and the documents of each query term, are summed over all blocks, so that a
score is the same in whatever block a document lies.

A block searches a query by itself.  Each term of the query has an impact list: the block's
documents by falling impact.  The lists are read in parallel, more deeply each round; a document
that is met is scored in full by direct accesses to the other lists, which mark its place there as
seen too.  A list's best position is the end of the run of seen places from its top, which lies at
or below the place last read; nothing unseen can have a higher impact there.  The impacts at the best
positions therefore add up to the most that an unseen document can score, and the search stops once
this is strictly below the k-th score, so that ties are always settled by the id.  The lists are
read to their ends if need be; no document is left out.

One block of SEED answers first: the k-th scores of the best of these are a bound that all other
blocks start from, so that they stop sooner and send on only what can still be among the k best.
Queries go to the blocks in packets of bounded size, by broadcast if one packet holds them all.

Null texts and texts without a term are not counted and never found; queries without terms find
nothing; repeated query rows are one query per row; repeated rows and null ids are documents of
their own; equal scores go by the id, null ids first; one very long text is a block of its own; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lookalike.llm import pieces as P
from lookalike.llm.common import BROADCAST_BYTES, keyed, table, written
from lookalike.llm.inverted import _Codes

#: Bytes of text in a block; bytes of queries in a packet; places that the first round reads of each list; one block of so many answers first.
BLOCK_BYTES, PACKET_BYTES, FIRST, SEED = 8 << 20, BROADCAST_BYTES, 64, 16
#: Separators: all of ASCII but digits and letters, which are lower-cased.
_SEPARATE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_SEPARATE).split()


def build(base: DataFrame) -> DataFrame:
    """The index of ``keyed`` texts.  terms are in byte order; term t has the next n[t] of places and tf.
    places are numbers of the block's documents, docs and sizes their _uid and numbers of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = P.string_buffers(batch.column(1))
            uids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in P.slices(off, BLOCK_BYTES):
                codes, post, size = _Codes(), [], np.zeros(j - i, np.int64)
                for k in range(i, j):
                    said = terms_of(raw[off[k] : off[k + 1]].tobytes())
                    size[k - i] = len(said)
                    post.append(np.unique(np.fromiter(map(codes.__getitem__, said), np.int32, len(said)), return_counts=True))
                names = sorted(codes)
                place = np.empty(len(names), np.int32)
                place[np.fromiter(map(codes.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
                term = place[np.concatenate([t for t, _ in post])]
                doc = np.repeat(np.arange(j - i, dtype=np.int32), [len(t) for t, _ in post])
                order = np.argsort(term, kind="stable")
                n = np.bincount(term, minlength=len(names)).astype(np.int32)
                row = (uids[i], names, n, doc[order].tobytes(), np.concatenate([c for _, c in post])[order].astype(np.int32).tobytes(), uids[i:j].tobytes(), size.tobytes(), int((size > 0).sum()), int(size.sum()))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)], _NAMES)

    return base.select("_uid", "_text").mapInArrow(run, "block long, terms array<binary>, n array<int>, places binary, tf binary, docs binary, sizes binary, n_docs long, n_terms long")


_NAMES = ["block", "terms", "n", "places", "tf", "docs", "sizes", "n_docs", "n_terms"]
_TYPES = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), *[pa.binary()] * 4, pa.int64(), pa.int64()]


def query_terms(queries: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(row, term): the distinct terms of each query row, which has a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [sorted(set(terms_of(t or b""))) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item"), pa.array(said, pa.list_(pa.binary()))], ["row", "item", "terms"])

    item = queries.schema[item_col].dataType.simpleString()
    rows = queries.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, f"row long, item {item}, terms array<binary>").where("size(terms) > 0"))


class Lists:
    """Impact lists of a block, made as queries ask for them.  A list's documents rise by number;
    ``impact`` goes with them, ``rank`` is their place by falling impact, ``order`` its inverse."""

    def __init__(self, terms: list[bytes], n: np.ndarray, places: np.ndarray, tf: np.ndarray, m: np.ndarray):
        self.at = {t: i for i, t in enumerate(terms)}
        self.end = np.cumsum(n)
        self.n, self.places, self.tf, self.m = n, places, tf, m
        self.made: dict[bytes, tuple] = {}

    def __getitem__(self, term: bytes) -> tuple:
        if term not in self.made:
            i = self.at[term]
            part = slice(self.end[i] - self.n[i], self.end[i])
            docs, tf = self.places[part], self.tf[part].astype(np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * self.m[docs])
            order = np.argsort(-impact, kind="stable").astype(np.int32)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            self.made[term] = docs, impact, rank, order
        return self.made[term]


def best_positions(lists: list[tuple], weights: list[int], k: int, bound: int, n_docs: int, uids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) that are among the k best by (score, id), have a score above 0 and at least ``bound``."""
    seen = [np.zeros(len(docs) + 1, bool) for docs, *_ in lists]  # the last place is never seen: it ends every run
    best = [0] * len(lists)  # seen places from the top
    known = np.zeros(n_docs, bool)
    top, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    read, upto = 0, FIRST
    while True:
        met = [docs[order[read:upto]] for docs, _, _, order in lists]
        new = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int32)
        new = new[~known[new]]
        known[new] = True
        total = np.zeros(len(new), np.int64)
        for (docs, impact, rank, _), weight, marks in zip(lists, weights, seen, strict=True):  # direct accesses
            i = np.searchsorted(docs, new)
            i[i == len(docs)] = 0
            here = docs[i] == new
            total[here] += weight * impact[i[here]]
            marks[rank[i[here]]] = True
        some = total >= max(bound, 1)
        top, scores = np.append(top, new[some]), np.append(scores, total[some])
        if len(top) > k:
            first = np.lexsort((uids[top], -scores))[:k]
            top, scores = top[first], scores[first]
        most, left = 0, False
        for t, (docs, impact, _, order) in enumerate(lists):
            best[t] += int(np.argmin(seen[t][best[t] :]))
            if best[t] < len(docs):  # at its end a list has nothing unseen
                most += weights[t] * int(impact[order[max(best[t] - 1, 0)]])
                left = True
        least = max(bound, int(scores.min()) if len(top) == k else 0, 1)
        if not left or most < least:
            return top, scores
        read, upto = upto, 2 * upto


def search(blocks: DataFrame, packets: DataFrame, stats: tuple[int, int], k: int, small: bool) -> DataFrame:
    """(row, uid, score): the k best of each block for each query, without those below the query's bound."""
    n_docs, n_terms = stats[0], max(stats[1], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lists, uids = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                b, terms, n, places, tf, docs, sizes, queries = (c[i] for c in batch.columns)
                if b.as_py() != block:
                    uids, size = np.frombuffer(docs.as_py(), np.int64), np.frombuffer(sizes.as_py(), np.int64)
                    fits = 90 * int(size.max(initial=0)) * n_docs < 1 << 63
                    share = 90 * size * n_docs // n_terms if fits else np.array([90 * int(x) * n_docs // n_terms for x in size], np.int64)
                    lists = Lists(terms.as_py(), n.values.to_numpy(), np.frombuffer(places.as_py(), np.int32), np.frombuffer(tf.as_py(), np.int32), 10 + share)
                    block = b.as_py()
                rows, found, scores = [], [], []
                for q in queries.as_py():
                    said = [(t["term"], t["w"]) for t in q["terms"] if t["term"] in lists.at and t["w"] > 0]
                    top, score = best_positions([lists[t] for t, _ in said], [w for _, w in said], k, q["bound"], len(uids), uids)
                    rows.append(np.full(len(top), q["row"]))
                    found.append(uids[top])
                    scores.append(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (rows, found, scores)], ["row", "uid", "score"])

    packets = F.broadcast(packets) if small else packets
    pairs = blocks.select("block", "terms", "n", "places", "tf", "docs", "sizes").crossJoin(packets)  # a stated query set against all blocks
    return pairs.mapInArrow(run, "row long, uid long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("row").orderBy(F.desc("score"), "uid")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): the k best documents of each query with a score above 0."""
    base = keyed(docs, id_col, text_col)
    blocks = written(build(base))
    asked = query_terms(queries, item_col, query_col)
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    wanted = asked.select("row", F.explode("terms").alias("term"))
    held = blocks.select(F.explode(F.arrays_zip("terms", "n")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.n").alias("n"))
    df = held.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = written(wanted.join(df, "term").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("term", weight.alias("w")))).alias("terms")))
    size = weighed.agg(F.coalesce(F.sum(F.expr("aggregate(terms, 64L, (s, t) -> s + 24 + length(t.term))")), F.lit(0))).first()[0]
    packets = max(1, -(-size // PACKET_BYTES))

    def packed(bounds: DataFrame | None) -> DataFrame:
        told = weighed.join(bounds, "row", "left") if bounds is not None else weighed.withColumn("bound", F.lit(0).cast("long"))
        one = F.struct("row", F.coalesce("bound", F.lit(0)).alias("bound"), "terms")
        return told.groupBy(F.expr(f"pmod(xxhash64(row), {packets})").alias("packet")).agg(F.collect_list(one).alias("queries")).select("queries")

    first = F.pmod(F.xxhash64("block"), F.lit(SEED)) == 0
    seeds = written(best(search(blocks.where(first), packed(None), (n_docs, n_terms), k, packets == 1), k))
    bounds = seeds.where(F.col("rank") == k).select("row", F.col("score").alias("bound"))
    rest = search(blocks.where(~first), packed(bounds), (n_docs, n_terms), k, packets == 1)
    top = written(best(seeds.select("row", "uid", "score").unionByName(rest), k))
    ids = base.select(F.col("_uid").alias("uid"), F.col("_id").alias("_doc")).join(top, "uid")  # k rows a query
    names = asked.select("row", F.col("item").alias("_item"))
    return ids.join(names, "row").select(F.col("_item").alias(item_col), "rank", F.col("_doc").alias(id_col), "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
z AS (SELECT count(*)::HUGEINT AS n, sum(len(w))::HUGEINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
q AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS w FROM benchmark),
t AS (SELECT i, unnest(w) AS term FROM q),
f AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM t) GROUP BY term),
v AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, z),
s AS (SELECT i, p.r, sum(v.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * n) // l)::BIGINT)))::BIGINT AS score
      FROM t JOIN v USING (term) JOIN p USING (term) JOIN d ON p.r = d.r, z GROUP BY i, p.r),
b AS (SELECT i, r, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM b JOIN q USING (i) JOIN d USING (r) WHERE rank <= 10"""
