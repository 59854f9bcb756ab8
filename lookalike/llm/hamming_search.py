"""Operator 2: exact top-k search of binary codes by incremental multi-index hashing.

A code holds the signs of a vector.  Codes are dealt to blocks; a block keeps one table per
segment of 16 bits.  A query probes all segments at radius 0, 1, 2, ...; every code that it
fetches is verified by its complete distance.  After radius r every code within
segments * (r + 1) - 1 bits is known, so a query is done once its k-th distance is no larger.
Blocks answer by themselves and their lists are merged.

Queries go to the blocks in packets of bounded size.  Null vectors and rows of null id are neither
indexed nor searched; NaN counts as not above zero; rows of one id are codes of their own; a query never finds itself, but finds its copies; ties go to the smaller id; shorter
vectors count as padded by zeros; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lookalike.llm.common import table, written

SEGMENT = 16
#: Tasks of a search at most.
TASKS = 10_000
#: Codes of a block, queries of a packet, keys that are probed at once.
BLOCK, PACKET, KEYS = 16_384, 256, 1 << 20


@cache
def ball(radius: int) -> np.ndarray:
    """Masks of SEGMENT bits with ``radius`` of them set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), radius)], np.int64)


class Tables:
    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        """codes: one row of 16-bit segments per id."""
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes = ids[order], codes[order]
        self.order, self.first = [], []
        for s in range(codes.shape[1]):
            by = np.argsort(self.codes[:, s], kind="stable")
            self.order.append(by)
            self.first.append(np.searchsorted(self.codes[by, s], np.arange((1 << SEGMENT) + 1)))

    def search(self, ids: np.ndarray, codes: np.ndarray, k: int):
        """(query place, found id, distance) of the k nearest of each query."""
        segments = codes.shape[1]
        live = np.arange(len(ids))
        q = np.zeros(0, np.int64)
        c, d = q.copy(), q.copy()
        for radius in range(SEGMENT + 1):
            found = [(q, c, d)]
            masks = ball(radius)
            width = max(1, KEYS // max(1, len(live)))
            for s in range(segments):
                for m in range(0, len(masks), width):
                    keys = codes[live, s].astype(np.int64)[:, None] ^ masks[None, m : m + width]
                    lo, hi = self.first[s][keys], self.first[s][keys + 1]
                    n = (hi - lo).ravel()
                    take = np.repeat(lo.ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    who = np.repeat(np.repeat(live, keys.shape[1]), n)
                    code = self.order[s][take]
                    apart = np.bitwise_count(codes[who] ^ self.codes[code]).astype(np.int64)
                    # A code is taken where its nearest segment (the first such) meets it.
                    new = (apart[:, :s] > radius).all(axis=1) & (apart[:, s + 1 :] >= radius).all(axis=1) & (self.ids[code] != ids[who])
                    found.append((who[new], code[new], apart[new].sum(axis=1)))
            q, c, d = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.lexsort((c, d, q))
            q, c, d = q[by], c[by], d[by]
            begin = np.searchsorted(q, np.arange(len(ids)))
            keep = np.arange(len(q)) - begin[q] < k
            q, c, d = q[keep], c[keep], d[keep]
            begin, count = np.searchsorted(q, live), np.bincount(q, minlength=len(ids))[live]
            known = segments * (radius + 1) - 1
            done = count >= k
            done[done] = d[begin[done] + k - 1] <= known
            live = live[~done]
            if not len(live):
                break
        return q, self.ids[c], d


def codes_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): signs, bit by bit, as bytes of whole segments of the longest vector."""
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    longest = source.agg(F.max(F.size("v"))).first()[0] or 1
    size = -(-longest // SEGMENT) * SEGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            off = np.asarray(lists.offsets, dtype=np.int64)
            flat = lists.values.slice(off[0], off[-1] - off[0]).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
            off = off - off[0]
            n = np.diff(off)
            bits = np.zeros((len(n), size), np.uint8)
            row = np.repeat(np.arange(len(n)), n)
            bits[row, np.arange(len(flat)) - np.repeat(off[:-1], n)] = flat > 0
            packed = np.packbits(bits, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], ["id", "code"])

    return source.mapInArrow(run, "id long, code binary")


def _packed(codes: DataFrame, parts: int, name: str) -> DataFrame:
    """One row per part: (part, ids, codes) as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, held = None, [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(held)], pa.binary())], [name, f"{name}_ids", f"{name}_codes"])

        for batch in batches:
            for p, i, c in zip(*(batch.column(x).to_pylist() for x in ("part", "id", "code")), strict=True):
                if p != part and part is not None:
                    yield out()
                    ids, held = [], []
                part = p
                ids.append(i)
                held.append(c)
        if part is not None:
            yield out()

    dealt = codes.withColumn("part", F.pmod(F.xxhash64("id", "code"), F.lit(parts)))
    return dealt.repartition("part").sortWithinPartitions("part", "id").mapInArrow(run, f"{name} long, {name}_ids binary, {name}_codes binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbor_id, distance) of the k nearest codes of each query row."""
    both = written(codes_of(vectors, id_col, vector_col))
    asked = both.join(queries.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi").distinct()
    blocks = max(1, -(-both.count() // BLOCK))
    packets = max(1, -(-asked.count() // PACKET))
    index = _packed(both, blocks, "block")
    packet = _packed(asked, packets, "packet").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = tables = None
        for batch in batches:
            for b, ids, codes, q_ids, q_codes in zip(*(batch.column(c).to_pylist() for c in ("block", "block_ids", "block_codes", "packet_ids", "packet_codes")), strict=True):
                if b != block:
                    ids = np.frombuffer(ids, np.int64)
                    block, tables = b, Tables(ids, np.frombuffer(codes, np.uint16).reshape(len(ids), -1))
                q_ids = np.frombuffer(q_ids, np.int64)
                q, found, apart = tables.search(q_ids, np.frombuffer(q_codes, np.uint16).reshape(len(q_ids), -1), k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(found), pa.array(apart)], ["query_id", "neighbor_id", "distance"])

    # A number of partitions of its own: small tables would else end in one task.
    pairs = index.join(packet, "block").repartition(min(blocks * packets, TASKS), "block", "packet").sortWithinPartitions("block")
    near = pairs.select("block", "block_ids", "block_codes", "packet_ids", "packet_codes").mapInArrow(run, "query_id long, neighbor_id long, distance long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return near.withColumn("rank", place.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
with c as (
  select vec_id, list_sum(list_transform(embedding, lambda x, i: case when x > 0 then (1::hugeint << (i - 1)::int) else 0::hugeint end))::hugeint as code from embeddings
), p as (
  select q.vec_id as query_id, b.vec_id as neighbor_id, bit_count(xor(q.code, b.code))::bigint as distance
  from c q join c b on q.vec_id % 50 = 0 and q.vec_id <> b.vec_id
)
select query_id, rank, neighbor_id, distance
from (select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from p) where rank <= 10
"""
