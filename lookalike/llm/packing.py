"""Operator 5: conflict-constrained best-fit packing of documents into sequences.

Documents are cut at the capacity; full pieces are bins by themselves, what remains is packed.
Remainders are dealt by hash into shards of about SHARD_PIECES, so that no task sees more and
every shard has the same mix of lengths, sources and clusters.  A shard packs the longest first.
Its bins are ordered by residual; each carries a bitmap of the sources that it is full of, and a
bitmap of the duplicate clusters it holds.  A piece starts at the smallest residual that it fits
and goes on to the next larger one until a bin is compatible: the tightest compatible bin.

Two pieces of one duplicate cluster (equal texts but for case and white space) never share a
bin; a source has at most ``per_source`` pieces in a bin.  Null and empty texts have no words and
are given bin -1; a null source is a source of its own; repeated rows are pieces of one cluster;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.llm.common import table, written

#: Remainders in a shard, on average.
SHARD_PIECES = 20_000


class Bins:
    """Open bins of a shard by residual, and within a residual by their sources."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.at: dict[int, dict[int, list[int]]] = {}  # residual -> full sources -> bins
        self.filled = 0  # bit r is set if a bin has residual r
        self.residual: list[int] = []
        self.clusters: list[int] = []
        self.sources: list[dict[int, int]] = []

    def _leave(self, residual: int, full: int, b: int) -> None:
        group = self.at[residual][full]
        group.remove(b)
        if not group:
            del self.at[residual][full]
            if not self.at[residual]:
                del self.at[residual]
                self.filled &= ~(1 << residual)

    def find(self, size: int, source: int, cluster: int) -> tuple[int, int] | None:
        above = self.filled >> size << size
        while above:
            residual = (above & -above).bit_length() - 1
            for full, group in self.at[residual].items():
                if not full >> source & 1:
                    for b in group:
                        if not self.clusters[b] >> cluster & 1:
                            return b, full
            above &= above - 1
        return None

    def put(self, size: int, source: int, cluster: int) -> int:
        found = self.find(size, source, cluster)
        if found is None:
            b, full = len(self.residual), 0
            self.residual.append(self.capacity)
            self.clusters.append(0)
            self.sources.append({})
        else:
            b, full = found
            self._leave(self.residual[b], full, b)
        held = self.sources[b][source] = self.sources[b].get(source, 0) + 1
        if held >= self.per_source:
            full |= 1 << source
        self.residual[b] -= size
        self.clusters[b] |= 1 << cluster
        if left := self.residual[b]:
            self.at.setdefault(left, {}).setdefault(full, []).append(b)
            self.filled |= 1 << left
        return b


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, source, cluster) without texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, marks = [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                said = (t or b"").split()
                words.append(len(said))
                marks.append(int.from_bytes(hashlib.blake2b(b" ".join(said).lower(), digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), batch.column(2), pa.array(marks, pa.int64())], ["doc_id", "n_words", "source", "cluster"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    return chosen.mapInArrow(run, "doc_id long, n_words long, source string, cluster long")


def _pack(capacity: int, per_source: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards come one after the other, longest pieces first."""
        shard, bins, sources, clusters = None, None, {}, {}
        for batch in batches:
            out = []
            for s, size, source, cluster in zip(*(batch.column(c).to_pylist() for c in ("shard", "rest", "source", "cluster")), strict=True):
                if s != shard:
                    shard, bins, sources, clusters = s, Bins(capacity, per_source), {}, {}
                out.append(bins.put(size, sources.setdefault(source, len(sources)), clusters.setdefault(cluster, len(clusters))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("shard"), pa.array(out, pa.int64())], ["doc_id", "n_words", "shard", "bin"])

    return run


def pack(docs: DataFrame, capacity: int = 2048, per_source: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: doc_id, part (0, 1, ... in the document), first_word, n_words, bin_id.

    bin_id names a bin: "shard-bin" of a packed one, "doc_id/part" of a full piece, "-1" of none."""
    sizes = written(measured(docs, id_col, text_col, source_col))
    rests = sizes.where(F.col("n_words") % capacity > 0).withColumn("rest", (F.col("n_words") % capacity).cast("int"))
    shards = max(1, -(-rests.count() // SHARD_PIECES))
    dealt = rests.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_words", "cluster"), F.lit(shards)))
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("rest"), "doc_id", "cluster", "source")
    packed = ordered.mapInArrow(_pack(capacity, per_source), "doc_id long, n_words long, shard long, bin long")
    last = packed.select("doc_id", F.expr(f"cast(n_words div {capacity} as int)").alias("part"), (F.col("n_words") % capacity).alias("n_words"), F.concat_ws("-", "shard", "bin").alias("bin_id"))
    full = sizes.where(f"n_words >= {capacity}").select("doc_id", F.explode(F.sequence(F.lit(0), F.expr(f"cast(n_words div {capacity} as int) - 1"))).alias("part"))
    full = full.select("doc_id", "part", F.lit(capacity).cast("long").alias("n_words"), F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "part").alias("bin_id"))
    none = sizes.where("n_words = 0").select("doc_id", F.lit(0).alias("part"), "n_words", F.lit("-1").alias("bin_id"))
    return last.unionByName(full).unionByName(none).select("doc_id", "part", (F.col("part").cast("long") * capacity).alias("first_word"), "n_words", "bin_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
