"""Exact nearest vectors through a tree of pivots that is as deep as the table is large.

A cell of more than BLOCK vectors is split: some of its own vectors become pivots, and each vector
goes to the cell of its nearest pivot.  Cells are split until all are small, so their radius, which
is what excludes them, shrinks as the table grows.  Each query goes down to the leaf of its nearest
pivots, and the nearest vector there bounds its answer from above.  Packets of such queries go down
the tree once more: a cell whose distance less its radius is beyond a query's bound, or whose border
to the cell of the nearest pivot is, holds nothing nearer for it.  What is written down of that is a
bit per query and leaf.  Packets and leaves that meet are brought together in groups of bytes of a
fixed size, so where nothing is excluded vectors are shipped once per group and not once per leaf.
The driver holds numbers of cells of one level, never vectors but those of the first one's pivots."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookalike.sources.io import written

#: Pivots of a cell at most (a power of two less one), vectors of a leaf, rows of a packet, levels at most.
PIVOTS, BLOCK, PACKET, LEVELS = 255, 4096, 512, 7
#: Bytes of vectors of a group, groups of either side at least, and rows and columns of a product of matrices.
GROUP, GROUPS, TILE = 8 << 20, 6, (256, 1024)


def apart(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of m."""
    return np.concatenate([np.sqrt(((a[i : i + 64, None, :] - m[None, :, :]) ** 2).sum(-1)) for i in range(0, len(a), 64)]) if len(a) else np.zeros((0, len(m)))


def least_apart(a: np.ndarray, m: np.ndarray, best: np.ndarray | None = None) -> np.ndarray:
    """apart(a, m).min(axis=1), or best where that is less: products of matrices tell which rows of m may
    be nearer than what is known, with room for their rounding, and only these are measured."""
    out = np.full(len(a), math.inf) if best is None else np.array(best)
    near, own = (m**2).sum(-1), (a**2).sum(-1)
    if not (np.isfinite(near).all() and np.isfinite(own).all()):
        return np.fmin(out, np.fmin.reduce(apart(a, m), axis=1))
    room = 1e-11 * (own + near.max())
    right = np.concatenate([m.T, near[None]])
    for i in range(0, len(a), TILE[0]):
        rows = a[i : i + TILE[0]]
        left = np.concatenate([-2 * rows, np.ones((len(rows), 1))], axis=1)
        slack = room[i : i + TILE[0]]
        base = slack - own[i : i + TILE[0]]
        reach = out[i : i + TILE[0]] ** 2 + base
        for j in range(0, len(m), TILE[1]):
            part = left @ right[:, j : j + TILE[1]]
            least = part.min(axis=1)
            hit = np.flatnonzero(least <= reach)
            if len(hit):
                who, where = np.nonzero(part[hit] <= np.minimum(least[hit] + 2 * slack[hit], reach[hit])[:, None])
                for k in range(0, len(who), 1 << 16):
                    w = hit[who[k : k + (1 << 16)]]
                    np.minimum.at(out, w + i, np.sqrt(((rows[w] - m[where[k : k + (1 << 16)] + j]) ** 2).sum(-1)))
                reach[hit] = out[hit + i] ** 2 + base[hit]
    return out


def _matrix(rows: pa.ListScalar | pa.Array, name: str | None = None) -> np.ndarray:
    array = rows.values if isinstance(rows, pa.ListScalar) else rows
    array = array.field(name) if name else array
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def _numbers(value: pa.BinaryScalar, kind=np.float64) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _of(mask: pa.BinaryScalar, n: int) -> np.ndarray:
    """Places of the bits; no mask is all of them."""
    return np.flatnonzero(np.unpackbits(_numbers(mask, np.uint8), count=n)) if mask.is_valid else np.arange(n)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _packed(rows: DataFrame, what: Column, of: list[str], most: int) -> DataFrame:
    """(cell, packet, vs): the cell's rows in packets of about ``most``."""
    many = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).alias("packets"))
    return rows.join(many, "cell").groupBy("cell", F.pmod(F.xxhash64(*of, F.lit(1)), "packets").alias("packet")).agg(F.collect_list(what).alias("vs"))


class Tree:
    """nodes: (parent, cell, pivot, radius, n); leaves: (cell, v).  The root is cell 0, a child's
    number is its parent's times PIVOTS + 1 and its own, from 1."""

    def __init__(self, base: DataFrame, vector: str):
        rows = base.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null").distinct().select(F.lit(0).cast("long").alias("cell"), "v")
        rows, nodes, leaves = written(rows), [], []
        self.size = rows.count()
        sizes = {0: self.size} if self.size else {}
        self.depth = 0
        while sizes and self.depth < LEVELS:
            self.depth += 1
            rows, made = self._split(rows, sizes)
            nodes.append(made)
            found = {r.cell: r.n for r in made.where(F.col("n") > BLOCK).select("cell", "n").collect()}  # cells still too large
            last = self.depth == LEVELS
            large = rows.join(F.broadcast(made.where(F.col("n") > BLOCK).select("cell")), "cell", "left_semi") if found and not last else None
            leaves.append(rows if large is None else rows.join(F.broadcast(made.where(F.col("n") > BLOCK).select("cell")), "cell", "left_anti"))
            if large is None:
                break
            rows, sizes = large, found
        self.nodes = nodes
        self.leaves = leaves
        self._blocks = None

    @staticmethod
    def _split(rows: DataFrame, sizes: dict[int, int]) -> tuple[DataFrame, DataFrame]:
        """Rows in the cells of their nearest pivots, and the new nodes."""
        spark = rows.sparkSession
        about = spark.createDataFrame([(c, min(PIVOTS, max(1, 2 * n // BLOCK)), math.ceil(n / PACKET)) for c, n in sizes.items()], "cell long, pivots int, packets int")
        by = Window.partitionBy("cell").orderBy(F.xxhash64("v"), "v")
        drawn = rows.withColumn("j", F.row_number().over(by)).where(F.col("j") <= PIVOTS).join(F.broadcast(about), "cell").where(F.col("j") <= F.col("pivots"))
        pivots = written(drawn.select("cell", "j", "v"))
        packets = rows.join(F.broadcast(about), "cell").groupBy("cell", F.pmod(F.xxhash64("v", F.lit(1)), "packets").alias("packet")).agg(F.collect_list("v").alias("vs"))
        sets = pivots.groupBy("cell").agg(F.collect_list(F.struct("j", "v")).alias("ps"))

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    cell, vs, ps = (c[i] for c in batch.columns)
                    j = ps.values.field("j").to_numpy()
                    d = apart(_matrix(vs), _matrix(ps, "v"))
                    at = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.as_py() * (PIVOTS + 1) + j[at].astype(np.int64)), pa.array(d[np.arange(len(d)), at]), vs.values], ["cell", "far", "v"])

        dealt = written(packets.join(sets, "cell").select("cell", "vs", "ps").mapInArrow(run, "cell long, far double, v array<double>"))
        measured = dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
        child = F.col("cell") * (PIVOTS + 1) + F.col("j")
        nodes = pivots.select(F.col("cell").alias("parent"), child.alias("cell"), F.col("v").alias("pivot")).join(measured, "cell")
        return dealt.select("cell", "v"), written(nodes.select("parent", "cell", "pivot", "radius", "n"))

    def _sets(self, level: DataFrame) -> DataFrame:
        """(cell, ps): the pivots in a cell; one row for the first level."""
        sets = level.groupBy(F.col("parent").alias("cell")).agg(F.collect_list(F.struct("cell", "pivot", "radius")).alias("ps"))
        return F.broadcast(sets) if level is self.nodes[0] else sets

    def _down(self, asked: DataFrame, step) -> DataFrame:
        """What arrives at leaves, if ``step(asked, level)`` takes rows of cells to cells in them."""
        out = []
        for level in self.nodes:
            asked = written(step(asked, level))
            if level is self.nodes[-1]:
                out.append(asked)
            else:
                inner = level.where(F.col("n") > BLOCK).select("cell")
                out.append(asked.join(inner, "cell", "left_anti"))
                asked = asked.join(inner, "cell", "left_semi")
        return _union(out)

    def blocks(self) -> DataFrame:
        """(b, cell, chunk, vs): the vectors of leaves as bytes, written once."""
        if self._blocks is None:

            def run(batches):
                for batch in batches:
                    for i in range(batch.num_rows):
                        cell, chunk, vs = (c[i] for c in batch.columns)
                        name = f"{cell.as_py()}:{chunk.as_py()}"
                        yield pa.RecordBatch.from_pylist([{"b": name, "cell": cell.as_py(), "chunk": chunk.as_py(), "vs": _matrix(vs).tobytes()}])

            packed = _packed(_union(self.leaves), F.col("v"), ["v"], BLOCK)
            self._blocks = written(packed.mapInArrow(run, "b string, cell long, chunk long, vs binary"))
        return self._blocks

    def packets(self, queries: DataFrame) -> DataFrame:
        """(p, cell, b, keys, qs, best): queries (key, q) by their nearest leaf, with their least distance
        to a block b of it."""

        def place(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    qs, ps = (c[i] for c in batch.columns)
                    at = apart(_matrix(qs, "q"), _matrix(ps, "pivot")).argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([qs.values.field("key"), qs.values.field("q"), ps.values.field("cell").take(pa.array(at))], ["key", "q", "cell"])

        def step(asked, level):
            packed = _packed(asked, F.struct("key", "q"), ["key", "q"], PACKET)
            return packed.join(self._sets(level), "cell").select("vs", "ps").mapInArrow(place, "key long, q array<double>, cell long")

        def meet(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    cell, packet, qs, b, vs = (c[i] for c in batch.columns)
                    q = _matrix(qs, "q")
                    m = _numbers(vs).reshape(-1, q.shape[1])
                    keys = qs.values.field("key").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_pylist([{"p": f"{cell.as_py()}:{packet.as_py()}", "cell": cell.as_py(), "b": b.as_py(), "keys": keys.astype(np.int64).tobytes(), "qs": q.tobytes(), "best": least_apart(q, m).tobytes()}])

        placed = self._down(queries.select("key", "q", F.lit(0).cast("long").alias("cell")), step)
        one = self.blocks().join(self.blocks().groupBy("cell").agg(F.min("chunk").alias("chunk")), ["cell", "chunk"], "left_semi")
        packed = _packed(placed, F.struct("key", "q"), ["key", "q"], PACKET).withColumnRenamed("vs", "qs")
        return written(packed.join(one, "cell").select("cell", "packet", "qs", "b", "vs").mapInArrow(meet, "p string, cell long, b string, keys binary, qs binary, best binary"))

    def visits(self, packets: DataFrame) -> DataFrame:
        """(p, b, mask): the blocks, besides the one met, that may hold something nearer, and for which
        of the packet's queries."""

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    p, mask, qs, best, ps = (c[i] for c in batch.columns)
                    bound, pivots = _numbers(best), _matrix(ps, "pivot")
                    rows = _of(mask, len(bound))
                    radius, cells = ps.values.field("radius").to_numpy(), ps.values.field("cell").to_numpy()
                    d = apart(_numbers(qs).reshape(len(bound), -1)[rows], pivots)
                    # the ball around the pivot, and half the way past the border to the nearest pivot's cell
                    least = np.maximum(d - radius, (d - d.min(axis=1)[:, None]) / 2)
                    may = np.zeros((len(bound), len(cells)), bool)
                    may[rows] = ~(least > bound[rows, None] + 1e-9 + 1e-12 * (d + radius))
                    some = np.flatnonzero(may.any(axis=0))
                    bits = np.packbits(may[:, some].T, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([p.as_py()] * len(some), pa.string()), pa.array(cells[some]), pa.array([x.tobytes() for x in bits], pa.binary())], ["p", "cell", "mask"])

        def step(asked, level):
            return asked.join(packets.select("p", "qs", "best"), "p").join(self._sets(level), "cell").select("p", "mask", "qs", "best", "ps").mapInArrow(run, "p string, cell long, mask binary")

        met = self._down(packets.select("p", F.lit(0).cast("long").alias("cell"), F.lit(None).cast("binary").alias("mask")), step)
        return met.join(self.blocks().select("cell", "b"), "cell").join(packets.select("p", "b"), ["p", "b"], "left_anti").select("p", "b", "mask")

    def nearest(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((key, distance), (key, cell) met): first a block of each query's nearest leaf, then the blocks
        that its best distance there does not exclude."""
        blocks, packets = self.blocks(), self.packets(queries)
        visits = written(self.visits(packets))
        (ps, p_bytes), (bs, b_bytes) = (df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(c)), F.lit(0))).first() for df, c in ((packets, "qs"), (blocks, "vs")))
        gp, gb = (max(math.ceil(size / GROUP), min(GROUPS, n), 1) for size, n in ((p_bytes, ps), (b_bytes, bs)))
        # in groups each side is shipped once for each group of the other, else once for each meeting
        alone = visits.count() * (p_bytes / max(ps, 1) + b_bytes / max(bs, 1)) < gb * p_bytes + gp * b_bytes
        group = lambda c, n: F.col(c) if alone else F.pmod(F.xxhash64(c), F.lit(n)).cast("string")
        todo = written(visits.groupBy(group("p", gp).alias("gp"), group("b", gb).alias("gb")).agg(F.collect_list(F.struct("p", "b", "mask")).alias("todo")))
        pairs = todo.select("gp", "gb")
        left = packets.groupBy(group("p", gp).alias("gp")).agg(F.collect_list(F.struct("p", "keys", "qs", "best")).alias("ps")).join(pairs, "gp")
        right = blocks.groupBy(group("b", gb).alias("gb")).agg(F.collect_list(F.struct("b", "vs")).alias("bs")).join(pairs, "gb")

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    todo, ps, bs = (c[i].values for c in batch.columns)
                    block = dict(zip(bs.field("b").to_pylist(), bs.field("vs"), strict=True))
                    wanted = {}
                    for p, b, mask in zip(todo.field("p").to_pylist(), todo.field("b").to_pylist(), todo.field("mask"), strict=True):
                        wanted.setdefault(p, []).append((b, mask))
                    for p, keys, qs, best in zip(ps.field("p").to_pylist(), ps.field("keys"), ps.field("qs"), ps.field("best"), strict=True):
                        if p not in wanted:
                            continue
                        known = _numbers(best)
                        found, q = known.copy(), _numbers(qs).reshape(len(known), -1)
                        for b, mask in wanted[p]:
                            rows = _of(mask, len(q))
                            found[rows] = least_apart(q[rows], _numbers(block[b]).reshape(-1, q.shape[1]), found[rows])
                        nearer = np.flatnonzero(found < known)
                        yield pa.RecordBatch.from_arrays([pa.array(_numbers(keys, np.int64)[nearer]), pa.array(found[nearer])], ["key", "distance"])

        def told(batches):
            for batch in batches:
                for keys, best in zip(*batch.columns, strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(_numbers(keys, np.int64)), pa.array(_numbers(best))], ["key", "distance"])

        def named(batches):
            for batch in batches:
                for keys, cell, mask in zip(*batch.columns, strict=True):
                    k = _numbers(keys, np.int64)
                    k = k[_of(mask, len(k))]
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), cell.as_py(), np.int64))], ["key", "cell"])

        better = todo.join(left, ["gp", "gb"]).join(right, ["gp", "gb"]).select("todo", "ps", "bs").mapInArrow(run, "key long, distance double")
        both = packets.select("keys", "best").mapInArrow(told, "key long, distance double").unionByName(better).groupBy("key").agg(F.min("distance").alias("distance"))
        own = packets.select("keys", "cell", F.lit(None).cast("binary").alias("mask"))
        more = visits.join(packets.select("p", "keys"), "p").join(blocks.select("b", "cell"), "b").select("keys", "cell", "mask")
        return written(both), own.unionByName(more).mapInArrow(named, "key long, cell long")


def nearest(queries: DataFrame, base: DataFrame | Tree, vector: str, key: str) -> DataFrame:
    """(key, distance) to the closest base vector, exactly (F-23).

    Rows without a vector have no answer and are none; keys are integers, rows of one key are one query.
    Queries of the same base may share its tree."""
    q = queries.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("q")).where("q is not null")
    tree = base if isinstance(base, Tree) else Tree(base, vector)
    return tree.nearest(q)[0] if tree.size else q.select("key", F.lit(None).cast("double").alias("distance")).limit(0)
