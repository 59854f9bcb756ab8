"""Operator 8: toxicity by the nearest labelled examples.

Terms are words and their stems of four and five letters.  A bounded sample of labelled rows
(``sample`` rows outside the held-out fold, by hash of the id) picks the terms whose presence goes
with the label: those of a chi-square above 4 ln(terms), which chance alone gives to one of so many
terms once in so many samples, whatever their size.  Their document frequencies are then counted
over all documents.  Examples lie in
an inverted index in blocks of BLOCK, which keeps for each term the largest weight in each
block.  A document takes blocks by the bound those maxima give on its cosine and stops when no
block can still hold one of its K nearest: the result is the exact top K by TF-IDF cosine.
Votes weigh by distance; isotonic regression over sample rows that are not examples turns them
into shares of label 1.  The evidence is the ids of all examples that voted.

Null texts count as empty; a text without any picked term gets the score of such texts in the
sample; repeated rows are scored each; without labelled rows every score is 0.5; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.llm.calibrate import curve, isotonic
from lookalike.llm.common import table, written
from lookalike.llm.inverted import words_of

#: Labelled rows that are learned from, neighbours, examples of a block, weight of the prior among
#: the votes, chi-square of a term in logarithms of the number of terms.
SAMPLE, K, BLOCK, PRIOR, STRICT = 20_000, 15, 64, 0.5, 4.0
#: Letters (bytes) of a stem.
STEMS = (4, 5)


def _terms(text: bytes) -> Counter:
    """Words and stems (with an asterisk) of a text."""
    said = Counter(words_of(text))
    stems: Counter = Counter()
    for w, n in said.items():
        for k in STEMS:
            if len(w) > k:
                stems[w[:k] + b"*"] += n
    return said + stems


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def pick_terms(sample: DataFrame) -> list[bytes]:
    """sample: (text, y).  The terms whose chi-square is beyond what chance gives the largest of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter(), Counter()]
        rows = [0, 0]
        for batch in batches:
            for t, y in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(_terms(t or b"").keys())
                rows[y] += 1
        names = list(seen[0].keys() | seen[1].keys())
        arrays = [pa.array([*names, None], pa.binary()), *(pa.array([*(seen[y][w] for w in names), rows[y]], pa.int64()) for y in (0, 1))]
        yield pa.RecordBatch.from_arrays(arrays, ["term", "n0", "n1"])

    counted = sample.mapInArrow(run, "term binary, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"))
    counted = written(counted)
    total = counted.where("term is null").first()
    if total is None or not total.a or not total.b:
        return []
    n0, n1 = total.a, total.b
    n = n0 + n1
    chi = f"{n} * pow(b * cast({n0} as double) - a * cast({n1} as double), 2) / (cast({n0} as double) * {n1} * (a + b) * ({n} - a - b))"
    candidates = counted.where(f"term is not null and a + b >= 3 and a + b < {n}")
    least = STRICT * np.log(max(candidates.count(), 2))
    best = candidates.withColumn("chi", F.expr(chi)).where(F.col("chi") > float(least))
    return [bytes(r.term) for r in best.orderBy(F.desc("chi"), "term").collect()]


def vectors(texts: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, ids, counts): the picked terms of each text, ascending."""
    place = {t: i for i, t in enumerate(terms)}
    stems = {t[:-1]: i for t, i in place.items() if t.endswith(b"*")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                found: Counter = Counter()
                for w, n in Counter(words_of(t or b"")).items():
                    if w in place:
                        found[place[w]] += n
                    for k in STEMS:
                        if len(w) > k and w[:k] in stems:
                            found[stems[w[:k]]] += n
                have = sorted(found)
                ids.append(have)
                counts.append([found[i] for i in have])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "ids", "counts"])

    return texts.mapInArrow(run, "doc_id long, ids array<int>, counts array<int>")


class BlockMax:
    """Inverted index of unit vectors with the largest weight of each term in each block."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]], terms: int):
        """rows: (id, label, term ids, weights)."""
        rows = sorted(rows, key=lambda r: (r[1], int(r[2][np.argmax(r[3])]) if len(r[2]) else -1, r[0]))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.float64)
        self.blocks = -(-len(rows) // BLOCK)
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) for r in rows])
        term = np.concatenate([r[2] for r in rows] or [np.zeros(0, np.int32)]).astype(np.int64)
        weight = np.concatenate([r[3] for r in rows] or [np.zeros(0)])
        cell = term * self.blocks + owner // BLOCK
        order = np.lexsort((owner, cell))
        self.owner, self.weight = owner[order], weight[order]
        self.first = np.searchsorted(cell[order], np.arange(terms * self.blocks + 1))
        self.most = np.zeros(terms * self.blocks)
        np.maximum.at(self.most, cell, weight)
        self.most = self.most.reshape(terms, self.blocks)

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k largest positive cosines, ties to the lower place."""
        bound = weights @ self.most[ids]
        order = np.argsort(-bound, kind="stable")
        best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
        step, at = 4, 0
        while at < len(order) and bound[order[at]] > 0:
            if len(best_s) >= k and bound[order[at]] * (1 + 1e-9) < best_s[k - 1]:
                break
            chosen = order[at : at + step]
            cells = (ids[:, None] * self.blocks + chosen[None, :]).ravel()
            lo, hi = self.first[cells], self.first[cells + 1]
            n = hi - lo
            take = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            score = self.weight[take] * np.repeat(np.repeat(weights, len(chosen)), n)
            who, where = np.unique(self.owner[take], return_inverse=True)
            s = np.bincount(where, weights=score)
            best_s, best_i = np.concatenate([best_s, s]), np.concatenate([best_i, who])
            keep = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[keep], best_i[keep]
            at, step = at + step, step * 2
        return best_i, best_s


class Scorer:
    def __init__(self, idf: np.ndarray, base: float):
        self.idf, self.base, self.index = idf, base, None
        self.knots: tuple[list[float], list[float]] = ([], [])

    def unit(self, ids, counts) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(ids, np.int64)
        w = np.log1p(np.asarray(counts, np.float64)) * self.idf[ids]
        norm = np.sqrt((w * w).sum())
        return ids, w / norm if norm else w

    def vote(self, ids, counts) -> tuple[float, list[int]]:
        if not len(ids):
            return self.base, []
        who, cosine = self.index.nearest(*self.unit(ids, counts), K)
        weight = 1 / (0.1 + np.maximum(1 - cosine, 0))
        return float(((weight * self.index.labels[who]).sum() + PRIOR * self.base) / (weight.sum() + PRIOR)), self.index.ids[who].tolist()

    def run(self, final: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict = {}
            for batch in batches:
                raw, proof = [], []
                for ids, counts in zip(batch.column("ids").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    key = (*ids, -1, *counts)
                    if key not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[key] = self.vote(ids, counts)
                    r, p = known[key]
                    raw.append(r)
                    proof.append(p)
                if final:
                    score = np.clip(curve(self.knots, np.array(raw)), 0, 1)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(proof, pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(raw, pa.float64())], ["y", "raw"])

        return go


def _frequencies(vecs: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 1, np.int64)
        for batch in batches:
            total[:terms] += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=terms)
            total[terms] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(terms + 1)), pa.array(total)], ["term", "n"])

    out = np.zeros(terms + 1, np.int64)
    for r in vecs.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out[:terms], int(out[terms])


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence (nearest examples)."""
    texts = _texts(docs, id_col, text_col)
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(f"y in (0, 1) and doc_id is not null").where(fold != held)
    chosen = written(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample))
    terms = pick_terms(texts.join(F.broadcast(chosen), "doc_id").select("text", "y"))  # sample rows of 12 bytes at most
    vecs = written(vectors(texts, terms))
    seen, rows = _frequencies(vecs, len(terms))
    learned = vecs.join(F.broadcast(chosen), "doc_id").withColumn("test", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(4)) == 0)
    examples = learned.where("not test").orderBy("doc_id", "y").limit(sample).collect()
    base = sum(r.y for r in examples) / len(examples) if examples else 0.5
    blank = [r.y for r in examples if not r.ids]
    scorer = Scorer(np.log((1 + rows) / (1 + seen)) + 1, sum(blank) / len(blank) if blank else base)
    scorer.index = BlockMax([(r.doc_id, r.y, *scorer.unit(r.ids, r.counts)) for r in examples if r.ids], len(terms))
    if examples:
        scorer.knots = isotonic(learned.where("test").select("ids", "counts", "y").mapInArrow(scorer.run(False), "y int, raw double"))
        if not scorer.knots[0]:
            scorer.knots = ([0.0, 1.0], [0.0, 1.0])
    scored = vecs.mapInArrow(scorer.run(True), "doc_id long, score double, evidence array<long>")
    return scored.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
