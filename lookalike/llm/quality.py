"""Operator 9: quality classifier on random Fourier features.

Statistics of each whole text (case, symbols, repetition, lines, word shapes) are standardised
and mapped to cosines of random projections, which approximate a Gaussian kernel.  Each
partition sums its part of the normal equations; blocks of rows of the sums are added up and a
ridge solution of fixed size is found on the driver.  Isotonic regression over binned scores
of the learning rows turns ridge scores into shares of label 1.

Null texts count as empty; empty texts get a score like any other; repeated rows are scored
each; with no labelled row every score is 0.5, with one class it is that label; other columns
are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.llm.calibrate import curve, isotonic
from lookalike.llm.common import keyed, table, written

FEATURES = (
    "length upper lower digit space newline mark symbol table stop comma other mean_word sd_word long_word distinct pairs twice top "
    "capital shouted lines short_line same_line"
).split()
_SYMBOLS = [ord(c) for c in "#$%&*@^~=+\\_`"]
_TABLE = [ord(c) for c in "|<>{}[]/"]
#: Random features, kernel width in standard deviations times the root of the features, ridge.
COMPONENTS, WIDTH, RIDGE, SEED = 256, 1.0, 1e-2, 9


def statistics(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    words = text.split()
    k = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    tops = Counter(words).most_common(1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    return [
        math.log1p(n), upper / n, lower / n, c[48:58].sum() / n, c[32] / n, c[10] / n * 10, c[33] / n * 10, c[_SYMBOLS].sum() / n * 5, c[_TABLE].sum() / n * 10,
        c[46] / n * 10, c[44] / n * 10, c[128:].sum() / n, min(sizes.mean(), 30) / 10, min(sizes.std(), 30) / 10, float((sizes > 20).mean()), len(set(words)) / k,
        len(set(zip(words, words[1:]))) / k, sum(map(bytes.__eq__, words, words[1:])) / k, (tops[0][1] / k if tops else 0.0),
        sum(w[:1].isupper() for w in words) / k, sum(w.isupper() for w in words) / k, math.log1p(len(lines)), sum(len(x) < 40 for x in lines) / m, 1 - len(set(lines)) / m,
    ]


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(_key, doc_id, x): a row's key (key_col; null without), its id and its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            flat = pa.array(np.asarray(x, np.float32).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("doc_id"), lists], ["_key", "doc_id", "x"])

    key = (F.col(key_col) if key_col else F.lit(None)).cast("long").alias("_key")
    return docs.select(key, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "_key long, doc_id long, x array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: tuple[list[float], list[float]]

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.standard_normal((len(FEATURES), COMPONENTS)) / (WIDTH * math.sqrt(len(FEATURES)))
        shift = rng.uniform(0, 2 * math.pi, COMPONENTS)
        z = np.cos(((x - self.mean) / self.scale) @ w + shift) * math.sqrt(2 / COMPONENTS)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64)


def fit(labelled: DataFrame) -> Model:
    """labelled: (x, y) with y 0 or 1."""
    stats = labelled.agg(F.count("*"), *[F.avg(F.col("x")[i]) for i in range(len(FEATURES))], *[F.stddev_pop(F.col("x")[i]) for i in range(len(FEATURES))]).first()
    d = len(FEATURES)
    if not stats[0]:
        return Model(np.zeros(d), np.ones(d), np.zeros(COMPONENTS + 1), ([], []))
    mean, scale = np.array(stats[1 : d + 1]), np.array(stats[d + 1 :])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(COMPONENTS + 1), ([], []))
    size, rows = COMPONENTS + 1, 16

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((size, size + 1))
        some = False
        for batch in batches:
            if batch.num_rows:
                some = True
                z = model.features(_matrix(batch.column(0)))
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                a += z.T @ np.column_stack([z, y])
        if some:
            parts = range(0, size, rows)
            yield pa.RecordBatch.from_arrays([pa.array([*parts], pa.int64()), pa.array([a[p : p + rows].tobytes() for p in parts], pa.binary())], ["part", "sums"])

    def added(pdf):
        total = sum(np.frombuffer(b) for b in pdf["sums"])
        return pdf.iloc[:1].assign(sums=[total.tobytes()])

    sums = labelled.select("x", "y").mapInArrow(partial, "part long, sums binary").groupBy("part").applyInPandas(added, "part long, sums binary").collect()
    a = np.concatenate([np.frombuffer(r.sums).reshape(-1, size + 1) for r in sorted(sums, key=lambda r: r.part)])
    model.weights = np.linalg.solve(a[:, :-1] + RIDGE * np.eye(size), a[:, -1])
    model.knots = isotonic(labelled.select("x", "y").mapInArrow(_scores(model, True), "y int, raw double"))
    return model


def _scores(model: Model, learning: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("x")
            raw = model.features(_matrix(batch.column(at))) @ model.weights
            if learning:
                yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(raw)], ["y", "raw"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("doc_id"), pa.array(curve(model.knots, raw))], ["_key", "doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """One row per document: _key (of featured), doc_id, held_out, score, predicted.  Learns from
    labelled rows outside the held-out fold only."""
    x = written(featured(docs, id_col, text_col, key_col))
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    marked = labels.select(F.col("doc_id").alias("_d"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    labelled = x.where(fold != held).join(marked, F.col("doc_id") == F.col("_d")).select("x", "y")
    scored = x.mapInArrow(_scores(fit(labelled), False), "_key long, doc_id long, score double")
    held_out = F.coalesce(fold == held, F.lit(False))
    return scored.select("_key", "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("_key")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.5 or more); each row is judged by itself."""
    base = keyed(docs, carry=docs.columns)
    good = quality_scores(base, table(spark, sf_dir, "labels"), id_col="_id", text_col="_text", key_col="_uid").where("predicted = 1").select(F.col("_key").alias("_uid"))
    return base.join(good, "_uid", "left_semi").select("_rest.*")
