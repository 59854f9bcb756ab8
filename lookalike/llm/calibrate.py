"""Isotonic calibration of scores that were counted in bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of a score bin; scores are clipped to [LOW, HIGH], so bins are few at any size.
STEP, LOW, HIGH = 1e-3, -2.0, 3.0


def isotonic(scored: DataFrame, score: str = "raw", label: str = "y") -> tuple[list[float], list[float]]:
    """Knots of a rising curve from score to the share of label 1: pool adjacent violators."""
    at = F.floor((F.least(F.greatest(F.col(score), F.lit(LOW)), F.lit(HIGH)) - LOW) / STEP)
    bins = scored.groupBy(at.alias("b")).agg(F.sum(label).alias("y"), F.count("*").alias("n")).orderBy("b").collect()
    pools: list[list[float]] = []  # label sum, rows, score sum
    for r in bins:
        pools.append([float(r.y), float(r.n), float(r.n) * (LOW + (r.b + 0.5) * STEP)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return [p[2] / p[1] for p in pools], [p[0] / p[1] for p in pools]


def curve(knots: tuple[list[float], list[float]], raw: np.ndarray) -> np.ndarray:
    x, y = knots
    return np.interp(raw, x, y) if x else np.full(len(raw), 0.5)
