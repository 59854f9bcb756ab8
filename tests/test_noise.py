"""Integer noise and the book of spends."""

import math
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F


def distance(counts: Counter, p: dict[int, float]) -> float:
    """Chi-square over the places that expect five draws at least, relative to its degrees of freedom."""
    n = sum(counts.values())
    some = [x for x, q in p.items() if q * n >= 5]
    return sum((counts[x] - p[x] * n) ** 2 / (p[x] * n) for x in some) / (len(some) - 1)


def test_column_draws_are_discrete_laplace(spark):
    from lookalike.functions.noise import geometric_noise

    n, scale = 60_000, 3.0
    drawn = spark.range(n).select(geometric_noise("t", "id", scale=scale, secret=9).alias("x"))
    assert dict(drawn.dtypes) == {"x": "bigint"}
    counts = Counter({r.x: r["count"] for r in drawn.groupBy("x").count().collect()})
    q = math.exp(-1 / scale)
    assert distance(counts, {x: (1 - q) / (1 + q) * q ** abs(x) for x in range(-40, 41)}) < 1.6


def test_exact_draws():
    from lookalike.functions.noise import Bits, discrete_gaussian, discrete_laplace

    bits, n = Bits(7, "test"), 20_000
    q = math.exp(-2 / 5)
    counts = Counter(discrete_laplace(bits, Fraction(5, 2)) for _ in range(n))
    assert distance(counts, {x: (1 - q) / (1 + q) * q ** abs(x) for x in range(-40, 41)}) < 1.8
    weights = {x: math.exp(-x * x / (2 * 6.25)) for x in range(-30, 31)}
    counts = Counter(discrete_gaussian(bits, Fraction(25, 4)) for _ in range(n))
    assert distance(counts, {x: w / sum(weights.values()) for x, w in weights.items()}) < 1.8
    again = [discrete_gaussian(Bits(s, lane), Fraction(10**30)) for s, lane in ((1, "a"), (1, "a"), (2, "a"), (1, "b"))]
    assert again[0] == again[1] and len(set(again)) == 3
    assert Counter(Bits(1, "u").below(3) for _ in range(9)) == {Bits(1, "u").below(3): 9}


def test_what_is_released_is_whole(spark):
    """Counts are integers, and a mean is a whole number of public units over the number of rows."""
    from lookalike.operators.privacy import UNITS, dp_histogram, dp_mean_var

    df = spark.range(1000).select((F.col("id") % 7).alias("g"), (F.col("id") * 0.1).alias("x"))
    assert dict(dp_histogram(df, "g", 0.5, secret=3).dtypes)["noisy"] == "bigint"
    r = dp_mean_var(df, "x", 0.0, 100.0, 1e9, secret=3).first()
    assert abs(r.dp_mean - 49.95) < 1e-3 and abs(r.dp_variance - 833.3325) < 1e-2
    noisy = dp_mean_var(df.limit(4), "x", 0.0, 1e6, 0.1, secret=3).first().dp_mean * 4 / (1e6 / UNITS)
    assert abs(noisy - round(noisy)) < 1e-4
    for call in (lambda: dp_histogram(df, "g", 0.5), lambda: dp_mean_var(df, "x", 0.0, 1.0, 1.0)):
        with pytest.raises(TypeError):
            call()


def test_release_is_booked_and_refused(spark, tmp_path):
    from lookalike.functions.noise import Book, BudgetExceeded, release
    from lookalike.operators.privacy import dp_correlation, dp_histogram, ledger

    df = spark.range(500).select((F.col("id") % 5).alias("g"), (F.col("id") % 13).cast("double").alias("x"))
    book = Book(spark, f"file://{tmp_path}/book", 1.0, 1e-6)
    got = release(book, "histogram of g", 0.6, 0.0, lambda e, d: dp_histogram(df, "g", e, secret=5).collect())
    assert len(got) == 5
    drawn = []
    with pytest.raises(BudgetExceeded):
        release(book, "again", 0.6, 0.0, lambda e, d: drawn.append(e))
    with pytest.raises(BudgetExceeded):
        release(book, "delta", 0.1, 1e-5, lambda e, d: drawn.append(e))
    with pytest.raises(ValueError):
        release(book, "negative", -1.0, 0.0, lambda e, d: drawn.append(e))
    assert drawn == []
    m = release(Book(spark, f"file://{tmp_path}/book", 1.0, 1e-6), "moments", 0.4, 1e-6, lambda e, d: dp_correlation(df, ["g", "x"], {"g": (0, 4), "x": (0, 12)}, e, d, secret=6))
    assert m[0][0] == 1.0
    kept = sorted(map(tuple, book.spends().collect()))
    assert kept == [(0, 0.6, 0.0, "histogram of g"), (1, 0.4, 1e-6, "moments")]
    assert all(r.allowed for r in ledger(book.spends(), 1.0, 1e-6).collect())
