"""Integer noise for differential privacy, and the book that spends are entered in.

A double that is drawn by an inverse distribution function and added to a sum tells the sum by its
low bits.  So sums and counts are integers here (values are rounded to a public unit first), noise
is an integer, and what is released is their sum; only public arithmetic follows.

Where results are many, two hashed geometric draws make a discrete Laplace draw as a column
expression.  Where they are few, the driver draws exactly, by rational arithmetic (Canonne, Kamath
and Steinke: The Discrete Gaussian for Differential Privacy, 2020).  Both are functions of a secret
seed, so a task that runs again draws the same noise and nothing can be averaged away."""

from __future__ import annotations

import hmac
import math
from collections.abc import Callable
from fractions import Fraction
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.functions.rng import uniform, uniform_sql

T = TypeVar("T")


def geometric_noise(lane: str, *keys: Column | str, scale: float, secret: int) -> Column:
    """Discrete Laplace draw, P(x) in proportion to exp(-|x| / scale), as the difference of two
    geometric draws.  scale is sensitivity over epsilon, in units."""
    draw = lambda side: F.floor(F.log(1 - uniform(f"{lane}:{side}", *keys, seed=secret)) * F.lit(-float(scale))).cast("long")
    return draw("a") - draw("b")


def geometric_noise_sql(lane: str, key: str, scale: float, secret: int) -> str:
    draw = lambda side: f"floor(ln(1 - {uniform_sql(f'{lane}:{side}', key, secret)}) * -({float(scale)}::double))::bigint"
    return f"({draw('a')} - {draw('b')})"


class Bits:
    """Random integers from a secret and a lane, by HMAC-SHA256 in counter mode."""

    def __init__(self, secret: int | str, lane: str):
        self.key, self.lane, self.at, self.pool, self.left = str(secret).encode(), lane.encode(), 0, 0, 0

    def take(self, n: int) -> int:
        while self.left < n:
            block = hmac.digest(self.key, self.lane + b"|" + str(self.at).encode(), "sha256")
            self.pool, self.left, self.at = self.pool << 256 | int.from_bytes(block), self.left + 256, self.at + 1
        self.left -= n
        out = self.pool >> self.left
        self.pool &= (1 << self.left) - 1
        return out

    def below(self, n: int) -> int:
        """Uniform on 0 to n - 1."""
        while True:
            x = self.take((n - 1).bit_length())
            if x < n:
                return x


def _coin(bits: Bits, p: Fraction) -> bool:
    return bits.below(p.denominator) < p.numerator


def _coin_exp(bits: Bits, g: Fraction) -> bool:
    """True with probability exp(-g)."""
    while g > 1:
        if not _coin_exp(bits, Fraction(1)):
            return False
        g -= 1
    k = 1
    while _coin(bits, g / k):
        k += 1
    return k % 2 == 1


def discrete_laplace(bits: Bits, scale: Fraction) -> int:
    """Exact draw with P(x) in proportion to exp(-|x| / scale)."""
    t, s = scale.numerator, scale.denominator
    while True:
        u = bits.below(t)
        if not _coin_exp(bits, Fraction(u, t)):
            continue
        v = 0
        while _coin_exp(bits, Fraction(1)):
            v += 1
        x = (u + t * v) // s
        if not bits.below(2):
            return x
        if x:
            return -x


def discrete_gaussian(bits: Bits, variance: Fraction) -> int:
    """Exact draw with P(x) in proportion to exp(-x * x / (2 * variance))."""
    t = math.isqrt(math.floor(variance)) + 1
    while True:
        y = discrete_laplace(bits, Fraction(t))
        if _coin_exp(bits, (abs(y) - variance / t) ** 2 / (2 * variance)):
            return y


class BudgetExceeded(ValueError):
    pass


class Book:
    """Spends of one budget, kept as a table: (step, epsilon, delta, purpose).

    A step is a file that is made once and a folder with the row; of two drivers that book the same
    step at once one is refused."""

    def __init__(self, spark: SparkSession, path: str, epsilon: float, delta: float = 0.0):
        self.spark, self.path, self.epsilon, self.delta = spark, path.rstrip("/"), epsilon, delta

    def _fs(self, path: str):
        from lookalike.sources.io import hadoop_path

        fs, where, _ = hadoop_path(self.spark, path)
        return fs, where

    def spends(self) -> DataFrame:
        schema = "step long, epsilon double, delta double, purpose string"
        fs, where = self._fs(self.path)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.path) if fs.exists(where) else self.spark.createDataFrame([], schema)

    def spend(self, epsilon: float, delta: float, purpose: str) -> None:
        """Books a spend, or raises and books nothing.  It is booked before anything is drawn."""
        if not (epsilon >= 0 and delta >= 0 and math.isfinite(epsilon) and math.isfinite(delta)):
            raise ValueError("a spend is finite and not below 0")
        n, e, d = self.spends().agg(F.coalesce(F.max("step") + 1, F.lit(0)), F.coalesce(F.sum("epsilon"), F.lit(0.0)), F.coalesce(F.sum("delta"), F.lit(0.0))).first()
        if e + epsilon > self.epsilon * (1 + 1e-12) or d + delta > self.delta * (1 + 1e-12):
            raise BudgetExceeded(f"{purpose}: {e:g} of {self.epsilon:g} epsilon and {d:g} of {self.delta:g} delta are spent")
        lock, where = self._fs(f"{self.path}/_taken-{n}")
        if lock.createNewFile(where):  # one of several drivers gets it
            row = self.spark.createDataFrame([(n, float(epsilon), float(delta), purpose)], "step long, epsilon double, delta double, purpose string")
            row.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/spend-{n}")
            return
        raise BudgetExceeded(f"{purpose}: step {n} is being booked by another driver")


def release(book: Book, purpose: str, epsilon: float, delta: float, draw: Callable[[float, float], T]) -> T:
    """draw(epsilon, delta), once its cost is booked; refused if the budget does not allow it."""
    book.spend(epsilon, delta, purpose)
    return draw(epsilon, delta)
