"""Deterministic randomness: every draw is a pure function of (seed, lane, key).

A draw does not depend on partitions, task retries or row order, so generated data can be
recomputed anywhere and checked against SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
_SCALE = 4503599627370496.0  # 2**52


def uniform(lane: str, *keys: Column | str, seed: int = SEED) -> Column:
    """Uniform on [0, 1) with 52 bits.  Keys are integers or strings."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(lane), *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(_SCALE)


def uniform_sql(lane: str, key: str, seed: int = SEED) -> str:
    """The same draw as DuckDB SQL; key is an SQL expression."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{lane}', cast({key} as varchar))), 1, 13))::bigint / {_SCALE})"


def big(lane: str, *keys: Column | str, seed: int = SEED) -> Column:
    """A number of 60 random bits as a decimal string, from the digest that uniform reads."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(lane), *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 15), 16, 10)


def big_sql(lane: str, key: str, seed: int = SEED) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{lane}', cast({key} as varchar))), 1, 15))::bigint)::varchar"


def normal(lane: str, *keys: Column | str, seed: int = SEED) -> Column:
    """Standard normal by Box and Muller on two lanes."""
    a, b = uniform(f"{lane}:a", *keys, seed=seed), uniform(f"{lane}:b", *keys, seed=seed)
    return F.sqrt(-2 * F.log(F.greatest(a, F.lit(1e-12)))) * F.cos(2 * F.pi() * b)


def normal_sql(lane: str, key: str, seed: int = SEED) -> str:
    a, b = uniform_sql(f"{lane}:a", key, seed), uniform_sql(f"{lane}:b", key, seed)
    return f"(sqrt(-2 * ln(greatest({a}, 1e-12))) * cos(2 * pi() * {b}))"


def pick(values: list, draw: Column) -> Column:
    """One of the values, each as likely."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(draw * len(values)) + 1).cast("int"))


def pick_sql(values: list, draw: str) -> str:
    said = ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values)
    return f"([{said}])[cast(floor({draw} * {len(values)}) as int) + 1]"


def weighted(values: list, weights: list[float], draw: Column) -> Column:
    """One of the values by weight: the first whose cumulative share exceeds the draw."""
    out, total, left = None, sum(weights), 0.0
    for v, w in list(zip(values, weights, strict=True))[:-1]:
        left += w / total
        out = F.when(draw < left, F.lit(v)) if out is None else out.when(draw < left, F.lit(v))
    return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))


def weighted_sql(values: list, weights: list[float], draw: str) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    total, left, cases = sum(weights), 0.0, ""
    for v, w in list(zip(values, weights, strict=True))[:-1]:
        left += w / total
        cases += f" when {draw} < {left!r} then {quote(v)}"
    return f"(case{cases} else {quote(values[-1])} end)"
