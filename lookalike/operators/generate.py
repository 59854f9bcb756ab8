"""Synthetic columns and tables (G): each row is a function of (seed, lane, row id)."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookalike.functions.checks import iban_digits, luhn_digit, mod97, verhoeff_digit
from lookalike.functions.rng import SEED, big, normal, pick, uniform, weighted
from lookalike.operators.privacy import CITY, COMPANY, FIRST, LAST
from lookalike.sources.io import written
from lookalike.sources.ranges import running_sums

#: Rows of a period that are made at once.
BLOCK = 10_000
#: Rows of a conditional model that may be broadcast once they were counted.
MODEL_ROWS = 50_000


def rows(spark, n: int, offset: int = 0) -> DataFrame:
    """row_id from offset: batches of any size give the same rows (G-16)."""
    return spark.range(offset, offset + n).withColumnRenamed("id", "row_id")


def draw(spec: dict, lane: str, key: str = "row_id", seed: int = SEED) -> Column:
    """A number of the spec's distribution, clipped to min and max (G-01, G-02)."""
    u, z = uniform(lane, key, seed=seed), normal(lane, key, seed=seed)
    kind = spec.get("distribution", "uniform")
    lo, hi = spec.get("min", 0), spec.get("max", 1)
    if kind == "uniform":
        out = lo + u * (hi - lo)
    elif kind == "normal":
        out = spec.get("mean", 0.0) + spec.get("std", 1.0) * z
    elif kind == "lognormal":
        mu, sigma = spec.get("mu"), spec.get("sigma")
        if mu is None:
            m, s = spec["mean"], spec["std"]
            sigma = math.sqrt(math.log(1 + (s / m) ** 2))
            mu = math.log(m) - sigma**2 / 2
        out = F.exp(mu + sigma * z)
    elif kind == "pareto":
        out = spec.get("scale", 1.0) * F.pow(1 - u, F.lit(-1.0 / spec["alpha"]))
    elif kind == "exponential":
        out = -spec.get("scale", 1.0) * F.log(1 - u)
    elif kind == "poisson":
        lam = spec["lam"]
        p, total, out = math.exp(-lam), 0.0, F.lit(0)
        cuts = []
        for k in range(int(lam + 10 * math.sqrt(lam) + 10)):
            total += p
            cuts.append(total)
            p *= lam / (k + 1)
        out = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= u))
    elif kind == "binomial":
        n, p = spec["n"], spec["p"]
        cuts, total = [], 0.0
        for k in range(n):
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            cuts.append(total)
        out = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= u))
    elif kind == "beta":
        # integer shapes: the a-th smallest of a + b - 1 uniforms
        a, b = int(spec["a"]), int(spec["b"])
        us = F.array_sort(F.array(*[uniform(f"{lane}:{i}", key, seed=seed) for i in range(a + b - 1)]))
        out = lo + us[a - 1] * (hi - lo)
    elif kind == "choices":
        out = weighted(spec["choices"], spec.get("weights") or [1] * len(spec["choices"]), u)
    else:
        raise ValueError(f"unknown distribution {kind}")
    if kind not in ("uniform", "beta", "choices"):
        if "min" in spec:
            out = F.greatest(out, F.lit(spec["min"]).cast("double"))
        if "max" in spec:
            out = F.least(out, F.lit(spec["max"]).cast("double"))
    return out


def gen_int(spec: dict, lane: str, key: str = "row_id", seed: int = SEED) -> Column:
    """Integers; fractions are cut off toward zero (G-01)."""
    if spec.get("distribution") == "sequence":
        return F.col(key) + spec.get("start", 1)
    if spec.get("distribution", "uniform") == "uniform":
        spec = spec | {"max": spec.get("max", 1) + 1}
        return F.floor(draw(spec, lane, key, seed)).cast("long")
    return draw(spec, lane, key, seed).cast("long")


def gen_float(spec: dict, lane: str, key: str = "row_id", seed: int = SEED) -> Column:
    """Floats rounded to the spec's decimals (G-02)."""
    return F.round(draw(spec, lane, key, seed).cast("double"), spec.get("decimals", 2))


def gen_bool(p: float, lane: str, key: str = "row_id") -> Column:
    """True with probability p (G-03)."""
    return uniform(lane, key) < p


def gen_category(choices: list, lane: str, weights: list[float] | None = None, zipf: float | None = None, key: str = "row_id") -> Column:
    """Choices by weight or by a power of their rank (G-04)."""
    w = weights or ([1 / (i + 1) ** zipf for i in range(len(choices))] if zipf else [1.0] * len(choices))
    return weighted(choices, w, uniform(lane, key))


def gen_timestamp(start: str, end: str, lane: str, key: str = "row_id", recent: float | None = None) -> Column:
    """Times between two, uniform or exponentially close to the end (mean ``recent`` days) (G-05)."""
    lo, hi = F.unix_timestamp(F.lit(start).cast("timestamp")), F.unix_timestamp(F.lit(end).cast("timestamp"))
    u = uniform(lane, key)
    second = lo + F.floor(u * (hi - lo)) if recent is None else F.greatest(lo, hi - F.floor(-recent * 86400 * F.log(1 - u)))
    return F.timestamp_seconds(second)


# Relative weights of the hours of a day (G-06), by what a platform is for.
_SHOP = [1, 1, 1, 1, 1, 1, 2, 3, 5, 7, 9, 12, 13, 12, 10, 8, 7, 10, 14, 15, 12, 8, 4, 2]
_OFFICE = [1, 1, 1, 1, 1, 2, 4, 8, 14, 16, 16, 15, 13, 15, 16, 14, 12, 8, 5, 3, 2, 2, 1, 1]
_PLAY = [8, 6, 4, 3, 2, 1, 1, 1, 2, 3, 4, 5, 6, 6, 6, 6, 8, 10, 14, 16, 18, 18, 16, 12]
_WORK = [1, 1, 1, 1, 1, 2, 4, 9, 14, 16, 15, 13, 12, 14, 15, 13, 11, 8, 5, 4, 3, 2, 2, 1]
_ANY = [1, 1, 1, 1, 1, 2, 4, 7, 10, 12, 12, 11, 11, 12, 12, 11, 10, 9, 7, 6, 4, 3, 2, 1]
HOURS = {
    "ecommerce": _SHOP, "fooddelivery": _SHOP, "marketplace": _SHOP,
    "fintech": _OFFICE, "hr": _OFFICE, "healthcare": _OFFICE, "realestate": _OFFICE,
    "gaming": _PLAY, "social": _PLAY,
    "saas": _WORK, "edtech": _WORK,
}


def time_of_day(df: DataFrame, column: str, key: str, domain: str = "") -> DataFrame:
    """The same day at a time that suits the domain; unknown ones lean to the day (G-06)."""
    hour = weighted(list(range(24)), HOURS.get(domain.lower(), _ANY), uniform(f"hour:{column}", key))
    second = F.floor(uniform(f"second:{column}", key) * 3600)
    day = F.unix_timestamp(F.date_trunc("day", F.col(column).cast("timestamp")))
    return df.withColumn(column, F.timestamp_seconds(day + hour * 3600 + second))


def indexed(parent: DataFrame, key: str) -> DataFrame:
    """(_i, key): parent keys numbered from 0 in key order, without one task seeing all."""
    from lookalike.sources.ranges import ranked

    return ranked(parent.select(key).where(F.col(key).isNotNull()).distinct(), [key], "_r").select((F.col("_r") - 1).cast("long").alias("_i"), F.col(key).alias("_parent"))


def assign_fk(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, out: str, lane: str | None = None, skew: float | None = None) -> DataFrame:
    """A parent key for each child: uniform, or by a power of the parent's place (G-07, G-08)."""
    numbered = indexed(parent, parent_key)
    m = numbered.count()
    if not m:
        raise ValueError("the parent table is empty")
    u = uniform(lane or f"fk:{out}", child_key)
    place = F.floor(F.pow(u, F.lit(skew)) * m) if skew else F.floor(u * m)
    return child.drop(out).withColumn("_i", F.least(place, F.lit(m - 1)).cast("long")).join(numbered, "_i", "left").drop("_i").withColumnRenamed("_parent", out)


def reassign_fks(tables: dict[str, DataFrame], edges: list[tuple[str, str, str, str, str]]) -> dict[str, DataFrame]:
    """edges: (child, child row key, fk column, parent, parent key), parents first; edges of a
    cycle come last, when all its tables exist (G-08, G-09)."""
    out = dict(tables)
    for child, row, fk, parent, key in edges:
        out[child] = assign_fk(out[child], row, out[parent], key, fk).select(*tables[child].columns)
    return out


def self_fk(df: DataFrame, key: str, out: str) -> DataFrame:
    """A reference to an earlier row of dense keys from 1; the root has none."""
    u = uniform(f"self:{out}", key)
    return df.withColumn(out, F.when(F.col(key) > 1, F.floor(u * (F.col(key) - 1)).cast("long") + 1))


def expand_children(parent: DataFrame, parent_key: str, model: DataFrame, context: str | None = None, cap: int | None = None) -> DataFrame:
    """(parent_key, child_no): as many children as a draw from the cardinality model (G-10)."""
    by = Window.partitionBy("context").orderBy("n_children").rowsBetween(Window.unboundedPreceding, 0)
    cum = model.withColumn("_c", F.sum("parents").over(by) / F.sum("parents").over(Window.partitionBy("context")))
    packed = cum.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("n_children", "_c"))).alias("_m"))
    ctx = F.col(context).cast("string") if context else F.lit("*")
    u = uniform("children", parent_key)
    n = F.coalesce(F.get(F.filter("_m", lambda x: u < x["_c"]), 0)["n_children"], F.lit(0))
    n = F.least(n, F.lit(cap)) if cap is not None else n
    j = parent.select(F.col(parent_key), ctx.alias("context")).join(packed, "context", "left").withColumn("_n", n.cast("int"))
    return j.where("_n > 0").select(parent_key, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("child_no"))


def sample_numeric(g: list[float], lane: str, key: str = "row_id", jitter: float = 0.01) -> Column:
    """Value from a quantile grid with a little noise, clipped to its ends (G-11)."""
    from lookalike.operators.models import from_grid

    noise = (uniform(f"{lane}:jitter", key) - 0.5) * 2 * jitter * (g[-1] - g[0])
    return F.least(F.greatest(from_grid(uniform(lane, key), g) + noise, F.lit(float(g[0]))), F.lit(float(g[-1])))


def sample_conditional(df: DataFrame, model: DataFrame, parents: list[str], out: str, key: str) -> DataFrame:
    """Category by context, by the marginal where the context is unknown (G-12, G-13).

    model: (context, value, probability) with context '*'; parents are banded as it was fitted."""
    by = Window.partitionBy("context").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    packed = model.withColumn("_c", F.round(F.sum("probability").over(by), 9)).groupBy("context").agg(F.array_sort(F.collect_list(F.struct("_c", "value"))).alias("_m"))
    ctx = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("∅")) for p in parents])
    m = F.coalesce("_m", "_any")
    # rounded shares may end below one: a draw beyond them gets the last value; it is made once a row, not once a value
    first = F.get(F.transform(F.array(uniform(f"cond:{out}", key)), lambda u: F.get(F.filter(m, lambda x: u < x["_c"]), 0)["value"]), 0)
    value = F.coalesce(first, F.element_at(m, -1)["value"])
    packed = written(packed)
    small = packed.agg(F.sum(F.size("_m"))).first()[0] or 0
    known = F.broadcast(packed) if small <= MODEL_ROWS else packed
    marginal = packed.where("context = '*'").select(F.col("_m").alias("_any"))
    j = df.withColumn("context", ctx).join(known, "context", "left").join(F.broadcast(marginal), how="left")  # one row
    return j.withColumn(out, value).drop("context", "_m", "_any")


def apply_month_curve(df: DataFrame, value: str, when: str, factors: dict[int, float], decimals: int = 2) -> DataFrame:
    """Values times their month's factor (G-15, G-33)."""
    f = F.create_map(*[F.lit(x) for kv in factors.items() for x in kv])
    return df.withColumn(value, F.round(F.col(value) * F.coalesce(f[F.month(when)], F.lit(1.0)), decimals))


def seasonal(points: dict[int, float]) -> dict[int, float]:
    """Twelve factors, linear between the given months (G-33)."""
    import bisect

    months = sorted(points)
    out = {}
    for m in range(1, 13):
        k = bisect.bisect_left(months, m)
        if m in points or k == 0 or k == len(months):
            out[m] = points[months[min(k, len(months) - 1)]]
        else:
            a, b = months[k - 1], months[k]
            out[m] = points[a] + (points[b] - points[a]) * (m - a) / (b - a)
    return out


def trend_curve(df: DataFrame, value: str, when: str, start: float, end: float, decimals: int = 2) -> DataFrame:
    """Values times a factor that runs linearly over the table's time span (G-33)."""
    s = F.unix_timestamp(F.col(when).cast("timestamp"))
    lo, hi = df.agg(F.min(s), F.max(s)).first()
    at = (s - F.lit(lo)) / F.lit(max((hi or 0) - (lo or 0), 1))
    return df.withColumn(value, F.round(F.col(value) * (start + (end - start) * at), decimals))


def time_density(df: DataFrame, when: str, key: str, weights: list[float], year: int) -> DataFrame:
    """Times dealt anew over the months of a year by weight, uniform inside (G-34)."""
    month = weighted(list(range(1, 13)), weights, uniform(f"month:{when}", key))
    first = F.make_date(F.lit(year), month, F.lit(1))
    days = F.dayofmonth(F.last_day(first))
    return df.withColumn(when, F.date_add(first, F.floor(uniform(f"day:{when}", key) * days).cast("int")))


def names_and_contacts(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Names, unique emails made of them, phones: independent of any source (G-17)."""
    first, last = pick(FIRST, uniform("first", key)), pick(LAST, uniform("last", key))
    named = df.withColumns({"full_name": F.concat_ws(" ", first, last)})
    local = F.regexp_replace(F.lower("full_name"), "[^a-z]+", ".")
    return named.withColumns({"email": F.concat(local, F.lit("."), F.col(key).cast("string"), F.lit("@example.com")), "phone": F.concat(F.lit("+1-555-"), F.lpad(F.floor(uniform("phone", key) * 10_000_000).cast("string"), 7, "0")), "city": pick(CITY, uniform("city", key)), "company": pick(COMPANY, uniform("company", key))})


def gen_dependent(on: Column, mapping: dict, lane: str, key: str = "row_id", default=None) -> Column:
    """A value by a sibling's: a constant, a list, {value: weight} or a distribution (G-18)."""
    out = None
    for k, spec in mapping.items():
        if isinstance(spec, dict) and "distribution" in spec:
            v = gen_float(spec, f"{lane}:{k}", key)
        elif isinstance(spec, dict):
            v = weighted(list(spec), list(spec.values()), uniform(lane, key))
        elif isinstance(spec, list):
            v = pick(spec, uniform(lane, key))
        else:
            v = F.lit(spec)
        out = F.when(on == k, v) if out is None else out.when(on == k, v)
    return out.otherwise(F.lit(default))


def relative_date(child: DataFrame, fk: str, parent: DataFrame, parent_key: str, parent_date: str, out: str, key: list[str], lo: int, hi: int) -> DataFrame:
    """Parent's date plus a drawn number of days (G-19)."""
    p = parent.select(F.col(parent_key).alias("_k"), F.col(parent_date).alias("_d"))
    days = lo + F.floor(uniform(f"days:{out}", *key) * (hi - lo + 1)).cast("int")
    return child.join(p, child[fk] == F.col("_k"), "left").withColumn(out, F.date_add(F.col("_d"), days.cast("int"))).drop("_k", "_d")


def unique_int(lo: int, hi: int, key: str = "row_id", seed: int = SEED) -> Column:
    """A permutation of a range: no two keys below its size meet (G-20)."""
    m = hi - lo + 1
    a = next(x for x in range(int(m * 0.618) | 1, 2 * m + 3) if math.gcd(x, m) == 1)
    return ((F.col(key).cast("decimal(38,0)") * a + seed * 7919) % m + lo).cast("long")


def _digits(lane: str, n: int, key: str, first: str = "") -> Column:
    """n digits, twelve from each digest: the low digits of a number of 60 bits."""
    return F.concat(F.lit(first), *[F.right(F.lpad(big(f"{lane}:{i}", key), 18, "0"), F.lit(min(12, n - i))) for i in range(0, n, 12)])


def _letters(lane: str, n: int, key: str) -> Column:
    """n letters from one digest of 60 bits."""
    drawn = big(f"{lane}:L", key).cast("long")
    return F.concat(*[F.chr(65 + F.shiftright(drawn, 8 * i) % 26) for i in range(n)])


def gen_typed_id(kind: str, key: str = "row_id") -> Column:
    """Identifiers whose check digits hold (G-21)."""
    if kind == "credit_card":
        body = _digits("card", 14, key, "4")
        return F.concat(body, luhn_digit(body).cast("string"))
    if kind == "aadhaar":
        body = F.concat((2 + F.floor(uniform("aadhaar:0", key) * 8)).cast("string"), _digits("aadhaar", 10, key))
        return F.concat(body, verhoeff_digit(body).cast("string"))
    if kind == "routing_number":
        from lookalike.functions.checks import aba_sum

        body = _digits("aba", 8, key)
        return F.concat(body, ((10 - aba_sum(body) % 10) % 10).cast("string"))
    if kind == "ssn":
        area = 1 + F.floor(uniform("ssn:a", key) * 665)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((1 + F.floor(uniform("ssn:g", key) * 99)).cast("string"), 2, "0"), F.lpad((1 + F.floor(uniform("ssn:s", key) * 9999)).cast("string"), 4, "0"))
    if kind == "ifsc_code":
        return F.concat(_letters("ifsc", 4, key), F.lit("0"), _digits("ifsc", 6, key))
    if kind == "swift_bic":
        return F.concat(_letters("bic", 4, key), F.lit("DE"), _letters("bic2", 2, key))
    if kind == "iban":
        bban = _digits("iban", 18, key)
        check = 98 - mod97(iban_digits(F.concat(F.lit("DE00"), bban)))
        return F.concat(F.lit("DE"), F.lpad(check.cast("string"), 2, "0"), bban)
    if kind == "account_number":
        return _digits("account", 11, key, "1")
    raise ValueError(f"unknown kind {kind}")


#: Word lists of generated texts (G-22).
PRODUCT = ["lamp", "chair", "table", "kettle", "jacket", "tent", "drill", "phone"]
QUALITY = ["sturdy", "light", "compact", "classic", "bright", "quiet", "warm", "plain"]


def gen_text(role: str, key: str = "row_id") -> Column:
    """Text of a role from word lists and templates (G-22)."""
    q, p = pick(QUALITY, uniform("quality", key)), pick(PRODUCT, uniform("product", key))
    return {
        "product": F.concat_ws(" ", q, p),
        "city": pick(CITY, uniform("city", key)),
        "company": pick(COMPANY, uniform("company", key)),
        "description": F.format_string("A %s %s from %s.", q, p, pick(CITY, uniform("city", key))),
        "name": F.concat_ws(" ", pick(FIRST, uniform("first", key)), pick(LAST, uniform("last", key))),
    }[role]


def inline_table(spark, columns: str, data: list[tuple]) -> DataFrame:
    """A reference table of given rows (G-25)."""
    return spark.createDataFrame(data, columns)


def null_if(df: DataFrame, column: str, on: str, values: list) -> DataFrame:
    """Null where a sibling has one of the values (G-26)."""
    return df.withColumn(column, F.when(F.col(on).isin(values), F.lit(None)).otherwise(F.col(column)))


def impose_correlation(df: DataFrame, a: str, b: str, rho: float, key: str) -> DataFrame:
    """b dealt anew so that its ranks follow a's with about rho; both marginals stay (G-27)."""
    from lookalike.sources.ranges import ranked

    if not -1 < rho < 1:
        return df
    za = ranked(df.select(key, a), [a, key], "_ra")
    n = df.count()
    score = rho * F.sqrt(F.lit(12.0)) * (F.col("_ra") / n - 0.5) + math.sqrt(1 - rho * rho) * normal(f"corr:{a}:{b}", key)
    target = ranked(za.withColumn("_s", score), ["_s", key], "_r").select(key, "_r")
    values = ranked(df.select(b, key), [b, key], "_r").select(F.col(b).alias("_b"), "_r")
    return df.join(target.join(values, "_r").select(key, "_b"), key).withColumn(b, F.col("_b")).drop("_b")


_FUNCTIONS = {"abs", "round", "ceil", "floor", "least", "greatest", "sin", "cos", "tan", "ln", "exp", "sqrt", "coalesce", "try_divide"}
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|('[^']*')|([A-Za-z_]\w*)|(<=|>=|<>|!=|==|[-+*/%<>=(),]))")
_WORDS = {"and", "or", "not", "is", "null", "in", "between", "true", "false"}


def safe_expression(text: str, columns: list[str]) -> Column:
    """A row expression of columns, numbers, strings, operators and listed functions; anything
    else is refused (G-28, G-30)."""
    at, out, pending = 0, [], None
    for m in iter(lambda: _TOKEN.match(text, at), None):
        number, string, name, op = m.groups()
        if pending and op != "(":
            raise ValueError(f"{pending} is not a column")
        if name:
            low = name.lower()
            follows = text[m.end() :].lstrip().startswith("(")
            if follows and low in _FUNCTIONS:
                pending = None
            elif follows and low not in ("and", "or", "not", "in"):
                raise ValueError(f"function {name} is not allowed")
            elif low not in _WORDS and name not in columns:
                raise ValueError(f"unknown name {name}")
            out.append(low if low in _WORDS | _FUNCTIONS and name not in columns else f"`{name}`")
        else:
            out.append(number or string or ("=" if op == "==" else op))
        at = m.end()
    if text[at:].strip():
        raise ValueError(f"not allowed: {text[at:].strip()[:20]}")
    return F.expr(" ".join(out))


def formula(df: DataFrame, name: str, text: str) -> DataFrame:
    """A column by a checked formula (G-28)."""
    return df.withColumn(name, safe_expression(text, df.columns))


def formula_lookup(df: DataFrame, name: str, text: str, tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Formula with @table.column: looked up through a key, missing as 0 (G-29).

    tables: name -> (table, its key, the row's key column)."""
    out, used = df, {}
    for table, column in dict.fromkeys(re.findall(r"@(\w+)\.(\w+)", text)):
        side, key, fk = tables[table]
        name_ = f"_{table}_{column}"
        out = out.join(side.select(F.col(key).alias(f"_k{len(used)}"), F.col(column).alias(name_)), F.col(fk) == F.col(f"_k{len(used)}"), "left").drop(f"_k{len(used)}").withColumn(name_, F.coalesce(name_, F.lit(0)))
        used[f"@{table}.{column}"] = name_
    for said, name_ in used.items():
        text = text.replace(said, name_)
    return formula(out, name, text).drop(*used.values())


def derive(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Derived fields; a division by zero gives null (G-30)."""
    out = df
    for name, text in rules.items():
        parts = re.fullmatch(r"\s*([^/]+)/([^/]+)\s*", text)
        value = F.try_divide(safe_expression(parts[1], out.columns), safe_expression(parts[2], out.columns)) if parts else safe_expression(text, out.columns)
        out = out.withColumn(name, value)
    return out


def apply_event(df: DataFrame, where: str, column: str, action: str, amount) -> DataFrame:
    """multiply, add or set where a condition holds (G-31)."""
    c = F.col(column)
    new = {"multiply": c * amount, "add": c + amount, "set": F.lit(amount)}[action]
    return df.withColumn(column, F.when(F.coalesce(safe_expression(where, df.columns), F.lit(False)), new).otherwise(c))


def cascade_event(parent: DataFrame, child: DataFrame, parent_key: str, fk: str, where: str, column: str, value) -> DataFrame:
    """A child column set where the parent meets a condition (G-32)."""
    hit = parent.where(safe_expression(where, parent.columns)).select(F.col(parent_key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return child.join(hit, F.col(fk) == F.col("_k"), "left").withColumn(column, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(column))).drop("_k", "_hit")


def allocate(weights: DataFrame, total: int, by: str = "period", weight: str = "weight") -> DataFrame:
    """Whole units per period that sum exactly to the total: largest remainders (G-35)."""
    s = F.sum(weight).over(Window.partitionBy())
    exact = F.col(weight) / s * total
    j = weights.withColumns({"_f": F.floor(exact + 1e-9).cast("long"), "_r": F.round(exact - F.floor(exact + 1e-9), 9)})
    left = F.lit(total) - F.sum("_f").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("_r"), by))
    return j.withColumn("units", F.col("_f") + (place <= left).cast("long")).drop("_f", "_r")


def fact_rows(plan: DataFrame, lane: str = "fact") -> DataFrame:
    """plan: (period, units, target in cents).  Rows of each period with values that sum exactly to
    its target (G-35): cents by drawn weight, the rest to the largest remainders."""
    last = F.floor((F.col("units") - 1) / BLOCK).cast("long")
    r = plan.where("units > 0").select("period", "units", "target", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_b")).repartition("period", "_b")
    numbers = F.sequence(F.col("_b") * BLOCK + 1, F.least((F.col("_b") + 1) * BLOCK, F.col("units").cast("long")))
    r = r.select("period", "units", "target", F.explode(numbers).alias("row_no"))
    r = r.withColumn("_w", 0.5 + uniform(lane, F.concat_ws("-", F.col("period").cast("string"), F.col("row_no").cast("string"))))
    return _shared_out(r, "period", "_w", "target", "row_no").drop("_w")


def _shared_out(df: DataFrame, by: str, weight: str, target: str, key: str) -> DataFrame:
    """Sums and places of a group of any size are taken in ranges; ``key`` is unique in a group."""
    j = running_sums(df, [by], key, [weight]).withColumn("_e", F.col(weight) / F.col(f"all_{weight}") * F.col(target))
    j = j.withColumn("_f", F.floor(F.col("_e") + 1e-7).cast("long")).withColumn("_r", F.coalesce(-F.round(F.col("_e") - F.col("_f"), 6), F.lit(2.0)))
    j = running_sums(written(j.withColumn("_one", F.lit(1))), [by], ["_r", key], ["_one", "_f"])
    return j.withColumn("cents", F.col("_f") + (F.col("upto__one") <= F.col(target) - F.col("all__f")).cast("long")).select(*df.columns, "cents")


def rebalance_periods(df: DataFrame, period: Column, value: str, targets: DataFrame, key: str) -> DataFrame:
    """Values scaled to their period's exact target in cents, by current weight (G-36)."""
    j = df.withColumn("period", period).join(targets, "period")
    return _shared_out(j, "period", value, "target", key).withColumn(value, F.col("cents") / 100).drop("cents", "target")


def inject_anomalies(df: DataFrame, column: str, key: str, rate: float) -> DataFrame:
    """Rows drawn at a rate get mean plus or minus three to six deviations (G-37)."""
    m, s = df.agg(F.avg(column), F.stddev_samp(column)).first()
    u = uniform(f"anomaly:{column}", key)
    size = 3 + 3 * uniform(f"anomaly:{column}:size", key)
    sign = F.when(uniform(f"anomaly:{column}:sign", key) < 0.5, -1.0).otherwise(1.0)
    return df.withColumn("is_anomaly", u < rate).withColumn(column, F.when(F.col("is_anomaly"), F.lit(m or 0.0) + sign * size * F.lit(s or 0.0)).otherwise(F.col(column)))


def noise_nulls(df: DataFrame, columns: list[str], key: str, rate: float) -> DataFrame:
    """Nulls at a rate (G-38)."""
    return df.withColumns({c: F.when(uniform(f"noise:null:{c}", key) < rate, F.lit(None)).otherwise(F.col(c)) for c in columns})


def noise_outliers(df: DataFrame, column: str, key: str, rate: float) -> DataFrame:
    """Mean plus five deviations times (1 + u), either sign (G-39)."""
    m, s = df.agg(F.avg(column), F.stddev_samp(column)).first()
    sign = F.when(uniform(f"noise:sign:{column}", key) < 0.5, -1.0).otherwise(1.0)
    v = F.lit(m or 0.0) + sign * 5 * F.lit(s or 0.0) * (1 + uniform(f"noise:size:{column}", key))
    return df.withColumn(column, F.when(uniform(f"noise:outlier:{column}", key) < rate, v).otherwise(F.col(column)))


def noise_typos(df: DataFrame, column: str, key: str, rate: float) -> DataFrame:
    """Swap, delete, double or flip the case of one character (G-40)."""
    c, n = F.col(column), F.char_length(column)
    p = (F.floor(uniform(f"typo:at:{column}", key) * n) + 1).cast("int")
    head, one, tail = F.substr(c, F.lit(1), p - 1), F.substr(c, p, F.lit(1)), F.substr(c, p + 1)
    swapped = F.concat(head, F.substr(c, p + 1, F.lit(1)), one, F.substr(c, p + 2))
    flipped = F.concat(head, F.when(one == F.lower(one), F.upper(one)).otherwise(F.lower(one)), tail)
    k = F.floor(uniform(f"typo:kind:{column}", key) * 4)
    new = F.when(k == 0, swapped).when(k == 1, F.concat(head, tail)).when(k == 2, F.concat(head, one, one, tail)).otherwise(flipped)
    return df.withColumn(column, F.when((n > 1) & (uniform(f"typo:{column}", key) < rate), new).otherwise(c))


def noise_duplicates(df: DataFrame, key: str, rate: float, jitter: str | None = None) -> DataFrame:
    """Rows drawn at a rate are appended again, a number moved by up to 1 % if asked (G-41)."""
    again = df.where(uniform("noise:dup", key) < rate)
    if jitter:
        again = again.withColumn(jitter, F.round(F.col(jitter) * (0.99 + 0.02 * uniform("noise:dup:jitter", key)), 2))
    return df.unionByName(again)


def temporal_drift(df: DataFrame, value: str, when: str, rate: float) -> DataFrame:
    """Values times 1 + rate times the share of the time span gone by (G-42)."""
    s = F.unix_timestamp(F.col(when).cast("timestamp"))
    lo, hi = df.agg(F.min(s), F.max(s)).first()
    return df.withColumn(value, F.col(value) * (1 + rate * (s - F.lit(lo)) / F.lit(max((hi or 0) - (lo or 0), 1))))


def noise(df: DataFrame, key: str, mode: str, rate: float, columns: dict[str, list[str]]) -> DataFrame:
    """off; analytics_safe (nulls and outliers, no key, no duplicates); custom (all) (G-43)."""
    if mode == "off":
        return df
    out = noise_nulls(df, [c for c in columns.get("nulls", []) if c != key], key, rate)
    for c in columns.get("outliers", []):
        out = noise_outliers(out, c, key, rate)
    if mode == "custom":
        for c in columns.get("typos", []):
            out = noise_typos(out, c, key, rate)
        out = noise_duplicates(out, key, rate)
    return out


def customize(df: DataFrame, key: str, overrides: dict[str, dict]) -> DataFrame:
    """Per column: pool of values, map of a sibling, expression, null rate (G-44)."""
    out = df
    for c, o in overrides.items():
        v = F.col(c) if c in df.columns else F.lit(None)
        if "pool" in o:
            v = pick(o["pool"], uniform(f"pool:{c}", key))
        if "map" in o:
            on, table = o["map"]
            v = gen_dependent(F.col(on), table, f"map:{c}", key, o.get("default"))
        if "expression" in o:
            v = safe_expression(o["expression"], out.columns)
        if "null_rate" in o:
            v = F.when(uniform(f"null:{c}", key) < o["null_rate"], F.lit(None)).otherwise(v)
        out = out.withColumn(c, v)
    return out


#: Named column profiles (G-45).
PROFILES = {
    "age": {"distribution": "normal", "mean": 38, "std": 14, "min": 18, "max": 90, "decimals": 0},
    "salary": {"distribution": "lognormal", "mean": 60000, "std": 30000, "min": 15000, "max": 500000},
    "rating": {"distribution": "choices", "choices": [1.0, 2.0, 3.0, 4.0, 5.0], "weights": [1, 1, 2, 5, 6]},
    "wait": {"distribution": "exponential", "scale": 12.0, "max": 240},
    "price": {"distribution": "pareto", "alpha": 2.5, "scale": 5.0, "max": 2000},
}


# Named profiles: family, parameters, least and largest value, decimals (G-45).
# Components of a mixture are (mean, deviation, weight).
NAMED_PROFILES = {
    "age_adult": ("mixture", [(28, 6, 0.3), (42, 10, 0.45), (62, 8, 0.25)], 18, 100, 0),
    "age_population": ("mixture", [(8, 4, 0.15), (25, 8, 0.25), (42, 12, 0.35), (68, 10, 0.25)], 0, 105, 0),
    "salary_usd": ("lognormal", (11.0, 0.5), 25000, 500000, 0),
    "salary_tech": ("mixture", [(75000, 15000, 0.2), (120000, 25000, 0.4), (180000, 40000, 0.3), (280000, 60000, 0.1)], 50000, 600000, 0),
    "price_retail": ("lognormal", (3.5, 1.2), 0.99, 10000, 2),
    "price_saas": ("mixture", [(15, 5, 0.3), (49, 15, 0.4), (199, 50, 0.25), (999, 200, 0.05)], 0, 5000, 0),
    "transaction_amount": ("pareto", (2.5, 10.0), 1, 100000, 2),
    "order_quantity": ("zipf", 2.0, 1, 100, 0),
    "session_duration_seconds": ("lognormal", (5.5, 1.5), 1, 7200, 0),
    "rating_5star": ("beta", (5, 2, 5), 1, 5, 1),
    "nps_score": ("mixture", [(3, 2, 0.15), (7, 1, 0.25), (9, 0.8, 0.6)], 0, 10, 0),
    "conversion_rate": ("beta", (2, 50, 100), 0, 100, 2),
    "churn_rate": ("beta", (1.5, 30, 100), 0, 100, 2),
}


def zipf_weights(alpha: float, most: int) -> list[float]:
    """Shares of 1 to ``most`` of the powers k ** -alpha, what lies beyond being at ``most``."""
    head = [k**-alpha for k in range(1, most)]
    tail = most ** (1 - alpha) / (alpha - 1) + most**-alpha / 2 + alpha * most ** (-alpha - 1) / 12  # Euler and Maclaurin
    return [*head, tail]


def gamma_draw(shape: float, lane: str, key: str = "row_id") -> Column:
    """Gamma draw of a whole or half shape: a sum of exponential draws, and half a squared normal one."""
    whole = [-F.log(1 - uniform(f"{lane}:{i}", key)) for i in range(int(shape))]
    parts = whole + ([normal(f"{lane}:half", key) * normal(f"{lane}:half", key) / 2] if shape % 1 else [])
    return sum(parts[1:], parts[0])


def profile_column(name: str, key: str = "row_id") -> Column:
    """A named profile (G-45); 'income' mixes two."""
    if name == "income":
        low = gen_float({"distribution": "normal", "mean": 30000, "std": 6000, "min": 0}, "income:low", key)
        high = gen_float({"distribution": "normal", "mean": 110000, "std": 25000, "min": 0}, "income:high", key)
        return F.when(uniform("income:mix", key) < 0.8, low).otherwise(high)
    if name not in NAMED_PROFILES:
        return gen_float(PROFILES[name], f"profile:{name}", key)
    family, said, least, most, decimals = NAMED_PROFILES[name]
    lane = f"profile:{name}"
    if family == "mixture":
        at = weighted(list(range(len(said))), [w for *_, w in said], uniform(f"{lane}:part", key))
        part = lambda i: F.element_at(F.array(*[F.lit(float(c[i])) for c in said]), at + 1)
        value = part(0) + part(1) * normal(lane, key)
    elif family == "lognormal":
        value = F.exp(said[0] + said[1] * normal(lane, key))
    elif family == "pareto":
        value = said[1] * F.pow(1 - uniform(lane, key), F.lit(-1 / said[0]))
    elif family == "zipf":
        value = weighted([float(k) for k in range(1, most + 1)], zipf_weights(said, most), uniform(lane, key))
    else:
        x, y = gamma_draw(said[0], f"{lane}:a", key), gamma_draw(said[1], f"{lane}:b", key)
        value = said[2] * x / (x + y)
    return F.round(F.least(F.greatest(value, F.lit(float(least))), F.lit(float(most))), decimals)


def series_panel(keys: DataFrame, key: str, n: int, level: float, slope: float, amplitude: float, period: int, sd: float, floor: float = 0.0, anomaly: float = 0.0) -> DataFrame:
    """A series per key: level, trend, season, noise, anomalies, floor (G-46)."""
    r = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step"))
    k = F.concat_ws("-", F.col(key).cast("string"), F.col("step").cast("string"))
    v = level + slope * F.col("step") + amplitude * F.sin(2 * F.pi() * F.col("step") / period) + sd * normal("series", k)
    v = F.when(uniform("series:anomaly", k) < anomaly, v * 3).otherwise(v)
    return r.withColumn("value", F.round(F.greatest(v, F.lit(floor)), 4))


def plan_rows(base: int, edges: list[tuple[str, str, float]], roots: list[str], reference: dict[str, int]) -> dict[str, int]:
    """Row counts: roots have the base, children the largest parent count times its multiplier (G-23)."""
    out = {t: base for t in roots} | reference
    for _ in range(len(edges) + 1):
        for parent, child, factor in edges:
            if parent in out and child not in reference:
                out[child] = max(out.get(child, 10), min(int(out[parent] * factor), 100 * base))
    return out


def mimic(df: DataFrame, n: int, key_column: str) -> DataFrame:
    """Profile, spec and look-alike rows in one call (B-35, B-36)."""
    from lookalike.operators import profile as P
    from lookalike.operators.models import sample_copula, fit_copula

    numbers = [c for c in P.numeric_columns(df) if c != key_column]
    out = sample_copula(df.sparkSession, fit_copula(df, numbers), n, "mimic") if numbers else rows(df.sparkSession, n)
    freq = P.fit_categorical(df, P.string_columns(df)).collect() if P.string_columns(df) else []
    for c in P.string_columns(df):
        held = [(r.value, r.probability) for r in freq if r.column_name == c]
        if held and len(held) < 50:
            out = out.withColumn(c, weighted([v for v, _ in held], [p for _, p in held], uniform(f"mimic:{c}", "row_id")))
        else:
            out = out.withColumn(c, gen_text("name"))
    return out.withColumn(key_column, F.col("row_id") + 1).drop("row_id")


def spec_from_profile(df: DataFrame) -> DataFrame:
    """(column_name, kind, distribution, minimum, maximum) (B-35)."""
    from lookalike.operators import profile as P

    kinds = P.column_kind(df)
    fitted = P.fit_numeric(df, P.numeric_columns(df))
    dist = F.when(F.col("kind") == "id_like", "sequence").when(F.col("kind") == "categorical", "choices").when(F.col("kind") == "numeric", F.col("distribution")).otherwise("uniform")
    num = F.col("kind") == "numeric"
    return kinds.join(fitted, "column_name", "left").select("column_name", "kind", dist.alias("distribution"), F.when(num, F.col("minimum")).alias("minimum"), F.when(num, F.col("maximum")).alias("maximum"))


