"""Constraints, distribution rules, duplicate repair and linked fields (G-50 to G-87)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookalike.functions.rng import pick, uniform
from lookalike.operators.generate import safe_expression
from lookalike.sources.ranges import ranked


def clip_range(df: DataFrame, c: str, lo=None, hi=None) -> DataFrame:
    """Values into a range (G-50)."""
    v = F.col(c)
    v = F.when(v < lo, F.lit(lo)).otherwise(v) if lo is not None else v
    return df.withColumn(c, F.when(v > hi, F.lit(hi)).otherwise(v) if hi is not None else v)


def range_violations(df: DataFrame, c: str, lo, hi) -> DataFrame:
    return df.agg(F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias("violations"))


def cap_sum(df: DataFrame, c: str, most: float, by: list[str]) -> DataFrame:
    """Groups whose sum is over the cap are scaled to it (G-51); sums are joined, so a hot group
    is aggregated before it is shuffled."""
    s = df.groupBy(*by).agg(F.sum(c).alias("_s"))
    return df.join(s, by).withColumn(c, F.when(F.col("_s") > most, F.col(c) * most / F.col("_s")).otherwise(F.col(c))).drop("_s")


def drop_past_cap(df: DataFrame, c: str, most: float, by: list[str], order: list[str]) -> DataFrame:
    """Rows until the running sum of their group passes the cap (G-51)."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_s", F.sum(c).over(upto)).where(F.col("_s") <= most).drop("_s")


def clip_group(df: DataFrame, c: str, lo=None, hi=None) -> DataFrame:
    """Max or min per group: a clip of each row (G-52)."""
    return clip_range(df, c, lo, hi)


def unique_combination(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The first row of each combination (G-53)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*columns).orderBy(*order))).where("_r = 1").drop("_r")


def not_null(df: DataFrame, c: str, fill=None) -> DataFrame:
    """Nulls filled, or their rows dropped (G-54)."""
    return df.where(F.col(c).isNotNull()) if fill is None else df.withColumn(c, F.coalesce(F.col(c), F.lit(fill)))


def largest_remainder(total: int, shares: dict) -> dict:
    """Whole counts that sum to the total, the rest to the largest fractions."""
    whole = sum(shares.values())
    exact = {k: total * v / whole for k, v in shares.items()}
    out = {k: int(x + 1e-9) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (-(exact[k] - out[k]), str(k)))[: total - sum(out.values())]:
        out[k] += 1
    return out


def force_ratio(df: DataFrame, c: str, ratios: dict, key: str) -> DataFrame:
    """Exactly the given shares of values, dealt in seeded order (G-55)."""
    counts = largest_remainder(df.count(), ratios)
    r = ranked(df.withColumn("_u", uniform(f"ratio:{c}", key)), ["_u", key], "_rank")
    out, upto = None, 0
    for v, n in counts.items():
        upto += n
        out = F.when(F.col("_rank") <= upto, F.lit(v)) if out is None else out.when(F.col("_rank") <= upto, F.lit(v))
    return r.withColumn(c, out).drop("_u", "_rank")


def order_dates(df: DataFrame, a: str, b: str, gap_days: int = 0) -> DataFrame:
    """a before b: inverted pairs are swapped, then b is at least gap days later (G-56)."""
    first, last = F.least(a, b), F.greatest(a, b)
    return df.withColumns({a: F.when(F.col(a).isNull() | F.col(b).isNull(), F.col(a)).otherwise(first), b: F.when(F.col(a).isNull() | F.col(b).isNull(), F.col(b)).otherwise(F.greatest(last, F.date_add(first, gap_days)))})


def enforce_ineq(df: DataFrame, a: str, op: str, b: str) -> DataFrame:
    """a OP b: where it does not hold, a becomes b moved by 1 % of |b| (G-57)."""
    x, y = F.col(a), F.col(b)
    step = F.greatest(F.abs(y) * 0.01, F.lit(1e-6))
    holds, new = {">": (x > y, y + step), ">=": (x >= y, y), "<": (x < y, y - step), "<=": (x <= y, y)}[op]
    return df.withColumn(a, F.when(holds | x.isNull() | y.isNull(), x).otherwise(new))


def clip_between(df: DataFrame, c: str, lo: str, hi: str) -> DataFrame:
    """A column between two others (G-58)."""
    return df.withColumn(c, F.least(F.greatest(c, lo), F.col(hi)))


def enforce_enum(df: DataFrame, c: str, allowed: list) -> DataFrame:
    """Anything else becomes the first allowed value; nulls stay (G-59)."""
    return df.withColumn(c, F.when(F.col(c).isNull() | F.col(c).isin(allowed), F.col(c)).otherwise(F.lit(allowed[0])))


def require_when(df: DataFrame, c: str, where: str) -> DataFrame:
    """Filled with the mode where a condition asks for a value (G-60)."""
    from lookalike.operators.clean import mode_of

    return df.withColumn(c, F.when(F.col(c).isNull() & F.coalesce(safe_expression(where, df.columns), F.lit(False)), F.lit(mode_of(df, c))).otherwise(F.col(c)))


def unique_numbers(df: DataFrame, c: str, key: str) -> DataFrame:
    """Repeats of a number become max + 1, max + 2, ... (G-60, G-70)."""
    top = df.agg(F.max(c)).first()[0] or 0
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy(c).orderBy(key)))
    again = ranked(r.where(F.col("_r") > 1).select(F.col(key).alias("_k")), ["_k"], "_n")
    return r.join(again, r[key] == F.col("_k"), "left").withColumn(c, F.when(F.col("_n").isNotNull(), F.lit(top) + F.col("_n")).otherwise(F.col(c))).drop("_r", "_k", "_n")


def unique_texts(df: DataFrame, columns: list[str], c: str, key: str) -> DataFrame:
    """The n-th repeat of a combination gets the suffix __n (G-60, G-70)."""
    r = F.row_number().over(Window.partitionBy(*columns).orderBy(key))
    return df.withColumn("_r", r).withColumn(c, F.when(F.col("_r") > 1, F.concat(F.col(c), F.lit("__"), (F.col("_r") - 1).cast("string"))).otherwise(F.col(c))).drop("_r")


def repair_rows(df: DataFrame, rules: list[dict]) -> DataFrame:
    """later: a >= b; assign: column = expression; required: value where a condition holds (G-60)."""
    out = df
    for r in rules:
        if r["kind"] == "later":
            out = enforce_ineq(out, r["column"], ">=", r["than"])
        elif r["kind"] == "assign":
            out = out.withColumn(r["column"], safe_expression(r["expression"], out.columns))
        elif r["kind"] == "required":
            out = require_when(out, r["column"], r["where"])
        else:
            raise ValueError(r["kind"])
    return out


def compile_constraints(profile: DataFrame, keys: list[str]) -> DataFrame:
    """(column_name, rule, argument) from keys and a profile with column_name, inferred_dtype,
    minimum, maximum, distinct_count (G-61)."""
    num = F.col("inferred_dtype").isin("integer", "float")
    rules = F.array(
        F.when(F.col("column_name").isin(keys), F.struct(F.lit("unique").alias("rule"), F.lit("").alias("argument"))),
        F.when(num & F.col("minimum").isNotNull(), F.struct(F.lit("range").alias("rule"), F.concat_ws("..", F.col("minimum").cast("long").cast("string"), F.ceil("maximum").cast("long").cast("string")).alias("argument"))),
        F.when((F.col("inferred_dtype") == "string") & (F.col("distinct_count") <= 20), F.struct(F.lit("enum").alias("rule"), F.col("distinct_count").cast("string").alias("argument"))),
    )
    return profile.select("column_name", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("r")).select("column_name", "r.*")


def check_rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, violations, compliance); what cannot be evaluated is a violation (G-62)."""
    ok = {n: F.coalesce(safe_expression(e, df.columns), F.lit(False)) for n, e in rules.items()}
    wide = df.agg(F.count("*").alias("_n"), *[F.count_if(~x).alias(f"v{i}") for i, x in enumerate(ok.values())])
    return wide.select("_n", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"v{i}").alias("violations")) for i, n in enumerate(ok)])).alias("r")).select("r.*", F.round(1 - F.try_divide(F.col("r.violations"), "_n"), 6).alias("compliance"))


def reject_rows(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that meet every rule (G-63)."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(safe_expression(e, df.columns), F.lit(False)) for e in rules.values()]))


@dataclass(frozen=True)
class PercentRule:
    """percent of the rows (in scope) have column OP value; others take an alternate (G-64..G-67)."""

    column: str
    op: str
    value: object
    percent: float
    alternates: tuple = ()

    def holds(self) -> Column:
        c, v = F.col(self.column), F.lit(self.value)
        return F.coalesce({"=": c == v, "<>": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[self.op], F.lit(False))

    def check(self, df: DataFrame, protected: tuple = ()) -> None:
        """Refuses unknown or protected columns and percentages out of range (G-69)."""
        if self.column not in df.columns or self.column in protected:
            raise ValueError(f"column {self.column} cannot take a rule")
        if not 0 <= self.percent <= 100:
            raise ValueError("a percentage is from 0 to 100")

    def target(self, n: int) -> int:
        return int(self.percent * n / 100 + 0.5)

    def alternate(self, key: str) -> Column:
        """A value for rows that the rule is not to hold for."""
        return pick(list(self.alternates), uniform(f"rule:alt:{self.column}", key)) if self.alternates else F.lit(None)

    def meet(self) -> Column:
        """A value for which the rule holds."""
        return F.lit({">": lambda v: v + 1, "<": lambda v: v - 1}.get(self.op, lambda v: v)(self.value)) if self.op != "<>" else F.lit(self.alternates[0])


def apply_percent_rule(df: DataFrame, rule: PercentRule, key: str, exact: bool = True, scope: Column | None = None) -> DataFrame:
    """Exactly round(P n) rows of the scope meet the rule, rows that do already first; without
    exact, only more are made to (G-64, G-65)."""
    rule.check(df, (key,))
    inside = F.coalesce(scope, F.lit(False)) if scope is not None else F.lit(True)
    j = df.withColumns({"_in": inside, "_ok": rule.holds(), "_u": uniform(f"rule:{rule.column}", key)})
    n, have = j.where("_in").agg(F.count("*"), F.count_if("_ok")).first()
    want = rule.target(n) if exact else max(have, rule.target(n))
    r = ranked(j.where("_in").select(F.col(key).alias("_k"), (~F.col("_ok")).cast("int").alias("_late"), "_u"), ["_late", "_u", "_k"], "_rank").select("_k", "_rank")
    j = j.join(r, j[key] == F.col("_k"), "left")
    hit = F.col("_rank") <= want
    new = F.when(~F.col("_in"), F.col(rule.column)).when(hit & ~F.col("_ok"), rule.meet()).when(~hit & F.col("_ok"), rule.alternate(key)).otherwise(F.col(rule.column))
    return j.withColumn(rule.column, new).select(*df.columns)


def linked(child: DataFrame, fk: str, parent: DataFrame, parent_key: str, where: str) -> DataFrame:
    """Child rows with _linked: whether their parent meets a condition (G-66)."""
    good = parent.where(safe_expression(where, parent.columns)).select(F.col(parent_key).alias("_pk")).distinct().withColumn("_linked", F.lit(True))
    return child.join(good, F.col(fk) == F.col("_pk"), "left").withColumn("_linked", F.coalesce("_linked", F.lit(False))).drop("_pk")


def apply_cross_rule(child: DataFrame, fk: str, parent: DataFrame, parent_key: str, where: str, rule: PercentRule, key: str) -> DataFrame:
    """A percent rule among children of parents that meet a condition (G-66)."""
    j = linked(child, fk, parent, parent_key, where)
    return apply_percent_rule(j, rule, key, scope=F.col("_linked")).select(*child.columns)


def apply_lift_rule(df: DataFrame, where: str, column: str, value, multiplier: float, key: str) -> DataFrame:
    """Rows of a condition are so many times likelier to have a value, 99 % at most (G-67)."""
    cond = F.coalesce(safe_expression(where, df.columns), F.lit(False))
    rate = df.where(~cond).agg(F.avg((F.col(column) == value).cast("double"))).first()[0] or 0.0
    rule = PercentRule(column, "=", value, min(rate * multiplier, 0.99) * 100)
    return apply_percent_rule(df, rule, key, exact=False, scope=cond)


def evaluate_rules(df: DataFrame, rules: list[PercentRule], exact: bool = True) -> DataFrame:
    """(rule, target, actual percentage, passed): within a quarter point or the exact count (G-68)."""
    wide = df.agg(F.count("*").alias("n"), *[F.count_if(r.holds()).alias(f"h{i}") for i, r in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(f"{r.column} {r.op} {r.value}").alias("rule"), F.lit(float(r.percent)).alias("target"), F.col(f"h{i}").alias("hits"), F.floor(F.col("n") * (r.percent / 100) + 0.5).alias("want")) for i, r in enumerate(rules)])
    out = wide.select("n", F.explode(rows).alias("r")).select("r.rule", "r.target", F.round(F.try_divide(F.col("r.hits") * 100.0, "n"), 4).alias("actual"), (F.col("r.hits") == F.col("r.want")).alias("same"))
    near = F.coalesce(F.abs(F.col("actual") - F.col("target")) <= 0.25, F.lit(False))
    return out.select("rule", "target", "actual", (F.col("same") | near).alias("passed"))


def chunk_target(percent: float, total: int, start: int, end: int) -> int:
    """Rows of a chunk that meet a rule so that the chunks together are exact (J-05)."""
    goal = percent * total / 100
    whole = lambda x: int(x + 0.5)
    return whole(goal * end / total) - whole(goal * start / total) if total else 0


def repair_duplicates(df: DataFrame, unique: dict[str, str], fingerprint: list[str], movable: str, key: str, rounds: int = 3) -> DataFrame:
    """Unique columns get new values; rows with a repeated business fingerprint move a safe number,
    a bounded number of times; other columns are never touched (G-70).  unique: column -> number | text."""
    out = df
    for c, kind in unique.items():
        out = unique_numbers(out, c, key) if kind == "number" else unique_texts(out, [c], c, key)
    for k in range(1, rounds + 1):
        r = F.row_number().over(Window.partitionBy(*fingerprint).orderBy(key))
        out = out.withColumn("_r", r).withColumn(movable, F.when(F.col("_r") > 1, F.col(movable) + (F.col("_r") - 1) * 0.01 * k).otherwise(F.col(movable))).drop("_r")
    return out


def duplicate_density(df: DataFrame, columns: list[str], fingerprint: list[str]) -> DataFrame:
    """(subject, share, advisory): top value 15 % or more, repeated fingerprints 10 % or more, from 50 rows (G-71)."""
    from lookalike.operators.profile import unpivoted

    n = df.count()
    top = unpivoted(df, columns).groupBy("column_name", "value").count().groupBy("column_name").agg(F.max("count").alias("c"))
    a = top.select(F.col("column_name").alias("subject"), F.round(F.col("c") / F.lit(max(n, 1)), 6).alias("share"), F.lit(0.15).alias("limit"))
    b = df.groupBy(*fingerprint).count().agg(F.round(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)) / F.lit(max(n, 1)), 6).alias("share")).select(F.lit("fingerprint").alias("subject"), "share", F.lit(0.10).alias("limit"))
    return a.unionByName(b).select("subject", "share", ((F.col("share") >= F.col("limit")) & F.lit(n >= 50)).alias("advisory"))


# --- linked fields: each rewrites one column from its siblings


def fix_date_order(df: DataFrame, first: str, last: str, key: str, most_days: int = 30) -> DataFrame:
    """A later date that is too early is drawn after the first (G-80)."""
    days = (1 + F.floor(uniform(f"order:{last}", key) * most_days)).cast("int")
    return df.withColumn(last, F.when(F.col(last) < F.col(first), F.date_add(F.col(first), days)).otherwise(F.col(last)))


def fix_status_dates(df: DataFrame, status: str, final: list[str], date: str, fallback: str) -> DataFrame:
    """A final status has a date, others have none (G-81)."""
    return df.withColumn(date, F.when(F.col(status).isin(final), F.coalesce(F.col(date), F.col(fallback))).otherwise(F.lit(None)))


def fix_prices(df: DataFrame, cost: str, price: str, discount: str | None = None) -> DataFrame:
    """Cost under price (at most 80 % of it where it was not), discount at most 30 % (G-82)."""
    out = df.withColumn(cost, F.when(F.col(cost) >= F.col(price), F.round(F.col(price) * 0.8, 2)).otherwise(F.col(cost)))
    return out.withColumn(discount, F.least(discount, F.lit(0.3))) if discount else out


def fix_line_totals(df: DataFrame, total: str, quantity: str, price: str, discount: str) -> DataFrame:
    """Total of a line: quantity times price less discount, not negative (G-83)."""
    return df.withColumn(total, F.greatest(F.lit(0.0), F.col(quantity) * F.col(price) * (1 - F.coalesce(F.col(discount), F.lit(0.0)))))


def fix_order_totals(orders: DataFrame, lines: DataFrame, key: str, fk: str, total: str, amount: str) -> DataFrame:
    """Order totals from their lines; orders without lines keep theirs (G-83)."""
    s = lines.groupBy(F.col(fk).alias("_k")).agg(F.sum(amount).alias("_s"))
    return orders.join(s, orders[key] == F.col("_k"), "left").withColumn(total, F.coalesce("_s", F.col(total))).drop("_k", "_s")


def map_plan_price(df: DataFrame, plan: str, price: str, prices: dict[str, float]) -> DataFrame:
    """Price by plan; unknown plans keep theirs (G-84)."""
    m = F.create_map(*[F.lit(x) for kv in prices.items() for x in kv])
    return df.withColumn(price, F.coalesce(m[F.col(plan)], F.col(price)))


def derive_handles(df: DataFrame, name: str) -> DataFrame:
    """username, slug and email from a name (G-85)."""
    low = F.lower(F.trim(F.col(name)))
    user = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "."), r"^\.+|\.+$", "")
    slug = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return df.withColumns({"username": user, "slug": slug, "email": F.concat(user, F.lit("@example.com"))})


def fix_geography(df: DataFrame, country: str, city: str, valid: DataFrame, key: str) -> DataFrame:
    """A city that is not of the row's country is drawn from the country's (G-86).
    valid: (country, city), compared without case."""
    held = valid.groupBy(F.lower("country").alias("_c")).agg(F.array_sort(F.collect_set("city")).alias("_cities"))
    j = df.join(held, F.lower(F.trim(country)) == F.col("_c"), "left")
    known = F.exists("_cities", lambda x: F.lower(x) == F.lower(F.trim(city)))
    new = F.element_at("_cities", (F.floor(uniform(f"city:{city}", key) * F.size("_cities")) + 1).cast("int"))
    return j.withColumn(city, F.when(F.col("_cities").isNull() | known, F.col(city)).otherwise(new)).drop("_c", "_cities")


def fix_role_age(df: DataFrame, title: str, age: str, floors: dict[str, int]) -> DataFrame:
    """Age at least what a title asks for, by a word of it (G-87)."""
    floor = F.greatest(*[F.when(F.lower(title).contains(k), v).otherwise(0) for k, v in floors.items()], F.lit(0))
    return df.withColumn(age, F.greatest(F.col(age), floor))
