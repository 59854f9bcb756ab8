"""Global order without a task that sees all rows: ranges with bounds kept as data, ranks, running sums.

The bounds of the ranges are sampled once, sorted and written into the plan as a literal.  A row's
range is therefore a pure function of its order columns: whatever branch of a plan computes it, over
whatever columns, with whatever number of partitions, the answer is the same.  Sizes and offsets can
so be taken in one branch and rows in another.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges for each shuffle partition, so that hashing ranges to partitions evens out; sampled keys for each range.
PER_PARTITION, SAMPLED = 4, 20
#: Letters of a text in a bound.
CUT = 200


class Ranges:
    """Cuts of the order of a table.  ``of`` gives a row's range, 0 to ``size``, rising with the order
    (nulls first, NaN last, as Spark sorts)."""

    def __init__(self, df: DataFrame, order: list[str], parts: int | None = None):
        self.order = order
        keys = df.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
        parts = parts or PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bounds = self._sampled(keys, parts)
        self.size = len(bounds)
        read = F.from_json(F.lit(json.dumps(bounds)), f"array<struct<{', '.join(f'{c}: string' for c in keys.columns)}>>")
        self.bounds = F.sort_array(read.cast(T.ArrayType(T.StructType([T.StructField(f.name, f.dataType) for f in keys.schema]))))

    @staticmethod
    def _sampled(keys: DataFrame, parts: int) -> list[dict]:
        """Keys as texts.  Any bounds are right, so long texts are cut; good ones are quantiles of a sample."""
        n = keys.count()
        if n <= parts:
            return []
        drawn = F.pmod(F.xxhash64(F.lit(n), *keys.columns), F.lit(1 << 20)) < F.lit((SAMPLED * parts << 20) // n)
        texts = [F.substring(c, 1, CUT).alias(c) if isinstance(keys.schema[c].dataType, T.StringType) else F.col(c).cast("string") for c in keys.columns]
        rows = [r.asDict() for r in keys.where(drawn).limit(2 * SAMPLED * parts).orderBy(*keys.columns).select(*texts).collect()]
        found = [rows[len(rows) * i // parts] for i in range(1, parts)] if rows else []
        return [b for b, before in zip(found, [None, *found], strict=False) if b != before]

    def of(self) -> Column:
        """The number of bounds that are not above the row's key, by binary search."""
        if not self.size:
            return F.lit(0)
        key = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(self.order)])
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(self.size.bit_length()))])

        def search(k: Column) -> Column:
            reach = lambda at, step: (at + step <= F.lit(self.size)) & (F.get(self.bounds, at + step - 1) <= k)
            return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reach(at, step), at + step).otherwise(at))

        return F.get(F.transform(F.array(key), search), 0)  # the key is made once a row, not once a step


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Global row number: the row's number in its range and the sizes of the ranges before.

    Equal keys must not occur in ``order``, or ranks among them are arbitrary."""
    parts = df.withColumn("__part", Ranges(df, order).of())
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))  # a row for each range
    placed = parts.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    joined = placed.join(F.broadcast(before), F.col("__part") == F.col("__p"))
    return joined.select(*df.columns, (F.col("__row") + F.col("__before")).alias(name))


def ranked_in(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Row number in each group; a group of any size is cut at ranges.  Keys as in ``ranked``."""
    return running_sums(df.withColumn("__one", F.lit(1)), by, order, ["__one"]).withColumnRenamed("upto___one", name).drop("__one", "all___one")


def running_sums(df: DataFrame, by: list[str], order: str | list[str], values: list[str]) -> DataFrame:
    """Adds upto_<value>, the sum of the group's values up to this row in order, and all_<value>, the
    group's total.

    Ranges run over (group, order), so small groups share a range and large ones are cut at several.
    Only groups that a bound cuts need anything from other ranges: two for each range at most, which
    is what is broadcast.  ``order`` is unique in a group."""
    order = [order] if isinstance(order, str) else order
    parts = df.withColumn("__part", Ranges(df, [*by, *order]).of())
    group = Window.partitionBy("__part", *by)
    whole = {f"__all_{v}": F.sum(v).over(group) for v in values}
    upto = {f"__upto_{v}": F.sum(v).over(group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) for v in values}
    placed = parts.withColumns(upto | whole)
    sums = parts.groupBy("__part", *by).agg(*[F.sum(v).alias(v) for v in values])
    # a group lies in consecutive ranges: it is cut if it ends one range and begins the next
    edge = F.struct(*by) if by else F.lit(0)
    ends = sums.groupBy("__part").agg(F.min(edge).alias("lo"), F.max(edge).alias("hi")).withColumns({"next": F.lead("lo").over(Window.orderBy("__part")), "last": F.lag("hi").over(Window.orderBy("__part"))})
    keys = [F.col(c).alias(f"__by_{c}") for c in by]
    held = sums.withColumn("__edge", edge).join(F.broadcast(ends.withColumnRenamed("__part", "__e")), (F.col("__part") == F.col("__e")) & (F.col("__edge").eqNullSafe(F.col("next")) | F.col("__edge").eqNullSafe(F.col("last"))))
    cut = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = cut.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(F.col("__part").alias("__p"), *keys, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"__before_{v}") for v in values], *[F.sum(v).over(cut).alias(f"__total_{v}") for v in values])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by], F.col("__part") == F.col("__p"))
    joined = placed.join(F.broadcast(before), same, "left")
    more = [e for v in values for e in ((F.col(f"__upto_{v}") + F.coalesce(f"__before_{v}", F.lit(0))).alias(f"upto_{v}"), F.coalesce(f"__total_{v}", f"__all_{v}").alias(f"all_{v}"))]
    return joined.select(*df.columns, *more)
