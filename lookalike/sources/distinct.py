"""Distinct values of all columns in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _met(df: DataFrame) -> DataFrame:
    """(at, a, b, n): places of columns, 128-bit hashes of their non-null values, occurrences in an
    Arrow batch."""
    names = df.columns
    hashes = [e.alias(f"{side}{i}") for i, c in enumerate(names) for side, e in (("a", F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(f"`{c}`"))), ("b", F.xxhash64(F.lit("b"), f"`{c}`")))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(len(names)):
                there = batch.column(2 * i).is_valid()
                a, b = (batch.column(2 * i + s).filter(there).to_numpy(zero_copy_only=False).astype(np.int64) for s in (0, 1))
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else order
                out.append((np.full(len(new), i, np.int32), a[new], b[new], np.diff(np.append(new, len(a)))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["at", "a", "b", "n"])

    return df.select(*hashes).mapInArrow(run, "at int, a long, b long, n long")


def _named(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in df.columns])).alias("at", "column_name"))


def distinct_counts(df: DataFrame) -> DataFrame:
    """(column_name, distinct_count): distinct non-null values, a row for every column.

    A row's values are hashed to 128 bits where they are read; each Arrow batch keeps the distinct
    hashes of each column, so that what is shuffled, dealt by column and hash, is the distinct
    values of a batch and not its rows times its columns.  Two values share a hash with a
    probability below 10**-18 at 10**10 distinct values."""
    counts = _met(df).select("at", "a", "b").distinct().groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    return _named(df).join(counts, "at", "left").select("column_name", F.coalesce("n", F.lit(0)).cast("long").alias("distinct_count"))  # a row a column


def hashed_counts(df: DataFrame) -> DataFrame:
    """(column_name, a, b, n): occurrences of each value by its hash; counts of parts of a table add up."""
    counts = _met(df).groupBy("at", "a", "b").agg(F.sum("n").alias("n"))
    return counts.join(F.broadcast(_named(df)), "at").select("column_name", "a", "b", "n")  # a row a column
