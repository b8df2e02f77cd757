"""Running sums over a global order without a global sort in one task.

Rows are first added up by key. Quantiles cut the keys into buckets, whose totals give every bucket's offset; the window
inside a bucket then runs in parallel. The cuts are a one-row aggregate inside the plan, so nothing runs while the plan is
built, and only they and the bounded table of totals are small-side joined.

The number of buckets follows the estimated size of the data. The cuts are quantiles of all keys together, so no bucket,
and no group within a bucket, holds more than about one part of all keys: a group with a third of the keys is spread over a
third of the buckets at least.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET_BYTES = 32 << 20
MOST_BUCKETS = 1 << 14


def bucket_count(df: DataFrame) -> int:
    """Buckets for the rows of ``df`` by the optimizer's estimate of what it reads; the session's shuffle partitions at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, min(MOST_BUCKETS, size // BUCKET_BYTES))


def _place(cuts: Column, key: Column, buckets: int) -> Column:
    """The number of sorted ``cuts`` below ``key``, by halving."""
    state = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        below = F.get(cuts, middle) < key
        go = at["low"] < at["high"]
        return F.struct(F.when(go & below, middle + 1).otherwise(at["low"]).alias("low"), F.when(go & ~below, middle).otherwise(at["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, buckets.bit_length()))), state, halve)["low"]


def join_groups(rows: DataFrame, info: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` joined with ``info`` on ``by``, where null is a value."""
    named = info.withColumnsRenamed({c: f"__g_{c}" for c in by})
    same = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(named[f"__g_{c}"]) for c in by))
    return rows.join(named, same).drop(*(f"__g_{c}" for c in by))


def running(df: DataFrame, order: str, sums: dict[str, Column], by: tuple[str, ...] = (), descending: bool = False, buckets: int | None = None) -> DataFrame:
    """One row for each key of ``order`` (and ``by``): each sum, and as ``cum_<name>`` its running total up to the key.

    Rows without a key are left out; a null in ``by`` is a group like any other.
    """
    buckets = buckets or bucket_count(df)
    df = df.where(F.col(order).isNotNull())
    sign = -1 if descending else 1
    keyed = df.groupBy(*by, order).agg(*(F.sum(c).alias(n) for n, c in sums.items())).withColumn("__k", sign * F.col(order))
    shares = F.lit(np.arange(1, max(buckets, 2)) / max(buckets, 2))
    cuts = keyed.agg(F.array_sort(F.array_distinct(F.percentile_approx("__k", shares, F.lit(max(1000, 10 * buckets))))).alias("__cuts"))
    placed = keyed.crossJoin(F.broadcast(cuts))  # one row
    placed = placed.withColumn("__b", F.coalesce(_place(F.col("__cuts"), F.col("__k"), buckets), F.lit(0))).drop("__cuts")
    totals = placed.groupBy(*by, "__b").agg(*(F.sum(n).alias(n) for n in sums))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # ``buckets`` rows for each group at most
    offsets = totals.select(*by, "__b", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__o_{n}") for n in sums))
    own = Window.partitionBy(*by, "__b").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    joined = join_groups(placed, offsets, [*by, "__b"])
    return joined.select(*by, order, *sums, *((F.sum(n).over(own) + F.col(f"__o_{n}")).alias(f"cum_{n}") for n in sums))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, value): the lines of text files in file order, numbered from 0."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("__m"))
    part = F.shiftright("__m", 33)
    sizes = lines.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file split
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return lines.withColumn("__p", part).join(offsets, "__p").select((F.col("__m").bitwiseAND((1 << 33) - 1) + F.col("__o")).alias("row_id"), "value")
