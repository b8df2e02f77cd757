"""Order statistics, thresholding and projections of long vectors (j, w)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Up to so many rows a selection keeps them in each task's heap; beyond it, it finds the value of rank k by digits.
HEAP = 10_000
_DIGIT = 16


def _rising(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys in the order of the values: doubles, NaN greatest and both zeros equal, or integers."""
    top = np.uint64(1 << 63)
    if values.dtype.kind in "iu":
        return values.astype(np.int64).view(np.uint64) ^ top
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    return np.where(bits & top, ~bits, bits | top)


def _digits(df: DataFrame, value: str, prefix: int, known: int) -> np.ndarray:
    """[2^16]: how many keys that start with the ``known`` bits of ``prefix`` have each next digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _DIGIT, np.int64)
        for batch in batches:
            keys = _rising(batch.column(0).to_numpy(zero_copy_only=False))
            if known:
                keys = keys[keys >> np.uint64(64 - known) == np.uint64(prefix)]
            total += np.bincount((keys >> np.uint64(64 - known - _DIGIT)).astype(np.int64) & ((1 << _DIGIT) - 1), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["digit", "n"])

    out = np.zeros(1 << _DIGIT, np.int64)
    for r in df.select(value).mapInArrow(run, "digit int, n long").groupBy("digit").agg(F.sum("n").alias("n")).collect():  # 2^16 rows at most
        out[r["digit"]] = r["n"]
    return out


def select_rank(df: DataFrame, value: str, k: int, descending: bool = True) -> tuple[float | int, int] | None:
    """(the k-th value, how many come before it strictly); None if there are fewer than k. Nulls do not count.

    The value's key is found digit by digit: a scan counts the digits of the keys that share what is known, and only the digit that holds
    rank k is followed. Four scans and no sort, whatever k.
    """
    whole = dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint")
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("long" if whole else "double").alias(value))
    prefix, known, before = 0, 0, 0
    while known < 64:
        counts = _digits(rows, value, prefix, known)
        order = np.arange(1 << _DIGIT)[::-1] if descending else np.arange(1 << _DIGIT)
        reached = before + np.cumsum(counts[order])
        if reached[-1] < k or k < 1:
            return None
        at = int(np.searchsorted(reached, k))
        before = int(reached[at] - counts[order[at]])
        prefix, known = prefix << _DIGIT | int(order[at]), known + _DIGIT
    key = np.array([prefix], np.uint64)
    top = np.uint64(1 << 63)
    if whole:
        return int((key ^ top).view(np.int64)[0]), before
    return float(np.where(key & top, key ^ top, ~key).view(np.float64)[0]), before


def top_by_magnitude(vector: DataFrame, k: int, value: str = "w", tie: str = "j") -> DataFrame:
    """The k largest in magnitude, ties by position: a bounded heap for each task, or beyond HEAP what reaches the value of rank k.

    Entries without a value come last. For a large k, ``tie`` is an integer without repeats.
    """
    if k <= HEAP:
        return vector.orderBy(F.abs(value).desc(), tie).limit(k)
    size = F.abs(F.col(value).cast("double"))
    if (found := select_rank(vector.select(size.alias("a")), "a", k)) is None:
        return vector.orderBy(F.abs(value).desc_nulls_last(), tie).limit(k)  # fewer values than k: all of them, and nulls
    least, before = found
    last = select_rank(vector.where(size == least).select(tie), tie, k - before, descending=False)
    return vector.where((size > least) | (size == least) & (F.col(tie) <= last[0]))


def kth_largest(df: DataFrame, value: str, k: int) -> DataFrame:
    """(kth): the k-th largest value; no row if there are fewer. Nulls do not count."""
    found = select_rank(df, value, k)
    kind = dict(df.dtypes)[value]
    return df.sparkSession.createDataFrame([] if found is None else [(found[0],)], f"kth {'long' if kind in ('tinyint', 'smallint', 'int', 'bigint') else 'double'}")


def hard_threshold(vector: DataFrame, k: int, compat: bool = False) -> DataFrame:
    """Zero all but the k largest in magnitude; compat keeps only what exceeds the k-th, so k - 1 at most."""
    if compat:
        kth = kth_largest(vector.select(F.abs("w").alias("a")), "a", k)
        return vector.crossJoin(F.broadcast(kth)).select("j", F.when(F.abs("w") > F.col("kth"), F.col("w")).otherwise(0.0).alias("w"))
    kept = top_by_magnitude(vector, k).select("j", F.lit(True).alias("kept"))
    kept = F.broadcast(kept) if k <= 100_000 else kept  # k rows at most
    return vector.join(kept, "j", "left").select("j", F.when(F.col("kept"), F.col("w")).otherwise(0.0).alias("w"))


def l1_ball(vector: DataFrame, radius: float) -> DataFrame:
    """The nearest vector whose l1 norm is ``radius`` at most, by the sorted cumulative sums of magnitudes."""
    from ordinata.operators.prefix import running

    sums = running(vector.withColumn("u", F.abs("w")), "u", {"one": F.lit(1), "s": F.abs("w")}, descending=True)
    theta = sums.where(F.col("u") * F.col("cum_one") > F.col("cum_s") - radius).agg(F.max_by((F.col("cum_s") - radius) / F.col("cum_one"), "cum_one").alias("theta"))
    total = vector.agg(F.sum(F.abs("w")).alias("total"))
    shrink = F.signum("w") * F.greatest(F.abs("w") - F.col("theta"), F.lit(0.0))
    return vector.crossJoin(F.broadcast(theta)).crossJoin(F.broadcast(total)).select("j", F.when(F.col("total") <= radius, F.col("w")).otherwise(shrink).alias("w"))


def l2_ball_long(vector: DataFrame, radius: float) -> DataFrame:
    n = vector.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    return vector.crossJoin(F.broadcast(n)).select("j", F.when(F.col("n") > radius, F.col("w") * radius / F.col("n")).otherwise(F.col("w")).alias("w"))


def lex_rank(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, rank, n) by falling x, then falling y: the first place of each pair of values, and its rows.

    The places before an x and those before a y within its x are running sums in parallel buckets; no task sorts the whole.
    """
    from ordinata.operators.prefix import running

    one = {"n": F.lit(1)}
    before = running(df, x, one, descending=True).select(x, (F.col("cum_n") - F.col("n")).alias("above"))
    within = running(df, y, one, (x,), descending=True)
    return within.join(before, x).select(x, y, (F.col("above") + F.col("cum_n") - F.col("n") + 1).alias("rank"), "n")


def argsort(df: DataFrame, value: str, row: str, descending: bool = True, magnitude: bool = False) -> DataFrame:
    """(row, position): the place of every row by ``value``, or by its magnitude; ties by row. Positions count from 0."""
    from ordinata.operators.prefix import running

    key = F.abs(value) if magnitude else F.col(value)
    keyed = df.select(row, key.alias("key__"))
    before = running(keyed, "key__", {"n__": F.lit(1)}, descending=descending).select("key__", (F.col("cum_n__") - F.col("n__")).alias("above__"))
    among = F.row_number().over(Window.partitionBy("key__").orderBy(row))  # rows of one value
    return keyed.join(before, "key__").select(row, (F.col("above__") + among - 1).alias("position"))


def checked_top(vector: DataFrame, k: int, value: str = "w", tie: str = "j") -> DataFrame:
    """``top_by_magnitude``, which fails if the vector has fewer than k entries."""
    top = top_by_magnitude(vector, k, value, tie)
    enough = top.agg(F.when(F.count(F.lit(1)) < k, F.raise_error(F.lit(f"k = {k} exceeds the entries")).cast("boolean")).otherwise(F.lit(True)).alias("enough__"))
    return top.crossJoin(F.broadcast(enough)).where("enough__").drop("enough__")  # one row
