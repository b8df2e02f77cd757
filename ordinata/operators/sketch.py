"""Mergeable sketches of the class covariances, and the weights that minimise the pairwise square loss in closed form from them.

All rows are read in parallel, once. A hashed projection adds up Z = sum of x g', where g is a vector of tau signs that a digest of the
row's id gives, so Z Z' / tau is the second moment without bias; sketches of parts add up. Frequent directions keep at most tau rows whose
second moment is below that of all rows by at most their squared sum over tau / 2; sketches of parts are stacked and
shrunk again, by a tree of groups, and the bound holds for any tree.

With class means m and covariances C, the mean of (1 - w (x+ - x-))^2 over all pairs plus lam |w|^2 is least at
w = (C+ + C- + (m+ - m-)(m+ - m-)' + lam I)^-1 (m+ - m-).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinata.operators import scan

#: Sketches that one task merges.
FAN = 16
_SKETCH = "key long, class int, sketch array<double>"


def signs(row_id: int, tau: int) -> np.ndarray:
    """``tau`` signs from the bits of MD5 digests of (row, number of the digest)."""
    data = b"".join(hashlib.md5(f"{row_id}-{k}".encode()).digest() for k in range(-(-tau // 128)))
    return np.unpackbits(np.frombuffer(data, np.uint8))[:tau] * 2.0 - 1.0


def shrink(rows: np.ndarray, tau: int) -> np.ndarray:
    """At most ``tau`` / 2 directions of more than ``tau`` rows; each loses the square of the first one that is dropped."""
    if len(rows) <= tau:
        return rows
    _, size, basis = np.linalg.svd(rows, full_matrices=False)
    half = max(1, tau // 2)
    if len(size) <= half:
        return size[:, None] * basis
    return np.sqrt(np.maximum(size[:half] ** 2 - size[half] ** 2, 0.0))[:, None] * basis[:half]


def _each_class(samples: DataFrame, d: int, start, add) -> DataFrame:
    """(class, sketch) of every task's rows, by class; ``add`` takes (state, ids, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = {}
        for batch in batches:
            ids, y = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(y), d)
            for own in (0, 1):
                inside = (y > 0) == own
                if inside.any():
                    held[own] = add(held.get(own, start), ids[inside], x[inside])
        for own, state in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([own], pa.int32()), pa.array([state.ravel()], pa.list_(pa.float64()))], names=["key", "class", "sketch"])

    return samples.where("y IS NOT NULL AND features IS NOT NULL").select("row_id", "y", "features").mapInArrow(run, _SKETCH)


def hashed(samples: DataFrame, d: int, tau: int) -> DataFrame:
    """(class, j, k, z): the entries of Z of both classes."""

    def add(state: np.ndarray, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        return state + x.T @ np.stack([signs(i, tau) for i in ids.tolist()])

    entries = _each_class(samples, d, np.zeros((d, tau)), add).select("class", F.posexplode("sketch").alias("at", "v"))
    return entries.groupBy("class", "at").agg(F.sum("v").alias("z")).select("class", F.floor(F.col("at") / tau).cast("int").alias("j"), (F.col("at") % tau).alias("k"), "z")


def directions(samples: DataFrame, d: int, tau: int) -> dict[int, np.ndarray]:
    """By class, at most ``tau`` rows that stand for all of its rows; as many numbers as that reach the driver."""

    def add(state: np.ndarray, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        for at in range(0, len(x), max(1, tau)):
            state = shrink(np.concatenate([state, x[at : at + tau]]), tau)
        return state

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        state = np.zeros((0, d))
        for flat in table.sort_by("key").column("sketch").to_pylist():
            state = shrink(np.concatenate([state, np.array(flat).reshape(-1, d)]), tau)
        return pa.table({"key": pa.array([key[1].as_py()], pa.int64()), "class": pa.array([key[0].as_py()], pa.int32()), "sketch": pa.array([state.ravel()], pa.list_(pa.float64()))})

    out, left = _each_class(samples, d, np.zeros((0, d)), add), samples.rdd.getNumPartitions()
    while True:
        out = out.groupBy("class", F.floor(F.col("key") / FAN).alias("next")).applyInArrow(merge, _SKETCH)
        left = -(-left // FAN)
        if left <= 1:
            break
    return {r["class"]: np.array(r["sketch"]).reshape(-1, d) for r in out.collect()}


def class_moments(samples: DataFrame, d: int) -> scan.Moments:
    """Rows, sums and second moments of both classes, from one scan."""
    ranged = samples.where("y IS NOT NULL AND features IS NOT NULL").select(F.lit(0).cast("long").alias("range"), "y", "features")
    return scan.total_moments(scan.range_moments(ranged, d), d)


def fit_pairwise(samples: DataFrame, d: int, lam: float, sketch: str | None = None, tau: int = 0) -> np.ndarray:
    """Weights from exact second moments, or from ``hashed`` or ``directions`` sketches of them. Both classes are needed."""
    if sketch is None:
        exact = class_moments(samples, d)
        count, means, second = exact.count, exact.sum / np.maximum(exact.count, 1)[:, None], exact.square
    else:
        long = samples.where("y IS NOT NULL AND features IS NOT NULL").select((F.col("y") > 0).cast("int").alias("class"), F.posexplode("features").alias("j", "v"))
        count, means, second = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for r in long.groupBy("class", "j").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n")).collect():  # 2 d rows
            means[r["class"], r["j"]], count[r["class"]] = r["v"], r["n"]
        if sketch == "hashed":
            z = np.zeros((2, d, tau))
            for r in hashed(samples, d, tau).collect():  # 2 d tau numbers
                z[r["class"], r["j"], r["k"]] = r["z"]
            second = z @ z.transpose(0, 2, 1) / tau
        else:
            for own, rows in directions(samples, d, tau).items():
                second[own] = rows.T @ rows
    if not count.all():
        raise ValueError("both classes are needed")
    gap = means[1] - means[0]
    spread = sum(second[k] / count[k] - np.outer(means[k], means[k]) for k in (0, 1))
    return np.linalg.solve(spread + np.outer(gap, gap) + lam * np.eye(d), gap)
