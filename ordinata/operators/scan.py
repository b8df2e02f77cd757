"""One-pass learners in parallel, by an associative scan over ranges of rows.

The step of some sequential learners is affine in the weights: w becomes A w + b, where A and b depend on the row and on running class
moments alone. Then a range of rows is one pair (A, b), pairs of neighbouring ranges compose to one, and the ranges can be worked out in
any order. What a range needs of the rows before it are the moments of each class, which are prefix sums.

1. Samples are stored in row order and cut into ranges of bounded size.
2. Each range adds up its class moments. Window sums over the ranges, one for each entry of the moments, turn them into prefixes.
3. Each range, with the moments before it, composes its rows to one (A, b).
4. Neighbouring pairs are composed by a tree of groups; of the root, b is the result, as the learners start from zero.

The result is that of the sequential learner up to rounding, whatever the number of ranges. A range costs O(d^3) a row for the
covariance learner and O(d^2) for the proximal one, d times the sequential cost, so it pays where there are more cores than features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordinata.operators import store

#: Rows in a range, at most.
RANGE_ROWS = 1 << 14
#: Neighbouring maps that one task composes.
FAN = 16


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width)


class Moments:
    """Rows seen, their sum and the sum of their squares x x' by class (0 negative, 1 positive)."""

    def __init__(self, d: int, flat: np.ndarray | None = None):
        flat = np.zeros(2 * (1 + d + d * d)) if flat is None else flat.copy()
        self.count, rest = flat[:2], flat[2:]
        self.sum, self.square = rest[: 2 * d].reshape(2, d), rest[2 * d :].reshape(2, d, d)
        self.flat = flat

    def add(self, x: np.ndarray, own: int) -> None:
        self.count[own] += 1
        self.sum[own] += x
        self.square[own] += np.outer(x, x)


def moments_of(x: np.ndarray, y: np.ndarray) -> Moments:
    out = Moments(x.shape[1])
    for own, rows in enumerate((x[y <= 0], x[y > 0])):
        out.count[own], out.sum[own], out.square[own] = len(rows), rows.sum(axis=0), rows.T @ rows
    return out


def compose_covariance(x: np.ndarray, y: np.ndarray, before: Moments, eta: float, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """(A, b) of steps against the running mean and covariance of the opposite class; no step before that class is seen."""
    d = x.shape[1]
    a, b = np.eye(d), np.zeros(d)
    for row, sign in zip(x, np.where(y > 0, 1.0, -1.0), strict=True):
        own = int(sign > 0)
        before.add(row, own)
        if k := before.count[1 - own]:
            mean = before.sum[1 - own] / k
            away = row - mean
            # both at once: the columns of A, and b
            both = np.column_stack([a, b])
            spread = before.square[1 - own] @ both / k - np.outer(mean, mean @ both)
            both = (1 - eta * lam) * both - eta * (np.outer(away, away @ both) + spread)
            both[:, -1] += eta * sign * away
            a, b = both[:, :-1], both[:, -1]
    return a, b


def compose_proximal(x: np.ndarray, y: np.ndarray, first: int, total: Moments, xi: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """(A, b) of proximal steps with an l2 penalty against the class means of all rows; ``first`` is the first row's step, from 1.

    With the saddle point's dual put in, a row's slope is 2 k (x - m) w - 2 k y, where m is the other class's mean and k its share.
    """
    d = x.shape[1]
    both = np.column_stack([np.eye(d), np.zeros(d)])
    means, share = total.sum / total.count[:, None], total.count / total.count.sum()
    for t, (row, sign) in enumerate(zip(x, np.where(y > 0, 1.0, -1.0), strict=True), first):
        other = int(sign < 0)
        eta, k = xi / np.sqrt(t), 2 * share[other]
        slope = k * ((row - means[other]) @ both)
        slope[-1] -= k * sign
        both = (both - eta * np.outer(row, slope)) / (1 + eta * l2)
    return both[:, :-1], both[:, -1]


_MOMENTS = "range long, moments array<double>"
_MAP = "range long, map array<double>"


def _ranges(samples: store.Store, rows: int) -> DataFrame:
    return samples.frame().withColumn("range", F.floor(F.col("position") / rows)).select("range", "position", "y", "features")


def _rows(table: pa.Table, d: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(features, labels, first position) of a range in order."""
    table = table.sort_by("position")
    return _matrix(table.column("features").combine_chunks(), d), table.column("y").to_numpy(), table.column("position")[0].as_py()


def range_moments(ranged: DataFrame, d: int) -> DataFrame:
    """(range, moments) of each range's own rows; added up where the rows lie, so no range is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            own, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), d)
            for k in np.unique(own).tolist():
                flat = moments_of(x[own == k], y[own == k]).flat
                sums[k] = sums[k] + flat if k in sums else flat
            for k in [k for k in sums if k < own[-1]]:  # rows come in order, so these ranges are over here
                yield _arrays(k, sums.pop(k), "moments")
        for k, flat in sums.items():
            yield _arrays(k, flat, "moments")

    return ranged.select("range", "y", "features").mapInArrow(run, _MOMENTS)


def _arrays(key: int, flat: np.ndarray, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([flat], pa.list_(pa.float64()))], names=["range", name])


def prefix_moments(own: DataFrame) -> DataFrame:
    """(range, moments): of all rows before each range, by a window for each entry of the moments."""
    entries = own.select("range", F.posexplode("moments").alias("k", "v")).groupBy("k", "range").agg(F.sum("v").alias("v"))
    before = Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    entries = entries.select("range", "k", F.coalesce(F.sum("v").over(before), F.lit(0.0)).alias("v"))
    return entries.groupBy("range").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("moments"))


def total_moments(own: DataFrame, d: int) -> Moments:
    """The moments of all rows, on the driver: 2 (1 + d + d^2) numbers."""
    found = own.select(F.posexplode("moments").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 * (1 + d + d * d))
    for r in found:
        flat[r["k"]] = r["v"]
    return Moments(d, flat)


def _compose_all(maps: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The composition of (range, map) in the order of ranges, FAN neighbours at a time; one map reaches the driver."""

    def join(key: tuple, table: pa.Table) -> pa.Table:
        whole = np.eye(d, d + 1)
        for flat in table.sort_by("range").column("map").to_pylist():
            step = np.array(flat).reshape(d, d + 1)
            whole = np.column_stack([step[:, :-1] @ whole[:, :-1], step[:, :-1] @ whole[:, -1] + step[:, -1]])
        return pa.table({"range": pa.array([key[0].as_py()], pa.int64()), "map": pa.array([whole.ravel()], pa.list_(pa.float64()))})

    spark, folders = maps.sparkSession, []
    while True:
        folders.append(store.shared_folder(spark))  # a level of the tree is written, so a lost executor costs one level
        maps.write.parquet(folders[-1])
        maps = spark.read.schema(_MAP).parquet(folders[-1])
        if maps.count() <= 1:
            break
        maps = maps.groupBy(F.floor(F.col("range") / FAN).alias("next")).applyInArrow(join, _MAP)
    root = np.array(maps.first()["map"]).reshape(d, d + 1)
    for folder in folders:
        store.remove(spark, folder)
    return root[:, :-1], root[:, -1]


def _scan(samples: store.Store, compose, before: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each range with its moments (null without) composed to one map, and these to one."""
    d = samples.features

    def run(key: tuple, own: pa.Table, moments: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({"range": pa.array([], pa.int64()), "map": pa.array([], pa.list_(pa.float64()))})
        x, y, first = _rows(own, d)
        a, b = compose(x, y, first, np.array(moments.column("moments")[0].as_py()) if moments.num_rows else None)
        return pa.table({"range": pa.array([key[0].as_py()], pa.int64()), "map": pa.array([np.column_stack([a, b]).ravel()], pa.list_(pa.float64()))})

    ranged = _ranges(samples, rows)
    maps = ranged.groupBy("range").cogroup(before.groupBy("range")).applyInArrow(run, _MAP)
    return _compose_all(maps, d)


def _range_rows(samples: store.Store, ranges: int | None) -> int:
    return max(1, min(RANGE_ROWS, samples.rows) if ranges is None else -(-samples.rows // ranges))


def fit_covariance(samples: DataFrame, eta: float, lam: float, passes: int = 1, ranges: int | None = None) -> np.ndarray:
    """Weights of the one-pass learner by running covariance, from (row_id, y, features); moments run on through the passes.

    Without rows the result is empty. ``ranges`` is the number of ranges; by default they have RANGE_ROWS rows.
    """
    held = store.write(samples, ranges)
    rows, d = _range_rows(held, ranges), held.features
    w = np.zeros(d)
    if held.rows:
        own = range_moments(_ranges(held, rows), d)
        before, total = prefix_moments(own), total_moments(own, d).flat if passes > 1 else 0.0
        for k in range(passes):
            a, b = _scan(held, lambda x, y, first, flat, k=k: compose_covariance(x, y, Moments(d, flat + k * total), eta, lam), before, rows)
            w = a @ w + b
    held.delete()
    return w


def fit_proximal(samples: DataFrame, xi: float, l2: float, passes: int = 1, ranges: int | None = None) -> np.ndarray:
    """Weights of the proximal learner with an l2 penalty, from (row_id, y, features), against the class means of all rows."""
    held = store.write(samples, ranges)
    rows, d = _range_rows(held, ranges), held.features
    w = np.zeros(d)
    if held.rows:
        if not 0 < held.positives < held.rows:
            raise ValueError("both classes are needed")
        own = range_moments(_ranges(held, rows), d)
        total, n = total_moments(own, d).flat, held.rows
        none = held.spark.createDataFrame([], _MOMENTS)
        for k in range(passes):
            # all steps see the moments of the whole table, so none before a range are needed
            a, b = _scan(held, lambda x, y, first, flat, k=k: compose_proximal(x, y, 1 + first + k * n, Moments(d, total), xi, l2), none, rows)
            w = a @ w + b
    held.delete()
    return w


def running_moments(samples: DataFrame, i: int, j: int, ranges: int | None = None) -> DataFrame:
    """(row_id, positive, n, mean, cov) over the rows of a row's class up to it: the mean of feature i, its covariance with j.

    The result reads the store, which goes with the application's folder.
    """
    pair = F.array(F.get("features", F.lit(i)), F.get("features", F.lit(j)))
    held = store.write(samples.withColumn("features", pair), ranges)
    rows = _range_rows(held, ranges)

    def run(key: tuple, own: pa.Table, before: pa.Table) -> pa.Table:
        own = own.sort_by("position")
        x, pos = _matrix(own.column("features").combine_chunks(), 2), own.column("y").to_numpy() > 0
        start = Moments(2, np.array(before.column("moments")[0].as_py()))
        out = np.zeros((3, len(x)))
        for k, inside in enumerate((~pos, pos)):
            n = start.count[k] + np.arange(1, inside.sum() + 1)
            sums = start.sum[k] + np.cumsum(x[inside], axis=0)
            products = start.square[k][0, 1] + np.cumsum(x[inside, 0] * x[inside, 1])
            out[:, inside] = n, sums[:, 0] / n, products / n - sums[:, 0] * sums[:, 1] / n**2
        return pa.table({"row_id": own.column("key"), "positive": pa.array(pos), "n": pa.array(out[0].astype(np.int64)), "mean": pa.array(out[1]), "cov": pa.array(out[2])})

    ranged = held.frame().withColumn("range", F.floor(F.col("position") / rows)).select("range", "position", "key", "y", "features")
    before = prefix_moments(range_moments(ranged.select("range", "y", "features"), 2))
    return ranged.groupBy("range").cogroup(before.groupBy("range")).applyInArrow(run, "row_id long, positive boolean, n long, mean double, cov double")
