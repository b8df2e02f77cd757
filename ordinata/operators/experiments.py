"""Experiments: the learners' grids, cross-validation, refitting with the best setting, and sweeps.

A grid is a parameter, so it stays on the driver; rows go once to each fold and batch of settings, not once to each setting.
Training rows are sorted by Spark and streamed to the learner. The proximal learner, whose class means are added up before, takes one pass
holding a batch of rows; the other learners, and several passes, hold a group's features as one matrix.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordinata.functions.vector import dot
from ordinata.operators import learners, metrics, prepare, store
from ordinata.operators.prefix import join_groups

Settings = list[dict[str, float]]


def _powers(base: float, first: int, last: int) -> list[float]:
    return [base**k for k in range(first, last + 1)]


# The grid of each learner, axes in search order.
GRIDS: dict[str, dict[str, list[float]]] = {
    "solam": {"xi": [float(v) for v in range(1, 101, 9)], "radius": _powers(10.0, -1, 5)},
    "spam_l1": {"xi": _powers(10.0, -5, 2), "l1": _powers(10.0, -5, 2)},
    "spam_l2": {"xi": _powers(10.0, -5, 2), "l2": _powers(10.0, -5, 2)},
    "spam_enet": {"xi": _powers(10.0, -5, 2), "l1": _powers(10.0, -5, 2), "l2": _powers(10.0, -5, 2)},
    "fsauc": {"radius": _powers(10.0, -1, 5), "eta": _powers(2.0, -10, 10)},
    "sht_auc": {"k": [float(v) for v in range(10, 101, 10)], "block": [640.0, 320.0, 160.0, 80.0, 64.0]},
    "stoiht": {"k": [float(v) for v in range(10, 101, 10)], "block": [640.0, 320.0, 160.0, 80.0, 64.0]},
    "hsg_ht": {"k": [float(v) for v in range(10, 101, 10)], "tau": [1.0, 10.0, 100.0, 1000.0]},
}


def settings(axes: dict[str, list[float]], **fixed: float) -> Settings:
    """The product of the axes in their order, each with the ``fixed`` parameters."""
    return [{**fixed, **dict(zip(axes, values, strict=True))} for values in itertools.product(*axes.values())]


def _class_heads(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, features) of each group: its share of positives, and the means of its negative and then of its positive class."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            kept, x = [batch.schema.field(k) for k in range(len(keys))], _matrix(batch.column(len(keys) + 1), batch.num_rows)
            at: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), (batch.column(len(keys)).to_numpy() > 0).tolist(), strict=True)):
                at.setdefault(key, []).append(i)
            for key, own in at.items():
                have = sums.setdefault(key, [0, 0.0])
                have[0] += len(own)
                have[1] = have[1] + x[own].sum(axis=0)
        for key, (n, total) in sums.items():
            out = pa.schema([*kept, ("pos__", pa.bool_()), ("n__", pa.int64()), ("total__", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, (*key, n, total.tolist()), strict=True))], out)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "pos__ boolean, n__ long, total__ array<double>"])
    own = rows.select(*keys, "y", "features").mapInArrow(run, schema)
    summed = own.select(*keys, "pos__", "n__", F.posexplode("total__").alias("j", "v")).groupBy(*keys, "pos__", "j").agg(F.sum("n__").alias("n"), F.sum("v").alias("v"))
    first = F.col("j") == 0
    share = F.sum(F.when(first & F.col("pos__"), F.col("n")).otherwise(0)) / F.sum(F.when(first, F.col("n")))
    means = F.transform(F.array_sort(F.collect_list(F.struct("pos__", "j", (F.col("v") / F.col("n")).alias("v")))), lambda e: e["v"])  # 2 d numbers
    return summed.groupBy(*keys).agg(share.alias("y"), means.alias("features"))


def _matrix(lists: pa.Array, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _pieces(batch: pa.RecordBatch, keys: int) -> list[tuple[int, int]]:
    """The runs of rows whose first ``keys`` columns are equal; null is a value."""
    changed = np.zeros(max(batch.num_rows - 1, 0), bool)
    for c in range(keys):
        a, b = batch.column(c)[1:], batch.column(c)[:-1]
        changed |= pc.coalesce(pc.not_equal(a, b), pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
    return list(zip(cuts, cuts[1:], strict=False)) if batch.num_rows else []


def _trained(rows: DataFrame, keys: list[str], method: str, grid: Settings, chosen: Callable[[tuple], range | list[int]], seed: int) -> DataFrame:
    """(keys, ordinal, w): by group, each setting that ``chosen`` gives for its key trained on its rows in row order; w is null without both classes."""
    kinds = dict(rows.dtypes)
    one_pass = method == "spam" and all(int(p.get("passes", 1)) == 1 for p in grid)
    data = rows.select(*keys, F.lit(1).alias("kind__"), F.col("row_id").cast("long").alias("row__"), F.col("y").cast("double").alias("y"), F.col("features").cast("array<double>").alias("features"))
    if one_pass:
        data = data.unionByName(_class_heads(data, keys).select(*keys, F.lit(0).alias("kind__"), F.lit(None).cast("long").alias("row__"), "y", "features"))
    ordered = data.repartition(*keys).sortWithinPartitions(*keys, "kind__", "row__").select(*keys, "kind__", "y", "features")

    def fitted(key: tuple, held: list, kept: list[pa.Field]) -> pa.RecordBatch:
        ordinals = list(chosen(key))
        if one_pass:
            found = [w.w if w else None for w in held] or [None] * len(ordinals)
        else:
            x, y = np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held])
            held.clear()
            usable = bool((y > 0).any() and (y <= 0).any())
            found = [learners.REGISTRY[method](x, y, grid[k], learners._schedule(len(y), grid[k], 0, seed)) if usable else None for k in ordinals]
        out = pa.schema([*kept, ("ordinal", pa.int64()), ("w", pa.list_(pa.float64()))])
        return pa.RecordBatch.from_pylist([dict(zip(out.names, (*key, k, None if w is None else w.tolist()), strict=True)) for k, w in zip(ordinals, found, strict=True)], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, kept = None, [], []
        for batch in batches:
            kept = [batch.schema.field(k) for k in range(len(keys))]
            for a, b in _pieces(batch, len(keys) + 1):
                piece = batch.slice(a, b - a)
                key = tuple(piece.column(k)[0].as_py() for k in range(len(keys)))
                if last is not None and key != last:
                    if chosen(last):
                        yield fitted(last, held, kept)
                    held = []
                last = key
                y, x = piece.column(len(keys) + 1).to_numpy(), _matrix(piece.column(len(keys) + 2), b - a)
                if not one_pass:
                    held.append((x.copy(), y.copy()))
                elif not piece.column(len(keys))[0].as_py():
                    both = 0 < y[0] < 1
                    held = [learners.Proximal(*reversed(x[0].reshape(2, -1)), float(y[0]), grid[k]) if both else None for k in chosen(key)]
                else:
                    for way in held:
                        if way:
                            way.walk(x, y)
        if last is not None and chosen(last):
            yield fitted(last, held, kept)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "ordinal long, w array<double>"])
    return ordered.mapInArrow(run, schema)


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so what reads it several times trains once; it goes with the application's folder."""
    path = store.shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cross_validate(folded: DataFrame, folds: int, method: str, grid: Settings, by: tuple[str, ...] = (), fold: str = "fold", batch: int = 8, seed: int = 1) -> DataFrame:
    """(by, ordinal, held, auc): each setting trained on a group's rows outside the fold ``held`` and tested on those inside.

    ``folded`` has by, row_id, y, features and ``fold`` (0 to ``folds`` - 1). Training rows are copied to folds x batches of
    ``batch`` settings, each of which is a task's stream, as the learners are sequential. Test rows stay where they lie: they are scored by their
    fold's models and ranked by Spark. The AUC is null where either side lacks a class, and a fold without rows gives none.
    """
    batches = -(-len(grid) // batch)
    rows = folded.withColumnRenamed(fold, "fold__").select(*by, "row_id", "y", "features", F.col("fold__").cast("int").alias("fold__"))
    copies = rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("fold__ <> held").drop("fold__")
    copies = copies.withColumn("batch__", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    models = _kept(_trained(copies, [*by, "held", "batch__"], method, grid, lambda key: range(key[-1] * batch, min(len(grid), (key[-1] + 1) * batch)), seed))
    keys = (*by, "ordinal", "held")
    test = rows.withColumnRenamed("fold__", "held")
    scored = _kept(join_groups(test, models.drop("batch__"), [*by, "held"]).select(*keys, "y", dot(F.col("features"), F.col("w")).alias("score")))
    lacking = scored.groupBy(*keys).agg(F.count("score").alias("n")).where("n = 0").select(*keys, F.lit(None).cast("double").alias("auc"))
    return metrics.auc(scored, by=keys).select(*keys, "auc").unionByName(lacking)


def refit(training: DataFrame, best: DataFrame, method: str, grid: Settings, by: tuple[str, ...] = (), seed: int = 1) -> DataFrame:
    """(by, ordinal, j, w): the setting that ``best`` (by, ordinal) names, trained on all rows of its group."""
    keys = list(by)
    chosen = best.select(*keys, F.col("ordinal").cast("long").alias("own__"))
    rows = training.select(*keys, "row_id", "y", "features")
    rows = rows.join(chosen, keys) if keys else rows.crossJoin(F.broadcast(chosen))  # without groups, one best row
    models = _kept(_trained(rows, [*keys, "own__"], method, grid, lambda key: [key[-1]], seed))
    without = F.when(F.col("w").isNull(), F.raise_error(F.lit("both classes are needed")).cast("array<double>")).otherwise(F.col("w"))
    return models.select(*keys, "ordinal", F.posexplode(without).alias("j", "w"))


def sweep(folded: DataFrame, folds: int, method: str, axis: str, values: list[float], fixed: dict[str, float], by: tuple[str, ...] = (), seed: int = 1) -> DataFrame:
    """(by, axis, mean, std, n): the held-out AUC over the folds as one parameter takes each of ``values``."""
    scores = cross_validate(folded, folds, method, settings({axis: values}, **fixed), by, seed=seed)
    named = scores.withColumn(axis, F.element_at(F.array(*map(F.lit, values)), (F.col("ordinal") + 1).cast("int")))
    return named.groupBy(*by, axis).agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"), F.count("auc").alias("n"))


def at_ratios(samples: DataFrame, ratios: list[float], seed: int) -> DataFrame:
    """(ratio, row_id, y, features): by ratio, the largest set of rows of that share of positives.

    All of the class that runs short are kept, and of the other the first by a digest; this resampling is the experiment.
    A ratio lies strictly between 0 and 1.
    """
    marked = samples.withColumn("pos__", F.col("y") > 0)
    placed = prepare.shuffled(marked, seed, by=("pos__",)).select("pos__", "row_id", "position")
    totals = samples.agg(F.count_if(F.col("y") > 0).alias("np__"), F.count_if(F.col("y") <= 0).alias("nn__"))
    ratio = F.col("ratio")
    wide = placed.withColumn("ratio", F.explode(F.array(*map(F.lit, ratios)))).crossJoin(F.broadcast(totals))  # one row
    positives = F.least(F.col("np__"), F.floor(F.col("nn__") * ratio / (1 - ratio) + 1e-9))
    negatives = F.least(F.col("nn__"), F.floor(positives * (1 - ratio) / ratio + 1e-9))
    kept = wide.where(F.col("position") < F.when(F.col("pos__"), positives).otherwise(negatives))
    return kept.select("ratio", "row_id").join(samples.select("row_id", "y", "features"), "row_id")


def folds_by(samples: DataFrame, folds: int, by: str) -> DataFrame:
    """``samples`` with contiguous folds in row order within each group."""
    return samples.join(prepare.kfold(samples, folds, (by,)), [by, "row_id"])


def best_settings(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ordinal, mean): by group, the first setting in grid order of the highest mean AUC."""
    means = scores.groupBy(*by, "ordinal").agg(F.avg("auc").alias("mean"))
    ranked = means.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("mean"), "ordinal")))  # one row a setting
    return ranked.where("k = 1").drop("k")
