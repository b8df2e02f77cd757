"""Preparation of sample tables: column and row scaling, class maps, splits and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_stats(long: DataFrame) -> DataFrame:
    """By feature: mean, population deviation, least, greatest and number of stored values."""
    return long.groupBy("j").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("v").alias("stored"))


def zscore(long: DataFrame) -> DataFrame:
    """Values minus the column's mean over its population deviation; 0 where the deviation is 0."""
    stats = column_stats(long).select("j", "mean", "std")
    return long.join(stats, "j").withColumn("v", F.when(F.col("std") > 0, (F.col("v") - F.col("mean")) / F.col("std")).otherwise(0.0)).drop("mean", "std")


def minmax_parameters(long: DataFrame, n_rows: int) -> DataFrame:
    """(j, low, high) with absent values as zeros; constant features are left out."""
    s = column_stats(long)
    sparse = F.col("stored") < n_rows
    low, high = F.when(sparse, F.least("least", F.lit(0.0))).otherwise(F.col("least")), F.when(sparse, F.greatest("most", F.lit(0.0))).otherwise(F.col("most"))
    return s.select("j", low.alias("low"), high.alias("high")).where("low < high")


def minmax_scale(long: DataFrame, parameters: DataFrame, lower: float = -1.0, upper: float = 1.0) -> DataFrame:
    """Stored values scaled to [lower, upper]; exact at the ends, features without parameters are dropped."""
    v = F.when(F.col("v") == F.col("low"), lower).when(F.col("v") == F.col("high"), upper).otherwise(lower + (upper - lower) * (F.col("v") - F.col("low")) / (F.col("high") - F.col("low")))
    return long.join(parameters, "j").withColumn("v", v).drop("low", "high")


def class_map(samples: DataFrame, label: str = "label", seed: int = 7) -> DataFrame:
    """(label, y): classes in a seeded order, the first half +1, the others -1."""
    shuffled = samples.select(label).distinct().withColumn("k", F.row_number().over(Window.orderBy(F.crc32(F.concat(F.col(label).cast("string"), F.lit(f"-{seed}")).cast("binary")), label)))  # one row for each class
    return shuffled.select(label, F.when(F.col("k") <= F.floor(F.max("k").over(Window.partitionBy()) / 2), 1.0).otherwise(-1.0).alias("y"))


def _fold_of(i: Column, n: Column, folds: int) -> Column:
    """The fold of position ``i`` of ``n``: contiguous folds, of which the first n mod k have one row more."""
    q, r = F.floor(n / folds), n % folds
    fold = F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(r + F.floor((i - r * (q + 1)) / F.greatest(q, F.lit(1))))
    return fold.cast("int")


def _counted(df: DataFrame, samples: DataFrame, by: tuple[str, ...]) -> DataFrame:
    count = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    from ordinata.operators.prefix import join_groups

    return join_groups(df, count, list(by)) if by else df.crossJoin(F.broadcast(count))


def kfold(samples: DataFrame, folds: int, by: tuple[str, ...] = (), row: str = "row_id") -> DataFrame:
    """(row, fold): contiguous folds in row order; the first n mod k have one row more."""
    from ordinata.operators.prefix import running

    position = running(samples.select(*by, row), row, {"one": F.lit(1)}, by)
    return _counted(position, samples, by).select(*by, row, _fold_of(F.col("cum_one") - 1, F.col("n"), folds).alias("fold"))


def shuffled(samples: DataFrame, seed: int, repeats: int = 1, name: str = "pass", row: str = "row_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, name, row, position): ``repeats`` seeded permutations of the rows; positions count from 0.

    The order is that of a digest of (row, permutation, seed); rows of equal digests go by their ids.
    """
    from ordinata.operators.prefix import running

    copies = samples.select(*by, row, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias(name))
    digest = F.md5(F.concat_ws("-", F.col(row).cast("string"), F.col(name).cast("string"), F.lit(str(seed))).cast("binary"))
    keyed = copies.withColumn("key__", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    groups = (*by, name)
    placed = keyed.join(running(keyed, "key__", {"one__": F.lit(1)}, groups), [*groups, "key__"])
    among = F.row_number().over(Window.partitionBy(*groups, "key__").orderBy(row))  # rows of one digest
    return placed.select(*groups, row, (F.col("cum_one__") - F.col("one__") + among - 1).alias("position"))


def random_folds(samples: DataFrame, folds: int, seed: int, row: str = "row_id") -> DataFrame:
    """(row, fold): folds [i n/k, (i+1) n/k) of a seeded permutation; as many folds as rows at most."""
    counted = _counted(shuffled(samples, seed, row=row), samples, ())
    k = F.least(F.lit(folds).cast("long"), F.col("n"))
    return counted.select(row, F.floor((F.col("position") * k + k - 1) / F.col("n")).cast("int").alias("fold"))


def outer_folds(samples: DataFrame, folds: int, seed: int, row: str = "row_id") -> DataFrame:
    """(fold, row, role): for each fold a permutation of its own, whose contiguous part is the test; tests may overlap."""
    counted = _counted(shuffled(samples, seed, folds, "fold", row), samples, ())
    test = _fold_of(F.col("position"), F.col("n"), folds) == F.col("fold")
    return counted.select("fold", row, F.when(test, "te").otherwise("tr").alias("role"))


def nested_folds(outer: DataFrame, folds: int, row: str = "row_id") -> DataFrame:
    """(fold, row, inner): contiguous folds within the training rows of every outer fold."""
    training = outer.where("role = 'tr'").select(F.col("fold").alias("outer__"), row)
    return kfold(training, folds, ("outer__",), row).select(F.col("outer__").alias("fold"), row, F.col("fold").alias("inner"))


def trial_splits(samples: DataFrame, trials: int, train_rows: int, positives: tuple[int, ...], folds: int, seed: int, *, least_negatives: int = 3, candidates: int = 200, row: str = "row_id") -> DataFrame:
    """(trial, row, role, inner): the first ``trials`` seeded candidates that pass.

    A candidate trains on ``train_rows`` rows. It passes if its number of positives is one of ``positives`` and the test
    part of each of its contiguous inner folds has ``least_negatives`` negatives. Reading the result fails if fewer than ``trials``
    of the ``candidates`` pass.
    """
    drawn = shuffled(samples, seed, candidates, "candidate", row).join(samples.select(row, "y"), row)
    fold = _fold_of(F.col("position"), F.lit(train_rows).cast("long"), folds)
    train = drawn.where(F.col("position") < train_rows).withColumn("inner", fold)
    by_fold = train.groupBy("candidate", "inner").agg(F.count_if(F.col("y") > 0).alias("p"), F.count_if(F.col("y") <= 0).alias("n"))
    passed = by_fold.groupBy("candidate").agg(F.sum("p").alias("p"), F.min("n").alias("least")).where(F.col("p").isin(*positives) & (F.col("least") >= least_negatives))
    numbered = passed.select("candidate", (F.row_number().over(Window.orderBy("candidate")) - 1).alias("trial")).where(F.col("trial") < trials)  # ``candidates`` rows at most
    rows = drawn.join(F.broadcast(numbered), "candidate")
    inside = F.col("position") < train_rows
    out = rows.select("trial", row, F.when(inside, "tr").otherwise("te").alias("role"), F.when(inside, fold).alias("inner"))
    short = F.raise_error(F.lit(f"fewer than {trials} of {candidates} candidates pass")).cast("boolean")
    checked = numbered.agg(F.count(F.lit(1)).alias("n")).where(F.when(F.col("n") < trials, short).otherwise(F.lit(False)))  # never a row
    return out.unionByName(checked.select(*(F.lit(None).cast(t).alias(c) for c, t in out.dtypes)))


def grid(spark, **axes: list[float]) -> DataFrame:
    """The product of parameter lists in their order, numbered by ``ordinal``."""
    out = spark.createDataFrame([(0,)], "ordinal long")
    for name, values in axes.items():
        axis = spark.createDataFrame(list(enumerate(map(float, values))), f"k int, {name} double")
        out = out.crossJoin(F.broadcast(axis)).withColumn("ordinal", F.col("ordinal") * len(values) + F.col("k")).drop("k")
    return out


def grand_sum(long: DataFrame) -> DataFrame:
    """(total, cells): the sum of all stored values and their number."""
    return long.agg(F.sum("v").alias("total"), F.count("v").alias("cells"))


def greatest_norm(long: DataFrame, row: str = "row_id") -> DataFrame:
    """(kappa): the greatest Euclidean norm of a row."""
    return long.groupBy(row).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")).agg(F.max("norm").alias("kappa"))


def by_feature(long: DataFrame, row: str = "row_id") -> DataFrame:
    """(j, stored, total, first, last): the columns of a sparse table, as their number of values, sum and ends in row order."""
    kept = long.where(F.col("v") != 0)
    return kept.groupBy("j").agg(F.count(F.lit(1)).alias("stored"), F.sum("v").alias("total"), F.min_by("v", row).alias("first"), F.max_by("v", row).alias("last"))


def save_minmax(parameters: DataFrame, path: str, lower: float = -1.0, upper: float = 1.0) -> None:
    """The parameters of a scaling, with its range, as Parquet."""
    parameters.select("j", "low", "high", F.lit(float(lower)).alias("lower"), F.lit(float(upper)).alias("upper")).write.mode("overwrite").parquet(path)


def restore_minmax(long: DataFrame, path: str) -> DataFrame:
    """``long`` scaled by saved parameters; features that they do not have are dropped."""
    p = long.sparkSession.read.parquet(path)
    share = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))
    v = F.when(F.col("v") == F.col("low"), F.col("lower")).when(F.col("v") == F.col("high"), F.col("upper")).otherwise(F.col("lower") + (F.col("upper") - F.col("lower")) * share)
    return long.join(p, "j").withColumn("v", v).drop("low", "high", "lower", "upper")


def scale_labels(samples: DataFrame, lower: float = -1.0, upper: float = 1.0, y: str = "y") -> DataFrame:
    """``samples`` with labels scaled to [lower, upper] by their least and greatest value; equal labels stay."""
    ends = samples.agg(F.min(y).alias("low__"), F.max(y).alias("high__"))
    share = (F.col(y) - F.col("low__")) / (F.col("high__") - F.col("low__"))
    scaled = samples.crossJoin(F.broadcast(ends))  # one row
    return scaled.withColumn(y, F.when(F.col("high__") > F.col("low__"), lower + (upper - lower) * share).otherwise(F.col(y))).drop("low__", "high__")
