"""Summaries of experiment results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_std(results: DataFrame, by: list[str], value: str = "auc") -> DataFrame:
    return results.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def best_setting(scores: DataFrame, task: list[str], ordinal: str = "ordinal", value: str = "auc") -> DataFrame:
    """By task, the first setting in grid order of the highest mean over its folds."""
    means = scores.groupBy(*task, ordinal).agg(F.avg(value).alias("mean"))
    ranked = means.withColumn("k", F.row_number().over(Window.partitionBy(*task).orderBy(F.desc("mean"), ordinal)))
    return ranked.where("k = 1").drop("k")


def best_by(summary: DataFrame, by: str) -> DataFrame:
    """The mean of the best setting of each group, with that setting's deviation."""
    return summary.groupBy(by).agg(F.max("mean").alias("best"), F.max_by("std", "mean").alias("std"))


def reference_share(models: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """By group, the share of the selected features (w <> 0) that a reference list of ``j`` has; 0 where none is selected."""
    known = reference.select("j").distinct().withColumn("known", F.lit(True))
    marked = models.join(known, "j", "left").groupBy(*by).agg(F.count_if(F.col("w") != 0).alias("n_selected"), F.count_if((F.col("w") != 0) & F.col("known")).alias("n_known"))
    return marked.withColumn("share", F.when(F.col("n_selected") > 0, F.col("n_known") / F.col("n_selected")).otherwise(0.0))


def learning_curve(traces: DataFrame, every: int = 1) -> DataFrame:
    """(step, auc): the mean over tasks at each step as a share of the greatest AUC; every ``every``-th step from the first."""
    greatest = traces.agg(F.max("auc").alias("greatest"))
    means = traces.groupBy("step").agg(F.avg("auc").alias("auc"))
    scaled = means.crossJoin(F.broadcast(greatest)).select("step", (F.col("auc") / F.col("greatest")).alias("auc"))  # one row
    if every == 1:
        return scaled
    return scaled.withColumn("k", F.row_number().over(Window.orderBy("step")) - 1).where(F.col("k") % every == 0).drop("k")  # one row a step


def mean_variance(df: DataFrame, value: str) -> DataFrame:
    """(n, mean, variance) with the population variance."""
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def support(vector: DataFrame, least: float = 0.0, task: tuple[str, ...] = ()) -> DataFrame:
    """By task, the number and the sorted positions of the weights whose magnitude exceeds ``least``; null positions where there are none."""
    kept = vector.where(F.abs("w") > least)
    listed = F.array_join(F.array_sort(F.collect_list("j")), ",")  # one vector's positions
    return kept.groupBy(*task).agg(F.count(F.lit(1)).alias("n_nonzero"), F.when(F.count(F.lit(1)) > 0, listed).alias("positions"))
