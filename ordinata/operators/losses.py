"""Losses, gradients and class statistics as aggregates over sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinata.functions.vector import expit, log_logistic


def class_means(long: DataFrame, samples: DataFrame) -> DataFrame:
    """(j, posi, nega): the mean of each feature by class; absent values count as zeros. A missing class gives nulls."""
    n = samples.agg(F.count_if(F.col("y") > 0).alias("n_p"), F.count_if(F.col("y") <= 0).alias("n_n"))
    sums = long.groupBy("j").agg(F.sum(F.when(F.col("y") > 0, F.col("v")).otherwise(0.0)).alias("s_p"), F.sum(F.when(F.col("y") > 0, 0.0).otherwise(F.col("v"))).alias("s_n"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return sums.crossJoin(F.broadcast(n)).select("j", share("s_p", "n_p").alias("posi"), share("s_n", "n_n").alias("nega"))


def linear_scores(long: DataFrame, weights: DataFrame, intercept: float = 0.0) -> DataFrame:
    """(row_id, y, score): the weighted sum of the features; zero weights are left out before the join."""
    return long.join(weights.where("w <> 0").select("j", "w"), "j").groupBy("row_id", "y").agg((F.sum(F.col("v") * F.col("w")) + intercept).alias("score"))


def loss_and_gradient(long: DataFrame, scores: DataFrame, weights: DataFrame, kind: str, eta: float = 0.0, p: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(loss, intercept_grad) and (j, grad) of a linear model at ``scores``.

    logistic: sum of -log expit(y s); square: mean of (s - y)^2 / 2; hinge2: sum of max(0, 1 - y s)^2;
    svr2: sum of max(0, |s - y| - p)^2. Each has eta/2 |w|^2 added, without the intercept.
    """
    y, s = F.col("y"), F.col("score")
    margin = F.greatest(1 - y * s, F.lit(0.0))
    slack = F.greatest(F.abs(s - y) - p, F.lit(0.0))
    value, slope = {
        "logistic": (-log_logistic(y * s), y * (expit(y * s) - 1)),
        "square": ((s - y) ** 2 / 2, s - y),
        "hinge2": (margin * margin, -2 * y * margin),
        "svr2": (slack * slack, 2 * F.signum(s - y) * slack),
    }[kind]
    total = F.avg if kind == "square" else F.sum
    sloped = scores.select("row_id", value.alias("value"), slope.alias("slope"))
    penalty = weights.agg((F.lit(eta / 2) * F.sum(F.col("w") * F.col("w"))).alias("penalty"))
    loss = sloped.agg(total("value").alias("value"), total("slope").alias("intercept_grad")).crossJoin(F.broadcast(penalty)).select((F.col("value") + F.col("penalty")).alias("loss"), "intercept_grad")
    scale = scores.agg(F.count(F.lit(1)).alias("n")) if kind == "square" else None
    grad = long.join(sloped.select("row_id", "slope"), "row_id").groupBy("j").agg(F.sum(F.col("v") * F.col("slope")).alias("g"))
    if scale is not None:
        grad = grad.crossJoin(F.broadcast(scale)).withColumn("g", F.col("g") / F.col("n")).drop("n")
    return loss, grad.join(weights.select("j", "w"), "j", "left").select("j", (F.col("g") + eta * F.coalesce("w", F.lit(0.0))).alias("grad"))


def block_gradient(samples_long: DataFrame, scores: DataFrame, means: DataFrame, weights: DataFrame, version: int) -> DataFrame:
    """(j, grad): the summed gradient of the AUC saddle objective over a block of rows, in one of three forms."""
    prior = scores.agg(F.avg((F.col("y") > 0).cast("double")).alias("p"), F.count(F.lit(1)).alias("rows"))
    at = means.join(weights, "j").agg(F.sum(F.col("posi") * F.col("w")).alias("u"), F.sum(F.col("nega") * F.col("w")).alias("q"))
    s = scores.crossJoin(F.broadcast(prior)).crossJoin(F.broadcast(at))
    pos, p, u, q, sc = F.col("y") > 0, F.col("p"), F.col("u"), F.col("q"), F.col("score")
    if version == 1:
        cx = F.when(pos, 2 * (1 - p) * (sc - u) - 2 * (1 + q - u) * (1 - p)).otherwise(2 * p * (sc - q) + 2 * (1 + q - u) * p)
        cp, cn = F.lit(0.0), F.lit(0.0)
    elif version == 0:
        lift = 2 * p * (1 - p) * (1 + q - u)
        cx = F.when(pos, 2 * (1 - p) * (sc - u)).otherwise(2 * p * (sc - q))
        cp, cn = -lift - F.when(pos, cx).otherwise(0.0), lift - F.when(pos, 0.0).otherwise(cx)
    else:
        both = 2 * p * (1 - p) * (u - q)
        cx = F.when(pos, 2 * (1 - p) * (sc - q - 1)).otherwise(2 * p * (sc - u + 1))
        cp = F.when(pos, 2 * (1 - p) * u - both).otherwise(-2 * p * sc - both)
        cn = F.when(pos, -2 * (1 - p) * sc + both).otherwise(2 * p * q + both)
    s = s.select("row_id", cx.alias("cx"), cp.alias("cp"), cn.alias("cn"))
    own = samples_long.join(s.select("row_id", "cx"), "row_id").groupBy("j").agg(F.sum(F.col("v") * F.col("cx")).alias("g"))
    sums = s.agg(F.sum("cp").alias("cp"), F.sum("cn").alias("cn"))
    return own.join(means, "j").crossJoin(F.broadcast(sums)).select("j", (F.col("g") + F.col("cp") * F.col("posi") + F.col("cn") * F.col("nega")).alias("grad"))


def hessian_vector(long: DataFrame, scores: DataFrame, direction: DataFrame, kind: str, eta: float = 0.0, p: float = 0.1) -> DataFrame:
    """(j, hv): the Hessian of ``loss_and_gradient``'s loss (a sum) at ``scores``, times the vector ``direction`` (j, w)."""
    y, s = F.col("y"), F.col("score")
    e = expit(y * s)
    curve = {"logistic": e * (1 - e), "hinge2": F.when(y * s < 1, 2.0).otherwise(0.0), "svr2": F.when(F.abs(s - y) > p, 2.0).otherwise(0.0)}[kind]
    along = linear_scores(long, direction).select("row_id", F.col("score").alias("along"))
    bent = scores.select("row_id", curve.alias("curve")).join(along, "row_id").select("row_id", (F.col("curve") * F.col("along")).alias("c"))
    summed = long.join(bent, "row_id").groupBy("j").agg(F.sum(F.col("v") * F.col("c")).alias("h"))
    return direction.join(summed, "j", "left").select("j", (F.coalesce("h", F.lit(0.0)) + eta * F.col("w")).alias("hv"))


def least_square_predict(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(row_id, value, label): the score itself and +1 where it reaches the threshold, else -1."""
    return scores.select("row_id", F.col("score").alias("value"), F.when(F.col("score") >= threshold, 1.0).otherwise(-1.0).alias("label"))
