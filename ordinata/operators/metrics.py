"""Ranking and evaluation metrics over (y, score) tables; every curve is by distinct score, so ties count half."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordinata.operators.prefix import join_groups, running


def _classes(y: str) -> dict:
    return {"p": F.when(F.col(y) > 0, 1).otherwise(0), "n": F.when(F.col(y) > 0, 0).otherwise(1)}


def curve(df: DataFrame, score: str = "score", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """By falling score: tp, fp, tpr, fpr, precision, with the class totals. A class without rows gives nulls.

    Rows without a score or a label are left out; a null in ``by`` is a group like any other.
    """
    df = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    ran = running(df, score, _classes(y), by, descending=True)
    total = df.groupBy(*by).agg(*(F.sum(c).alias(f"total_{n}") for n, c in _classes(y).items()))
    joined = join_groups(ran, total, list(by)) if by else ran.crossJoin(F.broadcast(total))  # one row
    tp, fp = F.col("cum_p"), F.col("cum_n")
    share = lambda a, b: F.when(b > 0, a / b)
    return joined.select(*by, score, F.col("p"), F.col("n"), tp.alias("tp"), fp.alias("fp"), "total_p", "total_n", share(tp, F.col("total_p")).alias("tpr"), share(fp, F.col("total_n")).alias("fpr"), (tp / (tp + fp)).alias("precision"))


def auc(df: DataFrame, score: str = "score", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """Exact AUC: the share of (positive, negative) pairs in order, ties counting half."""
    c = curve(df, score, y, by)
    above = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2))
    pairs = F.max("total_p") * F.max("total_n")
    return c.groupBy(*by).agg(F.max("total_p").alias("n_pos"), F.max("total_n").alias("n_neg"), F.when(pairs > 0, above / pairs).alias("auc"))


def auc_step_compat(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """AUC of the step curve without its last rank: 1/N- is missing if the lowest-scored row is negative."""
    full = auc(df, score, y)
    lowest = df.agg(F.min_by(F.col(y), F.col(score)).alias("low"))
    return full.crossJoin(F.broadcast(lowest)).select((F.col("auc") - F.when(F.col("low") > 0, 0.0).otherwise(1 / F.col("n_neg"))).alias("auc"))


def roc_summary(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """AUC and its complement, the equal error rate and its threshold; ``roc_areas`` has the areas of four coordinate pairs."""
    area = auc(df, score, y)
    c = curve(df, score, y).select(score, F.greatest(1 - F.col("tpr"), F.col("fpr")).alias("worst"))
    eer = c.agg(F.min(F.struct("worst", (-F.col(score)).alias("s"))).alias("m")).select(F.col("m.worst").alias("eer"), (-F.col("m.s")).alias("eer_threshold"))
    return area.crossJoin(eer).select("auc", (1 - F.col("auc")).alias("auc_tntp_complement"), "eer", "eer_threshold", "n_pos", "n_neg")


def pr_summary(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """Average precision, the trapezoid area under precision over recall, and the 11-point interpolated precision.

    The area starts at recall 0 with precision 1.
    """
    c = curve(df, score, y)
    points = F.array(*(F.lit(i / 10) for i in range(11)))
    best = c.select(F.explode(points).alias("r"), "tpr", "precision").where("tpr >= r").groupBy("r").agg(F.max("precision").alias("q")).agg((F.sum("q") / 11).alias("ap11"))
    above = F.col("tp") + F.col("fp") - F.col("p") - F.col("n")
    last = F.when(above > 0, (F.col("tp") - F.col("p")) / above).otherwise(1.0)
    area = F.sum(F.when(F.col("p") > 0, F.col("p") / F.col("total_p") * (F.col("precision") + last) / 2)).alias("auc_pr")
    ap = c.agg(F.sum(F.when(F.col("p") > 0, F.col("p") * F.col("precision") / F.col("total_p"))).alias("ap"), area, F.max("total_p").alias("n_pos"))
    return ap.crossJoin(best)


def det(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """Miss and false-alarm rates by threshold."""
    return curve(df, score, y).select(score, (1 - F.col("tpr")).alias("miss"), F.col("fpr").alias("false_alarm"))


def retrieved_curve(df: DataFrame, n_pos: int | None = None, n_neg: int | None = None, score: str = "score", y: str = "y") -> DataFrame:
    """(score, tpr, fpr) of what was retrieved: rows of label 0 do not count, and rows of score -inf only to the totals.

    ``n_pos`` and ``n_neg`` say how many rows there are of each class if the table has only some of them.
    """
    judged = df.where(F.col(y) != 0)
    total = judged.agg(F.count_if(F.col(y) > 0).alias("all_p"), F.count_if(F.col(y) < 0).alias("all_n"))
    c = curve(judged.where(F.col(score) > float("-inf")), score, y).crossJoin(F.broadcast(total))  # one row
    p, n = (F.col(k) if v is None else F.lit(v) for k, v in (("all_p", n_pos), ("all_n", n_neg)))
    return c.select(score, F.when(p > 0, F.col("tp") / p).otherwise(0.0).alias("tpr"), F.when(n > 0, F.col("fp") / n).otherwise(0.0).alias("fpr"))


def precision_at_prior(df: DataFrame, prior: float, score: str = "score", y: str = "y") -> DataFrame:
    """(score, recall, precision), the precision being that of classes mixed with ``prior`` positives."""
    c = curve(df, score, y)
    hit, miss = prior * F.col("tpr"), (1 - prior) * F.col("fpr")
    return c.select(score, F.col("tpr").alias("recall"), F.when(hit + miss > 0, hit / (hit + miss)).alias("precision"))


def evaluate(df: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """Accuracy in percent of equal signs, mean squared error, squared correlation (null where it is 0/0)."""
    y_, v = F.col(y), F.col(prediction)
    r = F.corr(v, y_)
    return df.agg((100 * F.avg(((y_ > 0) == (v > 0)).cast("double"))).alias("acc"), F.avg((v - y_) ** 2).alias("mse"), F.nanvl(r * r, F.lit(None).cast("double")).alias("scc"))


def support_scores(selected: DataFrame, truth: DataFrame, j: str = "j") -> DataFrame:
    """Precision, recall and F1 of a set of features; 0 where a set is empty."""
    both = selected.select(j).distinct().withColumn("s", F.lit(1)).join(truth.select(j).distinct().withColumn("t", F.lit(1)), j, "full")
    c = both.agg(F.count("s").alias("n_s"), F.count("t").alias("n_t"), F.count_if(F.col("s").isNotNull() & F.col("t").isNotNull()).alias("hit"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = c.select(share(F.col("hit"), F.col("n_s")).alias("precision"), share(F.col("hit"), F.col("n_t")).alias("recall"))
    total = F.col("precision") + F.col("recall")
    return c.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), total))


def rank_curve(aucs: DataFrame, by: str = "method", value: str = "auc") -> DataFrame:
    """Values of each group by falling order."""
    return aucs.select(by, value, F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value))).alias("rank"))


def roc_areas(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """The trapezoid areas of true positives over true negatives and over false positives, of true negatives over true
    positives, and of false negatives over false positives."""
    c = curve(df, score, y)
    step_p, step_n = F.col("p") / F.col("total_p"), F.col("n") / F.col("total_n")
    tpr, fpr = F.col("tpr") - step_p / 2, F.col("fpr") - step_n / 2  # in the middle of a step
    return c.agg(F.sum(step_n * tpr).alias("auc_tntp"), F.sum(step_n * tpr).alias("auc_fptp"), F.sum(step_p * (1 - fpr)).alias("auc_tptn"), F.sum(step_n * (1 - tpr)).alias("auc_fpfn"))
