"""Regularised linear classification and regression with the objectives of the usual linear library.

Smooth objectives are minimised by Newton steps and those with the absolute penalty by proximal ones, many models in one scan
(``batch``): the classes against the rest, the folds of a cross-validation, the folds at one C of a search. The hinge and the
absolute loss take dual ascent by parts (``dual``). Rows are dense (features) or sparse (indices, values).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordinata.operators import batch, dual
from ordinata.operators.prepare import random_folds

SOLVERS = {0: "logistic", 7: "logistic", 1: "hinge2", 2: "hinge2", 5: "hinge2", 6: "logistic", 11: "svr2", 12: "svr2", 3: "hinge", 13: "svr1"}
L1 = frozenset([5, 6])
REGRESSION = frozenset([11, 12, 13])
DEFAULT_EPS = {0: 0.01, 2: 0.01, 5: 0.01, 6: 0.01, 11: 0.0001, 1: 0.1, 3: 0.1, 4: 0.1, 7: 0.1, 12: 0.1, 13: 0.1}


def check_parameters(solver: int, c: float, eps: float, p: float = 0.1, bias: float = -1.0) -> str | None:
    """What is wrong with a set of parameters, or None."""
    if solver not in {*SOLVERS, 4}:
        return "unknown solver type"
    if eps <= 0:
        return "eps <= 0"
    if c <= 0:
        return "C <= 0"
    if p < 0:
        return "p < 0"
    return None


def parse_options(text: str) -> dict:
    """A dict of ``-s -c -p -e -B -w<label> -v -C -q``; eps defaults by solver."""
    out: dict = {"solver": 1, "c": 1.0, "p": 0.1, "bias": -1.0, "weights": {}, "folds": 0, "find_c": False, "quiet": False}
    words = text.split()
    names = {"-s": ("solver", int), "-c": ("c", float), "-p": ("p", float), "-e": ("eps", float), "-B": ("bias", float), "-v": ("folds", int)}
    at = 0
    while at < len(words):
        key = words[at]
        if key in ("-C", "-q"):
            out["find_c" if key == "-C" else "quiet"] = True
            at += 1
            continue
        if at + 1 == len(words):
            raise ValueError(f"{key} needs a value")
        if key in names:
            name, kind = names[key]
            out[name] = kind(words[at + 1])
        elif key.startswith("-w"):
            out["weights"][float(key[2:])] = float(words[at + 1])
        else:
            raise ValueError(f"unknown option {key}")
        at += 2
    out.setdefault("eps", DEFAULT_EPS[out["solver"]])
    return out


def spec(solver: int, c: float = 1.0, p: float = 0.1, **more) -> batch.Spec:
    """A model of ``batch`` by solver number."""
    if SOLVERS[solver] in ("hinge", "svr1"):
        raise ValueError("solvers 3 and 13 are dual: use train_dual")
    return batch.Spec(SOLVERS[solver], c, p, solver in L1, **more)


def loss_sum(samples: DataFrame, w: np.ndarray, kind: str, c: float, p: float, weights: dict[float, float]) -> float:
    """C times the summed loss."""
    return float(_family(samples, w, kind, c, p, weights).losses(_ONE, w[None])[0])


def slope_sum(samples: DataFrame, w: np.ndarray, kind: str, c: float, p: float, weights: dict[float, float]) -> tuple[float, np.ndarray]:
    """C times the summed loss and gradient."""
    f, g, _ = _family(samples, w, kind, c, p, weights).slopes(_ONE, w[None], False)
    return float(f[0]), g[0]


def bend_sum(samples: DataFrame, w: np.ndarray, v: np.ndarray, kind: str, c: float, p: float, weights: dict[float, float]) -> np.ndarray:
    """C times the summed Hessian at w, times the vector v."""
    return _family(samples, w, kind, c, p, weights).bends(_ONE, w[None], v[None])[0]


def sums(samples: DataFrame, w: np.ndarray, kind: str, c: float, p: float, weights: dict[float, float]) -> tuple[float, np.ndarray, np.ndarray]:
    """C times the summed loss, gradient and Hessian over all rows."""
    f, g, h = _family(samples, w, kind, c, p, weights).slopes(_ONE, w[None], True)
    return float(f[0]), g[0], h[0]


_ONE = np.zeros(1, int)


def _family(samples: DataFrame, w: np.ndarray, kind: str, c: float, p: float, weights: dict[float, float]) -> batch.Family:
    return batch.Family(samples, len(w), [batch.Spec(kind, c, p, weights=weights or {})], "y")


def train(samples: DataFrame, d: int, solver: int = 2, c: float = 1.0, eps: float | None = None, p: float = 0.1, weights: dict[float, float] | None = None, start: np.ndarray | None = None, max_iter: int = 100) -> tuple[np.ndarray, float]:
    """(w, objective) of a binary classifier (y in {+1, -1}) or a regression; the bias is a feature and is regularised.

    ``samples`` has y and either ``features`` or ``indices`` (from 0) and ``values``. With more than ``batch.WHOLE`` features
    the squared penalty takes Newton steps by conjugate gradients, whose products with the Hessian, like the gradient, are
    one number for each feature from every partition; a line search adds up losses alone. The absolute penalty then steps in the
    features that violate its optimality most.
    """
    eps = DEFAULT_EPS[solver] if eps is None else eps
    if problem := check_parameters(solver, c, eps, p):
        raise ValueError(problem)
    w, f, _ = batch.train(samples, d, [spec(solver, c, p, weights=weights or {})], eps=min(eps, 1e-6), start=None if start is None else start[None], max_iter=max_iter if solver not in L1 or d <= batch.WHOLE else 10 * max_iter)
    return w[0], float(f[0])


def dual_descent(x: np.ndarray, y: np.ndarray, c: float, kind: str = "hinge", p: float = 0.1, rounds: int = 1000, eps: float = 1e-3, seed: int = 1) -> np.ndarray:
    """Coordinate descent on the box-constrained dual of the hinge loss, or of the absolute epsilon loss."""
    rng, w, alpha, q = np.random.default_rng(seed), np.zeros(x.shape[1]), np.zeros(len(y)), np.maximum((x * x).sum(1), 1e-12)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            if kind == "hinge":
                fresh = min(max(alpha[i] - (y[i] * float(x[i] @ w) - 1) / q[i], 0.0), c)
                move = (fresh - alpha[i]) * y[i]
            else:
                z = alpha[i] - (float(x[i] @ w) - y[i]) / q[i]
                fresh = min(max(np.sign(z) * max(abs(z) - p / q[i], 0.0), -c), c)
                move = fresh - alpha[i]
            most = max(most, abs(move))
            w += move * x[i]
            alpha[i] = fresh
        if most < eps * c:
            break
    return w


def one_vs_rest(samples: DataFrame, d: int, labels: list[float], solver: int = 2, c: float = 1.0) -> np.ndarray:
    """One weight vector for each label, all trained by the same scans."""
    return batch.train(samples, d, [spec(solver, c, head=float(v)) for v in labels], label="label")[0]


def with_scores(samples: DataFrame, weights: np.ndarray, out: str = "s") -> DataFrame:
    """``samples`` with the scores under every row of ``weights`` as an array; the weights are one broadcast row, not part of the plan."""
    model = samples.sparkSession.createDataFrame([([[float(v) for v in w] for w in weights],)], "weights__ array<array<double>>")
    score = F.transform("weights__", lambda w: F.aggregate(F.zip_with("features", w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return samples.crossJoin(F.broadcast(model)).withColumn(out, score).drop("weights__")  # one row


def predict(samples: DataFrame, weights: np.ndarray, labels: list[float]) -> DataFrame:
    """(row_id, prediction, probability): the label of the largest score, ties to the first; logistic shares of the scores."""
    scored = with_scores(samples, weights).select("row_id", "s")
    if len(labels) == 2 and len(weights) == 1:
        one = scored.withColumn("s", F.get("s", F.lit(0)))
        return one.select("row_id", F.when(F.col("s") > 0, labels[0]).otherwise(labels[1]).alias("prediction"), (1 / (1 + F.exp(-F.abs("s")))).alias("probability"))
    shares = F.transform("s", lambda v: 1 / (1 + F.exp(-v)))
    best = F.array_position("s", F.array_max("s")).cast("int")
    return scored.select("row_id", F.element_at(F.array(*map(F.lit, labels)), best).alias("prediction"), (F.element_at(shares, best) / F.aggregate(shares, F.lit(0.0), lambda a, v: a + v)).alias("probability"))


def class_counts(samples: DataFrame, label: str = "label", row: str = "row_id") -> DataFrame:
    """(label, first, n): every class with its first row and its rows."""
    return samples.groupBy(label).agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n"))


def probabilities(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """(row_id, label, score, probability): the logistic shares of all classes, for weights (label, w array).

    As many rows as rows times classes; the table of weights is joined as a whole, one row for each class.
    """
    from ordinata.functions.vector import dot, expit

    scored = samples.select("row_id", "features").crossJoin(F.broadcast(weights)).select("row_id", "label", dot(F.col("features"), F.col("w")).alias("score"))
    share = expit(F.col("score"))
    return scored.withColumn("probability", share / F.sum(share).over(Window.partitionBy("row_id")))


def crammer_singer(x: np.ndarray, k: np.ndarray, classes: int, c: float = 1.0, eps: float = 0.1, rounds: int = 1000, seed: int = 1) -> np.ndarray:
    """Weights (classes, features) of the multiclass machine, by descent on each row's block of its dual.

    A row's block solves: least sum over m of A a_m^2 / 2 + B_m a_m, the a_m summing to 0, a_m at most C for the row's
    class and 0 for the others; so a_m = min(C_m, (beta - B_m) / A) with the beta that makes the sum 0.
    """
    rng, w, alpha, size = np.random.default_rng(seed), np.zeros((classes, x.shape[1])), np.zeros((len(k), classes)), (x * x).sum(1)
    counting = np.arange(1, classes + 1)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(k)):
            if size[i] <= 0:
                continue
            margin = w @ x[i] + 1.0
            margin[k[i]] -= 1.0
            cap = np.zeros(classes)
            cap[k[i]] = c
            free = alpha[i] < cap - 1e-12
            worst = max(worst, float(margin.max() - margin[free].min()) if free.any() else 0.0)
            b = margin - size[i] * alpha[i]
            d = np.sort(b + size[i] * cap)[::-1]
            betas = (np.cumsum(d) - size[i] * c) / counting
            beta = betas[np.flatnonzero(d > betas - 1e-15)[-1]]
            fresh = np.minimum(cap, (beta - b) / size[i])
            w += np.outer(fresh - alpha[i], x[i])
            alpha[i] = fresh
        if worst < eps:
            break
    return w


def train_dual(samples: DataFrame, method: str = "hinge", c: float = 1.0, p: float = 0.1, by: str = "task_id") -> DataFrame:
    """(task, label, j, w) by coordinate descent on the dual, one grouped-map task for each value of ``by``.

    method: hinge (y in {+1, -1}), absolute (regression with a margin of ``p``) or multiclass (y any label; a row of
    weights for each). The descent visits rows one by one, so a task's rows meet in one worker; tasks run in parallel.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        x, y = np.stack(pdf["features"].to_numpy()).astype(float), pdf["y"].to_numpy(float)
        if method == "multiclass":
            labels, k = np.unique(y, return_inverse=True)
            w = crammer_singer(x, k, len(labels), c)
        else:
            labels, w = np.ones(1), dual_descent(x, y, c, "hinge" if method == "hinge" else "svr", p)[None, :]
        wide = w.shape[1]
        return pd.DataFrame({"task": pdf[by].iloc[0], "label": np.repeat(labels, wide), "j": np.tile(np.arange(wide), len(labels)), "w": w.ravel()})

    return samples.select(by, "row_id", "y", "features").groupBy(by).applyInPandas(run, "task long, label double, j int, w double")


def group_classes(samples: DataFrame, label: str = "label") -> list[tuple[float, int]]:
    """(label, rows) by first occurrence; of the two labels -1 and +1, +1 comes first. As many entries as classes."""
    found = samples.groupBy(F.col(label).cast("double").alias("label")).agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first").collect()
    classes = [(r["label"], r["n"]) for r in found]
    return classes[::-1] if [v for v, _ in classes] == [-1.0, 1.0] else classes


@dataclass(frozen=True)
class Model:
    """Weights of a classifier (one row for two classes, else one for each label) or of a regression (no labels)."""

    solver: int
    labels: tuple[float, ...]
    weights: np.ndarray
    bias: float = -1.0

    def coefficient(self, feature: int, label_index: int = 0) -> float:
        """The weight of a feature (from 1) for a label; the second label of two has the first one's with the sign changed, and what is out of range is 0."""
        if not 1 <= feature <= self.weights.shape[1] - (self.bias >= 0):
            return 0.0
        return self._of(feature - 1, label_index)

    def intercept(self, label_index: int = 0) -> float:
        return self._of(-1, label_index) * self.bias if self.bias >= 0 else 0.0

    def _of(self, column: int, label_index: int) -> float:
        if not self.labels:
            return float(self.weights[0, column])
        if not 0 <= label_index < len(self.labels):
            return 0.0
        if len(self.weights) == 1 and len(self.labels) == 2:
            return float(self.weights[0, column]) * (1 if label_index == 0 else -1)
        return float(self.weights[label_index, column])

    def predict(self, samples: DataFrame) -> DataFrame:
        """(row_id, prediction, probability); features beyond the model's are ignored. A regression has no probability."""
        width = self.weights.shape[1] - (self.bias >= 0)
        cut = samples.withColumn("features", F.slice("features", 1, width))
        if self.bias >= 0:
            cut = cut.withColumn("features", F.concat("features", F.array(F.lit(float(self.bias)))))
        if not self.labels:
            return with_scores(cut, self.weights).select("row_id", F.get("s", F.lit(0)).alias("prediction"), F.lit(None).cast("double").alias("probability"))
        return predict(cut, self.weights, list(self.labels))


def train_model(samples: DataFrame, d: int, options: dict, label: str = "label") -> Model:
    """Train by parsed options: labels by first occurrence, class weights, one against the rest, bias as a feature."""
    solver, c, bias = options["solver"], options["c"], options["bias"]
    if problem := check_parameters(solver, c, options["eps"], options["p"], bias):
        raise ValueError(problem)
    rows = samples.withColumn("label", F.col(label).cast("double"))
    if bias >= 0:
        rows, d = rows.withColumn("features", F.concat("features", F.array(F.lit(float(bias))))), d + 1
    if solver in REGRESSION:
        rows = rows.withColumn("y", F.col("label"))
        return Model(solver, (), _weights(rows, d, options, {})[None, :], bias)
    labels = tuple(v for v, _ in group_classes(rows))
    if solver == 4:
        got = train_dual(rows.withColumn("y", F.col("label")).withColumn("task_id", F.lit(0).cast("long")), "multiclass", c).collect()  # classes times features
        weights = np.zeros((len(labels), d))
        for r in got:
            weights[labels.index(r["label"]), r["j"]] = r["w"]
        return Model(solver, labels, weights, bias)
    heads = labels[:1] if len(labels) == 2 else labels
    own = options["weights"]
    # of the rest of several classes each row has the weight 1
    scales = [{head: own.get(head, 1.0)} | ({labels[1]: own.get(labels[1], 1.0)} if len(labels) == 2 else {}) for head in heads]
    if SOLVERS[solver] == "hinge":
        binary = [(rows.withColumn("y", F.when(F.col("label") == head, 1.0).otherwise(-1.0)), scale) for head, scale in zip(heads, scales, strict=True)]
        return Model(solver, labels, np.stack([_weights(y, d, options, {1.0: scale[head], -1.0: scale.get(labels[1], 1.0) if len(labels) == 2 else 1.0}) for (y, scale), head in zip(binary, heads, strict=True)]), bias)
    specs = [spec(solver, c, options["p"], head=head, weights={k: v for k, v in scale.items() if v != 1.0}) for head, scale in zip(heads, scales, strict=True)]
    return Model(solver, labels, batch.train(rows, d, specs, label="label", eps=min(options["eps"], 1e-6))[0], bias)


def _weights(rows: DataFrame, d: int, options: dict, scale: dict[float, float]) -> np.ndarray:
    """Weights of one model; ``scale`` weights C by y."""
    solver, c = options["solver"], options["c"]
    scale = {v: k for v, k in scale.items() if k != 1.0}
    if SOLVERS[solver] in ("hinge", "svr1"):
        found = dual.fit(rows, "hinge" if SOLVERS[solver] == "hinge" else "absolute", c, options["p"], weights=scale, gap=min(options["eps"], 1e-2)).weights
        return found if len(found) else np.zeros(d)
    return train(rows, d, solver, c, options["eps"], options["p"], scale)[0]


def cross_validate(samples: DataFrame, d: int, options: dict, folds: int, seed: int = 1, label: str = "label") -> DataFrame:
    """(row_id, y, prediction): each row by the model that was trained on the other folds.

    The models of all folds, and of all classes against the rest, are trained by the same scans; those of the dual solvers fold by fold.
    """
    placed = samples.join(random_folds(samples, folds, seed), "row_id")
    models = _fold_models(placed, d, options, folds, label) if options["solver"] not in (3, 4, 13) else [train_model(placed.where(F.col("fold") != k), d, options, label) for k in range(folds)]
    parts = []
    for k, model in enumerate(models):
        held = placed.where(F.col("fold") == k)
        parts.append(model.predict(held).join(held.select("row_id", F.col(label).cast("double").alias("y")), "row_id").select("row_id", "y", "prediction"))
    return reduce(DataFrame.unionAll, parts)


def _fold_models(placed: DataFrame, d: int, options: dict, folds: int, label: str) -> list[Model]:
    """For each fold the model of the rows outside it; labels in the order of their first row there."""
    solver, c, p, bias = options["solver"], options["c"], options["p"], options["bias"]
    if problem := check_parameters(solver, c, options["eps"], p, bias):
        raise ValueError(problem)
    rows = placed.withColumn("label", F.col(label).cast("double"))
    if bias >= 0:
        rows, d = rows.withColumn("features", F.concat("features", F.array(F.lit(float(bias))))), d + 1
    orders: list[tuple[float, ...]] = [()] * folds
    if solver not in REGRESSION:
        found = rows.groupBy("label", "fold").agg(F.min("row_id").alias("first")).collect()  # labels times folds
        for k in range(folds):
            first: dict[float, int] = {}
            for r in found:
                if r["fold"] != k:
                    first[r["label"]] = min(r["first"], first.get(r["label"], r["first"]))
            order = tuple(sorted(first, key=first.get))
            orders[k] = order[::-1] if order == (-1.0, 1.0) else order
    heads = [(k, head) for k, order in enumerate(orders) for head in (order[:1] if len(order) == 2 else order or (None,))]
    own = options["weights"]
    specs = [spec(solver, c, p, head=head, held=k, weights={v: own[v] for v in ({head, *orders[k]} if len(orders[k]) == 2 else {head}) if v in own}) for k, head in heads]
    w = batch.train(rows, d, specs, label="label", eps=min(options["eps"], 1e-6))[0]
    return [Model(solver, order, w[[i for i, (fold, _) in enumerate(heads) if fold == k]], bias) for k, order in enumerate(orders)]


def first_c(samples: DataFrame, solver: int, p: float = 0.1) -> float:
    """Where the search for C starts: the power of two below the least C that can move the weights."""
    norm = F.aggregate("features", F.lit(0.0), lambda s, v: s + v * v)
    slack = F.greatest(F.abs("y") - p, F.lit(0.0))
    r = samples.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most"), F.sum(F.abs("y")).alias("sum_y"), F.sum(slack * slack).alias("loss")).first()
    if not r["n"] or not r["most"]:
        return 1.0
    if SOLVERS[solver] == "svr2":
        least = 0.01 * r["loss"] / (8 * r["sum_y"] ** 2 * r["most"]) if r["loss"] else 1.0
    else:
        least = 1.0 / ((2 if SOLVERS[solver] == "hinge2" else 1) * r["n"] * r["most"])
    return 2.0 ** math.floor(math.log2(least))


def search_c(samples: DataFrame, d: int, solver: int = 2, folds: int = 5, seed: int = 1, start: float | None = None, most: float = 1024.0, p: float = 0.1) -> list[tuple[float, float]]:
    """(C, score) along C = start, 2 start, ...: the held-out accuracy, or for a regression the mean squared error.

    The folds' models share their scans, and each starts from its weights and sums at the last C, so a C costs a scan for each Newton step. The scores of
    all C are one scan at the end. The search ends after five C in a row that move no weights, or beyond ``most``. The first best entry is ``best_c``.
    """
    placed = samples.select("row_id", "y", "features").join(random_folds(samples, folds, seed), "row_id").cache()
    try:
        c, still, warm, path, found, carry = start or first_c(samples, solver, p), 0, None, [], [], {}
        while c <= most:
            models = batch.train(placed, d, [spec(solver, c, p, held=k) for k in range(folds)], eps=1e-6, start=warm, carry=carry)[0]
            moved = warm is None or bool((np.linalg.norm(models - warm, axis=1) > 1e-15).any())
            path.append(c)
            found.append(models)
            warm, still, c = models, 0 if moved else still + 1, 2 * c
            if still == 5:
                break
        if not path:
            return []
        scored = with_scores(placed, np.concatenate(found))
        own = [F.get("s", F.col("fold") + k * folds) for k in range(len(path))]
        hits = [F.pow(s - F.col("y"), 2) if SOLVERS[solver] == "svr2" else ((s > 0) == (F.col("y") > 0)).cast("double") for s in own]
        scores = scored.agg(*(F.avg(hit).alias(f"s{k}") for k, hit in enumerate(hits))).first()
        return [(c, float(score)) for c, score in zip(path, scores, strict=True)]
    finally:
        placed.unpersist()


def best_c(path: list[tuple[float, float]], solver: int) -> tuple[float, float]:
    """The first best (C, score) of a search."""
    return min(path, key=lambda x: x[1]) if SOLVERS[solver] == "svr2" else max(path, key=lambda x: x[1])


def search_p(samples: DataFrame, d: int, folds: int = 5, seed: int = 1, most: float = 1024.0, start: float | None = None, steps: int = 20) -> tuple[float, float, float]:
    """(C, p, error) of a regression: p falls from 19/20 of the greatest |y| to 0, each with a search of C."""
    greatest = float(samples.agg(F.max(F.abs("y")).alias("m")).first()["m"] or 0.0)
    best = (1.0, 0.0, math.inf)
    for i in range(steps - 1, -1, -1):
        p = i / steps * greatest
        c, error = best_c(search_c(samples, d, 11, folds, seed, start, most, p), 11)
        if error < best[2]:
            best = (c, p, error)
    return best


def train_by_options(samples: DataFrame, d: int, text: str, label: str = "label") -> Model | float | tuple[float, float]:
    """What an option string asks for: a model, the cross-validated score (``-v``), or the best (C, score) (``-C``)."""
    options = parse_options(text)
    if options["find_c"]:
        if options["solver"] not in (0, 2, 11):
            raise ValueError("-C needs solver 0, 2 or 11")
        y = F.col(label).cast("double")
        if options["solver"] != 11:
            head = group_classes(samples, label)[0][0]
            y = F.when(y == head, 1.0).otherwise(-1.0)
        return best_c(search_c(samples.withColumn("y", y), d, options["solver"], options["folds"] or 5, p=options["p"]), options["solver"])
    if options["folds"]:
        held = cross_validate(samples, d, options, options["folds"], label=label)
        score = F.avg(F.pow(F.col("prediction") - F.col("y"), 2)) if options["solver"] in REGRESSION else 100 * F.avg((F.col("prediction") == F.col("y")).cast("double"))
        return float(held.agg(score.alias("score")).first()["score"])
    return train_model(samples, d, options, label)


def model_text(solver: str, labels: list[int], weights: np.ndarray, bias: float = -1.0) -> str:
    """The text form of a model; ``load_model`` reads it back."""
    head = [f"solver_type {solver}", f"nr_class {len(labels)}", "label " + " ".join(map(str, labels)), f"nr_feature {weights.shape[1] - (bias >= 0)}", f"bias {bias:.17g}", "w"]
    return "\n".join(head + ["".join(f"{v:.17g} " for v in column) for column in weights.T]) + "\n"


def load_model(text: str) -> tuple[dict[str, str], np.ndarray]:
    head, _, body = text.partition("\nw\n")
    fields = dict(line.split(" ", 1) for line in head.split("\n"))
    return fields, np.array([[float(v) for v in line.split()] for line in body.strip().split("\n")]).T


def predict_file(spark: SparkSession, test: str, model: str, out: str) -> DataFrame:
    """Predict the lines of libsvm files by a model's text, write a label a line to ``out`` in their order; (n, acc, mse) against the files' labels.

    Features that the model does not have are ignored; a bias is put behind the others.
    """
    from ordinata.sources import libsvm

    head, weights = load_model(model)
    bias, labels = float(head["bias"]), [float(v) for v in head.get("label", "").split()]
    table = spark.createDataFrame([([[float(v) for v in w] for w in weights],)], "weights__ array<array<double>>")
    rows = libsvm.read(spark, test).crossJoin(F.broadcast(table))  # one row
    width = weights.shape[1] - (bias >= 0)
    term = lambda w: F.zip_with("indices", "values", lambda j, v: F.when(j < width, v * F.get(w, j)).otherwise(0.0))
    last = lambda w: F.get(w, F.lit(width)) * bias if bias >= 0 else F.lit(0.0)
    scores = F.transform("weights__", lambda w: F.aggregate(term(w), F.lit(0.0), lambda a, b: a + b) + last(w))
    scored = rows.withColumn("s", scores)
    first = F.get("s", F.lit(0))
    if not labels:
        guess = first
    elif len(weights) == 1:
        guess = F.when(first > 0, labels[0]).otherwise(labels[1])
    else:
        guess = F.element_at(F.array(*map(F.lit, labels)), F.array_position("s", F.array_max("s")).cast("int"))
    scored = scored.select("row_id", "y", guess.alias("prediction"))
    scored.select(F.format_string("%s", F.col("prediction").cast("string")).alias("value")).write.mode("overwrite").text(out)
    return scored.agg(F.count(F.lit(1)).alias("n"), (100 * F.avg((F.col("prediction") == F.col("y")).cast("double"))).alias("acc"), F.avg(F.pow(F.col("prediction") - F.col("y"), 2)).alias("mse"))
