"""Many linear models in one scan of the rows.

Models that differ in the class they tell from the rest, the fold they leave out, C, the margin p or the class weights are one
matrix of weights. A scan scores a batch of rows under all of them at once and adds up every model's loss, gradient and,
as needed, Hessian or its product with a direction; K times some d (or d^2) numbers reach the driver, which takes the
Newton steps. Models go in lockstep and drop out when they are done, so a family costs as many scans as its slowest model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that a scan gives at most; beyond it steps use products with the Hessian, or several scans.
MOST_SUMS = 1 << 21
#: Up to so many features a step uses the whole Hessian.
WHOLE = 256


@dataclass
class Spec:
    """One model: loss (logistic, hinge2 or svr2), C, margin, penalty, the label that is its positive class (None: y itself), the fold it leaves out and weights by label."""

    kind: str
    c: float = 1.0
    p: float = 0.1
    l1: bool = False
    head: float | None = None
    held: int | None = None
    weights: dict[float, float] = field(default_factory=dict)


def terms(kind: str, y: np.ndarray, s: np.ndarray, p: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, first and second derivative by score."""
    if kind == "logistic":
        z = np.clip(y * s, -500, 500)
        e = 1 / (1 + np.exp(-z))
        return np.logaddexp(0, -z), y * (e - 1), e * (1 - e)
    if kind == "hinge2":
        m = np.maximum(1 - y * s, 0)
        return m * m, -2 * y * m, 2.0 * (m > 0)
    m = np.maximum(np.abs(s - y) - p, 0)
    return m * m, 2 * np.sign(s - y) * m, 2.0 * (m > 0)


class Rows:
    """The rows of an Arrow batch (label, fold, then features, or indices from 0 and values) as one matrix of width d."""

    def __init__(self, batch: pa.RecordBatch, d: int):
        self.label, self.fold, self.d = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), d
        lists = [batch.column(k) for k in range(2, batch.num_columns)]
        ends = lists[0].offsets.to_numpy()
        values = lists[-1].values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(float)
        self.row = np.repeat(np.arange(len(self.label)), np.diff(ends))
        if len(lists) == 2:
            j = lists[0].values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64)
        else:
            j = np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], np.diff(ends))
        kept = j < d  # features beyond the models' are ignored
        self.values, self.row, self.j = values[kept], self.row[kept], j[kept]
        self.dense = self.values.reshape(len(self.label), d) if len(self.values) == len(self.label) * d else None

    def scores(self, w: np.ndarray) -> np.ndarray:
        """[row, model]."""
        if self.dense is not None:
            return self.dense @ w.T
        return np.column_stack([np.bincount(self.row, self.values * v[self.j], minlength=len(self.label)) for v in w])

    def gather(self, c: np.ndarray) -> np.ndarray:
        """[model, feature]: the rows' sums with the coefficients [row, model]."""
        if self.dense is not None:
            return c.T @ self.dense
        return np.stack([np.bincount(self.j, self.values * v[self.row], minlength=self.d) for v in c.T])

    def squares(self, c: np.ndarray) -> np.ndarray:
        """[model, feature, feature]: the weighted products of all pairs of features."""
        x = self.dense
        if x is None:
            x = np.zeros((len(self.label), self.d))
            np.add.at(x, (self.row, self.j), self.values)
        return np.stack([(x * v[:, None]).T @ x for v in c.T])

    def columns(self, chosen: np.ndarray) -> np.ndarray:
        """[row, chosen feature]."""
        if self.dense is not None:
            return self.dense[:, chosen]
        place = np.full(self.d, -1)
        place[chosen] = np.arange(len(chosen))
        inside = place[self.j] >= 0
        out = np.zeros((len(self.label), len(chosen)))
        np.add.at(out, (self.row[inside], place[self.j[inside]]), self.values[inside])
        return out

    def under(self, specs: list[Spec], s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """C times loss and its first and second derivative, [row, model]; rows of a model's own fold count nothing."""
        out = np.zeros((3, *s.shape))
        for k, spec in enumerate(specs):
            y = self.label if spec.head is None else np.where(self.label == spec.head, 1.0, -1.0)
            cost = np.full(len(y), spec.c)
            for label, weight in spec.weights.items():
                cost[self.label == label] *= weight
            if spec.held is not None:
                cost[self.fold == spec.held] = 0.0
            out[:, :, k] = cost * np.stack(terms(spec.kind, y, s[:, k], spec.p))
        return out[0], out[1], out[2]


def _prepared(samples: DataFrame, label: str) -> DataFrame:
    fold = F.col("fold").cast("int") if "fold" in samples.columns else F.lit(-1)
    lists = ["features"] if "features" in samples.columns else ["indices", "values"]
    return samples.select(F.col(label).cast("double").alias("label"), fold.alias("fold"), *lists)


def summed(rows: DataFrame, size: int, d: int, add) -> np.ndarray:
    """The sum over all batches of ``add``, a vector of ``size``; as many rows from each task at most, added up by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += add(Rows(b, d))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["i", "v"])

    got = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(size)
    flat[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return flat


class Family:
    """The models' sums over the rows; each method is one scan for the models ``live``."""

    def __init__(self, samples: DataFrame, d: int, specs: list[Spec], label: str):
        self.rows, self.d, self.specs, self.scans = _prepared(samples, label), d, specs, 0

    def _scan(self, live: np.ndarray, width: int, add) -> np.ndarray:
        """[model, width]; ``add`` gives the sums of some models for a batch of rows."""
        out, most = [], max(1, MOST_SUMS // width)
        for at in range(0, len(live), most):
            own = live[at : at + most]
            specs = [self.specs[k] for k in own]
            self.scans += 1
            out.append(summed(self.rows, len(own) * width, self.d, lambda rows, own=own, specs=specs: add(rows, specs, own).ravel()).reshape(len(own), width))
        return np.concatenate(out)

    def losses(self, live: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self._scan(live, 1, lambda rows, specs, own: rows.under(specs, rows.scores(w[own]))[0].sum(axis=0))[:, 0]

    def slopes(self, live: np.ndarray, w: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(losses, gradients, Hessians if ``whole``)."""
        d = self.d

        def add(rows: Rows, specs: list[Spec], own: np.ndarray) -> np.ndarray:
            f, g, h = rows.under(specs, rows.scores(w[own]))
            parts = [f.sum(axis=0)[:, None], rows.gather(g)]
            return np.concatenate([*parts, rows.squares(h).reshape(len(own), -1)] if whole else parts, axis=1)

        got = self._scan(live, 1 + d + d * d * whole, add)
        return got[:, 0], got[:, 1 : 1 + d], got[:, 1 + d :].reshape(-1, d, d) if whole else None

    def corners(self, live: np.ndarray, w: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """[model, a, a]: the Hessians at w between the features of each model's row of ``sets``."""
        a = sets.shape[1]

        def add(rows: Rows, specs: list[Spec], own: np.ndarray) -> np.ndarray:
            bent = rows.under(specs, rows.scores(w[own]))[2]
            parts = [(x := rows.columns(sets[k])).T @ (x * bent[:, [i]]) for i, k in enumerate(own)]
            return np.stack(parts).reshape(len(own), -1)

        return self._scan(live, a * a, add).reshape(-1, a, a)

    def bends(self, live: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Hessians at w times the directions v."""
        return self._scan(live, self.d, lambda rows, specs, own: rows.gather(rows.under(specs, rows.scores(w[own]))[2] * rows.scores(v[own])))


def _conjugate(family: Family, live: np.ndarray, w: np.ndarray, grad: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Steps that nearly solve Hessian times step = -gradient, by conjugate gradients of all live models at once."""
    step, left, along = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    left[live] = along[live] = -grad[live]
    size = (left * left).sum(axis=1)
    goal = np.minimum(0.1, np.sqrt(np.sqrt(size))) ** 2 * size
    for _ in range(rounds):
        live = live[size[live] > goal[live]]
        if not len(live):
            break
        bent = along[live] + family.bends(live, w, along)
        rate = size[live] / (along[live] * bent).sum(axis=1)
        step[live] += rate[:, None] * along[live]
        left[live] -= rate[:, None] * bent
        fresh = (left[live] ** 2).sum(axis=1)
        along[live] = left[live] + (fresh / size[live])[:, None] * along[live]
        size[live] = fresh
    return step


def lasso(h: np.ndarray, g: np.ndarray, w: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The minimum of the quadratic model at w plus the l1 norm, by coordinate descent; a moved weight updates all slopes at once."""
    v, slope = w.copy(), g.copy()
    size = np.diag(h)
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(w)):
            z = v[j] - slope[j] / size[j]
            fresh = math.copysign(max(abs(z) - 1 / size[j], 0.0), z)
            if fresh != v[j]:
                slope += (fresh - v[j]) * h[j]
                moved = max(moved, abs(fresh - v[j]))
                v[j] = fresh
        if moved < 1e-10:
            break
    return v


def _worst(family: Family, live: np.ndarray, w: np.ndarray, g: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """Steps under the absolute penalty in the WHOLE features of each model that violate its optimality most, by the Hessian between them.

    A violated feature counts by its subgradient, which is weights' own slope where they are not zero, so in the end all features are at rest.
    """
    step = np.zeros_like(w)
    sets = np.zeros((len(w), WHOLE), int)
    sets[live] = np.sort(np.argsort(-np.abs(grad[live]), axis=1, kind="stable")[:, :WHOLE], axis=1)
    for k, h in zip(live, family.corners(live, w, sets), strict=True):
        own = sets[k]
        step[k, own] = lasso(h + 1e-9 * np.eye(len(own)), g[k, own], w[k, own]) - w[k, own]
    return step


def _penalty(specs: list[Spec], w: np.ndarray) -> np.ndarray:
    return np.array([np.abs(v).sum() if s.l1 else v @ v / 2 for s, v in zip(specs, w, strict=True)])


def train(samples: DataFrame, d: int, specs: list[Spec], *, label: str = "y", eps: float = 1e-6, start: np.ndarray | None = None, max_iter: int = 100, carry: dict | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(weights [model, feature], objectives, scans) of every model of ``specs`` over (label, fold if any, features or indices and values).

    A model stops when its gradient is ``eps`` of the first one's norm, or when a step no longer lowers its objective. Up to WHOLE
    features a step uses the whole Hessian. Beyond it, the squared penalty takes products with it, and the absolute penalty
    steps in the features that violate its optimality most; no matrix of all features is made.

    ``carry`` hands the sums at the last weights to a next call that differs in C alone and starts from those weights: all sums are
    in proportion to C, so it needs no scan for them.
    """
    family = Family(samples, d, specs, label)
    w = np.zeros((len(specs), d)) if start is None else start.astype(float).copy()
    l1 = np.array([s.l1 for s in specs], bool)
    whole = d <= WHOLE
    f, g = np.zeros(len(specs)), np.zeros_like(w)
    h = np.zeros((len(specs), d, d)) if whole else None
    first, live = np.zeros(len(specs)), np.arange(len(specs))

    def take(own: np.ndarray, at: np.ndarray) -> None:
        found = family.slopes(own, at, whole)
        f[own], g[own] = found[:2]
        if whole:
            h[own] = found[2]

    cost = np.array([s.c for s in specs])
    known = np.zeros(len(specs), bool)  # of which f, g and h are those at w
    if carry:
        known, ratio = carry["known"].copy(), cost / carry["cost"]
        f, g = carry["f"] * ratio, carry["g"] * ratio[:, None]
        h = carry["h"] * ratio[:, None, None] if whole else None
    if not known.all():
        take(live[~known], w)
    known[:] = True
    for _ in range(max_iter):
        grad = g + np.where(l1[:, None], np.where(w != 0, np.sign(w), np.clip(-g, -1, 1)), w)
        norm = np.linalg.norm(grad, axis=1)
        first = np.where(first > 0, first, np.where(norm > 0, norm, 1.0))
        live = live[norm[live] > eps * first[live]]
        if not len(live):
            break
        if whole:
            step = np.zeros_like(w)
            for k in live:
                step[k] = lasso(h[k] + 1e-9 * np.eye(d), g[k], w[k]) - w[k] if l1[k] else -np.linalg.solve(h[k] + np.eye(d), grad[k])
        else:
            step = np.zeros_like(w)
            for own, solve in ((live[~l1[live]], lambda own: _conjugate(family, own, w, grad)), (live[l1[live]], lambda own: _worst(family, own, w, g, grad))):
                if len(own):
                    step += solve(own)
        now, rate, before = f + _penalty(specs, w), np.ones(len(specs)), (f.copy(), g.copy(), None if h is None else h.copy())
        trying, done = live, []
        for attempt in range(20):
            at = w + rate[:, None] * step
            if attempt == 0:  # a whole step is nearly always taken, so its sums are what the next step needs
                take(trying, at)
                value = f.copy()
            else:
                value[trying] = family.losses(trying, at)
            good = value[trying] + _penalty(specs, at)[trying] <= now[trying]
            done += trying[good].tolist()
            if not len(trying := trying[~good]):
                break
            rate[trying] /= 2
        for k in trying:  # no step lowers it: it stays where it was
            f[k], g[k] = before[0][k], before[1][k]
            if h is not None:
                h[k] = before[2][k]
        moved = np.array(sorted(done), int)
        w[moved] += rate[moved][:, None] * step[moved]
        short = moved[rate[moved] < 1]
        after = value + _penalty(specs, w)
        f[short] = value[short]
        ended = moved[now[moved] - after[moved] <= 1e-12 * np.maximum(1.0, np.abs(now[moved]))]
        live = np.setdiff1d(moved, ended)
        known[short] = False
        if len(own := np.intersect1d(short, live)):
            take(own, w)
            known[own] = True
        if not len(live):
            break
    if carry is not None:
        carry |= {"known": known, "cost": cost, "f": f, "g": g, "h": h}
    return w, f + _penalty(specs, w), family.scans
