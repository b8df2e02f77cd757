"""Block gradient learners, whose large steps are distributed jobs and whose small ones are walked in legs.

Samples are stored once in row order. A step whose rows exceed a part (``store.PART_BYTES``) is one job: it reads the positions of
its block alone; the tasks score their rows under the weights of all settings at once and add up, for each setting, the gradient
over the rows of its own block; the sums, some d numbers a setting, reach the driver, which takes the step and thresholds.

Smaller steps follow each other too closely for a job each. Their rows are written anew in the order of the steps, a pass at a
time, in parts of bounded size; a leg is a job whose one task streams a part and takes all of its steps, and the next leg goes on from
its weights. So the jobs are as many as the parts, and a task holds the rows of one step. Settings of one schedule go together.

For one setting the result is that of the sequential learner, up to the rounding of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinata.operators import store
from ordinata.operators.learners import block_schedule, seeded_schedule, top_k

Settings = list[dict[str, float]]
#: A setting's sums over a block, behind the gradient: coefficients, scores and rows of the negative and of the positive class.
_SIDES = 6


def block_ranges(n: int, size: int, schedule: np.ndarray) -> list[tuple[int, int]]:
    """The rows of each step; the last block has the rows that are left."""
    count = n // size
    if count < 1:
        raise ValueError("a block must not exceed the rows")
    return [(int(k) % count * size, n if int(k) % count == count - 1 else (int(k) % count + 1) * size) for k in schedule]


def growing_ranges(n: int, tau: float, zeta: float, passes: int) -> list[tuple[int, int]]:
    """Consecutive batches whose sizes grow by ``zeta`` from ``tau``, from the first row anew in every pass."""
    out = []
    for _ in range(passes):
        start, k = 0, 0
        while start < n:
            stop = min(n, start + max(1, int(tau * zeta**k)))
            out.append((start, stop))
            start, k = stop, k + 1
    return out


def _schedule(n: int, p: dict[str, float], steps: int, seed: int) -> list[tuple[int, int]]:
    if "tau" in p:
        return growing_ranges(n, p["tau"], p["zeta"], int(p.get("passes", 1)))
    size = int(p["block"])
    order = seeded_schedule(steps, seed) if steps or n < size else block_schedule(int(p.get("passes", 1)), n // size, seed)
    return block_ranges(n, size, order)


def _logistic(scores: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Slopes of -log expit(y (s + c)); ``at`` has a row (c,) for each setting."""
    return -y[:, None] / (1 + np.exp(np.clip(y[:, None] * (scores + at[:, 0]), -500, 500)))


def _pairwise(scores: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Slopes of the pairwise square loss with class means put in; ``at`` has a row (version, share, u, q) for each setting.

    Version 0 leaves the margin to the means, version 1 takes it at the own class's mean, version 2 at the other's.
    """
    version, p, u, q = at.T
    pos = (y > 0)[:, None]
    sign, weight = np.where(pos, 1.0, -1.0), np.where(pos, 2 * (1 - p), 2 * p)
    own, other = np.where(pos, u, q), np.where(pos, q, u)
    margin = np.where(version == 0, 0.0, np.where(version == 1, 1 + q - u, 1.0))
    return weight * (scores - np.where(version == 2, other, own) - sign * margin)


def _add(total: np.ndarray, x: np.ndarray, y: np.ndarray, scores: np.ndarray, own: np.ndarray, inside: np.ndarray) -> None:
    """Put the sums of some rows, of which ``inside`` tells each setting's, on ``total`` [setting, d + 6]."""
    d = x.shape[1]
    total[:, :d] += own.T @ x
    for k, side in enumerate((y <= 0, y > 0)):
        total[:, d + k] += own[side].sum(axis=0)
        total[:, d + 2 + k] += np.where(inside, scores, 0.0)[side].sum(axis=0)
        total[:, d + 4 + k] += inside[side].sum(axis=0)


def block_sums(rows: DataFrame, weights: np.ndarray, at: np.ndarray, spans: list[tuple[int, int]], slopes: Callable, d: int) -> np.ndarray:
    """[setting, d + 6]: sums over each setting's span of positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(weights), d + _SIDES))
        for batch in batches:
            position, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            scores = x @ weights.T
            inside = np.column_stack([(position >= a) & (position < b) for a, b in spans])
            own = np.where(inside, slopes(scores, y, at), 0.0)
            _add(total, x, y, scores, own, inside)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["setting", "sums"])

    parts = rows.select("position", "y", "features").mapInArrow(run, "setting long, sums array<double>")
    summed = parts.select("setting", F.posexplode("sums").alias("k", "v")).groupBy("setting", "k").agg(F.sum("v").alias("v"))
    out = np.zeros((len(weights), d + _SIDES))
    for r in summed.collect():
        out[r["setting"], r["k"]] = r["v"]
    return out


class _Logistic:
    """Logistic steps with an intercept ``c`` that is neither thresholded nor returned."""

    def __init__(self, held: store.Store, settings: Settings):
        self.settings, self.c = settings, np.zeros(len(settings))

    slopes = staticmethod(_logistic)

    def at(self, live: list[int], w: np.ndarray) -> np.ndarray:
        return self.c[live][:, None]

    def step(self, live: list[int], w: np.ndarray, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        d = w.shape[1]
        rate = np.array([self.settings[k]["xi"] for k in live]) / sizes
        shrink = np.array([self.settings[k].get("l2", 0.0) for k in live])
        self.c[live] -= rate * sums[:, d : d + 2].sum(axis=1)
        return w - rate[:, None] * (sums[:, :d] + shrink[:, None] * w)


class _Pairwise:
    """Steps on the pairwise square loss in one of three forms of its gradient, against the class means of all rows."""

    def __init__(self, held: store.Store, settings: Settings):
        if not 0 < held.positives < held.rows:
            raise ValueError("both classes are needed")
        self.settings, self.share, self.c = settings, held.positives / held.rows, np.zeros(len(settings))  # c stays 0
        long = held.frame().select((F.col("y") > 0).alias("pos"), F.posexplode("features").alias("j", "v")).groupBy("pos", "j").agg(F.avg("v").alias("v"))
        self.means = np.zeros((2, held.features))
        for r in long.collect():  # 2 d numbers
            self.means[int(r["pos"]), r["j"]] = r["v"]

    slopes = staticmethod(_pairwise)

    def at(self, live: list[int], w: np.ndarray) -> np.ndarray:
        version = np.array([self.settings[k].get("version", 0.0) for k in live])
        return np.column_stack([version, np.full(len(live), self.share), w @ self.means[1], w @ self.means[0]])

    def step(self, live: list[int], w: np.ndarray, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        d, p = w.shape[1], self.share
        g, slopes, scores, rows = sums[:, :d], sums[:, d : d + 2], sums[:, d + 2 : d + 4], sums[:, d + 4 :]
        version, _, u, q = self.at(live, w).T
        gap = 2 * p * (1 - p) * (u - q)
        # what the means take of the gradient, by form
        lift = 2 * p * (1 - p) * (1 + q - u) * sizes
        means = np.where(version == 0, np.stack([lift - slopes[:, 0], -lift - slopes[:, 1]]), 0.0)
        both = np.stack([-2 * (1 - p) * scores[:, 1] + gap * sizes + 2 * p * q * rows[:, 0], 2 * (1 - p) * u * rows[:, 1] - gap * sizes - 2 * p * scores[:, 0]])
        means = np.where(version == 2, both, means)
        rate, l2 = (np.array([self.settings[k].get(name, 0.0) for k in live]) for name in ("xi", "l2"))
        return (w - (rate / sizes)[:, None] * (g + means.T @ self.means)) / (rate * l2 + 1)[:, None]


LEARNERS = {"sht_auc": _Pairwise, "stoiht": _Logistic, "hsg_ht": _Logistic}


def legs(spans: list[tuple[int, int]], room: int, most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive steps: one of more than ``room`` rows alone, the others together up to ``most`` rows."""
    out, first, rows = [], 0, 0
    for t, (start, stop) in enumerate(spans):
        size = stop - start
        if t > first and (rows + size > most or size > room or spans[t - 1][1] - spans[t - 1][0] > room):
            out.append((first, t))
            first, rows = t, 0
        rows += size
    return [*out, (first, len(spans))] if spans else out


def _in_step_order(held: store.Store, spans: list[tuple[int, int]], room: int) -> store.Store:
    """The rows of the steps ``spans``, which are equal or disjoint, written in the order of the steps; ``key`` is the step."""
    steps: dict[tuple[int, int], list[int]] = {}
    for t, span in enumerate(spans):
        steps.setdefault(span, []).append(t)
    ordered = sorted(steps)
    starts, stops = np.array(ordered).T
    lists = [*(steps[span] for span in ordered), []]

    @F.pandas_udf("array<long>")
    def of(position: pd.Series) -> pd.Series:
        at = np.searchsorted(starts, position, "right") - 1
        return pd.Series([lists[k] for k in np.where((at >= 0) & (position < stops[at]), at, -1)])

    rows = held.frame().select(F.explode(of("position")).alias("step"), "y", "features")
    return store.write(rows, -(-sum(b - a for a, b in spans) // room), order="step")


def _walk(placed: store.Store, part: int, rule: _Logistic | _Pairwise, live: list[int], w: np.ndarray) -> np.ndarray:
    """The weights of the settings ``live`` behind all steps of a part; the intercepts of ``rule`` change in place."""
    d = placed.features

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and key[a] != last:
                    yield np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held])
                    held = []
                held.append((x[a:b], y[a:b]))
                last = key[a]
        if held:
            yield np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = w.copy()
        for x, y in steps(batches):
            total, scores = np.zeros((len(live), d + _SIDES)), x @ now.T
            _add(total, x, y, scores, rule.slopes(scores, y, rule.at(live, now)), np.ones(scores.shape, bool))
            now = _kept(rule, live, rule.step(live, now, total, np.full(len(live), float(len(y)))))
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int64()), pa.array(list(now), pa.list_(pa.float64())), pa.array(rule.c[live])], names=["setting", "w", "c"])

    rows = placed.stored.where(F.col("part") == part).coalesce(1).sortWithinPartitions("local")  # one part, of bounded size
    found = {r["setting"]: r for r in rows.select("key", "y", "features").mapInArrow(run, "setting long, w array<double>, c double").collect()}
    for k in live:
        rule.c[k] = found[k]["c"]
    return np.array([found[k]["w"] for k in live])


def _kept(rule: _Logistic | _Pairwise, live: list[int], stepped: np.ndarray) -> np.ndarray:
    return np.array([top_k(row, int(rule.settings[k]["k"])) for k, row in zip(live, stepped, strict=True)])


def fit(samples: DataFrame, method: str, settings: Settings, *, steps: int = 0, seed: int = 1, parts: int | None = None, part_bytes: int = store.PART_BYTES, on_step: Callable[[int, list[int], np.ndarray], None] | None = None) -> np.ndarray:
    """[setting, feature]: the weights of every setting, from (row_id, y, features).

    ``steps`` 0 takes ``passes`` over the blocks, each pass every block once in the order of a digest; hsg_ht's batches are
    consecutive. ``on_step`` sees the step's number, the settings that took it and the weights of all; for it all settings go in
    lockstep, by a job for each step. A table without rows gives no features.
    """
    held = store.write(samples, parts)
    w = np.zeros((len(settings), held.features))
    if held.rows:
        rule = LEARNERS[method](held, settings)
        plans = [_schedule(held.rows, p, steps, seed) for p in settings]

        def step(live: list[int], spans: list[tuple[int, int]]) -> None:
            sums = block_sums(held.between(sorted(set(spans))), w[live], rule.at(live, w[live]), spans, rule.slopes, held.features)
            w[live] = _kept(rule, live, rule.step(live, w[live], sums, np.array([b - a for a, b in spans], float)))

        if on_step:
            for t in range(max(map(len, plans))):
                live = [k for k, plan in enumerate(plans) if t < len(plan)]
                step(live, [plans[k][t] for k in live])
                on_step(t + 1, live, w)
        else:
            together: dict[tuple, list[int]] = {}
            for k, plan in enumerate(plans):
                together.setdefault(tuple(plan), []).append(k)
            room = max(1, part_bytes // (8 * max(1, held.features)))
            for plan, live in together.items():
                for first, last in legs(list(plan), room, max(room, held.rows)):
                    own = list(plan[first:last])
                    if len(own) == 1 and own[0][1] - own[0][0] > room:
                        step(live, own * len(live))
                        continue
                    placed = _in_step_order(held, own, room)
                    for part in range(placed.parts):
                        if placed.starts[part + 1] > placed.starts[part]:
                            w[live] = _walk(placed, part, rule, live, w[live])
                    placed.delete()
    held.delete()
    return w
