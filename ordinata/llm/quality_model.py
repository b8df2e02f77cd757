"""Quality classifier: a regularised quadratic discriminant over transformed statistics of the text.

Each class is a Gaussian with mean m_k and covariance S_k. A covariance is shrunk towards the pooled one and towards a
multiple of the identity on standardised statistics:

    S_k' = (1 - pooled) S_k + pooled S,    S_k'' = (1 - ridge) S_k' + ridge (trace S_k' / d) I

The score is the posterior of class 1, from the difference of the two log-densities and the log prior odds; both are
computed from the classes' cached Cholesky factors (solving with a factor gives the Mahalanobis distance, its diagonal the
determinant). Fitting needs only counts, sums and sums of products per class, which executors add up, so the fit
covers every labelled row; the driver receives one small matrix for each class.

Defined results: a null text counts as empty; an empty text has all statistics 0 and a score like any other; a null or
unlabelled row is never learnt from. Without rows of both classes every score is 0.5. Repeated rows count as often as
they occur. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinata.llm.workspace import release

STATISTICS = (
    "log_words", "log_word_length", "symbols", "bangs", "capitals", "distinct_words", "top_word", "bare_words", "ends", "commas",
    "dup_lines", "entropy", "adjacent_repeats", "repeated_pairs", "pipes", "tiny_words",
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&<>@^~=_\\{}[]")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text, in the order of STATISTICS."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(data, minlength=256)
    chars = max(1, int(counts.sum() - counts[_SPACE].sum()))
    share = lambda k: math.sqrt(float(k) / chars)
    bag = Counter(words)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    lines = [line for line in text.split("\n") if line.strip()]
    p = counts[counts > 0] / data.size
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(n),
        math.log(chars / n),
        share(counts[_SYMBOLS].sum()),
        share(counts[33] + counts[63]),
        math.sqrt(upper / max(1, upper + lower)),
        math.log(len(bag) / n),
        math.sqrt(max(bag.values()) / n) if n > 9 else 0.3,
        math.sqrt(sum(k for w, k in bag.items() if len(w) < 4 and not any(map(str.isalpha, w))) / n),
        math.sqrt(counts[46] / n),
        math.sqrt(counts[44] / n),
        math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0,
        float(-(p * np.log(p)).sum()),
        math.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n),
        math.sqrt(1 - pairs / (n - 1)) if n > 1 else 0.0,
        math.sqrt(counts[124] / n),
        math.sqrt(sum(k for w, k in bag.items() if len(w) < 3) / n),
    ]


def bucket(doc_id: Column, folds: int = 3) -> Column:
    """crc32 of the decimal doc_id, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


@dataclass(frozen=True)
class QuadraticDiscriminant:
    """Two Gaussians over standardised statistics, with the Cholesky factors of their covariances."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()  # lower Cholesky factors of the shrunk covariances
    offsets: tuple[float, ...] = ()  # log prior minus half the log determinant

    @classmethod
    def from_moments(cls, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], *, pooled: float = 0.3, ridge: float = 0.01) -> QuadraticDiscriminant:
        """moments: by class, its rows, the sum of its statistics and the sum of their outer products."""
        d = len(STATISTICS)
        if any(moments.get(k, (0,))[0] < 2 for k in (0, 1)):
            return cls(np.zeros(d), np.ones(d))
        total = sum(moments[k][0] for k in (0, 1))
        centre = sum(moments[k][1] for k in (0, 1)) / total
        second = sum(moments[k][2] for k in (0, 1)) / total - np.outer(centre, centre)
        scale = np.sqrt(np.maximum(np.diag(second), 1e-12))
        scale[np.diag(second) < 1e-10] = 1.0
        means, covs = [], []
        for k in (0, 1):
            n, s, ss = moments[k]
            m = s / n
            means.append((m - centre) / scale)
            covs.append((ss / n - np.outer(m, m)) / np.outer(scale, scale))
        within = sum(moments[k][0] * covs[k] for k in (0, 1)) / total
        factors, offsets = [], []
        for k in (0, 1):
            cov = (1 - pooled) * covs[k] + pooled * within
            cov = (1 - ridge) * cov + (ridge * max(np.trace(cov) / d, 1e-6)) * np.eye(d)
            factor = np.linalg.cholesky(cov)
            factors.append(factor)
            offsets.append(math.log(moments[k][0] / total) - float(np.log(np.diag(factor)).sum()))
        return cls(centre, scale, tuple(means), tuple(factors), tuple(offsets))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posteriors of class 1 for rows of statistics."""
        if not self.means:
            return np.full(len(x), 0.5)
        z = (x - self.centre) / self.scale
        log = [o - 0.5 * (np.linalg.solve(f, (z - m).T) ** 2).sum(axis=0) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        gap = np.clip(log[1] - log[0], -700, 700)
        return np.round(1 / (1 + np.exp(-gap)), 9)


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], float).reshape(len(texts), len(STATISTICS))


def describe(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) with the statistics of every whole text; far smaller than the texts, which need not move again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                stats = _matrix(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(stats), pa.list_(pa.float64()))], names=["doc_id", "stats"])
        release()

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, stats array<double>")


def _stacked(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), len(STATISTICS))


def fit(labelled: DataFrame, *, pooled: float = 0.3, ridge: float = 0.01) -> QuadraticDiscriminant:
    """Fit on every row (stats, label) of ``labelled`` whose label is 0 or 1."""
    d = len(STATISTICS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: [0.0, np.zeros(d), np.zeros((d, d))] for k in (0, 1)}
        for batch in batches:
            x, y = _stacked(batch.column(0)), np.array(batch.column(1).to_pylist())
            for k, own in sums.items():
                rows = x[y == k]
                own[0] += len(rows)
                own[1] += rows.sum(axis=0)
                own[2] += rows.T @ rows
        for k, (n, s, ss) in sums.items():
            if n:
                values = np.concatenate([[n], s, ss.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["label", "i", "v"])

    rows = labelled.select("stats", F.col("label").cast("int").alias("label")).where(F.col("label").isin(0, 1))
    summed = rows.mapInArrow(partial, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()  # 2 (1 + d + d^2) rows at most
    moments = {}
    for k in {r["label"] for r in summed}:
        values = np.zeros(1 + d + d * d)
        for r in summed:
            if r["label"] == k:
                values[r["i"]] = r["v"]
        moments[k] = (values[0], values[1 : 1 + d], values[1 + d :].reshape(d, d))
    return QuadraticDiscriminant.from_moments(moments, pooled=pooled, ridge=ridge)


def fit_on_labels(described: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1) -> QuadraticDiscriminant:
    """Fit on the described documents with a label ``quality`` whose bucket is not the held-out one."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & (bucket(F.col("doc_id"), folds) != held_out))
    return fit(described.join(known, "doc_id"))


def score(described: DataFrame, model: QuadraticDiscriminant) -> DataFrame:
    """(doc_id, score) of described documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_stacked(batch.column(1))))], names=["doc_id", "score"])

    return described.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def with_score(docs: DataFrame, model: QuadraticDiscriminant, *, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """``docs`` with one more column, the score of every whole text; no row moves."""

    @F.arrow_udf("double")
    def of_text(texts: pa.Array) -> pa.Array:
        parts = [model.score(_matrix(texts.slice(at, 512).to_pylist())) for at in range(0, len(texts), 512)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(out_col, of_text(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def held_out_bucket(doc_id: int | None, folds: int = 3) -> int | None:
    """The bucket of ``bucket`` in Python, for tests."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds
