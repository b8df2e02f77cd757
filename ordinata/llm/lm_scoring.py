"""Language-model scores by stupid backoff, computed relationally over n-gram count tables partitioned by hash.

For every word w with the words h before it, ``order`` - 1 of them or as many as the document has,

    S(w | h) = c(h w) / c(h)      if c(h w) >= min_count
             = alpha S(w | h')    otherwise, h' being h without its first word,

and S(w) = c(w) / N without words before it. Counts are those of the whole corpus, N its number of words. An n-gram of
count 1 is the document's own, so with min_count = 2 what no other place confirms backs off. A document's score is the
mean of log S over its words; n_backoffs counts each step to a shorter context.

Plan: the rows of a scan's task, in their order, form batches of bounded text. A batch explodes its n-grams into 64-bit keys,
counts them locally and sends one block of distinct keys to each shard of the key space; however frequent an n-gram, a batch
sends it once. A shard adds up the counts of its keys over all batches and answers each block with the totals in the
block's order. The answers are joined to the batch's documents, which are scored there. Texts are shuffled once, for that join.
N is an ordinary sum. Batches and shards both follow the size of the input, but a key that most batches have gets an entry from
each of them, so the shard of a common word grows by 16 bytes a batch, with one batch for about 3 MB of text.

Defined results: words are runs of characters other than white space, case kept; a null or empty text has no words, a
null score and no backoffs. Repeated rows count as often as they occur and give repeated rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinata.llm.shingles import ngram_hashes, word_hashes
from ordinata.llm.workspace import clip, release

BATCH_CHARS = 3_000_000
SHARD_CHARS = 8_000_000


def _keys(texts: list[str | None], order: int) -> list[tuple[np.ndarray, ...]]:
    """By document, the keys of its words, of its pairs and so on."""
    return [tuple(ngram_hashes(words, n) for n in range(1, order + 1)) for _, words in word_hashes(texts, lower=False)]


def _distinct(keys: list[tuple[np.ndarray, ...]], shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, their counts, the shard of each); a shard is a range of keys, so shards rise too."""
    found, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for own in keys for x in own)]), return_counts=True)
    return found, counts, ((found >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _planes(values: np.ndarray) -> bytes:
    """Values by byte planes, so that the leading zeros of all of them lie together and compress."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _values(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chars, words) of a task's texts; bytes.split() cuts at the white space of this module."""
    chars = words = 0
    for batch in batches:
        chars += pc.sum(pc.utf8_length(batch.column(1))).as_py() or 0
        words += sum(len(text.split()) for text in batch.column(1).cast(pa.binary()).to_pylist() if text)
    yield pa.RecordBatch.from_arrays([pa.array([chars], pa.int64()), pa.array([words], pa.int64())], names=["chars", "words"])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A task's rows, with the number of the batch they belong to: that of the scan's partition and of the texts before them.

    The scan reads its rows in one order, so every run of it deals them alike.
    """
    from pyspark import TaskContext

    first, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        ends = held + np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy().astype(np.int64) + 1)
        starts = np.concatenate([[held], ends[:-1]]) // BATCH_CHARS
        for own in np.unique(starts):
            at = np.flatnonzero(starts == own)
            yield first | int(own), batch.slice(int(at[0]), len(at))
        held = int(ends[-1]) if len(ends) else held


def score(docs: DataFrame, *, order: int = 3, alpha: float = 0.4, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_backoffs, mean_log_score) of every row, against counts of all rows."""
    if order < 1:
        raise ValueError("order must be at least 1")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = texts.mapInArrow(_sizes, "chars long, words long").agg(F.sum("chars").alias("chars"), F.sum("words").alias("words")).first()
    total, shards = size["words"] or 0, clip(math.ceil((size["chars"] or 0) / SHARD_CHARS), 1, 1 << 30)

    def blocks_of(batch: int, parts: list[str | None]) -> pa.RecordBatch:
        found, counts, shard = _distinct(_keys(parts, order), shards)
        present, starts = np.unique(shard, return_index=True)
        bounds = [*starts.tolist(), len(found)]
        blocks = [(_planes(np.diff(found[a:b], prepend=np.uint64(0))), _planes(counts[a:b].astype("<u4"))) for a, b in zip(bounds, bounds[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), pa.array([batch] * len(present), pa.int64()), pa.array([k for k, _ in blocks], pa.binary()), pa.array([c for _, c in blocks], pa.binary())], names=["shard", "batch", "keys", "counts"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str | None] = []
        now = None
        for batch, rows in _dealt(batches):
            if held and batch != now:
                yield blocks_of(now, held)
                held = []
            held, now = held + rows.column(1).to_pylist(), batch
        if held:
            yield blocks_of(now, held)
        release()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _dealt(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.full(rows.num_rows, batch))], names=["doc_id", "text", "batch"])

    def add_up(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_values(k, "<u8"), dtype=np.uint64) for k in table.column("keys").to_pylist()]
        counts = np.concatenate([_values(c, "<u4") for c in table.column("counts").to_pylist()])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, weights=counts)[inverse].astype("<u8")
        ends = np.cumsum([0] + [len(k) for k in keys])
        answers = [_planes(totals[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        return pa.table({"batch": table.column("batch"), "shard": table.column("shard"), "n_keys": pa.array([len(k) for k in keys], pa.int64()), "totals": pa.array(answers, pa.binary())})

    def apply(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys = _keys(table.column("text").to_pylist(), order)
        found, _, shard = _distinct(keys, shards)
        by_shard = dict(zip(answers.column("shard").to_pylist(), answers.column("totals").to_pylist(), strict=True))
        totals = np.concatenate([np.zeros(0, "<u8"), *(_values(by_shard[s], "<u8") for s in np.unique(shard).tolist())])
        if len(totals) != len(found):
            raise RuntimeError("the answers do not belong to this batch")
        totals = totals.astype(np.float64)
        of = lambda x: totals[np.searchsorted(found, x)]
        n_words, backoffs, means = [], [], []
        for own in keys:
            n_words.append(len(own[0]))
            if not len(own[0]):
                backoffs.append(0)
                means.append(None)
                continue
            count = of(own[0])
            logs, off = np.log(count / total), np.zeros(len(count), np.int64)
            for n in range(1, order):  # a context of n words
                longer = of(own[n])
                seen = longer >= min_count
                logs[n:] = np.where(seen, np.log(longer / count[: len(longer)]), math.log(alpha) + logs[n:])
                off[n:] = np.where(seen, 0, off[n:] + 1)
                count = longer
            backoffs.append(int(off.sum()))
            means.append(round(float(logs.mean()), 6))
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_backoffs": pa.array(backoffs, pa.int64()), "mean_log_score": pa.array(means, pa.float64())})

    blocks = texts.mapInArrow(explode, "shard int, batch long, keys binary, counts binary")
    answers = blocks.groupBy("shard").applyInArrow(add_up, "batch long, shard int, n_keys long, totals binary")
    dealt = texts.mapInArrow(deal, "doc_id long, text string, batch long")
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(apply, "doc_id long, n_words long, n_backoffs long, mean_log_score double")
