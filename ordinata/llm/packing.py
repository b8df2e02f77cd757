"""Packing documents into fixed windows by lexical retrieval.

The corpus is dealt into shards of similar documents and bounded size; each shard holds a BM25 inverted index of its own
over token ids. A seed document starts a window; the index returns its unused neighbours by falling score of all its
distinct terms, and they fill the window greedily. The neighbour that reaches the end is cut there, and its rest is the next seed, so every window but
the last of a shard is full. What is left at the end of a shard goes into sequences whose lengths are powers of two, which
need no padding.

A range that draws more than twice its share is packed in parts, so memory stays bounded.

Document frequencies and the mean length come from the whole corpus; the frequency table is bounded by the vocabulary.
Shards are contiguous ranges of (commonest token, least hash of a token pair, doc_id), so likely neighbours meet, and a
hot group of copies is split between shards rather than gathered. The number of shards follows the number of tokens.

Token ids are those of the ``tokenizers`` library. Texts of Latin script, on which both libraries split alike, take a
faster route through the same vocabulary's rank file; all others go through ``tokenizers`` itself.

Defined results: a null text counts as empty, and an empty text has only the end id. Repeated rows are packed repeatedly;
a null doc_id is kept. Ties in score go to the earlier document. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinata.llm.bpe import load_ranks
from ordinata.llm.shingles import mix
from ordinata.llm.workspace import clip, materialize, release

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 2_500_000
K1, B = 1.2, 0.75
#: A term that one in so many documents have is held as a dense row, as far as these bytes go.
DENSE, DENSE_BYTES = 64, 32 << 20
SPECIAL = "<|endoftext|>"
_LONG_RUN = 60_000
_RUN = re.compile(rf"\s{{{_LONG_RUN}}}")


class Tokens:
    """Token ids of texts, as the ``tokenizers`` library gives them."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text. Characters beyond Latin-1 and the special token's string take the slower route, and so do runs
        of white space beyond the faster library's stack."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            fast = False
        else:
            fast = SPECIAL not in text and not (len(text) > _LONG_RUN and _RUN.search(text))
        if fast:
            return np.frombuffer(array("I", self.fast.encode_ordinary(text)), np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


_tokens: dict[tuple[str, str], Tokens] = {}


def tokens(json_path: str, ranks_path: str, pattern: str) -> Tokens:
    key = (json_path, ranks_path)
    if key not in _tokens:
        _tokens[key] = Tokens(json_path, ranks_path, pattern)
    return _tokens[key]


_PRIORITY = (mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint32)


def locality(ids: np.ndarray) -> int:
    """A sort key under which documents of like vocabulary are near each other: least hashes of a token, then of a pair."""
    first = int(_PRIORITY[ids & np.uint32(0xFFFF)].min())
    if len(ids) < 3:
        return first << 40
    pairs = (ids[:-2] * np.uint32(0x9E3779B1)) ^ (ids[1:-1] * np.uint32(0x85EBCA6B))
    pairs ^= pairs >> np.uint32(15)
    return first << 40 | int((pairs * np.uint32(0x2C1B3C6D)).min())


def tokenized(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, near, ids): the ids of every text with the end id, packed as little-endian 32-bit values or 16-bit ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(json_path, ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, near, packed = [], [], []
                for text in part.column(1).to_pylist():
                    ids = np.append(own.ids(text or ""), np.uint32(END_ID))
                    sizes.append(len(ids))
                    near.append(locality(ids))
                    packed.append(ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\0" + ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(near, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n", "near", "ids"])
        release()

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, n long, near long, ids binary")


def unpack(packed: bytes) -> np.ndarray:
    """Ids from their packed form; an odd number of bytes marks 32-bit values."""
    return np.frombuffer(packed, "<u4", offset=1) if len(packed) % 2 else np.frombuffer(packed, "<u2")


def document_frequencies(table: DataFrame) -> DataFrame:
    """(token, df) over all documents; at most one row for each token of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                ids = [unpack(packed) for packed in batch.column(0).slice(at, 128).to_pylist()]
                widest = max(int(own.max()) for own in ids) + 1
                if widest > len(counts):
                    counts = np.append(counts, np.zeros(widest - len(counts), np.int64))
                present = np.zeros((len(ids), widest), bool)
                for row, own in zip(present, ids, strict=True):
                    row[own] = True
                counts[:widest] += present.sum(axis=0)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], names=["token", "df"])

    return table.select("ids").mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


def _labelled(docs: list[np.ndarray]) -> np.ndarray:
    """All ids of a list of documents, with the document's position in the upper half of each value."""
    if not docs:
        return np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(docs), dtype=np.uint64) << np.uint64(32), [len(d) for d in docs])
    return owner | np.concatenate(docs)


class Bm25Shard:
    """An inverted index of the unused documents of one shard.

    Frequent terms are held as dense rows, which add up faster than postings; the rest have
    postings. ``forget`` drops used documents, so a query costs less as the shard empties; scores stay the same.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.own = np.arange(len(docs))  # the shard's documents that the index still holds
        lengths = np.array([len(d) for d in docs], np.float32)
        norms = (K1 * (1 - B + B * lengths / mean_length)).astype(np.float32)
        labelled = _labelled(docs)
        labelled = labelled << np.uint64(32) | labelled >> np.uint64(32)
        postings, tf = np.unique(labelled, return_counts=True)  # by term, then by document
        self.terms = (postings >> np.uint64(32)).astype(np.int64)
        self.docs = postings.astype(np.uint32)
        self.weights = (tf * np.float32(K1 + 1) / (tf + norms[self.docs])).astype(np.float32) * idf[self.terms]
        self.vocabulary = len(idf)
        self._arrange()

    def _arrange(self) -> None:
        counts = np.bincount(self.terms, minlength=self.vocabulary)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        frequent = np.flatnonzero(counts > max(len(self.own) // DENSE, 16))
        frequent = frequent[np.argsort(-counts[frequent], kind="stable")[: DENSE_BYTES // (4 * max(len(self.own), 1))]]
        self.row = np.full(self.vocabulary, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        at = self.row[self.terms]
        self.dense = np.zeros((len(frequent), len(self.own)), np.float32)
        self.dense[at[at >= 0], self.docs[at >= 0]] = self.weights[at >= 0]

    def forget(self, unused: np.ndarray) -> None:
        """Drop the documents that are not ``unused``."""
        left = unused[self.own]
        place = np.cumsum(left, dtype=np.uint32) - np.uint32(1)
        kept = left[self.docs]
        self.terms, self.docs, self.weights = self.terms[kept], place[self.docs[kept]], self.weights[kept]
        self.own = self.own[left]
        self._arrange()

    def scores(self, query: np.ndarray) -> np.ndarray:
        """The BM25 score of each document that the index holds for all distinct terms of a query."""
        terms = np.unique(query)
        rows = self.row[terms]
        total = self.dense[rows[rows >= 0]].sum(axis=0)
        rare = terms[rows < 0]
        for a, b in zip(self.starts[rare].tolist(), self.starts[rare.astype(np.int64) + 1].tolist(), strict=True):
            if a < b:
                total[self.docs[a:b]] += self.weights[a:b]
        return total

    def neighbours(self, query: np.ndarray, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with a query, by falling score; ties by position."""
        scores = self.scores(query) * unused[self.own]
        hits = np.flatnonzero(scores > 0)
        if len(hits) > 64:
            cut = np.partition(scores[hits], len(hits) - 16)[len(hits) - 16]
            top = hits[scores[hits] >= cut]
            yield from self.own[top[np.argsort(-scores[top], kind="stable")]].tolist()
            hits = hits[scores[hits] < cut]
        yield from self.own[hits[np.argsort(-scores[hits], kind="stable")]].tolist()


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences count from 0."""
    index = Bm25Shard(docs, idf, mean_length)
    unused = np.ones(len(docs), bool)
    first = sequence = offset = 0
    left = len(docs)
    pieces: list[tuple[int, int, int]] = []  # of the window that is being filled

    def flush(lengths: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
        """The held pieces, cut into sequences of these lengths."""
        nonlocal sequence
        room, at = lengths[0], 0
        todo = iter(lengths[1:])
        for k, start, length in pieces:
            while length:
                step = min(length, room - at)
                yield k, start, step, sequence, at
                start, length, at = start + step, length - step, at + step
                if at == room:
                    sequence, at, room = sequence + 1, 0, next(todo, 0)
        pieces.clear()

    def fill(k: int) -> Iterator[tuple[int, int, int, int, int]]:
        nonlocal offset
        start, left = 0, len(docs[k])
        while left:
            step = min(left, window - offset)
            pieces.append((k, start, step))
            start, left, offset = start + step, left - step, offset + step
            if offset == window:
                yield from flush([window])
                offset = 0

    while True:
        while first < len(docs) and not unused[first]:
            first += 1
        if first == len(docs):
            break
        seed = first
        unused[seed] = False
        left -= 1
        yield from fill(seed)
        while offset:  # the window of this seed, or of the rest of a cut neighbour, is open
            if 4 * left < 3 * len(index.own):
                index.forget(unused)
            for k in index.neighbours(docs[seed], unused):
                unused[k] = False
                left -= 1
                reaches = offset + len(docs[k]) >= window
                yield from fill(k)
                if reaches:
                    seed = k  # its rest, if any, starts the next window
                    break
            else:
                break  # no neighbour is left: the next unused document goes on in this window
    if offset:
        yield from flush([1 << b for b in range(offset.bit_length() - 1, -1, -1) if offset >> b & 1])


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, *, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    table = materialize(tokenized(docs, json_path, ranks_path, pattern, id_col=id_col, text_col=text_col), "packing-ids")
    total = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    n_docs, n_tokens = max(total["n"], 1), max(total["tokens"], 1)
    frequency = document_frequencies(table).toPandas()  # bounded by the vocabulary
    size = int(frequency["token"].max()) + 1 if len(frequency) else 1
    df = np.zeros(size, np.float64)
    df[frequency["token"].to_numpy(np.int64)] = frequency["df"].to_numpy(np.float64)
    idf = table.sparkSession.sparkContext.broadcast(np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32))
    mean_length = n_tokens / n_docs
    shards = clip(math.ceil(n_tokens / shard_tokens), 1, 1 << 20)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        shard = used = 0

        def packed(doc_ids: list[int | None], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal used
            last, out = -1, []
            for k, start, length, sequence, offset in pack_shard(ids, idf.value, mean_length, window):
                crc = zlib.crc32(ids[k][start : start + length].astype("<u4").tobytes())
                out.append((doc_ids[k], start, length, crc, len(ids[k]), shard << 40 | used + sequence, offset))
                last = sequence
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                    out = []
            used += last + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

        doc_ids, ids, held = [], [], 0
        for batch in batches:
            for doc_id, data, shard in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                doc_ids.append(doc_id)
                ids.append(unpack(data))
                held += len(ids[-1])
                if held >= 2 * shard_tokens:  # a range that drew more than its share is packed in parts
                    yield from packed(doc_ids, ids)
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield from packed(doc_ids, ids)
        release()

    order = ("near", "doc_id", F.xxhash64("ids"))
    dealt = table.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "ids", F.spark_partition_id().cast("long").alias("shard"))
    return dealt.mapInArrow(run, schema)
