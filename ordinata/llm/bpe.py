"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte parts. Every mergeable neighbour pair waits in the bucket of its merge rank;
a two-level bitmap over the ranks, of 256-bit words, gives the lowest non-empty bucket by find-first-set, and the leftmost position of
that bucket is merged. Entries whose pair has changed since are stale and skipped, so a pre-token of n bytes costs
O(n log n) however long it is.

Defined results: a null text counts as empty; an empty text has no ids, so its digests are those of the empty string.
Repeated rows give repeated rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens in each of the two generations whose ids a Python worker remembers.
CACHE_ENTRIES = 700_000
#: Pre-tokens longer than this are never remembered.
CACHE_CHARS = 64
#: Texts are encoded by so many pre-tokens at a time, which bounds memory for very long texts.
STEP = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a rank file: base64 of the token's bytes, a space, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


_BIT = tuple(1 << k for k in range(1 << 12))


class RankQueue:
    """A priority queue of positions by merge rank: a bucket per rank under a hierarchy of bitmaps.

    A bit of a 256-bit word of ``words`` is a rank with a bucket; a bit of the root, which ``BytePairCodec.merge`` holds,
    is a word with a bit. A bucket of one position is that position, a larger one a heap. The queue is empty between two
    pre-tokens.
    """

    __slots__ = ("buckets", "words")

    def __init__(self, n_ranks: int):
        self.words = [0] * ((n_ranks >> 8) + 1)
        self.buckets: dict[int, int | list[int]] = {}


class BytePairCodec:
    """Encodes and decodes by a rank file; every match of ``pattern`` is encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(pattern)
        self.queue = RankQueue(len(self.tokens))
        self.pairs = [-1] * (1 << 16)  # ranks of two bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.seen = _Remembered(self)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token. The queue's steps are written out here, as calls would double the time."""
        ranks, queue = self.ranks, self.queue
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        rank_of, words, buckets, bit = ranks.get, queue.words, queue.buckets, _BIT
        pairs, n, root = self.pairs, len(piece), 0
        now = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        now.append(-1)
        if n > 4096:
            nxt, prv, now = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), array("q", now)
        else:
            nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def share(rank: int, i: int) -> None:
            """One more position for a rank that has a bucket."""
            bucket = buckets[rank]
            if type(bucket) is int:
                buckets[rank] = [bucket, i] if bucket < i else [i, bucket]
            else:
                heappush(bucket, i)

        for i, rank in enumerate(now):
            if rank >= 0:
                if rank in buckets:
                    share(rank, i)
                else:
                    buckets[rank] = i
                    words[rank >> 8] |= bit[rank & 255]
                    root |= bit[rank >> 8]
        while root:
            w = (root & -root).bit_length() - 1
            bits = words[w]
            rank = w << 8 | (bits & -bits).bit_length() - 1
            i = buckets[rank]
            if type(i) is int or len(i) == 1:
                if type(i) is not int:
                    i = i[0]
                del buckets[rank]
                bits &= bits - 1
                words[w] = bits
                if not bits:
                    root &= root - 1
            else:
                i = heappop(i)
            if now[i] != rank:
                continue  # stale: this pair has been merged or has grown
            j = nxt[i]
            end = nxt[j]
            nxt[i] = end
            now[i] = now[j] = -1
            before = prv[i]
            if end < n:
                prv[end] = i
                rank = rank_of(piece[i : nxt[end]], -1)
                if rank >= 0:
                    now[i] = rank
                    if rank in buckets:
                        share(rank, i)
                    else:
                        buckets[rank] = i
                        words[rank >> 8] |= bit[rank & 255]
                        root |= bit[rank >> 8]
            if before >= 0:
                rank = now[before] = rank_of(piece[before:end], -1)
                if rank >= 0:
                    if rank in buckets:
                        share(rank, before)
                    else:
                        buckets[rank] = before
                        words[rank >> 8] |= bit[rank & 255]
                        root |= bit[rank >> 8]
        out, i = [], 0
        while i < n:
            end = nxt[i]
            out.append(ranks[piece[i:end]])
            i = end
        return tuple(out)

    def encode_steps(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, a bounded number of pre-tokens at a time."""
        ids_of = self.seen.__getitem__
        if len(text) <= STEP:
            yield list(chain.from_iterable(map(ids_of, self.split.findall(text))))
            return
        matches = (m.group() for m in self.split.finditer(text))
        while words := list(islice(matches, STEP)):
            yield list(chain.from_iterable(map(ids_of, words)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_steps(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Remembered(dict):
    """Ids by pre-token; a miss is encoded. When full, it becomes the older generation, from which words in use return."""

    def __init__(self, codec: BytePairCodec):
        self.codec = codec
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.codec.merge(word.encode("utf-8", "surrogatepass"))
            if len(word) > CACHE_CHARS:
                return ids
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


_codecs: dict[tuple[str, str], BytePairCodec] = {}


def codec(ranks_path: str, pattern: str) -> BytePairCodec:
    """The codec of a rank file, made once in each process."""
    key = (ranks_path, pattern)
    if key not in _codecs:
        _codecs[key] = BytePairCodec(load_ranks(ranks_path), pattern)
    return _codecs[key]


def _columns(docs: DataFrame, id_col: str, value_col: str, kind: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(value_col).cast(kind).alias("value"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [own.encode(text or "") for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _columns(docs, id_col, text_col, "string").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data) with the bytes of every list of ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            data = [own.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return _columns(encoded, id_col, ids_col, "array<int>").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids in one pass, keeping digests only, so that no id leaves the worker.

    (doc_id, n_tokens, ids_sha256 of the decimal ids joined by a space, decoded_sha256 of the decoded bytes).
    """

    def digests(own: BytePairCodec, text: str) -> tuple[int, str, str]:
        ids_hash, data_hash, n = hashlib.sha256(), hashlib.sha256(), 0
        for ids in own.encode_steps(text):
            if ids:
                ids_hash.update((" " * (n > 0) + " ".join(map(own.decimals.__getitem__, ids))).encode())
                data_hash.update(own.decode(ids))
                n += len(ids)
        return n, ids_hash.hexdigest(), data_hash.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [digests(own, text or "") for text in part.column(1).to_pylist()]
                n, ids, data = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(data)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _columns(docs, id_col, text_col, "string").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
