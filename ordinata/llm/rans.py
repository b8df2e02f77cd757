"""Token-ID files by a static range asymmetric numeral system (rANS).

One frequency table, counted over the whole corpus and scaled to 2^20, is shared by all files. A file holds a contiguous
range of documents in ascending doc_id order. Its ids are cut into blocks of 65,536, each coded by itself in 32 interleaved
64-bit states, which give 32-bit words to one stream. Every 256 steps of a block, a checkpoint keeps the 32 states and the
place in the stream, so decoding can begin there, and all checkpoints of many blocks are decoded side by side. Blocks and
the index of documents carry checksums.

File: the magic number; the blocks; the index (zlib: doc_ids, lengths, and bits of the null ids); the block directory; the
trailer (sizes, checksums, table's checksum, magic number). A block: number of ids, of words and of checkpoints, the
checkpoints' places and states, the words. Numbers are little-endian.

Files are written by Spark tasks, one for each range of doc_id; the manifest names those that finished tasks wrote, so
what a lost attempt left is never read. Reading plans ranges of blocks; a range gives the documents that begin in it,
and decodes on beyond its end as far as its last one reaches, from the nearest checkpoint.

Tokens are those of the ``tokenizers`` library. They are worked out once for each distinct piece between ASCII white space in
a batch, as neither a token of this vocabulary nor a step of its normaliser reaches over white space.

Defined results: a null or empty text has only the end id. Repeated rows are stored repeatedly; those without doc_id come
first and stay null; rows of equal doc_id follow the order in which the tokenized table was written. Other columns are ignored. An empty table
gives no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordinata.llm.media import open_store
from ordinata.llm.workspace import clip, discard, materialize, new_path, release

END_ID = 2
MAGIC = b"RANSIDS1"
SCALE = 20
LANES = 32
BLOCK = 1 << 16
STEPS = BLOCK // LANES
CHECK = 256
LOW = np.uint64(1 << 31)
#: Blocks coded or decoded at once.
BATCH_BLOCKS = 32
#: Ids in a file, and files at most; beyond both, files grow.
FILE_IDS, MOST_FILES = 4_000_000, 20_000
#: Blocks in a range that one task reads.
RANGE_BLOCKS = 64
#: Bytes of text that are split at once.
TEXT_STEP = 4_000_000
#: Stands for the end of a word; no piece that takes the faster library holds it.
END_MARK = "\0"
_PLAIN = "^[\\x21-\\x7e\\x{a1}-\\x{ff}]+$"

_HEAD = struct.Struct("<III")
_TRAILER = struct.Struct("<QQQIIII8s")  # places of index, directory and trailer; checksums of index, directory, table; blocks; magic


class Corrupt(ValueError):
    """A file that is not what was written."""


class Table:
    """Scaled frequencies of symbols: they add up to 2^SCALE, and every symbol that occurs has one."""

    def __init__(self, frequencies: np.ndarray):
        self.f = frequencies.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.f)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.f), dtype=np.uint32), frequencies.astype(np.int64))
        self.common = int(self.f.argmax())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Largest shares are rounded last, so that the sum is exact; ties go to the lower symbol."""
        counts = counts.astype(np.int64)
        present = int((counts > 0).sum())
        if not 0 < present <= 1 << SCALE:
            raise ValueError(f"a table holds 1 to {1 << SCALE} symbols, not {present}")
        total, room = int(counts.sum()), (1 << SCALE) - present
        scaled = np.array([1 + int(c) * room // total if c else 0 for c in counts.tolist()], np.int64)  # exact beyond 64 bits
        scaled[np.argsort(-counts, kind="stable")[: (1 << SCALE) - int(scaled.sum())]] += 1
        return cls(scaled)

    def to_bytes(self) -> bytes:
        return zlib.compress(self.f.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        return cls(np.frombuffer(zlib.decompress(data), "<u4"))


def encode_blocks(ids: np.ndarray, table: Table) -> Iterator[bytes]:
    """The coded blocks of ids, in order."""
    for at in range(0, len(ids), BATCH_BLOCKS * BLOCK):
        yield from _encode_batch(ids[at : at + BATCH_BLOCKS * BLOCK], table)


def _encode_batch(ids: np.ndarray, table: Table) -> Iterator[bytes]:
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    steps = -(-min(n, BLOCK) // LANES)
    sizes = np.full(blocks, min(n, BLOCK))
    sizes[-1] = n - (blocks - 1) * BLOCK
    padded = np.full(blocks * steps * LANES, table.common, ids.dtype)
    padded[:n] = ids
    symbols = np.ascontiguousarray(padded.reshape(blocks, steps, LANES).swapaxes(0, 1))
    words, gives = np.zeros(symbols.shape, np.uint32), np.zeros(symbols.shape, bool)
    states = np.full((blocks, LANES), LOW)
    kept = np.zeros((-(-steps // CHECK), blocks, LANES), np.uint64)
    shift, high, whole = np.uint64(32), np.uint64(SCALE), np.uint64(63 - SCALE)
    for step in range(steps - 1, -1, -1):
        own = symbols[step]
        f = table.f[own]
        full = states >> whole >= f  # states >= f << whole, without overflow
        moved = np.where(full, states >> shift, states)
        share = moved // f
        coded = (share << high) + (moved - share * f) + table.start[own]
        if (step + 1) * LANES > sizes[-1]:  # the last block ends here
            live = step * LANES + np.arange(LANES) < sizes[:, None]
            full &= live
            coded = np.where(live, coded, states)
        words[step], gives[step], states = states, full, coded
        if step % CHECK == 0:
            kept[step // CHECK] = states
    for b in range(blocks):
        own = -(-int(sizes[b]) // LANES)
        given = gives[:own, b]
        places = np.concatenate([[0], np.cumsum(given.sum(axis=1))])[:own:CHECK].astype("<u4")
        stream = words[:own, b][given].astype("<u4")
        yield _HEAD.pack(int(sizes[b]), len(stream), len(places)) + places.tobytes() + kept[: len(places), b].astype("<u8").tobytes() + stream.tobytes()


def decode_checkpoints(parts: list[tuple[bytes, int, int]], table: Table) -> np.ndarray:
    """Ids of (block, first checkpoint, end checkpoint) in order, all side by side."""
    streams, places, states, sizes, base = [], [], [], [], 0
    for block, first, end in parts:
        n, n_words, n_checks = _HEAD.unpack_from(block)
        end = min(end, n_checks)
        body = _HEAD.size
        places.append(np.frombuffer(block, "<u4", n_checks, body)[first:end].astype(np.int64) + base)
        states.append(np.frombuffer(block, "<u8", n_checks * LANES, body + 4 * n_checks).reshape(-1, LANES)[first:end])
        streams.append(np.frombuffer(block, "<u4", n_words, body + 4 * n_checks + 8 * n_checks * LANES))
        sizes += [min(CHECK * LANES, n - k * CHECK * LANES) for k in range(first, end)]
        base += n_words
    if not sizes:
        return np.zeros(0, np.uint32)
    stream = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    at, x, sizes = np.concatenate(places), np.concatenate(states).astype(np.uint64), np.array(sizes)
    steps = -(-int(sizes.max()) // LANES)
    out = np.zeros((steps, len(sizes), LANES), np.uint32)
    mask, high, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    least = int(sizes.min())
    for step in range(steps):
        slot = x & mask
        own = table.symbol[slot]
        out[step] = own
        decoded = table.f[own] * (x >> high) + slot - table.start[own]
        wants = decoded < LOW
        if (step + 1) * LANES > least:
            live = step * LANES + np.arange(LANES) < sizes[:, None]
            wants &= live
            decoded = np.where(live, decoded, x)
        taken = np.cumsum(wants, axis=1)
        x = np.where(wants, decoded << shift | stream[np.minimum(at[:, None] + taken - wants, len(stream) - 1)], decoded)
        at = at + taken[:, -1]
    whole = out.swapaxes(0, 1).reshape(len(sizes), -1)
    return np.concatenate([row[:size] for row, size in zip(whole, sizes, strict=True)])


class FileWriter:
    """Writes documents to one file."""

    def __init__(self, sink, table: Table, table_crc: int):
        self.sink, self.table, self.table_crc, self.at = sink, table, table_crc, 0
        self.keys, self.lengths, self.nulls, self.directory = array("q"), array("q"), array("b"), []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key or 0)
        self.nulls.append(key is None)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= BATCH_BLOCKS * BLOCK:
            ready = np.concatenate(self.waiting)
            end = len(ready) // BLOCK * BLOCK
            self._code(ready[:end])
            self.waiting, self.n_waiting = [ready[end:]], len(ready) - end

    def _code(self, ids: np.ndarray) -> None:
        for block in encode_blocks(ids, self.table):
            self.directory.append((self.at, len(block), zlib.crc32(block)))
            self._put(block)

    def close(self) -> None:
        if self.n_waiting:
            self._code(np.concatenate(self.waiting))
        index_at = self.at
        index = zlib.compress(np.array(self.keys, "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes() + np.packbits(np.array(self.nulls, bool)).tobytes(), 1)
        directory = np.array(self.directory, "<i8").tobytes()
        self._put(index)
        directory_at = self.at
        self._put(directory)
        self._put(_TRAILER.pack(index_at, directory_at, len(self.keys), zlib.crc32(index), zlib.crc32(directory), self.table_crc, len(self.directory), MAGIC))


class FileReader:
    """Reads documents of one file; ``store`` has seek and read."""

    def __init__(self, store, size: int, table: Table, table_crc: int):
        self.store, self.table = store, table
        index_at, directory_at, n, index_crc, directory_crc, own_table, blocks, magic = _TRAILER.unpack(self._read(size - _TRAILER.size, _TRAILER.size))
        index, directory = self._read(index_at, directory_at - index_at), self._read(directory_at, size - _TRAILER.size - directory_at)
        if magic != MAGIC or own_table != table_crc or (zlib.crc32(index), zlib.crc32(directory)) != (index_crc, directory_crc) or len(directory) != 24 * blocks:
            raise Corrupt("trailer, index, directory or table")
        index = zlib.decompress(index)
        self.keys, self.lengths = np.frombuffer(index, "<i8", n), np.frombuffer(index, "<i8", n, 8 * n)
        self.nulls = np.unpackbits(np.frombuffer(index, np.uint8, offset=16 * n), count=n).astype(bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.directory = np.frombuffer(directory, "<i8").reshape(-1, 3)

    def _read(self, at: int, size: int) -> bytes:
        self.store.seek(at)
        data = self.store.read(size)
        if len(data) != size:
            raise Corrupt("the file ends early")
        return data

    def block(self, k: int) -> bytes:
        at, size, crc = self.directory[k].tolist()
        data = self._read(at, size)
        if zlib.crc32(data) != crc:
            raise Corrupt(f"block {k}")
        return data

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file, decoded from the checkpoint before them."""
        if start >= end:
            return np.zeros(0, np.uint32)
        own, first, last = CHECK * LANES, start // BLOCK, (end - 1) // BLOCK
        parts = [(self.block(k), (start - k * BLOCK) // own if k == first else 0, -(-(end - k * BLOCK) // own) if k == last else STEPS // CHECK) for k in range(first, last + 1)]
        skipped = first * BLOCK + parts[0][1] * own
        return decode_checkpoints(parts, self.table)[start - skipped : end - skipped]

    def documents(self, first: int, last: int) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start in the file, length, crc32 of the ids as 32-bit values) of documents that begin in blocks first to last - 1."""
        k, end = np.searchsorted(self.starts, [first * BLOCK, last * BLOCK], "left").tolist()
        while k < end:
            stop = max(k + 1, min(end, int(np.searchsorted(self.starts, self.starts[k] + BATCH_BLOCKS * BLOCK, "right")) - 1))
            if stop == k + 1 and self.lengths[k] > BATCH_BLOCKS * BLOCK:  # longer than a batch: piece by piece
                crc, length = 0, int(self.lengths[k])
                for at in range(int(self.starts[k]), int(self.starts[k]) + length, BATCH_BLOCKS * BLOCK):
                    crc = zlib.crc32(self.ids(at, min(at + BATCH_BLOCKS * BLOCK, int(self.starts[k]) + length)).astype("<u4").tobytes(), crc)
                yield None if self.nulls[k] else int(self.keys[k]), int(self.starts[k]), length, crc
                k = stop
                continue
            base = int(self.starts[k])
            raw = memoryview(self.ids(base, int(self.starts[stop - 1] + self.lengths[stop - 1])).astype("<u4").tobytes())
            for i in range(k, stop):
                at = int(self.starts[i]) - base
                yield None if self.nulls[i] else int(self.keys[i]), int(self.starts[i]), int(self.lengths[i]), zlib.crc32(raw[4 * at : 4 * (at + int(self.lengths[i]))])
            k = stop


class Pieces:
    """Ids of texts, worked out once for each distinct piece of a batch.

    Pieces of Latin-1's printable characters take the faster library, with the same merges: a mark behind each pre-token stands for
    the vocabulary's end of word and is joined to the last byte before any other merge. All others, and those that may hold a special
    token, go to ``tokenizers``.
    """

    def __init__(self, json_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        ranks, self.ids, self.ends = _end_marked(json_path)
        self.fast = tiktoken.Encoding("marked", pat_str=f"[^{END_MARK} ]+{END_MARK}", mergeable_ranks=ranks, special_tokens={})
        kinds = {kind: "".join(re.escape(chr(c)) for c in range(33, 256) if unicodedata.category(chr(c))[0] == kind) for kind in "LN"}
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^{kinds['L']}{kinds['N']} ]+")

    def plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of ids of each) of pieces of Latin-1's printable characters."""
        marked = self.split.sub(rf"\g<0>{END_MARK}", " ".join(pieces).lower())
        tokens = np.array(self.fast.encode_ordinary(marked), np.int64)
        ends = np.concatenate([[0], np.flatnonzero(self.ends[tokens]) + 1])
        return self.ids[tokens], np.diff(ends[np.cumsum([0, *(piece.count(END_MARK) for piece in marked.split(" "))])])

    def learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place of each piece's first, number of each piece's ids)."""
        plain = pc.and_not(pc.match_substring_regex(pieces, _PLAIN), pc.match_substring(pieces, "<|"))
        fast = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        slow = np.setdiff1d(np.arange(len(pieces)), fast)
        flat, sizes = [np.zeros(0, np.uint32)], np.zeros(len(pieces), np.int64)
        if len(fast):
            ids, sizes[fast] = self.plain(pieces.filter(plain).to_pylist())
            flat.append(ids)
        if len(slow):
            found = [e.ids for e in self.exact.encode_batch_fast(pieces.take(pa.array(slow)).to_pylist(), add_special_tokens=False)]
            sizes[slow] = [len(ids) for ids in found]
            flat.append(np.array([i for ids in found for i in ids], np.uint32))
        order = np.concatenate([fast, slow])
        first = np.zeros(len(pieces), np.int64)
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(flat), first, sizes

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        flat, first, sizes = self.learn(coded.dictionary)
        piece = coded.indices.to_numpy()
        length = sizes[piece]
        ends = np.cumsum(length)
        every = flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length - first[piece], length)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [every[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _end_marked(json_path: str) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """(ranks, id by rank, whether a rank ends a word) of a byte-level vocabulary with an end-of-word suffix, END_MARK in its place.

    Ranks go by single bytes, then bytes with the mark, then merges in their order.
    """
    with open(json_path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    suffix, vocabulary = model["end_of_word_suffix"], model["vocab"]
    # the alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def raw(token: str) -> bytes:
        ended = token.endswith(suffix)
        return bytes(alphabet[c] for c in token.removesuffix(suffix)) + END_MARK.encode() * ended

    letters = [*alphabet, *(c + suffix for c in alphabet)]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ranks: dict[bytes, int] = {}
    ids, ends = [], []
    for token in [*letters, *merged]:
        if (data := raw(token)) not in ranks:
            ranks[data] = len(ranks)
            ids.append(vocabulary[token])
            ends.append(token.endswith(suffix))
    return ranks, np.array(ids, np.uint32), np.array(ends)


_pieces: dict[str, Pieces] = {}


def pieces(json_path: str) -> Pieces:
    if json_path not in _pieces:
        _pieces[json_path] = Pieces(json_path)
    return _pieces[json_path]


def tokenized(docs: DataFrame, json_path: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, place, n, ids): the ids of every text with the end id, as little-endian 16-bit values, or after a zero byte 32-bit ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(json_path)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_STEP, "right")))
                ids = [np.append(x, np.uint32(end_id)) for x in own.many(texts.slice(at, stop - at))]
                packed = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"\0" + x.astype("<u4").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), pa.array([len(x) for x in ids], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n", "ids"])
                at = stop
        release()

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, n long, ids binary").withColumn("place", F.monotonically_increasing_id())


def unpack(packed: bytes) -> np.ndarray:
    """Ids from their packed form; an odd number of bytes marks 32-bit values."""
    return np.frombuffer(packed, "<u4", offset=1) if len(packed) % 2 else np.frombuffer(packed, "<u2")


def token_counts(table: DataFrame) -> DataFrame:
    """(token, n) over all documents; a row for each token of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                own = np.bincount(unpack(packed))
                if len(own) > len(counts):
                    counts = np.append(counts, np.zeros(len(own) - len(counts), np.int64))
                counts[: len(own)] += own
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], names=["token", "n"])

    return table.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_files(table: DataFrame, folder: str, frequencies: Table, n_files: int) -> DataFrame:
    """Write (doc_id, place, ids) to files by range of doc_id; the manifest (file, part, size, n_docs, n_ids, n_blocks)."""
    packed = frequencies.to_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = Table.from_bytes(packed), TaskContext.get().partitionId()
        writer = sink = None
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = batch.slice(at, 128)
                for key, ids in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    if writer is None:
                        store, root = open_store(folder)
                        store.create_dir(root, recursive=True)
                        name = f"part-{part:06d}-{uuid.uuid4().hex}.rans"
                        sink = store.open_output_stream(f"{root}/{name}")
                        writer = FileWriter(sink, own, zlib.crc32(packed))
                    writer.add(key, unpack(ids))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "part": part, "size": writer.at, "n_docs": len(writer.keys), "n_ids": writer.n_ids, "n_blocks": len(writer.directory)}])
        release()

    ordered = table.select("doc_id", "place", "ids").repartitionByRange(n_files, F.col("doc_id").asc_nulls_first(), "place").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "place")
    return ordered.select("doc_id", "ids").mapInArrow(run, "file string, part long, size long, n_docs long, n_ids long, n_blocks long")


def read_files(manifest: DataFrame, folder: str, frequencies: Table) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in a manifest's files, by ranges of blocks."""
    packed = frequencies.to_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, readers = Table.from_bytes(packed), {}
        store, root = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] not in readers:
                    readers = {row["file"]: FileReader(store.open_input_file(f"{root}/{row['file']}"), row["size"], own, zlib.crc32(packed))}
                found = list(readers[row["file"]].documents(row["first"], row["last"]))
                keys, starts, sizes, crcs = map(list, zip(*found, strict=True)) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.array(starts, np.int64) + row["base"]), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        release()

    # a row for each file: ids before it
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    ranges = manifest.withColumn("base", base).withColumn("first", F.explode(F.expr(f"sequence(0, n_blocks - 1, {RANGE_BLOCKS}L)")))
    ranges = ranges.select("file", "size", "base", "first", F.least(F.col("first") + RANGE_BLOCKS, "n_blocks").alias("last"))
    return ranges.repartition(max(1, manifest.count()), "file", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame, json_path: str, *, end_id: int = END_ID, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files written to ``folder``."""
    spark: SparkSession = docs.sparkSession
    folder = folder or new_path(spark, "token-ids")
    table = materialize(tokenized(docs, json_path, end_id, id_col=id_col, text_col=text_col), "rans-tokens")
    counts = token_counts(table).toPandas()
    if counts.empty:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    dense = np.zeros(int(counts["token"].max()) + 1, np.int64)
    dense[counts["token"]] = counts["n"]
    frequencies = Table.of_counts(dense)
    n_files = clip(-(-int(dense.sum()) // FILE_IDS), 1, MOST_FILES)
    manifest = materialize(write_files(table, folder, frequencies, n_files), "rans-manifest")
    discard(table)
    return read_files(manifest, folder, frequencies)
