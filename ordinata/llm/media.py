"""Media archives as a Spark data source: members by byte range, streamed through Arrow, each retried by itself.

An archive is a ZIP file; its directory (the central one, at the file's end) gives every member's offset. The source
``media_archive`` plans partitions from archive sizes alone: a partition is a list of byte ranges of archives and owns the
members whose headers start in them, so the driver holds no list of members. Ranges grow with the total, so there are
never more than ``MOST_PARTITIONS`` partitions. Which archives there are, and their sizes, come from the manifest that the
writer returned (option ``manifest``), so what a lost or repeated attempt has left in the folder is not read; without a
manifest all archives of the folder are. A task reads the directory, then each of its members at its offset; a member that
fails (an I/O error, a bad header or checksum) is read again on a newly opened file, without disturbing the others. After
the last attempt the task fails, or with ``on_error = row`` the member becomes a row with its error and no payload, and an
archive whose directory cannot be read one row with its error, without offset and name, of the range that starts it.

Payloads are stored as 8-bit greyscale PNG images of 64 samples a row, which is lossless; the unpadded length is kept in
a text chunk. Files are reached through Arrow's file systems by URI, so the folder may be in any store Arrow knows.

Defined results: a null text counts as empty, whose payload is 64 zero bytes. Repeated rows are stored repeatedly; a null
doc_id is stored and read back as null. Other columns are ignored. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ordinata.llm.workspace import new_path

ROW = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
MOST_PARTITIONS = 20_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, and the path in it; a plain path is a local or mounted one."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes, n_bytes: int, level: int = 2) -> bytes:
    """A PNG whose samples are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    packed = zlib.compress(lines.tobytes(), level)
    body = b"".join(_chunk(b"IDAT", packed[at : at + (1 << 24)]) for at in range(0, len(packed), 1 << 24))
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"tEXt", b"Length\0" + str(n_bytes).encode()) + body + _chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """(samples, the noted length) of an 8-bit greyscale PNG; any of the five row filters."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("not a PNG")
    at, packed, n_bytes, width, height = len(_SIGNATURE), [], -1, 0, 0
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"bad checksum of {kind!r}")
        at += 12 + size
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("not 8-bit greyscale")
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            n_bytes = int(body[7:])
        elif kind == b"IDAT":
            packed.append(body)
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if not lines[:, 0].any():
        return lines[:, 1:].tobytes(), n_bytes
    out, above = np.zeros((height, width), np.uint8), np.zeros(width, np.uint8)
    for y in range(height):
        kind, row = lines[y, 0], lines[y, 1:].copy()
        if kind == 1:
            row = np.cumsum(row, dtype=np.uint8)
        elif kind == 2:
            row = row + above
        elif kind >= 3:
            left = corner = 0
            for x in range(width):
                up = int(above[x])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                left, corner = (int(row[x]) + guess) & 255, up
                row[x] = left
        out[y] = above = row
    return out.tobytes(), n_bytes


def feature(samples: bytes) -> str:
    """Mean, deviation, entropy in bits and share of changing neighbours of the samples."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(x))
    spread = float(np.sqrt(max(0.0, float((counts * values**2).sum() / len(x)) - mean**2)))
    return f"mean={mean:.3f};std={spread:.3f};entropy={float(-(p * np.log2(p)).sum()):.4f};edges={np.count_nonzero(x[1:] != x[:-1]) / max(1, len(x) - 1):.4f}"


def store(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every text as a PNG into archives under ``path``; (archive, members, bytes) of each archive.

    Every attempt of a task writes archives of its own names, and only the rows of the attempt that Spark commits name
    them; so the returned table, once written, is the manifest to read them by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = open_store(path)
        fs.create_dir(root, recursive=True)
        buffer, members, serial = io.BytesIO(), 0, 0
        archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)

        def close() -> pa.RecordBatch:
            nonlocal buffer, members, serial, archive
            archive.close()
            final = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{serial:05d}.zip"
            with fs.open_output_stream(final) as out:
                out.write(buffer.getbuffer())
            row = pa.RecordBatch.from_pydict({"archive": [final], "members": pa.array([members], pa.int64()), "bytes": pa.array([buffer.getbuffer().nbytes], pa.int64())})
            buffer, members, serial = io.BytesIO(), 0, serial + 1
            archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    archive.writestr(zipfile.ZipInfo(f"{'' if doc_id is None else doc_id}.png"), to_png(pad(data), len(data)))
                    members += 1
                    if buffer.tell() >= archive_bytes or members >= 60_000:
                        yield close()
        if members:
            yield close()

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(run, "archive string, members long, bytes long")


@dataclass
class Ranges(InputPartition):
    """The members of archives whose headers start in [start, end), for each (archive, start, end) of ``spans``."""

    spans: list[tuple[str, int, int]]

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.spans = spans


def plan_ranges(archives: list[tuple[str, int]], range_bytes: int, most: int = MOST_PARTITIONS) -> list[list[tuple[str, int, int]]]:
    """Spans of the (path, size) archives, dealt into partitions of ``range_bytes`` or, beyond ``most`` of them, more each."""
    whole = max(range_bytes, -(-sum(size for _, size in archives) // most))
    out: list[list[tuple[str, int, int]]] = []
    held, room = [], whole
    for path, size in archives:
        at = 0
        while at < size:
            step = min(room, size - at)
            held.append((path, at, at + step))
            at, room = at + step, room - step
            if not room:
                out.append(held)
                held, room = [], whole
    return [*out, held] if held else out


class MemberReader:
    """Reads members of one archive at their offsets, each with attempts of its own."""

    def __init__(self, fs: pafs.FileSystem, path: str, attempts: int = 3, wait: float = 0.2):
        self.fs, self.path, self.attempts, self.wait = fs, path, attempts, wait
        self.file: pa.NativeFile | None = None

    def _open(self) -> pa.NativeFile:
        if self.file is None:
            self.file = self.fs.open_input_file(self.path)
        return self.file

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None

    def directory(self) -> list[zipfile.ZipInfo]:
        return self._try(lambda: zipfile.ZipFile(self._open()).infolist())[0]

    def member(self, info: zipfile.ZipInfo) -> tuple[bytes, int]:
        """(bytes, attempts) of a member."""
        return self._try(lambda: self._at(info))

    def _at(self, info: zipfile.ZipInfo) -> bytes:
        file = self._open()
        head = file.read_at(30, info.header_offset)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member at this offset")
        name, extra = struct.unpack_from("<HH", head, 26)
        data = file.read_at(info.compress_size, info.header_offset + 30 + name + extra)
        if info.compress_type == zipfile.ZIP_DEFLATED:
            data = zlib.decompress(data, -15)
        elif info.compress_type != zipfile.ZIP_STORED:
            raise ValueError(f"compression {info.compress_type} is not supported")
        if zlib.crc32(data) != info.CRC:
            raise ValueError("bad checksum")
        return data

    def _try(self, read):
        for attempt in range(1, self.attempts + 1):
            try:
                return read(), attempt
            except (OSError, ValueError, zlib.error, zipfile.BadZipFile, struct.error):
                self.close()
                if attempt == self.attempts:
                    raise
                time.sleep(self.wait * attempt)
        raise AssertionError("no attempt")


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").option("path", folder)``; options: manifest, range_bytes, attempts, on_error (fail or row)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, name string, payload binary, attempts int, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", 3))
        self.on_error = options.get("on_error", "fail")
        self.manifest = options.get("manifest")

    def archives(self) -> list[tuple[str, int]]:
        """(path, size) of the manifest's archives, or of all in the folder."""
        if self.manifest:
            fs, root = open_store(self.manifest)
            table = ds.dataset(root, format="parquet", filesystem=fs).to_table(columns=["archive", "bytes"])
            return sorted(zip(table.column("archive").to_pylist(), table.column("bytes").to_pylist(), strict=True))
        fs, root = open_store(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".zip"))

    def partitions(self) -> list[Ranges]:
        return [Ranges(spans) for spans in plan_ranges(self.archives(), self.range_bytes)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        if not partition.spans:
            return
        fs, _ = open_store(self.path)
        names = ["archive", "offset", "name", "payload", "attempts", "error"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.string()]
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for archive, start, end in partition.spans:
            reader = MemberReader(fs, archive, self.attempts)
            try:
                try:
                    directory = reader.directory()
                except Exception as error:
                    if self.on_error != "row":
                        raise
                    directory = []
                    if start == 0:
                        rows.append((archive, None, None, None, self.attempts, str(error)))
                for info in directory:
                    if not start <= info.header_offset < end:
                        continue
                    try:
                        data, attempts = reader.member(info)
                        rows.append((archive, info.header_offset, info.filename, data, attempts, None))
                        size += len(data)
                    except Exception as error:
                        if self.on_error != "row":
                            raise
                        rows.append((archive, info.header_offset, info.filename, None, self.attempts, str(error)))
                    if size >= BATCH_BYTES or len(rows) >= 2000:
                        yield batch()
                        rows, size = [], 0
            finally:
                reader.close()
        if rows:
            yield batch()


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Every member of the archives under ``path``, or of those that the option ``manifest`` names."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(path=path, **options).load()


def described(members: DataFrame) -> DataFrame:
    """Digests and features of stored payloads, from the bytes that the source has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples, n_bytes = from_png(media)
                stem = name.removesuffix(".png")
                rows.append((int(stem) if stem else None, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return members.select("name", "payload").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store_and_describe(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text in archives in the shared folder, then read them back through the source and describe them."""
    spark = docs.sparkSession
    path, manifest = new_path(spark, "media"), new_path(spark, "media-manifest")
    store(docs, path, id_col=id_col, text_col=text_col).write.parquet(manifest)
    return described(read_archives(spark, path, manifest=manifest))
