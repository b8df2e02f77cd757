"""libsvm text as a Spark data source: byte ranges with global line numbers, ranges of lines, a writer that commits.

A partition is a byte range of a file and owns the lines that start in it, so a large file is read by many tasks. Line numbers are
global: a first scan counts the lines of each range, one number a range, and the source gets their sums. Of a range of lines
(``first`` to ``last``) only the byte ranges are read that hold some. Every task of a writer makes a file of its own under a hidden name; the commit
gives the files of the tasks that finished their names, in the order of partitions, so a lost or repeated attempt leaves nothing
that a reader sees.

Rows are (row_id, y, indices from 0, values). Lines are ``label index:value ...`` with ascending indices from 1; a line that is not
fails with its number, from whichever range it is in. Files are reached by URI through Arrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE_BYTES = 32 << 20
BATCH_ROWS = 4096
_SCHEMA = "row_id long, y double, indices array<int>, values array<double>"
_HIDDEN = "_writing"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def _files(path: str) -> list[tuple[str, int]]:
    """(name, size) of the files that count, in order: a single file, or those of a folder whose names start with neither _ nor a dot."""
    store, root = _store(path)
    info = store.get_file_info(root)
    if info.is_file:
        return [("", info.size)]
    found = store.get_file_info(pafs.FileSelector(root)) if info.type == pafs.FileType.Directory else []
    return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name[0] not in "_.")


def _lines(path: str, name: str, start: int, stop: int) -> Iterator[bytes]:
    """The lines that start in a byte range; the last one is read on beyond it."""
    store, root = _store(path)
    with store.open_input_file(f"{root}/{name}" if name else root) as file:
        at, held = start, b""
        if start:  # the first line begins behind the first end of line from start - 1 on
            file.seek(start - 1)
            at, found = start - 1, -1
            while found < 0:
                data = file.read(1 << 20)
                if not data:
                    return
                found = data.find(b"\n")
                at += len(data) if found < 0 else found + 1
            held = data[found + 1 :]
        while at < stop:
            end = held.find(b"\n")
            if end < 0:
                data = file.read(1 << 20)
                if not data:
                    if held:
                        yield held
                    return
                held += data
                continue
            # whole lines at once
            last = held.rfind(b"\n") + 1
            for line in held[:last].split(b"\n")[:-1]:
                if at >= stop:
                    return
                yield line
                at += len(line) + 1
            held = held[last:]


def parse(line: bytes, number: int, zero_based: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
    """(label, indices from 0, values) of a line."""
    parts = line.split()
    try:
        pairs = [part.split(b":") for part in parts[1:]]
        label, indices, values = float(parts[0]), np.array([int(j) for j, _ in pairs], np.int64), np.array([float(v) for _, v in pairs])
        if len(indices) and (np.diff(indices) <= 0).any() or len(indices) and indices[0] < (not zero_based):
            raise ValueError("indices do not ascend")
    except (ValueError, IndexError) as error:
        raise ValueError(f"wrong input format at line {number + 1}: {line[:80]!r}") from error
    return label, indices - (not zero_based), values


@dataclass
class Range(InputPartition):
    name: str
    start: int
    stop: int
    first_line: int
    lines: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.zero_based = options["path"], options.get("zerobased", "false") == "true"
        self.ranges = [Range(*r) for r in json.loads(options["ranges"])]
        self.least, self.most = int(options.get("first", 0)), int(options.get("last", 1 << 62))

    def partitions(self) -> list[Range]:
        return [r for r in self.ranges if r.first_line <= self.most and r.first_line + r.lines > self.least] or [Range("", 0, 0, 0, 0)]

    def read(self, own: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for number, line in enumerate(_lines(self.path, own.name, own.start, own.stop) if own.lines else (), own.first_line):
            if number > self.most:
                break
            if number >= self.least:
                rows.append((number, *parse(line, number, self.zero_based)))
            if len(rows) == BATCH_ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    number, y, indices, values = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(y, pa.float64()), pa.array(indices, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["row_id", "y", "indices", "values"])


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        store.create_dir(f"{root}/{_HIDDEN}-{self.run}", recursive=True)
        with store.open_output_stream(f"{root}/{_HIDDEN}-{self.run}/{name}") as file:
            for batch in batches:
                for row in batch.select(["y", "indices", "values"]).to_pylist():
                    cells = (f"{j + 1}:{v:.17g}" for j, v in zip(row["indices"] or (), row["values"] or (), strict=True) if v)
                    file.write((" ".join([f"{row['y']:.17g}", *cells]) + "\n").encode())
        return Written(part, name)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        if self.overwrite:
            for name, _ in _files(self.path):
                store.delete_file(f"{root}/{name}")
        for m in messages:
            if m is not None:
                store.move(f"{root}/{_HIDDEN}-{self.run}/{m.name}", f"{root}/part-{m.part:06d}-{self.run}.libsvm")
        store.delete_dir(f"{root}/{_HIDDEN}-{self.run}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{_HIDDEN}-{self.run}").type == pafs.FileType.Directory:
            store.delete_dir(f"{root}/{_HIDDEN}-{self.run}")


class LibsvmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "libsvm_ranges"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def count_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> list[list]:
    """[file, start, stop, first line, lines] of every byte range, in order; one scan that gives a number for each."""
    ranges = [(k, name, at, min(size, at + range_bytes)) for k, (name, size, at) in enumerate((name, size, at) for name, size in _files(path) for at in range(0, size, range_bytes))]
    if not ranges:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.to_pylist()
            counts = [sum(1 for _ in _lines(path, r["name"], r["start"], r["stop"])) for r in own]
            yield pa.RecordBatch.from_arrays([pa.array([r["k"] for r in own]), pa.array(counts, pa.int64())], names=["k", "n"])

    table = spark.createDataFrame(ranges, "k long, name string, start long, stop long").repartition(len(ranges), "k")
    counts = {r["k"]: r["n"] for r in table.mapInArrow(run, "k long, n long").collect()}
    out, first = [], 0
    for k, name, start, stop in ranges:
        out.append([name, start, stop, first, counts[k]])
        first += counts[k]
    return out


def read(spark: SparkSession, path: str, *, first: int = 0, last: int | None = None, zero_based: bool | None = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(row_id, y, indices, values) of a file or folder, from line ``first`` to ``last``, which counts, from 0.

    ``zero_based`` None finds an index 0 by a scan for the least one.
    """
    spark.dataSource.register(LibsvmSource)
    load = spark.read.format("libsvm_ranges").option("path", path).option("ranges", json.dumps(count_lines(spark, path, range_bytes)))
    load = load.option("first", str(first)).option("last", str(1 << 62 if last is None else last))
    if zero_based is None:
        least = load.option("zeroBased", "true").load().agg(F.min(F.array_min("indices"))).first()[0]
        zero_based = least == 0
    return load.option("zeroBased", str(bool(zero_based)).lower()).load()


def write(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write (y, indices from 0, values), or (y, features), a file for each partition; zeros are not written."""
    samples.sparkSession.dataSource.register(LibsvmSource)
    if "features" in samples.columns:
        pairs = F.filter(F.transform("features", lambda v, j: F.struct(j.alias("j"), v.alias("v"))), lambda p: p["v"] != 0)
        samples = samples.select("y", pairs.alias("p")).select("y", F.col("p.j").alias("indices"), F.col("p.v").alias("values"))
    rows = samples.select(F.lit(0).cast("long").alias("row_id"), F.col("y").cast("double").alias("y"), F.col("indices").cast("array<int>").alias("indices"), F.col("values").cast("array<double>").alias("values"))
    rows.write.format("libsvm_ranges").option("path", path).mode(mode).save()
