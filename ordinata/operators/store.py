"""Samples written once in row order, in parts of bounded size, so that learners read positions instead of sorting again.

A part is one file of consecutive rows. Its rows carry their position in the whole order, and a learner's block is a range
of positions, which the parts' folders and the files' statistics prune. The offsets of the parts come from the written
files, so a part that is computed again after a lost executor cannot shift the others.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of features in a part, about; a part is one file and is read by one task.
PART_BYTES = 32 << 20
MOST_PARTS = 20_000
_SCHEMA = "local long, key long, y double, features array<double>, part int"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the session's ``spark.checkpoint.dir``; in local mode without it, under a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ordinata-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/ordinata-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whichever store holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@dataclass
class Store:
    """Samples in row order: ``starts[k]`` is the position of the first row of part k, and ``starts[-1]`` their number."""

    spark: SparkSession
    path: str
    stored: DataFrame  # (local, key, y, features, part); its files are listed once
    features: int
    starts: np.ndarray
    positives: int

    @property
    def rows(self) -> int:
        return int(self.starts[-1])

    @property
    def parts(self) -> int:
        return len(self.starts) - 1

    def frame(self) -> DataFrame:
        """(part, position, key, y, features); a task reads the rows of a part in order. ``key`` is the column that orders them."""
        return self._placed(self.stored)

    def between(self, ranges: list[tuple[int, int]]) -> DataFrame:
        """The rows whose position lies in one of the half-open ranges; other parts are not opened."""
        whole, cut = set(), {}  # parts that lie in a range, and the pieces of those at its ends
        for start, stop in ranges:
            first, last = (int(k) for k in np.searchsorted(self.starts, [start, stop - 1], "right") - 1)
            for part in range(first, last + 1):
                low, high = max(start, int(self.starts[part])), min(stop, int(self.starts[part + 1]))
                if high - low == self.starts[part + 1] - self.starts[part]:
                    whole.add(part)
                elif high > low:
                    cut.setdefault(part, []).append((low - int(self.starts[part]), high - int(self.starts[part])))
        stored = self.stored.where(F.col("part").isin(sorted(whole | cut.keys())))
        inside = F.col("part").isin(sorted(whole))
        for part, pieces in cut.items():
            for low, high in pieces:
                inside = inside | (F.col("part") == part) & F.col("local").between(low, high - 1)
        return self._placed(stored.where(inside))

    def _placed(self, stored: DataFrame) -> DataFrame:
        starts = F.lit(self.starts[:-1].tolist()) if self.parts else F.array().cast("array<bigint>")
        return stored.select("part", (F.get(starts, F.col("part")) + F.col("local")).alias("position"), "key", "y", "features")

    def delete(self) -> None:
        remove(self.spark, self.path)


def write(samples: DataFrame, parts: int | None = None, order: str = "row_id", even: bool = False) -> Store:
    """Store (``order``, y, features) in ascending order; rows without y or features are left out, ties keep any fixed order.

    Parts are cut by a sample of the rows. ``even`` writes once more, so that part k has exactly the rows from k / ``parts`` of all on,
    for learners whose result depends on the cuts.
    """
    spark = samples.sparkSession
    rows = samples.select(F.col(order).cast("long").alias("key"), F.col("y").cast("double").alias("y"), F.col("features").cast("array<double>").alias("features")).where("y IS NOT NULL AND features IS NOT NULL")
    if parts is None:
        size = rows.agg(F.sum(8 * F.size("features"))).first()[0] or 0
        parts = max(1, min(MOST_PARTS, -(-size // PART_BYTES)))
    ranged = rows.repartitionByRange(parts, "key") if parts > 1 else rows.coalesce(1)
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # within the part
    held = _written(spark, ranged.sortWithinPartitions("key").select(F.spark_partition_id().alias("part"), local.alias("local"), "key", "y", "features"))
    if not even or parts == 1 or not held.rows:
        return held
    cuts = -(-np.arange(parts + 1) * held.rows // parts)
    placed = held.frame().withColumn("part", F.floor(F.col("position") * parts / held.rows).cast("int"))
    placed = placed.withColumn("local", F.col("position") - F.get(F.lit(cuts[:-1].tolist()), F.col("part")))
    evened = _written(spark, placed.repartition(parts, "part").sortWithinPartitions("part", "local").select("part", "local", "key", "y", "features"))
    held.delete()
    return evened


def _written(spark: SparkSession, placed: DataFrame) -> Store:
    """(part, local, key, y, features) written by part."""
    path = shared_folder(spark)
    placed.write.partitionBy("part").parquet(path)
    stored = spark.read.schema(_SCHEMA).parquet(path)
    sizes = (F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") > 0).alias("pos"), F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most"))
    found = stored.groupBy("part").agg(*sizes).collect()  # one row for each part
    if not found:
        return Store(spark, path, stored, 0, np.zeros(1, np.int64), 0)
    if len(widths := {w for r in found for w in (r["least"], r["most"])}) > 1:
        raise ValueError(f"rows have {min(widths)} to {max(widths)} features")
    rows = np.zeros(max(r["part"] for r in found) + 1, np.int64)
    for r in found:
        rows[r["part"]] = r["n"]
    return Store(spark, path, stored, found[0]["most"], np.concatenate([[0], np.cumsum(rows)]), sum(r["pos"] for r in found))
