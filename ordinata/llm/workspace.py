"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch of texts: enough to amortise a batch, few enough that long texts stay small in memory.
BATCH_ROWS = 1000
#: Keys whose info a join broadcasts, at most; each of the others has a smaller share of the rows than its inverse.
HOT_KEYS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset, a local-mode session gets a temporary folder; on a cluster that is an error, since a
    machine-local folder is not seen by the other machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ordinata-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's own part of the shared folder; when the application has ended all of it can go."""
    return f"{shared_dir(spark)}/ordinata-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that a lost executor costs no recomputation.

    While it is written, Arrow batches are held to ``batch_rows`` rows; the session's setting is then put back.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with bounded_batches(spark, batch_rows):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no result needs any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clip(n: float, low: int, high: int) -> int:
    """``n`` as an integer within [low, high]."""
    return int(max(low, min(high, n)))


@contextmanager
def bounded_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what the session runs has Arrow batches of ``rows`` rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    now = int(before or 0)  # 0 or less is no bound
    spark.conf.set(key, str(min(rows, now) if now > 0 else rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def join_with_hot_keys(rows: DataFrame, info: DataFrame, key: str, size: str, total: int, how: str = "inner", most: int = HOT_KEYS) -> DataFrame:
    """``rows`` joined with ``info``, which has one row for a key and in ``size`` the key's rows; ``total`` is their sum at least.

    The info of keys with more than total / ``most`` rows, which are fewer than ``most``, is broadcast, so the rows of a
    hot key stay where they are. Only the rows of the other keys are shuffled. ``info`` has columns of bounded size.
    """
    least = total // most
    hot = info.where(F.col(size) > least)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(info.where(F.col(size) <= least), key, how)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def join_salted(rows: DataFrame, wide: DataFrame, key: str, by: str, part: int = 1000) -> DataFrame:
    """``rows`` joined with ``wide``, which has one row of any size for a key.

    A key of more than ``part`` rows, and of more than a HOT_KEYS-th of all, is salted by ``by``: its wide row is repeated
    for every ``part`` of its rows, and each copy meets a share of them. There are fewer than HOT_KEYS such keys.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("size__"))
    total = rows.count()
    hot = materialize(sizes.where(F.col("size__") > max(part, total // HOT_KEYS)).select(key, F.ceil(F.col("size__") / part).alias("parts__")), "hot-keys")
    if hot.isEmpty():
        return rows.join(wide, key)
    hot = F.broadcast(hot)
    salted = rows.join(hot, key).withColumn("salt__", F.pmod(F.xxhash64(by), F.col("parts__"))).drop("parts__")
    copies = wide.join(hot, key).withColumn("salt__", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts__") - 1))).drop("parts__")
    return rows.join(hot.select(key), key, "left_anti").join(wide, key).unionByName(salted.join(copies, [key, "salt__"]).drop("salt__"))


def release() -> None:
    """Give a Python worker's free memory back, as workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc
