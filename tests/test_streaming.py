"""The streaming learner gives what a batch fit over the same order would reach."""

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from ordinata.streaming.online import solam_stream


def steps(x, y, xi=1.0, r=1.0):
    n, d = x.shape
    w, ab, alpha, share = np.full(d, r / np.sqrt(d)), np.array([r, r]), 2 * r, 0.0
    for t in range(1, n + 1):
        share = ((t - 1) * share + (y[t - 1] > 0)) / t
        g, s, (a, b) = xi / np.sqrt(t), float(x[t - 1] @ w), ab
        if y[t - 1] > 0:
            w = w - g * 2 * (1 - share) * (s - a - 1 - alpha) * x[t - 1]
            ab = np.array([min(a + g * 2 * (1 - share) * (s - a), r), b])
            alpha += g * (-2 * (1 - share) * s - 2 * share * (1 - share) * alpha)
        else:
            w = w - g * 2 * share * (s - b + 1 + alpha) * x[t - 1]
            ab = np.array([a, min(b + g * 2 * share * (s - b), r)])
            alpha += g * (2 * share * s - 2 * share * (1 - share) * alpha)
        w, alpha = w * min(1, r / np.linalg.norm(w)), max(-2 * r, min(2 * r, alpha))
    return w


def test_stream_of_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 4)), np.where(rng.random(60) < 0.4, 1.0, -1.0)
    schema = T.StructType([T.StructField("model_id", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("y", T.DoubleType()), T.StructField("features", T.ArrayType(T.DoubleType()))])
    for part in range(3):
        rows = [(m, i, i, float(y[i]), x[i].tolist()) for m in (1, 2) for i in range(part * 20, part * 20 + 20)]
        spark.createDataFrame(pd.DataFrame(rows, columns=schema.names), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{part}"))
    for upto in range(3):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in/{upto}"))
        query = solam_stream(stream, 4).writeStream.outputMode("update").format("memory").queryName(f"out{upto}").option("checkpointLocation", str(tmp_path / f"c{upto}")).start()
        query.processAllAvailable()
        query.stop()
    got = {r["model_id"]: r for r in spark.table("out0").collect()}
    assert got.keys() == {1, 2} and got[1]["t"] == 20
    assert np.allclose(got[1]["w"], steps(x[:20], y[:20])) and np.allclose(got[2]["w"], got[1]["w"])


def test_state_carries_over(spark, tmp_path):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 3)), np.where(rng.random(40) < 0.5, 1.0, -1.0)
    schema = "model_id long, ts long, event_id long, y double, features array<double>"
    feed = lambda a, b: spark.createDataFrame([(1, i, i, float(y[i]), x[i].tolist()) for i in range(a, b)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed(0, 25)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = solam_stream(stream, 3).writeStream.outputMode("update").format("memory").queryName("carried").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    feed(25, 40)
    query.processAllAvailable()
    query.stop()
    last = spark.table("carried").orderBy("t").collect()[-1]
    assert last["t"] == 40 and np.allclose(last["w"], steps(x, y))
