"""The libsvm source: ranges, line numbers, push-down, errors with their line, and commits."""

import pytest
from pyspark.sql import functions as F

from ordinata.sources import libsvm


def lines(n=500):
    return [f"{(-1) ** i} " + " ".join(f"{j + 1}:{(i * 7 + j) % 5 - 2}.5" for j in range(i % 9)) for i in range(n)]


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_any_ranges_give_all_lines(spark, tmp_path, size):
    (tmp_path / "a").write_text("\n".join(lines(300)) + "\n")
    (tmp_path / "b").write_text("\n".join(lines(40)))  # without an end of line
    (tmp_path / "_hidden").write_text("no")
    (tmp_path / "c").write_text("")
    if size == 7:  # ranges within a line
        (tmp_path / "a").write_text("\n".join(lines(30)) + "\n")
    n = 30 if size == 7 else 300
    got = libsvm.read(spark, str(tmp_path), range_bytes=size).orderBy("row_id").collect()
    want = lines(n) + lines(40)
    assert [r["row_id"] for r in got] == list(range(len(want)))
    for r, line in zip(got, want, strict=True):
        label, indices, values = libsvm.parse(line.encode(), 0)
        assert (r["y"], r["indices"], r["values"]) == (label, indices.tolist(), values.tolist())


def test_ranges_of_lines(spark, tmp_path):
    (tmp_path / "a").write_text("\n".join([*lines(200), "broken", *lines(200)]) + "\n")
    read = lambda **k: libsvm.read(spark, str(tmp_path / "a"), range_bytes=500, **k)
    part = read(first=40, last=59)
    assert sorted(r["row_id"] for r in part.collect()) == list(range(40, 60)) and part.rdd.getNumPartitions() < 5 < read().rdd.getNumPartitions()
    assert read(first=201).where("y > 0").count() == 100 and read(first=9999).count() == 0
    with pytest.raises(Exception, match="line 201"):
        read().count()


@pytest.mark.parametrize("bad", ["", "x 1:2", "1 0:2", "1 2:1 2:3", "1 3:1 2:3", "1 1:z", "1 1"])
def test_a_bad_line_is_named(spark, tmp_path, bad):
    (tmp_path / "a").write_text("\n".join([*lines(50), bad, *lines(3)]) + "\n")
    with pytest.raises(Exception, match="line 51"):
        libsvm.read(spark, str(tmp_path / "a"), range_bytes=300).count()


def test_indices_from_zero(spark, tmp_path):
    (tmp_path / "a").write_text("1 0:2 3:1\n-1 1:1\n")
    assert [r["indices"] for r in libsvm.read(spark, str(tmp_path / "a"), zero_based=None).orderBy("row_id").collect()] == [[0, 3], [1]]
    (tmp_path / "a").write_text("1 1:2 3:1\n")
    assert libsvm.read(spark, str(tmp_path / "a"), zero_based=None).first()["indices"] == [0, 2]


def test_written_files_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    dense = spark.createDataFrame([(1.0, [0.0, 1e-300, 2.5]), (-1.0, [0.0, 0.0, 0.0]), (0.1, [1 / 3, 0.0, -7.0])], "y double, features array<double>")
    libsvm.write(dense.coalesce(1), path)
    assert [tuple(r) for r in libsvm.read(spark, path).orderBy("row_id").collect()] == [(0, 1.0, [1, 2], [1e-300, 2.5]), (1, -1.0, [], []), (2, 0.1, [0, 2], [1 / 3, -7.0])]
    sparse = spark.createDataFrame([(2.0, [4], [1.0])], "y double, indices array<int>, values array<double>")
    libsvm.write(sparse, path, "append")
    assert libsvm.read(spark, path).count() == 4
    libsvm.write(sparse, path)
    assert [r["indices"] for r in libsvm.read(spark, path).collect()] == [[4]]
    libsvm.write(sparse.limit(0), path)
    assert libsvm.read(spark, path).count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    good = spark.createDataFrame([(2.0, [4], [1.0])], "y double, indices array<int>, values array<double>")
    libsvm.write(good, path)
    bad = good.union(good).repartition(2).withColumn("y", F.when(F.rand(1) >= 0, F.raise_error(F.lit("lost")).cast("double")))
    with pytest.raises(Exception, match="lost"):
        libsvm.write(bad, path)
    assert libsvm.read(spark, path).count() == 1 and not list(tmp_path.glob("out/_writing*"))
