"""CSV readers, the planted generator, class maps, the search for p and prediction from file to file."""

import numpy as np
import pytest

from ordinata.operators import linear, prepare
from ordinata.sources import libsvm
from ordinata.sources import samples as src
from tests.test_estimators import data, frame


def test_matrix_and_labels_from_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,g.1,g2\na,1.5,-2\nb,,3\n")
    (tmp_path / "y.csv").write_text("id,kind\na,t\nb,n\nc,ALL\nd,\n")
    assert {r["id"]: r["features"] for r in src.read_matrix_csv(spark, str(tmp_path / "m.csv")).collect()} == {"a": [1.5, -2.0], "b": [None, 3.0]}
    assert {r["id"]: r["y"] for r in src.read_label_csv(spark, str(tmp_path / "y.csv")).collect()} == {"a": 1.0, "b": -1.0, "c": 1.0, "d": -1.0}


def test_planted_samples(spark):
    rows = src.planted(spark, 2000, 6, 2, 0.25, mean=1.0).orderBy("row_id").collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["y"] for r in rows])
    assert x.shape == (2000, 6) and (y > 0).sum() == 500
    assert np.allclose(x[y > 0].mean(0), [1, 1, 0, 0, 0, 0], atol=0.2) and np.allclose(x[y < 0].mean(0), 0, atol=0.1) and np.allclose(x.std(0), 1.05, atol=0.12)
    again = src.planted(spark, 2000, 6, 2, 0.25, mean=1.0).repartition(7).orderBy("row_id").collect()
    assert [r["features"] for r in again] == [r["features"] for r in rows]


def test_class_map_halves_the_classes(spark):
    for classes in (2, 5, 6):
        df = spark.createDataFrame([(k % classes,) for k in range(40)], "label int")
        one, two = ({r["label"]: r["y"] for r in prepare.class_map(df, seed=s).collect()} for s in (1, 2))
        assert one.keys() == set(range(classes)) and sum(v > 0 for v in one.values()) == classes // 2 == sum(v > 0 for v in two.values())


def test_search_for_the_margin(spark):
    """The best of all margins tried, from the largest label down."""
    x, _ = data(40, 2)
    df = frame(spark, x, x @ np.array([1.0, -1.0]))
    c, p, error = linear.search_p(df, 2, folds=2, start=1.0, most=1.0, steps=2)
    greatest = float(np.abs(x @ np.array([1.0, -1.0])).max())
    paths = {i / 2 * greatest: linear.search_c(df, 2, 11, 2, 1, 1.0, 1.0, i / 2 * greatest)[0][1] for i in (0, 1)}
    assert c == 1.0 and paths[p] == pytest.approx(error) and error == pytest.approx(min(paths.values()))


@pytest.mark.parametrize(("zero_based", "want"), [(False, [[0, 2]]), (True, [[1, 3]]), (None, [[0, 2]])])
def test_text_reader_and_first_index(spark, tmp_path, zero_based, want):
    (tmp_path / "a").write_text("1 1:2 3:1\n")
    assert [r["indices"] for r in src.read_libsvm(spark, str(tmp_path / "a"), zero_based=zero_based).collect()] == want


def test_predictions_from_file_to_file(spark, tmp_path):
    x, y = data(90, 3)
    libsvm.write(frame(spark, x, y).coalesce(2), str(tmp_path / "in"))
    rows = libsvm.read(spark, str(tmp_path / "in")).orderBy("row_id").collect()
    w = np.array([[0.5, -0.25, 1.0, 0.1]])  # with a bias of 1 behind
    got = linear.predict_file(spark, str(tmp_path / "in"), linear.model_text("L2R_LR", [1, -1], w, bias=1.0), str(tmp_path / "out")).first()
    s = [sum(w[0, j] * v for j, v in zip(r["indices"], r["values"], strict=True)) + 0.1 for r in rows]
    want = [1.0 if v > 0 else -1.0 for v in s]
    assert [float(v) for part in sorted(tmp_path.glob("out/part-*")) for v in part.read_text().split()] == want
    assert got["n"] == 90 and got["acc"] == pytest.approx(100 * np.mean([a == r["y"] for a, r in zip(want, rows, strict=True)]))
