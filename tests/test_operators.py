"""Operators against brute force on small inputs."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ordinata.operators import batch, graph, learners, linear, metrics, order, prepare, report
from ordinata.operators.prefix import running
from ordinata.plans import catalogue
from ordinata.sources import samples as src


def pairwise_auc(pairs):
    pos, neg = [s for y, s in pairs if y > 0], [s for y, s in pairs if y <= 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", range(3))
def test_auc_is_the_share_of_ordered_pairs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.choice([1.0, -1.0]), float(rng.randrange(8))) for _ in range(60)]
    got = metrics.auc(spark.createDataFrame(pairs, "y double, score double")).first()
    assert got["auc"] == pytest.approx(pairwise_auc(pairs))


def test_auc_of_one_class_is_null(spark):
    assert metrics.auc(spark.createDataFrame([(1.0, 2.0)], "y double, score double")).first()["auc"] is None


def test_running_sums(spark):
    values = [random.Random(5).randrange(50) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    for r in running(df, "v", {"n": F.lit(1)}, buckets=7).collect():
        assert r["cum_n"] == sum(v <= r["v"] for v in values)


def test_hard_threshold_example(spark):
    values = [7, -3, 4, 0, -5, 6, 10, -1, 7, 12, 15, -8, 20, 2, 7]
    df = spark.createDataFrame([(j, float(v)) for j, v in enumerate(values)], "j int, w double")
    keep = lambda out: {r["j"] for r in out.collect() if r["w"]}
    assert keep(order.hard_threshold(df, 6, compat=True)) == {6, 9, 10, 11, 12}
    assert keep(order.hard_threshold(df, 6)) == {0, 6, 9, 10, 11, 12}
    assert [order.kth_largest(df, "w", k).first()["kth"] for k in range(1, 7)] == [20, 15, 12, 10, 7, 7]


def test_l1_ball(spark):
    w = np.random.default_rng(1).normal(size=30)
    df = spark.createDataFrame([(j, float(v)) for j, v in enumerate(w)], "j int, w double")
    got = np.array([r["w"] for r in order.l1_ball(df, 2.0).orderBy("j").collect()])
    assert np.allclose(got, learners.to_l1_ball(w, 2.0)) and np.abs(got).sum() == pytest.approx(2.0)


def test_lexicographic_ranks(spark):
    rng = random.Random(6)
    pairs = [(float(rng.randrange(4)), float(rng.randrange(9))) for _ in range(200)]
    got = {(r["x"], r["y"]): (r["rank"], r["n"]) for r in order.lex_rank(spark.createDataFrame(pairs, "x double, y double"), "x", "y").collect()}
    ranked = sorted(pairs, reverse=True)
    assert got == {p: (ranked.index(p) + 1, pairs.count(p)) for p in set(pairs)}


def test_folds(spark):
    df = spark.range(23).withColumnRenamed("id", "row_id")
    got = {r["row_id"]: r["fold"] for r in prepare.kfold(df, 5).collect()}
    assert [sum(f == k for f in got.values()) for k in range(5)] == [5, 5, 5, 4, 4]
    assert sorted(got, key=lambda r: (got[r], r)) == list(range(23))
    got = {r["row_id"]: r["fold"] for r in prepare.random_folds(df, 5, seed=3).collect()}
    assert len(got) == 23 and {sum(f == k for f in got.values()) for k in range(5)} == {4, 5}


def test_libsvm_round_trip_and_errors(spark, tmp_path):
    samples = spark.createDataFrame([(0, 1.0, [0.0, 1.5, 2.0]), (1, -1.0, [3.0, 0.0, 0.0])], "row_id long, y double, features array<double>")
    src.libsvm_lines(src.to_sparse(samples)).orderBy("row_id").select("value").coalesce(1).write.text(str(tmp_path / "a"))
    got = {tuple(r["indices"]): tuple(r["values"]) for r in src.read_libsvm(spark, str(tmp_path / "a")).collect()}
    assert got == {(1, 2): (1.5, 2.0), (0,): (3.0,)}
    (tmp_path / "b.txt").write_text("1 1:2 3:4\n-1 3:1 2:5\n")
    with pytest.raises(Exception, match="line 2"):
        src.read_libsvm(spark, str(tmp_path / "b.txt")).collect()


def data(n=120, d=6, seed=2):
    rng = np.random.default_rng(seed)
    y = np.where(rng.random(n) < 0.4, 1.0, -1.0)
    return rng.normal(size=(n, d)) + 0.8 * (y > 0)[:, None] * (np.arange(d) < 3), y


@pytest.mark.parametrize(
    ("name", "params", "steps"),
    [
        ("solam", {"xi": 1.0, "radius": 1.0, "passes": 3}, 0), ("spam", {"xi": 0.1, "l2": 0.1, "passes": 3}, 0), ("fsauc", {"radius": 1.0, "eta": 0.1, "passes": 5}, 0),
        ("sht_auc", {"xi": 0.1, "block": 30, "k": 3}, 40), ("sht_auc", {"xi": 0.1, "block": 30, "k": 3, "version": 1}, 40), ("sht_auc", {"xi": 0.1, "block": 30, "k": 3, "version": 2}, 40),
        ("stoiht", {"xi": 1.0, "block": 30, "k": 3}, 40), ("hsg_ht", {"xi": 1.0, "tau": 10, "zeta": 1.5, "k": 3, "passes": 5}, 0), ("opauc", {"eta": 0.01, "lam": 0.01, "passes": 3}, 0), ("opauc", {"eta": 0.01, "lam": 0.01, "tau": 4, "passes": 3}, 0),
    ],
)
def test_learners_rank(name, params, steps):
    x, y = data()
    w = learners.REGISTRY[name](x, y, params, learners.seeded_schedule(steps, 1))
    assert pairwise_auc(list(zip(y, x @ w, strict=True))) > 0.75
    if "k" in params:
        assert np.count_nonzero(w) <= params["k"]


def test_area_under_precision_over_recall(spark):
    """Points (0, 1), (1/3, 1), (2/3, 2/4), (2/3, 2/5), (1, 3/6); two rows tie."""
    pairs = [(1.0, 5.0), (1.0, 4.0), (-1.0, 4.0), (-1.0, 4.0), (-1.0, 3.0), (1.0, 2.0)]
    got = metrics.pr_summary(spark.createDataFrame(pairs, "y double, score double")).first()
    assert got["auc_pr"] == pytest.approx((2 + 1.5 + 0.9) / 6)


def test_search_cost_takes_the_whole_path(spark, monkeypatch):
    """The query's C goes from the least that can move the weights to 1024, unless five move nothing."""
    samples = spark.createDataFrame([(i, 1.0 if i % 2 else -1.0, [float(i % 2), 1.0]) for i in range(40)], "row_id long, y double, features array<double>")
    monkeypatch.setattr(catalogue.src, "embeddings", lambda *_: samples)
    monkeypatch.setattr(batch, "train", lambda df, d, specs, start=None, **k: (np.full((len(specs), 2), (0.0 if start is None else start[0, 0]) + 1.0), None, None))
    got = [r["c"] for r in catalogue.QUERIES["search_cost"](spark, "").collect()]
    assert sorted(got) == pytest.approx([c for k in range(-30, 11) if (c := 2.0**k) >= linear.first_c(samples, 2)], abs=1e-6)


@pytest.mark.parametrize(("name", "passes"), [("fit_graph_auc", 1)])
def test_block_queries_reach_every_block(spark, monkeypatch, name, passes):
    """On 2,000 rows every one of the 40 blocks gives a gradient once a pass."""
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"y": rng.choice([1.0, -1.0], 2000), "features": list(rng.normal(size=(2000, 64)))})
    monkeypatch.setattr(catalogue.src, "embeddings", lambda *_: spark.createDataFrame([(0, 1.0, [0.0])], "row_id long, y double, features array<double>"))
    held = []
    monkeypatch.setattr(learners, "fit", lambda s, tasks, edges=None: held.append((tasks, edges)) or tasks.selectExpr("0 AS j", "0.0D AS w"))
    catalogue.QUERIES[name](spark, "")
    task, seen, blocks = held[0][0].first(), [], learners._blocks
    monkeypatch.setattr(learners, "_blocks", lambda *a: (seen.append(b.start) or b for b in blocks(*a)))
    learners._run_task(rows.assign(**{k: [task[k]] * 2000 for k in task.asDict()}), held[0][1])
    assert sorted(seen) == sorted([*range(0, 2000, 50)] * passes)


def test_sht_gradients_agree_with_differences():
    """Version 0 is the gradient of the saddle objective of the block."""
    x, y = data(40, 4)
    posi, nega, p = x[y > 0].mean(0), x[y <= 0].mean(0), float((y > 0).mean())
    w = np.array([0.3, -0.2, 0.5, 0.1])

    def objective(w):
        s, u, q = x @ w, w @ posi, w @ nega
        return np.where(y > 0, (1 - p) * (s - u) ** 2, p * (s - q) ** 2).sum() + len(y) * p * (1 - p) * (1 + q - u) ** 2

    step = 1e-6
    numeric = np.array([(objective(w + step * e) - objective(w - step * e)) / (2 * step) for e in np.eye(4)])
    assert np.allclose(learners._sht_gradient(x, y, w, posi, nega, p, 0), numeric, atol=1e-4)


@pytest.mark.parametrize(("solver", "kind"), [(0, "logistic"), (2, "hinge2"), (11, "svr2")])
def test_smooth_solvers_reach_a_stationary_point(spark, solver, kind):
    x, y = data(80, 4)
    df = spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y, strict=True)], "y double, features array<double>")
    w, _ = linear.train(df, 4, solver)
    _, g, _ = batch.terms(kind, y, x @ w, 0.1)
    assert np.linalg.norm(w + g @ x) < 1e-4


@pytest.mark.parametrize(("solver", "kind"), [(5, "hinge2"), (6, "logistic")])
def test_absolute_penalty_meets_its_conditions(spark, solver, kind):
    x, y = data(80, 4)
    df = spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y, strict=True)], "y double, features array<double>")
    w, _ = linear.train(df, 4, solver, c=0.1)
    _, g, _ = batch.terms(kind, y, x @ w, 0.1)
    g = 0.1 * g @ x
    assert np.all(np.where(w != 0, np.abs(g + np.sign(w)), np.maximum(np.abs(g) - 1, 0)) < 1e-3)


def test_dual_descent_meets_the_primal():
    x, y = data(60, 3)
    w = linear.dual_descent(x, y, 1.0)
    value = lambda v: v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum()
    assert all(value(w) <= value(w + d) + 1e-3 for d in 0.05 * np.random.default_rng(1).normal(size=(50, 3)))


def test_options_and_model_text():
    got = linear.parse_options("-s 6 -c 2 -w1 3 -B 1 -q")
    assert (got["solver"], got["c"], got["weights"], got["bias"], got["eps"], got["quiet"]) == (6, 2.0, {1.0: 3.0}, 1.0, 0.01, True)
    w = np.array([[0.1, -2.5, 1 / 3]])
    fields, back = linear.load_model(linear.model_text("L2R_LR", [1, -1], w))
    assert fields["nr_class"] == "2" and np.array_equal(back, w)
    assert linear.check_parameters(2, -1.0, 0.1) == "C <= 0"


def brute_worth(edges, prizes):
    """The best prize minus cost over connected node sets (with a spanning tree of least cost)."""
    best = 0.0
    for size in range(1, len(prizes) + 1):
        for nodes in itertools.combinations(range(len(prizes)), size):
            inside = sorted((c, a, b) for a, b, c in edges if a in nodes and b in nodes)
            group, cost, joined = {v: v for v in nodes}, 0.0, 1
            for c, a, b in inside:
                if group[a] != group[b]:
                    old, cost, joined = group[b], cost + c, joined + 1
                    group = {v: group[a] if g == old else g for v, g in group.items()}
            if joined == size:
                best = max(best, sum(prizes[v] for v in nodes) - cost)
    return best


@pytest.mark.parametrize("pruning", graph.PRUNINGS)
def test_forests_are_trees(pruning):
    rng = np.random.default_rng(4)
    for _ in range(10):
        edges, prizes = graph.grid_edges(3, 3, 0.6), rng.random(9)
        nodes, used = graph.steiner_forest(edges, prizes, pruning=pruning)
        assert len(used) <= max(len(nodes) - 1, 0) and all(edges[i][0] in nodes and edges[i][1] in nodes for i in used)


def test_strong_pruning_is_near_the_best():
    rng = np.random.default_rng(7)
    for _ in range(8):
        edges, prizes = graph.grid_edges(2, 3, 0.5), rng.random(6)
        nodes, used = graph.steiner_forest(edges, prizes)
        assert prizes.sum() - (sum(prizes[v] for v in nodes) - sum(edges[i][2] for i in used)) <= 2 * (prizes.sum() - brute_worth(edges, prizes)) + 1e-9


def test_projection_meets_the_size():
    w = np.random.default_rng(3).normal(size=25)
    assert 4 <= len(graph.project(graph.grid_edges(5, 5), w, 4, 8)) <= 8


def test_support_without_weights_is_null(spark):
    """As SQL's string_agg over no rows; a magnitude at the bound does not count."""
    v = spark.createDataFrame([(0, 0.01), (1, -0.01), (2, None)], "j int, w double")
    assert [tuple(r) for r in report.support(v, 0.01).collect()] == [(0, None)]
    assert [tuple(r) for r in report.support(v, 0.001).collect()] == [(2, "0,1")]
