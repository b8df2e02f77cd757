"""Splits, learners with graphs and sketches, dual solvers and the training driver on small inputs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinata.operators import batch, experiments, graph, learners, linear, metrics, order, prepare, report
from ordinata.sources import samples as src


def data(n=120, d=6, seed=2):
    rng = np.random.default_rng(seed)
    y = np.where(rng.random(n) < 0.4, 1.0, -1.0)
    return rng.normal(size=(n, d)) + 0.8 * (y > 0)[:, None] * (np.arange(d) < 3), y


def frame(spark, x, y):
    return spark.createDataFrame([(i, float(b), float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, y double, label double, features array<double>")


def test_permutations_are_permutations(spark):
    got = prepare.shuffled(spark.range(50).withColumnRenamed("id", "row_id"), 1, 3).collect()
    for k in range(3):
        assert sorted(r["position"] for r in got if r["pass"] == k) == list(range(50))
    orders = [[r["row_id"] for r in sorted((r for r in got if r["pass"] == k), key=lambda r: r["position"])] for k in range(3)]
    assert len(set(map(tuple, orders))) == 3


def test_outer_and_inner_folds(spark):
    outer = prepare.outer_folds(spark.range(23).withColumnRenamed("id", "row_id"), 5, 1)
    tests = {k: [r for r in outer.collect() if r["fold"] == k and r["role"] == "te"] for k in range(5)}
    assert [len(v) for v in tests.values()] == [5, 5, 5, 4, 4]
    inner = prepare.nested_folds(outer, 3).collect()
    assert len(inner) == 5 * 23 - 23 and {r["inner"] for r in inner} == {0, 1, 2}


def test_trials_meet_their_rule(spark):
    x, y = data(60, 2)
    got = prepare.trial_splits(frame(spark, x, y), 3, 40, (15, 16, 17), 4, 1).collect()
    assert {r["trial"] for r in got} == {0, 1, 2}
    for k in range(3):
        train = [r for r in got if r["trial"] == k and r["role"] == "tr"]
        assert len(train) == 40 and sum(y[r["row_id"]] > 0 for r in train) in (15, 16, 17)
        assert all(sum(y[r["row_id"]] <= 0 for r in train if r["inner"] == f) >= 3 for f in range(4))


def test_empty_table_has_no_splits(spark):
    empty = spark.createDataFrame([], "row_id long, y double")
    assert prepare.random_folds(empty, 5, 1).count() == 0
    assert prepare.outer_folds(empty, 5, 1).count() == 0


def test_frequent_directions_bound():
    rng = np.random.default_rng(1)
    rows, tau = rng.normal(size=(300, 12)), 10
    kept = learners._Directions(12, tau)
    for r in rows:
        kept.add(r)
    gap = np.linalg.eigvalsh(rows.T @ rows - kept.rows.T @ kept.rows)
    assert gap.min() > -1e-6 and gap.max() <= (rows**2).sum() / (np.ceil(0.9 * tau) - 1)


def test_sketches_without_loss_agree():
    x, y = data()
    p = {"eta": 0.01, "lam": 0.01, "passes": 2}
    whole = learners.REGISTRY["opauc"](x, y, p, None)
    assert np.allclose(learners.REGISTRY["opauc_directions"](x, y, {**p, "tau": 1000}, None), whole)
    assert np.allclose(learners.REGISTRY["opauc_thresholded"](x, y, {**p, "tau": 6}, None), whole)


@pytest.mark.parametrize(("name", "params"), [("opauc_directions", {"eta": 0.01, "lam": 0.01, "tau": 5, "passes": 3}), ("opauc_thresholded", {"eta": 0.01, "lam": 0.01, "tau": 4, "passes": 3}), ("solam_boxed", {"xi": 1.0, "radius": 1.0, "passes": 3}), ("solam_boxed", {"xi": 1.0, "radius": 1.0, "l1": 1, "passes": 3})])
def test_more_learners_rank(name, params):
    x, y = data()
    assert learners._rank_auc(y, x @ learners.REGISTRY[name](x, y, params, None)) > 0.75


def test_rank_auc_is_the_share_of_pairs():
    rng = np.random.default_rng(4)
    y, s = np.where(rng.random(50) < 0.4, 1.0, -1.0), rng.integers(0, 6, 50).astype(float)
    pairs = [(a > b) + (a == b) / 2 for a in s[y > 0] for b in s[y <= 0]]
    assert learners._rank_auc(y, s) == pytest.approx(np.mean(pairs))


def test_trace_and_graph(spark):
    x, y = data(100, 9)
    tasks = spark.createDataFrame([(1, "graph_auc", {"xi": 0.5, "block": 20.0, "k": 4.0}, 7, 1)], "task_id long, method string, params map<string,double>, steps long, seed long")
    rows = frame(spark, x, y).withColumn("task_id", F.lit(1).cast("long"))
    edges = graph.grid_edges(3, 3, 0.001)
    w = [r["w"] for r in learners.fit(rows, tasks, edges).orderBy("j").collect()]
    assert 0 < np.count_nonzero(w) <= 6
    traced = learners.trace(rows, tasks, 3, edges).orderBy("step").collect()
    assert [r["step"] for r in traced] == [1, 4, 7]
    assert traced[-1]["auc"] == pytest.approx(learners._rank_auc(y, x @ np.array(w)))
    assert [r["step"] for r in report.learning_curve(learners.trace(rows, tasks, 1, edges), 4).orderBy("step").collect()] == [1, 5]


def test_rooted_tree_holds_its_root():
    rng = np.random.default_rng(4)
    for pruning, root in itertools.product(("gw", "strong"), range(0, 9, 4)):
        nodes, used = graph.steiner_forest(graph.grid_edges(3, 3, 0.4), rng.random(9), pruning=pruning, root=root)
        assert root in nodes and len(used) == len(nodes) - 1


def test_multiclass_machine_is_optimal():
    rng = np.random.default_rng(3)
    k = rng.integers(0, 3, 60)
    x = rng.normal(size=(60, 4)) + 1.5 * np.eye(4)[k]
    w = linear.crammer_singer(x, k, 3, 0.5, eps=1e-4)

    def value(w):
        s = x @ w.T + 1
        s[np.arange(60), k] -= 1
        return (w * w).sum() / 2 + 0.5 * (s.max(1) - (x * w[k]).sum(1)).sum()

    assert all(value(w) <= value(w + 0.05 * rng.normal(size=w.shape)) + 1e-4 for _ in range(50))


def test_classes_and_accessors(spark):
    x, y = data(60, 3)
    rows = frame(spark, x, y)
    assert [v for v, _ in linear.group_classes(rows.where("row_id >= 0"))] == ([1.0, -1.0])
    model = linear.train_by_options(rows, 3, "-s 2 -B 1 -q")
    assert model.labels == (1.0, -1.0) and model.weights.shape == (1, 4)
    assert model.coefficient(1, 1) == -model.coefficient(1, 0) and model.coefficient(4) == 0.0
    assert model.intercept() == pytest.approx(model.weights[0, 3])
    got = {r["row_id"]: r["prediction"] for r in model.predict(rows).collect()}
    want = np.where(x @ model.weights[0, :3] + model.weights[0, 3] > 0, 1.0, -1.0)
    assert [got[i] for i in range(60)] == want.tolist()


@pytest.mark.parametrize("solver", [3, 4, 7])
def test_options_train_every_kind(spark, solver):
    x, y = data(60, 3)
    rows = frame(spark, x, y)
    model = linear.train_by_options(rows, 3, f"-s {solver} -c 0.5")
    w = model.weights[0] - model.weights[1] if solver == 4 else model.weights[0]
    assert learners._rank_auc(y, x @ w) > 0.75
    got = {r["row_id"]: r["prediction"] for r in model.predict(rows).collect()}
    assert [got[i] for i in range(60)] == np.where(x @ w > 0, model.labels[0], model.labels[1]).tolist()


def test_regression_and_search(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3))
    rows = frame(spark, x, x @ np.array([1.0, -2.0, 0.5]))
    for solver in (11, 13):
        model = linear.train_by_options(rows, 3, f"-s {solver} -c 10 -p 0.01")
        assert np.allclose(model.weights[0], [1.0, -2.0, 0.5], atol=0.1)
    path = linear.search_c(rows, 3, 11, 3, start=0.25, most=1.0)
    assert [c for c, _ in path] == [0.25, 0.5, 1.0] and linear.best_c(path, 11)[1] == min(s for _, s in path)
    assert linear.first_c(rows, 2) == 2.0 ** np.floor(np.log2(1 / (2 * 60 * (x * x).sum(1).max())))


def test_cross_validated_score(spark):
    x, y = data(60, 3)
    assert linear.train_by_options(frame(spark, x, y), 3, "-s 2 -v 3") > 60


def test_retrieved_curve_ignores_label_zero(spark):
    rows = [(1.0, 3.0), (-1.0, 2.0), (0.0, 2.5), (1.0, float("-inf"))]
    got = metrics.retrieved_curve(spark.createDataFrame(rows, "y double, score double")).orderBy(F.desc("score")).collect()
    assert [(r["tpr"], r["fpr"]) for r in got] == [(0.5, 0.0), (0.5, 1.0)]


def test_results_and_names(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "method string, auc double")
    src.write_results(df, str(tmp_path / "r"))
    assert [r["auc"] for r in src.read_results(spark, str(tmp_path / "r"), method="b").collect()] == [2.0]
    (tmp_path / "n.csv").write_text("id,name\n1,x\n2,y\n")
    assert {(r["id"], r["name"]) for r in src.read_names_csv(spark, str(tmp_path / "n.csv")).collect()} == {("1", "x"), ("2", "y")}


@pytest.mark.parametrize("solver", [0, 2, 11])
def test_products_reach_the_minimum_of_the_whole_hessian(spark, monkeypatch, solver):
    x, y = data(100, 5)
    rows = frame(spark, x, y)
    whole = linear.train(rows, 5, solver)
    monkeypatch.setattr(batch, "WHOLE", 2)
    by_products = linear.train(rows, 5, solver)
    assert np.allclose(whole[0], by_products[0], atol=1e-4) and whole[1] == pytest.approx(by_products[1], rel=1e-6)


def test_sparse_rows_train_like_dense(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 6)) * (rng.random((80, 6)) < 0.4)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=80) > 0, 1.0, -1.0)
    dense = frame(spark, x, y)
    for solver in (0, 2, 5):
        assert np.allclose(linear.train(dense, 6, solver)[0], linear.train(src.to_sparse(dense), 6, solver)[0], atol=1e-8)


def test_many_features_need_no_matrix(spark):
    """7,129 features of 30 rows; the gradient of the objective vanishes."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(30, 7129)), np.where(np.arange(30) % 2, 1.0, -1.0)
    w, _ = linear.train(frame(spark, x, y), 7129, 2, 0.001)
    s = x @ w
    assert np.linalg.norm(w - 0.002 * (y * np.maximum(1 - y * s, 0)) @ x) < 1e-3


def test_more_than_all_entries_is_an_error(spark):
    df = spark.createDataFrame([(0, 1.0), (1, -2.0)], "j int, w double")
    assert order.checked_top(df, 2).count() == 2
    with pytest.raises(Exception, match="exceeds"):
        order.checked_top(df, 3).collect()


def test_scaling_is_saved_and_restored(spark, tmp_path):
    long = spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0), (0, 1, 5.0), (1, 1, 5.0)], "row_id long, j int, v double")
    found = prepare.minmax_parameters(long, 2)
    prepare.save_minmax(found, str(tmp_path / "p"), 0.0, 1.0)
    fresh = spark.createDataFrame([(7, 0, 2.0), (7, 1, 9.0), (7, 2, 9.0)], "row_id long, j int, v double")
    assert [(r["j"], r["v"]) for r in prepare.restore_minmax(fresh, str(tmp_path / "p")).collect()] == [(0, 0.5)]
    assert [r["y"] for r in prepare.scale_labels(spark.createDataFrame([(2.0,), (4.0,)], "y double")).orderBy("y").collect()] == [-1.0, 1.0]


GRID = experiments.settings({"xi": [0.1, 1.0], "l2": [0.01, 1.0]})


def folded(spark, n=120):
    x, y = data(n)
    return x, y, frame(spark, x, y).withColumn("fold", (F.col("row_id") % 3).cast("int"))


def test_cross_validation_equals_the_plain_loop(spark):
    x, y, rows = folded(spark)
    k = np.arange(len(y)) % 3
    got = {(r["ordinal"], r["held"]): r["auc"] for r in experiments.cross_validate(rows, 3, "spam", GRID, batch=3).collect()}
    assert len(got) == 12
    for (ordinal, held), auc in got.items():
        w = learners.spam(x[k != held], y[k != held], GRID[ordinal], np.array([]))
        s = x[k == held] @ w
        pairs = [(a > b) + 0.5 * (a == b) for a in s[y[k == held] > 0] for b in s[y[k == held] <= 0]]
        assert auc == pytest.approx(np.mean(pairs), abs=1e-12)


def test_batches_of_settings_do_not_matter(spark):
    rows = folded(spark)[2]
    one, all_ = ({(r["ordinal"], r["held"], r["auc"]) for r in experiments.cross_validate(rows, 3, "spam", GRID, batch=b).collect()} for b in (1, 4))
    assert one == all_


def test_a_fold_without_a_class_has_no_auc_and_loses(spark):
    x, y, rows = folded(spark)
    rows = rows.withColumn("y", F.when(F.col("fold") == 0, 1.0).otherwise(F.when(F.col("fold") == 1, 1.0).otherwise(F.col("y"))))
    got = {(r["ordinal"], r["held"]): r["auc"] for r in experiments.cross_validate(rows, 3, "spam", GRID).collect()}
    assert all((auc is None) for auc in got.values())
    best = experiments.best_settings(experiments.cross_validate(rows, 3, "spam", GRID)).collect()
    assert [r["ordinal"] for r in best] == [0]


def test_refit_uses_each_groups_setting(spark):
    x, y, rows = folded(spark)
    groups = rows.withColumn("fold", F.lit(0)).union(rows.withColumn("fold", F.lit(1)))
    best = spark.createDataFrame([(0, 3), (1, 1)], "fold int, ordinal long")
    got = experiments.refit(groups, best, "spam", GRID, ("fold",)).orderBy("fold", "j").collect()
    for fold, ordinal in ((0, 3), (1, 1)):
        w = [r["w"] for r in got if r["fold"] == fold]
        assert w == pytest.approx(learners.spam(x, y, GRID[ordinal], np.array([])), abs=1e-12)


def test_ratios_keep_all_of_the_short_class(spark):
    x, y, rows = folded(spark)
    n_pos, n_neg = int((y > 0).sum()), int((y <= 0).sum())
    got = experiments.at_ratios(rows, [0.1, 0.5, 0.9], 3).groupBy("ratio").agg(F.count_if(F.col("y") > 0).alias("p"), F.count_if(F.col("y") <= 0).alias("n")).collect()
    assert len(got) == 3
    for r in got:
        assert abs(r["p"] / (r["p"] + r["n"]) - r["ratio"]) < 0.02
        assert r["p"] == n_pos or r["n"] >= n_neg - 9


def test_empty_table_has_no_scores(spark):
    rows = folded(spark)[2].limit(0)
    scores = experiments.cross_validate(rows, 3, "spam", GRID)
    assert scores.count() == 0 and experiments.best_settings(scores).count() == 0


def test_staged_steps_by_hand():
    """Two rows of two values, so one stage: the mean of the two iterates, worked out from the step's definition."""
    x, y = np.array([[1.0, 0.0], [0.0, 2.0]]), np.array([1.0, -1.0])
    # row 1: share 1, so nothing moves; row 2: share 1/2, score 0, lean 1, weights fall by 0.1 * 1 * (0, 2)
    assert learners.solam_staged(x, y, {"radius": 5.0, "eta": 0.1}, np.array([])) == pytest.approx([0.0, -0.1])


@pytest.mark.parametrize("rounds", [1.0, 3.0])
def test_staged_learner_ranks_within_its_ball(rounds):
    x, y = data(400)
    w = learners.solam_staged(x, y, {"radius": 1.0, "eta": 0.5, "projections": rounds}, np.array([]))
    assert np.abs(w).sum() <= 1 + 1e-9
    assert learners._rank_auc(y, x @ w) > 0.75


def test_training_streams_its_rows(spark, monkeypatch):
    """The proximal learner sees pieces of a group, never a whole one, whatever cuts the pieces; other learners agree with the plain call."""
    x, y, rows = folded(spark)
    rows = rows.withColumn("g", F.when(F.col("row_id") % 2 == 0, F.lit("a")))  # a null group is a group
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for method, p in (("spam", {"xi": 1.0, "l2": 0.1}), ("sht_auc", {"xi": 0.5, "block": 5.0, "k": 2.0})):
            got = {(r["g"], r["held"]): r["auc"] for r in experiments.cross_validate(rows, 3, method, [p], ("g",)).collect()}
            assert len(got) == 6
            k, half = np.arange(len(y)) % 3, np.arange(len(y)) % 2
            for (g, held), auc in got.items():
                own, test = (half == (g is None)) & (k != held), (half == (g is None)) & (k == held)
                w = learners.REGISTRY[method](x[own], y[own], p, learners._schedule(int(own.sum()), p, 0, 1))
                assert auc == pytest.approx(learners._rank_auc(y[test], x[test] @ w), abs=1e-12)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_traced_steps_are_ranked_in_cells(spark, monkeypatch):
    """Walking ranks nothing; blocks of a few rows give the AUC of all rows, ties between the classes counting half."""
    x, y = data(60, 3)
    x = np.round(x)  # ties
    tasks = spark.createDataFrame([(k, "spam", {"xi": 0.5, "l2": 0.1 * k}, 0, 1) for k in (1, 2)], "task_id long, method string, params map<string,double>, steps long, seed long")
    rows = frame(spark, x, y).crossJoin(tasks.select("task_id"))
    want = {}
    for k in (1, 2):
        learners.spam(x, y, {"xi": 0.5, "l2": 0.1 * k, "watch": lambda t, w, k=k: want.update({(k, t): learners._rank_auc(y, np.einsum("ij,j->i", x, w))} if t % 4 == 1 else {})}, np.array([]))
    monkeypatch.setattr(learners, "_rank_auc", None)
    got = {(r["task_id"], r["step"]): r["auc"] for r in learners.trace(rows, tasks, 4, rank_rows=9).collect()}
    assert got == pytest.approx(want, abs=1e-12) and len(got) == 30


def test_moats_do_not_go_through_the_edges_for_each_event():
    class Edges(list):
        passes = 0

        def __iter__(self):
            Edges.passes += 1
            return super().__iter__()

    prizes = np.random.default_rng(2).random(36) ** 2
    plain = graph.grid_edges(6, 6, 0.1)
    assert graph.steiner_forest(Edges(plain), prizes) == graph.steiner_forest(plain, prizes) and Edges.passes < 8
