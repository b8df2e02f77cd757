"""Learners over stored parts: the scan, block steps and averaged rounds against their sequential forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinata.operators import batch, blocks, dual, learners, linear, metrics, order, prepare, saddle, scan, sketch, store
from ordinata.sources import samples as src
from tests.test_estimators import data, frame


@pytest.fixture(scope="module")
def samples(spark):
    x, y = data(150, 5)
    return x, y, frame(spark, x, y).repartition(3).cache()


@pytest.mark.parametrize("ranges", [1, 4, 16])
def test_scan_is_the_sequential_learner(samples, ranges):
    x, y, df = samples
    w = scan.fit_covariance(df, 0.01, 0.02, 2, ranges)
    assert w == pytest.approx(learners.REGISTRY["opauc"](x, y, {"eta": 0.01, "lam": 0.02, "passes": 2}, None), abs=1e-9)
    w = scan.fit_proximal(df, 0.5, 0.1, 2, ranges)
    assert w == pytest.approx(learners.REGISTRY["spam"](x, y, {"xi": 0.5, "l2": 0.1, "passes": 2}, None), abs=1e-9)


def test_scan_gathers_no_task(samples):
    """The plan groups by range, and composing neighbours gives the maps of the whole."""
    x, y, _ = samples
    whole = scan.compose_covariance(x, y, scan.Moments(5), 0.01, 0.02)
    a = scan.compose_covariance(x[:70], y[:70], scan.Moments(5), 0.01, 0.02)
    b = scan.compose_covariance(x[70:], y[70:], scan.moments_of(x[:70], y[:70]), 0.01, 0.02)
    assert np.allclose(b[0] @ a[0], whole[0]) and np.allclose(b[0] @ a[1] + b[1], whole[1])


def test_running_moments(samples):
    x, y, df = samples
    got = {r["row_id"]: r for r in scan.running_moments(df, 0, 1, ranges=5).collect()}
    for i in (0, 40, 149):
        rows = x[: i + 1][y[: i + 1] == y[i]]
        assert (got[i]["n"], got[i]["positive"]) == (len(rows), y[i] > 0)
        assert got[i]["mean"] == pytest.approx(rows[:, 0].mean()) and got[i]["cov"] == pytest.approx(np.cov(rows[:, 0], rows[:, 1], bias=True)[0, 1], abs=1e-12)


def test_blocks_are_the_sequential_learners(samples):
    """All settings in lockstep, with schedules of different lengths and blocks that cross parts."""
    x, y, df = samples
    grids = {
        "sht_auc": [{"xi": 0.3, "block": b, "k": 3, "passes": 1, "version": v, "l2": l2} for b, v, l2 in ((40, 0, 0.0), (40, 1, 0.1), (75, 2, 0.0))],
        "stoiht": [{"xi": 0.5, "block": b, "k": 2, "l2": 0.01, "passes": 1} for b in (50, 150)],
        "hsg_ht": [{"xi": 0.5, "tau": t, "zeta": 2.0, "k": 3, "passes": 1} for t in (1, 30)],
    }
    for method, grid in grids.items():
        seen = []
        got = blocks.fit(df, method, grid, parts=4, on_step=lambda t, live, w, seen=seen: seen.append((t, len(live))))
        for w, p in zip(got, grid, strict=True):
            assert w == pytest.approx(learners.REGISTRY[method](x, y, p, learners._schedule(len(y), p, 0, 1)), abs=1e-12)
        assert [t for t, _ in seen] == list(range(1, len(seen) + 1)) and seen[0][1] == len(grid)


def test_a_block_beyond_the_rows_fails(samples):
    with pytest.raises(ValueError, match="block"):
        blocks.fit(samples[2], "stoiht", [{"xi": 0.5, "block": 151, "k": 2}])


def test_rounds_of_one_part_are_sequential(samples):
    x, y, df = samples
    for rule, name, p in ((saddle.Saddle(1.0), "solam", {}), (saddle.Saddle(1.0, box=2.0, trails=False), "solam_boxed", {})):
        want = np.zeros(5)
        way, mean = rule.start(5), saddle.Mean(np.zeros(7))
        rule.walk(x, y, way, mean, 1, [*range(150)] * 2)
        want = mean.value[:5]
        for rounds in (1, 3):
            got = saddle.fit_rounds(df, rule, passes=2, rounds=rounds, parts=1)
            assert got.weights == pytest.approx(want, abs=1e-12) and got.rounds == 2 * rounds
            assert (got.way.seen, got.way.positives) == (300, 2 * (y > 0).sum())
    assert learners.REGISTRY["solam"](x, y, {"xi": 1.0, "radius": 1.0, "passes": 2}, None) == pytest.approx(saddle.fit_rounds(df, saddle.Saddle(1.0), passes=2, parts=1).weights, abs=1e-12)


def test_averaged_rounds_rank_as_well(spark):
    """Held-out AUC of 8 parts, averaged 4 times a pass, within 0.01 of the sequential learner's."""
    x, y = data(4000, 6, seed=5)
    train, test = frame(spark, x[:3000], y[:3000]).cache(), slice(3000, None)
    auc = [learners._rank_auc(y[test], x[test] @ saddle.fit_rounds(train, saddle.Saddle(1.0), passes=2, rounds=4, parts=parts).weights) for parts in (1, 8)]
    assert auc[0] > 0.75 and abs(auc[0] - auc[1]) < 0.01


def test_even_parts(spark):
    rows = spark.range(101).select(F.col("id").alias("row_id"), F.lit(1.0).alias("y"), F.array(F.col("id").cast("double")).alias("features")).repartition(7)
    held = store.write(rows, 4, even=True)
    assert held.starts.tolist() == [0, 26, 51, 76, 101]
    assert [r["key"] for r in held.frame().orderBy("position").collect()] == list(range(101))
    assert sorted(r["key"] for r in held.between([(20, 30), (49, 77)]).collect()) == [*range(20, 30), *range(49, 77)]
    held.delete()


def test_odd_samples(spark):
    """Rows without label or features are left out; ties in order stay; a table without rows gives no features; ragged rows fail."""
    schema = "row_id long, y double, features array<double>, extra string, part string, position int"
    odd = [(3, 1.0, [1.0, 0.0], None, "p", 1), (3, -1.0, [0.0, 1.0], None, "p", 1), (None, 1.0, [0.5, 0.5], None, "p", 1), (4, None, [9.0, 9.0], None, "p", 1), (5, 1.0, None, None, "p", 1)]
    df = spark.createDataFrame(odd, schema)
    held = store.write(df, 2)
    assert held.rows == 3 and held.positives == 2 and held.features == 2
    held.delete()
    assert np.isfinite(scan.fit_covariance(df, 0.1, 0.1, ranges=2)).all() and np.isfinite(saddle.fit_rounds(df, saddle.Saddle(1.0), parts=2).weights).all()
    empty = df.limit(0)
    assert len(scan.fit_covariance(empty, 0.1, 0.1)) == len(saddle.fit_rounds(empty, saddle.Saddle(1.0)).weights) == 0
    assert blocks.fit(empty, "stoiht", [{"xi": 1.0, "block": 2, "k": 1}]).shape == (1, 0)
    with pytest.raises(ValueError, match="features"):
        store.write(spark.createDataFrame([(1, 1.0, [1.0]), (2, 1.0, [1.0, 2.0])], "row_id long, y double, features array<double>"), 1)
    with pytest.raises(ValueError, match="classes"):
        scan.fit_proximal(df.where("y > 0"), 1.0, 0.1)


def test_the_thresholded_moment_keeps_the_largest():
    rng = np.random.default_rng(7)
    kept = learners._Thresholded(8, 3)
    for row in rng.normal(size=(30, 8)):
        kept.add(row)
        assert 0.9 * kept.most <= np.count_nonzero(kept.matrix) <= kept.most or np.count_nonzero(kept.matrix) < kept.most


def test_many_models_in_one_scan(spark):
    """Classes against the rest, folds and values of C at once are what each is alone; scans are those of the slowest."""
    rng = np.random.default_rng(9)
    k = rng.integers(0, 3, 120)
    x = rng.normal(size=(120, 4)) + np.eye(4)[k]
    rows = spark.createDataFrame([(i, float(c), int(i % 3), [float(v) for v in f]) for i, (c, f) in enumerate(zip(k, x, strict=True))], "row_id long, label double, fold int, features array<double>")
    specs = [linear.spec(s, c, 0.1, head=head, held=held) for s, c in ((0, 0.1), (2, 2.0), (5, 0.5)) for head, held in ((0.0, None), (2.0, 1))]
    w, f, scans = batch.train(rows, 4, specs, label="label")
    most = 0
    for one, v, value in zip(specs, w, f, strict=True):
        own = rows.withColumn("y", F.when(F.col("label") == one.head, 1.0).otherwise(-1.0))
        own = own if one.held is None else own.where(F.col("fold") != one.held)
        alone = batch.train(own.drop("fold"), 4, [batch.Spec(one.kind, one.c, one.p, one.l1)])
        assert v == pytest.approx(alone[0][0], abs=1e-5) and value == pytest.approx(alone[1][0], rel=1e-8)
        most = max(most, alone[2])
        y = np.where(k == one.head, 1.0, -1.0)[(np.arange(120) % 3 != one.held) if one.held is not None else slice(None)]
        rest = x[(np.arange(120) % 3 != one.held) if one.held is not None else slice(None)]
        g = one.c * batch.terms(one.kind, y, rest @ v, 0.1)[1] @ rest
        gap = np.where(v != 0, g + np.sign(v), np.maximum(np.abs(g) - 1, 0)) if one.l1 else g + v
        assert np.abs(gap).max() < 1e-3
    assert scans <= 2 * most


def test_cross_validation_shares_scans(spark):
    """The predictions of every fold's model, for two and for three classes and a regression, with class weights and a bias."""
    x, y = data(90, 3)
    rows = frame(spark, x, y)
    for labels, text in ((rows, "-s 2 -c 0.5 -B 1 -w1 2"), (rows.withColumn("label", F.col("row_id") % 3 * 1.0), "-s 0"), (rows.withColumn("label", F.get("features", F.lit(0))), "-s 11")):
        options = linear.parse_options(text)
        got = {r["row_id"]: r["prediction"] for r in linear.cross_validate(labels, 3, options, 3).collect()}
        placed = labels.join(prepare.random_folds(labels, 3, 1), "row_id")
        for k in range(3):
            model = linear.train_model(placed.where(F.col("fold") != k).drop("fold"), 3, options)
            for r in model.predict(placed.where(F.col("fold") == k)).collect():
                assert got[r["row_id"]] == pytest.approx(r["prediction"], abs=1e-4)


@pytest.mark.parametrize(("kind", "c", "weights"), [("hinge", 0.1, {1.0: 3.0}), ("absolute", 0.1, {})])
def test_dual_ascent_is_certified(spark, kind, c, weights):
    """The gap recomputed from weights alone; no other weights do better than the bound; parts agree within it."""
    x, y = data(120, 4)
    rows = frame(spark, x, y)
    cost = np.where(y > 0, c * weights.get(1.0, 1.0), c)
    objective = lambda w: w @ w / 2 + cost @ (np.maximum(1 - y * (x @ w), 0) if kind == "hinge" else np.maximum(np.abs(x @ w - y) - 0.1, 0))
    for parts in (1, 3):
        got = dual.fit(rows, kind, c, 0.1, weights=weights, parts=parts, gap=1e-2)
        assert 0 <= got.gap <= 1e-2 and got.objective == pytest.approx(objective(got.weights))
        rng = np.random.default_rng(1)
        assert all(objective(got.weights + 0.1 * rng.normal(size=4)) >= got.bound for _ in range(50))
    assert dual.fit(rows.limit(0), kind).weights.size == 0


@pytest.mark.parametrize(("kind", "weights"), [("hinge", {}), ("hinge", {1.0: 0.5}), ("absolute", {})])
def test_accelerated_steps_are_those_of_one_matrix(spark, monkeypatch, kind, weights):
    """Long before the optimum too, in one task and in jobs; dual ascent to its optimum gives other weights there."""
    monkeypatch.setattr(dual, "BLOCK_BYTES", 8 * 4 * 11)
    monkeypatch.setattr(dual, "KEPT_ROUNDS", 3)
    x, y = data(120, 4)
    rows, top, cost = frame(spark, x, y), (x * x).sum(), np.where(y > 0, 0.1 * weights.get(1.0, 1.0), 0.1)
    a = v = np.zeros(120)
    for t in range(10):
        s = x @ (x.T @ (v * y if kind == "hinge" else v))
        z = v + ((1 - y * s) if kind == "hinge" else y - s) / top
        u = np.clip(z, 0, cost) if kind == "hinge" else np.clip(np.sign(z) * np.maximum(abs(z) - 0.1 / top, 0), -cost, cost)
        a, v = u, u + t / (t + 3) * (u - a)
    want = x.T @ (a * y if kind == "hinge" else a)
    for part_bytes in (1 << 20, 64):
        got = dual.accelerate(rows, kind, 0.1, 0.1, weights=weights, rounds=10, part_bytes=part_bytes)
        loss = np.maximum(1 - y * (x @ want), 0) if kind == "hinge" else np.maximum(abs(x @ want - y) - 0.1, 0)
        assert got.weights == pytest.approx(want, abs=1e-12) and got.objective == pytest.approx(want @ want / 2 + cost @ loss)
        assert got.gap == pytest.approx((got.objective - (a.sum() if kind == "hinge" else y @ a - 0.1 * abs(a).sum()) + want @ want / 2) / max(1, got.objective))
    assert abs(dual.fit(rows, kind, 0.1, 0.1, weights=weights, parts=1, gap=1e-6).weights - want).max() > 1e-3
    assert dual.accelerate(rows.limit(0), kind).weights.size == 0


def test_class_weights_reach_the_hinge_machine(spark):
    x, y = data(80, 3)
    heavy, plain = (linear.train_model(frame(spark, x, y), 3, linear.parse_options(f"-s 3 -c 0.05 -e 0.01{w}")).weights[0] for w in (" -w1 5", ""))
    assert (x @ heavy > 0).sum() > (x @ plain > 0).sum()


def test_settings_reach_every_block(spark):
    """On 2,000 rows a pass takes every one of the 40 blocks once, the last with the rows that are left."""
    spans = blocks._schedule(2010, {"block": 50.0, "passes": 3.0}, 0, 1)
    assert sorted(spans) == sorted([*((50 * k, 50 * k + 50) for k in range(39)), (1950, 2010)] * 3)


def test_rank_by_digits(spark):
    rng = np.random.default_rng(2)
    values = [*rng.normal(size=300).tolist(), *([0.5] * 50), 0.0, -0.0, float("inf"), float("-inf"), float("nan"), 5e-324, -5e-324, None]
    df = spark.createDataFrame([(v, None if v is None or v != v or abs(v) > 1e300 else int(1000 * v)) for v in values], "v double, i long").repartition(3)
    order_of = sorted((v for v in values if v is not None), key=lambda v: (v != v, v), reverse=True)
    for k in (1, 2, 3, 60, 100, 200, len(order_of)):
        got, before = order.select_rank(df, "v", k)
        want = order_of[k - 1]
        assert (got != got and want != want) or got == want
        assert before == sum((v != v) > (want != want) or v > want for v in order_of)
    assert order.select_rank(df, "v", len(order_of) + 1) is None and order.select_rank(df, "v", 0) is None
    ints = sorted(r["i"] for r in df.collect() if r["i"] is not None)
    assert [order.select_rank(df, "i", k, descending=False)[0] for k in (1, 100, len(ints))] == [ints[0], ints[99], ints[-1]]
    assert order.kth_largest(df, "v", 10_000).count() == 0


def test_a_large_top_is_that_of_a_sort(spark, monkeypatch):
    rows = [(i, float((i * 7919) % 13 - 6)) for i in range(400)] + [(400, None)]
    df = spark.createDataFrame(rows, "j long, w double").repartition(3)
    monkeypatch.setattr(order, "HEAP", 5)
    for k in (6, 100, 333, 400, 401):
        want = sorted(rows, key=lambda r: (r[1] is None, -abs(r[1] or 0), r[0]))[:k]
        assert sorted(tuple(r) for r in order.top_by_magnitude(df, k).select("j", "w").collect() if r["w"] is not None) == sorted(r for r in want if r[1] is not None)


def test_null_groups_and_scores(spark):
    rows = [("a", 1.0, 0.9), ("a", -1.0, 0.1), (None, 1.0, 0.2), (None, -1.0, 0.8), (None, 1.0, 0.9), (None, -1.0, None), ("a", None, 0.5)]
    got = {r["g"]: (r["n_pos"], r["n_neg"], r["auc"]) for r in metrics.auc(spark.createDataFrame(rows, "g string, y double, score double"), by=("g",)).collect()}
    assert got == {"a": (1, 1, 1.0), None: (2, 1, 0.5)}


def test_too_few_trials_fail(spark):
    x, y = data(60, 2)
    with pytest.raises(Exception, match="fewer than 3 of 2 candidates"):
        prepare.trial_splits(frame(spark, x, y), 3, 40, (15, 16, 17), 4, 1, candidates=2).collect()
    with pytest.raises(Exception, match="fewer than 1 of 5 candidates"):
        prepare.trial_splits(frame(spark, x, y), 1, 40, (99,), 4, 1, candidates=5).collect()


@pytest.mark.parametrize("solver", [5, 6])
def test_absolute_penalty_on_many_features(spark, solver):
    """7,129 features of 40 rows, dense and sparse: every feature meets its optimality condition."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(40, 7129)) * (rng.random((40, 7129)) < 0.5), np.where(np.arange(40) % 2, 1.0, -1.0)
    rows = frame(spark, x, y)
    for df in (rows, src.to_sparse(rows)) if solver == 5 else (rows,):
        w, f = linear.train(df, 7129, solver, 0.5)
        kind = linear.SOLVERS[solver]
        loss, slope, _ = batch.terms(kind, y, x @ w, 0.1)
        g = 0.5 * slope @ x
        assert np.abs(np.where(w != 0, g + np.sign(w), np.maximum(np.abs(g) - 1, 0))).max() < 1e-3
        assert f == pytest.approx(np.abs(w).sum() + 0.5 * loss.sum()) and 0 < np.count_nonzero(w) <= 40


def test_sketches_merge_within_their_bounds(spark):
    """Frequent directions of 1, 4 and 16 partitions; hashed projections add up to the same whatever the partitions."""
    x, y = data(400, 8)
    x = x * np.array([5, 3, 2, 1, 1, 0.5, 0.5, 0.1])
    rows, tau, seen = frame(spark, x, y), 6, []
    for parts in (1, 4, 16):
        df = rows.repartition(parts)
        for own, kept in sketch.directions(df, 8, tau).items():
            whole = x[(y > 0) == own]
            gaps = np.linalg.eigvalsh(whole.T @ whole - kept.T @ kept)
            assert len(kept) <= tau and gaps.min() > -1e-6 * (whole**2).sum() and gaps.max() <= (whole**2).sum() / (tau // 2)
        seen.append(sorted((r["class"], r["j"], r["k"], round(r["z"], 9)) for r in sketch.hashed(df, 8, 5).collect()))
    assert seen[0] == seen[1] == seen[2]
    z = sum(np.outer(v, sketch.signs(i, 5)) for i, v in enumerate(x) if y[i] > 0)
    assert np.allclose(z.ravel(), [r[3] for r in seen[0] if r[0] == 1])


def test_pairwise_weights(spark):
    """Against all pairs; sketches that keep everything agree, and small ones rank nearly as well."""
    x, y = data(200, 6)
    rows = frame(spark, x, y).repartition(3)
    pairs = (x[y > 0][:, None] - x[y <= 0][None]).reshape(-1, 6)
    want = np.linalg.solve(pairs.T @ pairs / len(pairs) + 0.1 * np.eye(6), pairs.mean(0))
    assert sketch.fit_pairwise(rows, 6, 0.1) == pytest.approx(want, abs=1e-9)
    assert sketch.fit_pairwise(rows, 6, 0.1, "directions", 12) == pytest.approx(want, abs=1e-6)
    exact, rough = (learners._rank_auc(y, x @ w) for w in (want, sketch.fit_pairwise(rows, 6, 0.1, "hashed", 64)))
    assert rough > exact - 0.05
    with pytest.raises(ValueError, match="classes"):
        sketch.fit_pairwise(rows.where("y > 0"), 6, 0.1)


def test_small_steps_are_walked_in_legs(samples, monkeypatch):
    """The sequential learners without a job for each step: by parts, by passes, and with larger steps between."""
    x, y, df = samples
    jobs = []
    summed = blocks.block_sums
    monkeypatch.setattr(blocks, "block_sums", lambda *a: jobs.append(a) or summed(*a))
    grids = {
        "sht_auc": [{"xi": 0.3, "block": 10, "k": k, "passes": 2, "version": v, "l2": 0.1} for k, v in ((2, 0), (3, 1), (5, 2))],
        "stoiht": [{"xi": 0.5, "block": b, "k": 2, "l2": 0.01, "passes": 2} for b in (7, 50)],
        "hsg_ht": [{"xi": 0.5, "tau": 3, "zeta": 2.0, "k": 3, "passes": 2}],
    }
    for room, most in ((1 << 20, 0), (40, 6)):
        for method, grid in grids.items():
            jobs.clear()
            got = blocks.fit(df, method, grid, parts=4, part_bytes=room * 8 * 5)
            for w, p in zip(got, grid, strict=True):
                assert w == pytest.approx(learners.REGISTRY[method](x, y, p, learners._schedule(len(y), p, 0, 1)), abs=1e-12)
            assert len(jobs) <= most
    w = blocks.fit(df, "stoiht", [{"xi": 0.5, "block": 10, "k": 2}], steps=40)
    assert w[0] == pytest.approx(learners.REGISTRY["stoiht"](x, y, {"xi": 0.5, "block": 10, "k": 2}, learners._schedule(150, {"block": 10}, 40, 1)), abs=1e-12)
    assert blocks.legs([(0, 2), (2, 9), (9, 10), (10, 12)], 3, 3) == [(0, 1), (1, 2), (2, 4)]


def test_search_of_c_scans_once_a_step(samples, monkeypatch):
    """Each C goes on from the last one's sums; the path is that of models scanned and scored for each C by itself."""
    x, y, df = samples
    scans, train = [], batch.train

    def counted(*a, **k):
        out = train(*a, **k)
        scans.append(out[2])
        return out

    monkeypatch.setattr(batch, "train", counted)
    for solver in (2, 11):
        scans.clear()
        path = linear.search_c(df, 5, solver, 3, start=0.001, most=0.1)
        carried = scans.copy()
        placed, warm, plain = df.join(prepare.random_folds(df, 3, 1), "row_id").cache(), None, []
        scans.clear()
        for c, _ in path:
            warm = batch.train(placed, 5, [linear.spec(solver, c, 0.1, held=k) for k in range(3)], eps=1e-6, start=warm)[0]
            rows = placed.toPandas()
            s = np.array([np.dot(f, warm[k]) for f, k in zip(rows["features"], rows["fold"], strict=True)])
            plain.append((c, ((s - rows["y"]) ** 2).mean() if solver == 11 else ((s > 0) == (rows["y"] > 0)).mean()))
        placed.unpersist()
        assert np.array(path) == pytest.approx(np.array(plain), abs=1e-9)
        assert carried[0] == scans[0] and all(a == b - 1 for a, b in zip(carried[1:], scans[1:], strict=True))
