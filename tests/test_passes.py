"""Fits in passes against brute force, against Spark ML, and over one and several blocks."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from mailsift.operators import boosting as B, linear as L, passes, training as TR

N, D = 240, 30


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = np.where(rng.random((N, D)) < 0.35, np.round(rng.exponential(1, (N, D)), 2), 0.0)
    logit = 1.5 * (x[:, 3] > 0.5) - 1.5 * x[:, 7] + 2 * ((x[:, 1] > 0) & (x[:, 2] > 0)) - 0.3
    return x, (rng.random(N) < 1 / (1 + np.exp(-2 * logit))).astype(float)


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    made = [(i, SparseVector(D, np.flatnonzero(r).tolist(), r[r > 0].tolist()), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    from mailsift.session import scratch_path
    path = scratch_path(spark, "test-vectors")
    spark.createDataFrame(made, ["doc_id", "features", "target"]).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def one(rows):
    return TR.blocks_of(rows)


@pytest.fixture(scope="module")
def several(rows):
    return TR.blocks_of(rows, block_rows=90)


def test_layout(one, several):
    assert (one.n_blocks, one.n_rows, one.n_features) == (1, N, D) and several.n_blocks > 1


def brute_split(x, g, h, rows, l2, least):
    best = (B.LEAST_GAIN, None, None)
    G, H = g[rows].sum(), h[rows].sum()
    for f in range(x.shape[1]):
        for t in np.unique(np.append(x[rows, f], 0.0)):
            low = rows & (x[:, f] <= t)
            high = rows & ~low
            if min(low.sum(), high.sum()) < least or min(h[low].sum(), h[high].sum()) < B.LEAST_HESSIAN:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (low, high)) - G ** 2 / (H + l2)
            if gain > best[0] + 1e-9:
                best = (gain, f, t)
    return best


def grown(x, g, h, leaves, l2, least):
    """Leaf-wise growth by trying every split: list of (feature, threshold) in the order of growth, and the leaves."""
    parts, steps = [np.ones(len(x), bool)], []
    while len(parts) < leaves:
        found = [brute_split(x, g, h, p, l2, least) for p in parts]
        k = max(range(len(parts)), key=lambda i: found[i][0])
        gain, f, t = found[k]
        if f is None:
            break
        steps.append((f, t))
        low = x[:, f] <= t
        parts[k:k + 1] = [parts[k] & low, parts[k] & ~low]
    return steps, parts


@pytest.mark.parametrize("leaves, l2, least", [(63, 0.0, 20), (6, 0.5, 8)])
def test_boosting_equals_brute_force(data, one, several, leaves, l2, least):
    x, y = data
    params = {"max_iter": 4, "learning_rate": 0.3, "max_leaf_nodes": leaves, "l2_regularization": l2, "min_samples_leaf": least}
    share = y.mean()
    margin = np.full(N, np.log(share / (1 - share)))
    for _ in range(4):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        steps, parts = grown(x, g, h, leaves, l2, least)
        assert steps
        for p in parts:
            margin[p] -= 0.3 * g[p].sum() / (h[p].sum() + l2)
    want = 1 / (1 + np.exp(-margin))
    for blocks in (one, several):
        (fitted,) = passes.run(blocks, [B.BoostJob(params, [])])
        assert max(sum(v < 0 for v in t.left) for t in fitted.trees) <= leaves
        model = B.TreeModel.of(fitted, blocks)
        assert np.allclose(model.probabilities(x[:, model.features]), want, atol=1e-9)


def test_many_trees_are_absorbed_by_the_blocks(data, one, several):
    params = {**TR.DEFAULTS["gradient_boosting"], "max_iter": 27, "min_samples_leaf": 15, "max_leaf_nodes": 5}
    a, b = (B.TreeModel.of(passes.run(k, [B.BoostJob(params, [])])[0], k) for k in (one, several))
    assert len(a.roots) == len(b.roots) == 27
    assert np.allclose(a.probabilities(data[0][:, a.features]), b.probabilities(data[0][:, b.features]), atol=1e-8)


def test_l2_shrinks_leaves(one):
    fits = passes.run(one, [B.BoostJob({**TR.DEFAULTS["gradient_boosting"], "max_iter": 1, "l2_regularization": v}, []) for v in (0, 50)])
    assert max(map(abs, fits[1].trees[0].value)) < 0.5 * max(map(abs, fits[0].trees[0].value))


def test_transform(rows, data, one):
    model = B.TreeModel.of(passes.run(one, [B.BoostJob({**TR.DEFAULTS["gradient_boosting"], "max_iter": 5}, [])])[0], one)
    got = {r["doc_id"]: r["probability"][1] for r in model.transform(rows).collect()}
    want = model.probabilities(data[0][:, model.features])
    assert np.allclose([got[i] for i in range(N)], want)


def test_forest_over_blocks(data, one, several):
    x, y = data
    params = {"n_estimators": 30, "max_depth": 6, "min_samples_leaf": 2, "max_features": "sqrt"}
    models = [B.TreeModel.of(passes.run(k, [B.ForestJob(params, [], D)])[0], k) for k in (one, several)]
    p = models[0].probabilities(x[:, models[0].features])
    assert ((p > 0.5) == (y > 0)).mean() > 0.85 and len(models[0].roots) == 30
    # Rows are numbered when blocks are built, and the bootstrap goes by number: the same forest in both layouts.
    assert np.allclose(p, models[1].probabilities(x[:, models[1].features]), atol=1e-9)


def test_forests_take_one_pass_a_level(rows, one, several, monkeypatch):
    params = {"n_estimators": 12, "max_depth": 5, "min_samples_leaf": 2}
    passed, receive = [], B.ForestJob.receive
    monkeypatch.setattr(B.ForestJob, "receive", lambda self, total: (passed.append(1), receive(self, total)))
    for blocks in (several, TR.blocks_of(rows, block_rows=30)):
        passed.clear()
        passes.run(blocks, [B.ForestJob(params, [], D)])
        assert len(passed) == 6  # the root and five levels
    model = TR.train(rows, "random_forest", params).model
    assert isinstance(model, B.TreeModel) and len(model.roots) == 12


def test_leaves_of_a_forest_hold_the_mean_of_their_draws(spark, rows, data, several):
    import pickle
    params = {"n_estimators": 3, "max_depth": None, "min_samples_leaf": 3}
    (fitted,) = passes.run(several, [B.ForestJob(params, [], D)])
    blocks = [pickle.loads(bytes(r[0])) for r in several.table.collect()]
    for t, tree in enumerate(fitted.trees):
        key = B._mix(np.array([42 * 1_000_003 + t], np.uint64))[0]
        times = np.concatenate([np.searchsorted(B._POISSON, B._mix(b.number.astype(np.uint64) ^ key) / 2.0 ** 64) for b in blocks])
        leaf, y = (np.concatenate(x) for x in zip(*((tree.leaves_of(b), b.target) for b in blocks)))
        drawn = np.bincount(leaf, times, len(tree.left))
        kept = np.flatnonzero(np.array(tree.left) < 0)
        assert len(kept) > 5 and (drawn[kept] >= 3).all() and drawn.sum() == times.sum()
        assert np.allclose(np.array(tree.value)[kept], np.bincount(leaf, times * y, len(tree.left))[kept] / drawn[kept])


def test_logistic_regression_equals_spark_ml(rows, one, several):
    ml = LogisticRegression(featuresCol="features", labelCol="target", regParam=1 / (5.0 * N), maxIter=1000, tol=1e-9,
                            standardization=False).fit(rows)
    for blocks in (one, several):
        (m,) = passes.run(blocks, [L.LinearJob("logistic", 5.0, 1000, D, [])])
        assert np.allclose(m.coefficients, ml.coefficients.toArray(), atol=0.02) and abs(m.intercept - ml.intercept) < 0.02


def test_squared_hinge_reaches_the_minimum(data, one):
    x, y = data
    sign = np.where(y > 0, 1, -1)
    (m,) = passes.run(one, [L.LinearJob("squared_hinge", 1.0, 10_000, D, [])])
    w = np.append(m.coefficients, m.intercept)

    def loss(w):
        return 0.5 * w @ w + (np.maximum(1 - sign * (x @ w[:-1] + w[-1]), 0) ** 2).sum()
    rng = np.random.default_rng(1)
    assert all(loss(w) <= loss(w + 0.01 * rng.normal(size=D + 1)) for _ in range(200))


def test_calibration(data, one, several):
    x, y = data
    fits = [passes.run(b, [L.CalibratedJob(1.0, 10_000, D, [], "f3", 3)])[0] for b in (one, several)]
    assert np.allclose(fits[0].platt, fits[1].platt, atol=0.02)
    p = fits[0]._link(x @ fits[0].coefficients + fits[0].intercept)
    assert fits[0].platt[0] > 0 and abs(p.mean() - y.mean()) < 0.1


def test_naive_bayes_equals_spark_ml(rows, one):
    ml = NaiveBayes(smoothing=0.1, featuresCol="features", labelCol="target").fit(rows)
    (m,) = passes.run(one, [L.BayesJob(0.1, D, [])])
    want = {r["doc_id"]: r["probability"][1] for r in ml.transform(rows).collect()}
    got = {r["doc_id"]: r["probability"][1] for r in m.transform(rows).collect()}
    # Spark smooths the class shares as well, which is a constant shift of the log-odds.
    odds = lambda p: np.log(p / (1 - p))
    shift = [odds(got[i]) - odds(want[i]) for i in range(N) if 1e-9 < want[i] < 1 - 1e-9]
    assert np.allclose(shift, shift[0], atol=1e-6) and abs(shift[0]) < 0.05


def test_search_equals_separate_fits(rows, data, one, several):
    y = data[1]
    fold = {r["doc_id"]: r["f"] for r in rows.select("doc_id", TR.fold_of("doc_id", 3).alias("f")).collect()}
    fold = np.array([fold[i] for i in range(N)])
    names = ["naive_bayes", "logistic_regression", "svm", "random_forest", "gradient_boosting"]
    fixed = {"max_iter": 12, "n_estimators": 7}
    found = TR.search(rows, names, folds=3, draws=2, fixed=fixed)
    again = TR.search(rows, ["naive_bayes", "svm", "gradient_boosting"], folds=3, draws=2, fixed=fixed, block_rows=90)
    for name in again:
        assert [p for p, _ in again[name]] == [p for p, _ in found[name]]
        assert np.allclose([s for _, s in again[name]], [s for _, s in found[name]], atol=0.03)
    for name in names:
        for params, scores in found[name]:
            for k in range(3):
                (fitted,) = passes.run(one, [TR.job(name, params, D, [("f3", k)], calibrated=False)])
                model = TR._usable(fitted, one)
                p = {r["doc_id"]: r["probability"][1] for r in model.transform(rows).collect()} if k == 0 else None
                if p:
                    held = fold == k
                    guess = np.array([p[i] > 0.5 for i in range(N)])
                    assert scores[k] == pytest.approx(TR.macro_f1(L.confusion(held, guess, y)))


def test_negative_features_are_refused(spark):
    df = spark.createDataFrame([(1, SparseVector(2, [0], [-1.0]), 1.0)], ["doc_id", "features", "target"])
    with pytest.raises(ValueError):
        TR.blocks_of(df)


def test_rows_without_entries_and_dense_vectors(spark):
    from pyspark.ml.linalg import DenseVector
    made = [(i, SparseVector(3, [], []) if i % 2 else DenseVector([1.0, 0.0, float(i)]), float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(made, ["doc_id", "features", "target"])
    got = TR.train(df, "gradient_boosting", {"max_iter": 3}).score(df).select(F.col("target"), "prediction").distinct().collect()
    assert {(r["target"], r["prediction"]) for r in got} == {(0.0, "ham"), (1.0, "spam")}


def test_linear_fits_need_no_bins(spark, rows, monkeypatch):
    df = rows.select("*")
    plain = TR.blocks_of(df, block_rows=90, bins=False)
    assert plain.cuts is None and plain.n_blocks > 1
    with_bins = TR.blocks_of(rows, block_rows=90)
    a, b = (passes.run(x, [TR.job("svm", None, D, [])])[0] for x in (plain, with_bins))
    assert np.allclose(a.coefficients, b.coefficients, atol=1e-6) and np.allclose(a.platt, b.platt, atol=1e-4)
    asked = []
    monkeypatch.setattr(passes, "build", lambda *args, bins=True, **kw: asked.append(bins) or plain)
    for names in (["svm"], ["svm", "gradient_boosting"]):
        monkeypatch.setattr(passes, "run", lambda blocks, jobs: [a for _ in jobs])
        TR.train_in_passes(rows.select("*"), names)
    assert asked == [False, True]


def test_bins_are_found_by_halving(spark):
    cuts = np.round(np.sort(np.random.default_rng(1).exponential(1, 254)), 4)
    cuts = np.unique(cuts)
    rows = [(float(v), cuts[:n].tolist()) for n in (0, 1, 2, 3, 127, 128, len(cuts)) for v in (0.0, 0.1, 5.0, 99.0, *cuts[:n:9], *cuts[max(n - 1, 0):n])]
    found = passes._below("cuts", spark.createDataFrame(rows, "value double, cuts array<double>")).collect()
    assert [r["bin"] for r in found] == [int(np.searchsorted(c, v)) + 1 for v, c in rows]


def test_only_splits_of_trees_reach_the_driver(data, several, monkeypatch):
    got, receive = [], B.BoostJob.receive
    monkeypatch.setattr(B, "RANGE", 7)
    monkeypatch.setattr(B.BoostJob, "receive", lambda self, total: (got.append(total), receive(self, total)))
    (fitted,) = passes.run(several, [B.BoostJob({**TR.DEFAULTS["gradient_boosting"], "max_iter": 2, "max_leaf_nodes": 4}, [])])
    found = [split for total in got[1:] for _, split in total.values()]
    assert len(fitted.trees) == 2 and found and all(split is None or len(split) == 3 for split in found)


def test_the_driver_holds_a_bounded_number_of_jobs(one, several, monkeypatch):
    job = lambda c: L.Trial(L.LinearJob("squared_hinge", c, 50, D, [("f3", 0)]), "f3", 0)
    costs = [0.1, 1.0, 5.0, 20.0]
    want = passes.run(one, [job(c) for c in costs])
    monkeypatch.setattr(passes, "DRIVER_BYTES", 2 * job(1.0).weight(N))
    open_jobs, most, request = set(), [], L.Trial.request

    def counted(self, width):
        asked = request(self, width)
        (open_jobs.add if asked is not None else open_jobs.discard)(self.id)
        most.append(len(open_jobs))
        return asked
    monkeypatch.setattr(L.Trial, "request", counted)
    jobs = [job(c) for c in costs]
    assert np.array_equal(passes.run(several, jobs), want)
    assert max(most) == 2 and all(type(j.job) is passes.Job for j in jobs)


def test_a_tree_takes_few_passes_however_many_leaves(data, one, several, monkeypatch):
    """Boosting over blocks measures the guessed rest of a tree at once; leaf by leaf, these trees took more than twice the passes."""
    params = {**TR.DEFAULTS["gradient_boosting"], "max_iter": 12, "min_samples_leaf": 4}
    passed, receive = [], B.BoostJob.receive
    monkeypatch.setattr(B.BoostJob, "receive", lambda self, total: (passed.append(1), receive(self, total)))
    (fitted,) = passes.run(several, [B.BoostJob(params, [])])
    assert len(fitted.trees) == 12 and min(len(t.left) for t in fitted.trees) > 20
    assert len(passed) <= 4 + 2 * 12
    (want,) = passes.run(one, [B.BoostJob(params, [])])
    a, b = (B.TreeModel.of(m, k) for m, k in ((fitted, several), (want, one)))
    assert np.allclose(a.probabilities(data[0][:, a.features]), b.probabilities(data[0][:, b.features]), atol=1e-8)


def test_wrong_guesses_change_no_tree(data, one, several, monkeypatch):
    params = {**TR.DEFAULTS["gradient_boosting"], "max_iter": 6, "min_samples_leaf": 6, "l2_regularization": 0.3}
    (want,) = passes.run(one, [B.BoostJob(params, [("f3", 1)])])
    monkeypatch.setattr(B, "GUESS_ROWS", 50)
    monkeypatch.setattr(B, "GUESS_ENTRIES", 100)
    monkeypatch.setattr(B, "LEADERS", 1)
    wrong, corrected = [], B.Grower.corrected

    def counted(self, nodes):
        before = sum(v >= 0 for v in self.tree.left)
        corrected(self, nodes)
        wrong.append(before - sum(v >= 0 for v in self.tree.left))
    monkeypatch.setattr(B.Grower, "corrected", counted)
    (fitted,) = passes.run(several, [B.BoostJob(params, [("f3", 1)])])
    assert sum(wrong) > 5
    a, b = (B.TreeModel.of(m, k) for m, k in ((fitted, several), (want, one)))
    assert np.allclose(a.probabilities(data[0][:, a.features]), b.probabilities(data[0][:, b.features]), atol=1e-8)


def test_support_vectors_reach_the_minimum_in_few_passes():
    """Frequent words beside rare ones: L-BFGS took 94 passes and left a slope of 0.007."""
    rng = np.random.default_rng(7)
    n, d = 600, 400
    x = np.where(rng.random((n, d)) < 0.9 / np.sqrt(np.arange(1, d + 1)), rng.exponential(1, (n, d)), 0.0)
    x /= np.maximum(np.sqrt((x * x).sum(1)), 1e-9)[:, None]  # of unit length, as the weights of a text
    y = (rng.random(n) < 0.3).astype(float)
    feature, row = np.nonzero(x.T)
    block = passes.Block(y, np.arange(n), {}, row, feature, np.zeros(len(row), np.int16), x[row, feature], d)
    job, passed = TR.job("svm", None, d, [], calibrated=False), 0
    while (request := job.request(1)) is not None:
        job.receive(job.answer(block, request))
        passed += 1
    model, sign = job.result(), np.where(y > 0, 1, -1)
    w = np.append(model.coefficients, model.intercept)
    short = np.maximum(1 - sign * (x @ w[:-1] + w[-1]), 0)
    slope = w - 2 * np.append(x.T @ (sign * short), (sign * short).sum())
    assert passed < 75 and np.abs(slope).max() < 1e-4
