"""Whole fits against a second implementation in numpy, and properties that must hold."""

import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions.losses import loss_from_name
from larkspur.functions.metrics import AUC, metric_from_name
from larkspur.operators import multioutput, ordered, sampling
from larkspur.operators.binning import BINNERS, binner_from_name
from larkspur.plans import booster as booster_module
from larkspur.plans.adaptive import AdaptiveESCV
from larkspur.plans.booster import GradientBoosting, SketchBoost
from larkspur.plans.callbacks import Callback, DuplicateFilter, LoggerStream, verbosity_to_loglevel
from larkspur.plans.cv import CrossValidation
from larkspur.plans.model import Model
from larkspur.sources import export, frames
from larkspur.streaming.scoring import score_stream

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    n = 600
    a, b, c = rng.integers(0, 12, n).astype(float), rng.normal(size=n).round(1), rng.integers(0, 3, n).astype(float)
    b[rng.random(n) < 0.15] = np.nan
    y = np.where(a > 5, 2.0, -1.0) + np.where(np.isnan(b), 3.0, b) + rng.integers(0, 2, n)
    w = 1.0 + rng.integers(0, 3, n)
    return [(k, float(a[k]), float(b[k]), float(c[k]), float(y[k]), float(w[k]), float(y[k] > 1), float(c[k] > 0)) for k in range(n)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, y double, w double, t double, u double").repartition(3).persist()


class Twin:
    """A plain grower for squared loss: sorted distinct values are bins, bin 0 is missing."""

    def __init__(self, rows, depth, lr, lam=1.0, min_leaf=10):
        self.x = np.array([r[1:4] for r in rows])
        self.y, self.w = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        self.depth, self.lr, self.lam, self.min_leaf = depth, lr, lam, min_leaf
        self.pred = np.full(len(self.y), self.y.mean())

    def gain(self, g, h, left):
        big_g, big_h, n = g.sum(), h.sum(), len(g)
        gl, hl = g[left].sum(), h[left].sum()
        count = hl / big_h * n
        if min(n - count, count) <= self.min_leaf:
            return 0.0
        return gl**2 / (hl + self.lam) + (big_g - gl) ** 2 / (big_h - hl + self.lam) - big_g**2 / (big_h + self.lam)

    def tree(self, weighted):
        w = self.w if weighted else np.ones_like(self.y)
        g, h = (self.pred - self.y) * w, w
        nodes = [np.arange(len(self.y))]
        done = []
        for _ in range(self.depth):
            after = []
            for node in nodes:
                best = (0.0, None)
                for f in range(3):
                    x = self.x[node, f]
                    missing = np.isnan(x)
                    for v in [-np.inf, *np.unique(x[~missing])]:
                        for missing_left in (True, False):
                            if not missing_left and not missing.any():
                                continue
                            left = np.where(missing, missing_left, x <= v)
                            gain = self.gain(g[node], h[node], left)
                            if gain > best[0] + 1e-9:
                                best = (gain, left)
                if best[1] is None:
                    done.append(node)
                else:
                    after += [node[best[1]], node[~best[1]]]
            nodes = after
        for node in done + nodes:
            self.pred[node] -= self.lr * g[node].sum() / (h[node].sum() + self.lam)


def predictions(booster, df):
    return {r.id: np.array(r.prediction) for r in booster.predict(df).collect()}


@pytest.mark.parametrize(("weighted", "cells"), [(False, 2_000_000), (True, 2_000_000), (True, 0)])
def test_equals_the_numpy_twin(df, rows, monkeypatch, weighted, cells):
    monkeypatch.setattr(booster_module, "DRIVER_CELLS", cells)
    booster = GradientBoosting("mse", ntrees=3, max_depth=3, lr=0.4, es=0, verbose=0, checkpoint_every=2)
    booster.fit(df, FEATURES, "y", "id", "w" if weighted else None)
    twin = Twin(rows, 3, 0.4)
    for _ in range(3):
        twin.tree(weighted)
    got = predictions(booster, df)
    np.testing.assert_allclose([got[k][0] for k in range(len(rows))], twin.pred, rtol=1e-9, atol=1e-9)
    by_sql = {r.id: r.prediction[0] for r in booster.model.predict_sql(df).collect()}
    np.testing.assert_allclose([by_sql[k] for k in range(len(rows))], twin.pred, rtol=1e-9, atol=1e-9)


def test_stages_leaves_files_and_export(spark, df, tmp_path):
    booster = GradientBoosting("mse", ntrees=3, max_depth=2, lr=0.4, es=0, verbose=0).fit(df, FEATURES, ["y", "t"], "id")
    final = predictions(booster, df)
    staged = booster.predict_staged(df, [0, 2]).where("iter = 2").collect()
    assert all(np.allclose(r.prediction, final[r.id]) for r in staged)
    leaves = booster.predict_leaves(df).collect()
    assert len(leaves) == 3 * df.count() and max(r.leaf[0] for r in leaves) < 4
    for bad in ([], [2, 1], [0, 0], [3]):
        with pytest.raises(ValueError):
            booster.predict_staged(df, bad)
    booster.dump(f"{tmp_path}/m.json")
    again = Model.load(f"{tmp_path}/m.json")
    booster.model.save_tables(spark, f"file://{tmp_path}/tables")
    tables = Model.load_tables(spark, f"file://{tmp_path}/tables")
    for m in (again, tables, GradientBoosting("mse").load(f"{tmp_path}/m.json").model):
        got = {r.id: r.prediction for r in m.predict(df).collect()}
        assert all(np.allclose(got[k], final[k]) for k in final)
        assert m.feature_importance("gain").tolist() == booster.feature_importance("gain").tolist()
    assert booster.feature_importance().sum() == sum(f >= 0 for t in again.trees for g in t.groups for f in g.feat)
    second = {r.id: r.prediction for r in export.Scorer(again, [1]).predict(df).collect()}
    assert all(np.allclose(second[k], final[k][1:]) for k in final)
    targets = export.target_table(again, spark, [1]).collect()
    assert {r.target for r in targets} == {0}
    with pytest.warns(UserWarning):
        assert export.chosen_outputs(again, [1, 0]) == [0, 1]
    for kind in export.POST_TRANSFORMS:
        assert export.Scorer(again, transform=kind).predict(df).count() == df.count()


def test_streaming_scores_equal_batch_scores(spark, df, tmp_path):
    booster = GradientBoosting("bce", ntrees=2, max_depth=2, es=0, verbose=0).fit(df, FEATURES, "t", "id")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    score_stream(booster.model, stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = {r.id: r.prediction for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = predictions(booster, df)
    assert all(np.allclose(got[k], want[k]) for k in want) and all(0 < v[0] < 1 for v in want.values())
    with pytest.raises(ValueError):
        score_stream(booster.model, df, "x", "y")


def test_early_stopping_and_callbacks(df):
    class Watch(Callback):
        seen: list = []

        def after_iteration(self, state):
            self.seen.append((state["num_iter"], state["iter_score"]))
            return False

    train, valid = df.where("id % 2 = 0"), df.where("id % 2 = 1").withColumn("y", -F.col("y"))
    booster = GradientBoosting("mse", ntrees=6, max_depth=1, lr=0.9, es=2, verbose=0, callbacks=[Watch()]).fit(train, FEATURES, "y", "id", eval_sets=[train, valid])
    assert booster.best_round == 1 and len(booster.model.trees) == 1 and len(booster.history) == 3
    assert Watch.seen[0][1] is None and Watch.seen[1][1] == booster.history[0]


@pytest.mark.parametrize("method", ["topk", "svd", "rand", "proj", "filter", None])
def test_sketches(df, method):
    booster = SketchBoost("multilabel", sketch_method=method, ntrees=2, max_depth=2, es=0, verbose=0).fit(df, FEATURES, ["t", "u"], "id")
    before = df.select(F.array("t", "u").alias("y"), F.array(F.lit(0.5), F.lit(0.5)).alias("p"))
    after = booster.predict(df).select(F.array("t", "u").alias("y"), F.col("prediction").alias("p"))
    metric = metric_from_name("bce")
    assert metric.evaluate(after) < metric.evaluate(before)


@pytest.mark.parametrize("splitter", ["OneVsAll", "RandomGroups"])
def test_splitters_and_samplers(df, splitter):
    options = {"ntrees": 2, "max_depth": 2, "es": 0, "verbose": 0, "target_splitter": splitter, "subsample": 0.7, "colsample": 0.7, "gd_steps": 2}
    booster = GradientBoosting("mse", **options).fit(df, FEATURES, ["y", "t", "u"], "id")
    again = GradientBoosting("mse", **options).fit(df.repartition(2), FEATURES, ["y", "t", "u"], "id")
    assert {len(t.groups) for t in booster.model.trees} == {3 if splitter == "OneVsAll" else 2}
    one, other = predictions(booster, df), predictions(again, df)
    assert all(np.allclose(one[k], other[k]) for k in one)


def test_mvs_and_column_importance(df):
    booster = GradientBoosting("mse", ntrees=2, max_depth=2, es=0, verbose=0, subsample=sampling.MVSSampler(0.5), colsample=sampling.ColumnImportanceSampler(0.7)).fit(df, FEATURES, "y", "id")
    assert len(booster.model.trees) == 2
    p = sampling.ColumnImportanceSampler(inverse=True, n_force=1).shares(np.array([1.0, 2.0, 5.0]))
    assert p.sum() == pytest.approx(1) and p[0] > p[1] and len(p) == 2
    assert multioutput.RandomGroups(5)(3) and sorted(k for g in multioutput.RandomGroups(2)(5) for k in g) == list(range(5))


@pytest.mark.parametrize("kind", sorted(BINNERS))
def test_binners(df, kind):
    binner = binner_from_name(kind, max_bin=8).fit(df, FEATURES, "id")
    for path in (64, 0):
        import larkspur.operators.binning as module

        old, module.SQL_BORDERS = module.SQL_BORDERS, path
        codes = binner.transform(df).select("a", "b", "bins").collect()
        module.SQL_BORDERS = old
        for r in codes:
            assert (r.bins[1] == 0) == bool(np.isnan(r.b))
            assert r.bins[0] == np.searchsorted(binner.borders[0], r.a, side="left") + 1
    assert all(len(b) <= 7 for b in binner.borders) and np.isinf(binner.get_borders()[0][[0, -1]]).all()
    with pytest.raises(ValueError):
        binner_from_name("Other")


def test_constant_and_missing_features_never_split(spark):
    df = spark.createDataFrame([(k, 1.0, None, float(k % 2)) for k in range(100)], "id bigint, a double, b double, y double")
    booster = GradientBoosting("mse", ntrees=1, es=0, verbose=0).fit(df, ["a", "b"], "y", "id")
    assert booster.model.trees[0].groups[0].left == [-1] and len({r.prediction[0] for r in booster.predict(df).collect()}) == 1


def test_losses_metrics_and_their_errors(spark, df):
    with pytest.raises(ValueError):
        loss_from_name("nothing")
    with pytest.raises(ValueError):
        metric_from_name("nothing")
    with pytest.raises(ValueError):
        SketchBoost("mse", sketch_method="nothing")
    with pytest.raises(Exception, match="negative"):
        GradientBoosting("msle", ntrees=1, verbose=0).fit(df, FEATURES, "y", "id")
    one = spark.createDataFrame([([1.0], [0.5]), ([0.0], [0.5])], "y array<double>, p array<double>")
    assert AUC().evaluate(one) == 0.5 and metric_from_name("precision").evaluate(one.withColumn("p", F.array(F.lit(0.1)))) == 0.0
    assert metric_from_name("auc").argmax([0.2, 0.9, 0.9]) == 1 and metric_from_name("rmse").argmax([0.2, 0.1, 0.1]) == 1
    booster = GradientBoosting("multiclass", ntrees=2, max_depth=2, verbose=0, metric="f1").fit(df, ["a", "b"], "c", "id", eval_sets=[df])
    assert len(booster.history) == 2 and all(sum(p) == pytest.approx(1, abs=1e-3) for p in predictions(booster, df).values())
    with pytest.raises(ValueError):
        frames.scan(df, "id", ["missing"])


def test_cross_validation_and_adaptive_stopping(df):
    booster = GradientBoosting("mse", ntrees=3, max_depth=2, lr=0.5, verbose=0)
    cv = CrossValidation(booster)
    assert cv.fit_predict(df, FEATURES, "y", "id", cv=3).count() == df.count() and cv.predict(df).count() == df.count()
    custom = CrossValidation(booster)
    assert {r.fold for r in custom.fit_predict(df.withColumn("f", (F.col("id") % 2).cast("int")), FEATURES, "y", "id", cv="f").select("fold").distinct().collect()} == {0, 1}
    adaptive = AdaptiveESCV(booster, range(1, 3), 50, 3)
    assert adaptive.fit_predict(df, FEATURES, "y", "id", cv=2).count() == df.count() and adaptive.predict(df).count() == df.count()


def test_sources_and_logging(spark, tmp_path):
    assert frames.make_regression(spark, 50, 3, 2).columns == ["row_id", "x0", "x1", "x2", "y0", "y1"]
    spark.range(5).selectExpr("id", "id * 1.5 as v").coalesce(1).write.csv(f"{tmp_path}/c", header=True)
    assert frames.read_csv(spark, f"{tmp_path}/c").count() == 5
    logger, seen = logging.getLogger("larkspur.test"), []
    logger.setLevel(logging.DEBUG)
    handler = logging.Handler()
    handler.emit = lambda record: seen.append(record.getMessage())
    handler.addFilter(DuplicateFilter())
    logger.addHandler(handler)
    stream = LoggerStream(logger)
    stream.write("one\none\ntwo")
    stream.flush()
    assert seen == ["one", "two"] and verbosity_to_loglevel(0) == logging.ERROR


def test_names_that_clash(spark, df):
    odd = {"a": "w", "b": "_x0", "c": "fold", "y": "pred", "id": "bins"}
    renamed = df.drop("w", "t", "u").toDF(*(odd.get(c, c) for c in df.drop("w", "t", "u").columns)).withColumnsRenamed({"_x0": "a.b c"}).withColumn("_x0", F.lit("text")).withColumn("iter", F.lit(7)).withColumn("_f0", F.lit(1))
    features = ["w", "a.b c", "fold"]
    plain = GradientBoosting("mse", ntrees=2, max_depth=2, lr=0.4, es=0, verbose=0).fit(df, FEATURES, "y", "id")
    booster = GradientBoosting("mse", ntrees=2, max_depth=2, lr=0.4, es=0, verbose=0).fit(renamed, features, "pred", "bins")
    want = predictions(plain, df)
    for scored in (booster.predict(renamed), booster.model.predict_sql(renamed), export.Compiled.convert(booster.model).predict(renamed), booster.predict_staged(renamed, [1])):
        got = {r["bins"]: r["prediction"] for r in scored.collect()}
        assert all(np.allclose(got[k], want[k]) for k in want)
    assert booster.predict_leaves(renamed, [0]).where("iter = 0").count() == df.count()
    cv = CrossValidation(booster)
    assert cv.fit_predict(renamed, features, "pred", "bins", cv=2).count() == df.count() and cv.predict(renamed).count() == df.count()


def test_wide_leaves_move_margins_by_batch(df, monkeypatch):
    options = {"ntrees": 2, "max_depth": 3, "es": 0, "verbose": 0, "gd_steps": 2, "target_splitter": "RandomGroups"}
    one = predictions(GradientBoosting("mse", **options).fit(df, FEATURES, ["y", "t", "u"], "id"), df)
    monkeypatch.setattr(booster_module, "SQL_VALUES", 1)
    other = predictions(GradientBoosting("mse", **options).fit(df, FEATURES, ["y", "t", "u"], "id"), df)
    assert all(np.allclose(one[k], other[k]) for k in one)


def test_ranks_and_samples_in_many_buckets(spark, df, monkeypatch):
    scored = df.select(F.array("t").alias("y"), F.array(F.col("a") + F.coalesce(F.nanvl("b", F.lit(0.0)), F.lit(0.0))).alias("p"))
    whole = AUC().evaluate(scored), {r.id: r.rank for r in ordered.ranked(df, "id").collect()}
    order = sorted(whole[1], key=whole[1].get)
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 40)
    assert AUC().evaluate(scored) == pytest.approx(whole[0]) and {r.id: r.rank for r in ordered.ranked(df, "id").collect()} == whole[1]
    for k in (0, 1, 17, 599, 600, 700):
        assert {r.id for r in sampling.exact_rows(df, "id", k).collect()} == set(order[:k])


def test_singular_vectors_of_gradients(df):
    g = df.select("id", F.array(*(F.sin(F.col("id") * (k + 1)) * (k + 1) for k in range(10))).alias("g"))
    matrix = np.array([r.g for r in g.orderBy("id").collect()])
    products = multioutput.gram(g, 10)
    np.testing.assert_allclose(products, matrix.T @ matrix, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(multioutput.gram(g.withColumn("g", F.slice("g", 1, 4)), 4), products[:4, :4], rtol=1e-9, atol=1e-9)
    exact = multioutput.SVDSketch(n_components=3).vectors(products, 42, 0)
    near = multioutput.SVDSketch(n_components=3, algorithm="randomized", n_iter=30).vectors(products, 42, 0)
    np.testing.assert_allclose(np.abs(exact.T @ near), np.eye(3), atol=1e-3)
    for bad in ({"sample": 0.5}, {"sample": 0}, {"algorithm": "other"}):
        with pytest.raises(ValueError):
            multioutput.SVDSketch(**bad)


def test_files_for_other_scorers(spark, df, tmp_path):
    booster = GradientBoosting("mse", ntrees=3, max_depth=3, lr=0.4, es=0, verbose=0).fit(df, FEATURES, ["y", "t"], "id")
    want = predictions(booster, df)
    export.to_onnx(booster.model, spark, f"{tmp_path}/m.onnx")
    with open(f"{tmp_path}/m.onnx", "rb") as file:
        scored = export.score_onnx(df, file.read(), FEATURES)
    got = {r.id: r.prediction for r in scored.collect()}
    assert all(np.allclose(got[k], want[k], atol=1e-4) for k in want)
    second = {r.id: r.prediction for r in export.score_onnx(df, export.onnx_bytes(booster.model, spark, [1]), FEATURES).collect()}
    assert all(np.allclose(second[k], want[k][1:], atol=1e-4) for k in want)
    export.Compiled.convert(booster.model, [1]).dump(f"{tmp_path}/m.json")
    compiled = {r.id: r.prediction for r in export.Compiled.load(f"{tmp_path}/m.json").predict(df).collect()}
    assert all(np.allclose(compiled[k], want[k][1:]) for k in want)


def test_adaptive_stopping_asks_for_a_metric(df):
    booster = GradientBoosting("msle", ntrees=3, max_depth=1, verbose=0)
    rows = df.withColumn("y", F.abs("y"))
    with pytest.raises(ValueError, match="metric"):
        AdaptiveESCV(booster).fit_predict(rows, FEATURES, "y", "id", cv=2)
    own = AdaptiveESCV(booster, range(1, 2), 50, [0, 2], metric=lambda y, p: F.abs(F.get(y, F.lit(0)) - F.get(p, F.lit(0))))
    assert own.fit_predict(rows, FEATURES, "y", "id", cv=2).count() == df.count()
    with pytest.raises(ValueError):
        AdaptiveESCV(GradientBoosting("mse", ntrees=2, max_depth=1, verbose=0), range(1, 2), 50, [0, 5]).fit_predict(rows, FEATURES, "y", "id", cv=2)
