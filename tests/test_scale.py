"""What must not depend on the number of groups, outputs, parts, classes or trees: results against plain numpy, and jobs counted."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import queries
from larkspur.functions import losses, metrics
from larkspur.operators import binning, multioutput, ordered
from larkspur.plans import adaptive, booster
from larkspur.plans.booster import GradientBoosting
from larkspur.plans.model import GroupTree, Model, Packed, Tree
from larkspur.sources import export

FEATURES = ["a", "b", "c"]
QUIET = {"es": 0, "verbose": 0}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 30, 400).astype(float), rng.normal(size=400).round(2), rng.integers(0, 4, 400).astype(float)], axis=1)
    x[rng.random(400) < 0.1, 1] = np.nan
    y = np.stack([x[:, 0] + rng.normal(size=400), np.nan_to_num(x[:, 1]) * 3, x[:, 2] ** 2, -x[:, 0] * x[:, 2]], axis=1)
    return x, y


@pytest.fixture(scope="module")
def df(spark, data):
    rows = [(k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(zip(*data, strict=True))]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, y0 double, y1 double, y2 double, y3 double").repartition(3).persist()


def random_tree(rng, depth, features):
    tree = GroupTree()
    for _ in range(depth):
        for node in tree.leaves:
            if rng.random() < 0.8:
                tree.grow(node, int(rng.integers(features)), 1, float(rng.normal()), bool(rng.random() < 0.5), 1.0)
    return tree


def walked(tree, row):
    node = 0
    while tree.left[node] >= 0:
        v = row[tree.feat[node]]
        right = not tree.nan_left[node] if np.isnan(v) else v > tree.threshold[node]
        node = tree.right[node] if right else tree.left[node]
    return tree.leaves.index(node)


def test_packed_ensembles_equal_walks_node_by_node():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[0], x[1] = np.inf, -np.inf
    trees = []
    for _ in range(40):
        groups = [random_tree(rng, int(rng.integers(0, 6)), 5) for _ in range(2)]
        outs = [[2, 0], [1]]
        trees.append(Tree(groups, outs, [rng.normal(size=(len(g.leaves), len(o))) for g, o in zip(groups, outs, strict=True)]))
    packed, columns = Packed(trees, 5), Packed.doubled(list(x.T))
    expected = np.zeros((300, 3))
    for tree in trees:
        for group, outs, values in zip(tree.groups, tree.outputs, tree.values, strict=True):
            expected[:, outs] += values[[walked(group, r) for r in x]]
    found = np.zeros((300, 3))
    packed.add(columns, found, 0, 40)
    np.testing.assert_array_equal(found, expected)
    leaves = {k: leaf for k, leaf in packed.walk(columns, 3, 7)}
    assert list(leaves) == list(range(6, 14)) and all(leaves[7] == [walked(trees[3].groups[1], r) for r in x])


def test_models_without_trees_features_or_rows(spark, df):
    empty = Model(FEATURES, losses.MSELoss(), [1.5])
    assert {tuple(r.prediction) for r in empty.predict(df).collect()} == {(1.5,)}
    bare = Model([], losses.MSELoss(), [0.5], [Tree([GroupTree()], [[0]], [np.array([[2.0]])])])
    assert {tuple(r.prediction) for r in bare.predict(df).collect()} == {(2.5,)}
    assert empty.predict(df.where("id < 0")).count() == 0


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("path", ["sql", "arrow"])
def test_one_tree_an_output_equals_separate_fits_with_as_many_jobs(spark, df, monkeypatch, path):
    if path == "arrow":
        monkeypatch.setitem(booster.group_histogram.__globals__, "SQL_NODES", 0)
    made = {}

    def fit(n):
        targets = [f"y{k}" for k in range(n)]
        made[n] = GradientBoosting("mse", ntrees=2, max_depth=3, lr=0.3, target_splitter="OneVsAll", **QUIET).fit(df, FEATURES, targets, "id", "c")

    counts = [jobs(spark, f"{path}{n}", lambda n=n: fit(n)) for n in (2, 4)]
    assert counts[0] == counts[1]
    found = {r.id: r.prediction for r in made[4].predict(df).collect()}
    for k in range(4):
        alone = GradientBoosting("mse", ntrees=2, max_depth=3, lr=0.3, **QUIET).fit(df, FEATURES, f"y{k}", "id", "c")
        np.testing.assert_allclose([found[r.id][k] for r in alone.predict(df).collect()], [r.prediction[0] for r in alone.predict(df).collect()], rtol=1e-9, atol=1e-9)


def test_groups_of_different_sizes_with_their_own_hessians(df):
    """Three labels in two random groups, with and without a sketch of the larger one."""
    label = [(F.col(f"y{k}") > 1).cast("double").alias(f"t{k}") for k in range(3)]
    rows = df.select("id", *FEATURES, *label)
    for sketch in (None, booster.SKETCHES["topk"](1, {})):
        fitted = GradientBoosting("bce", ntrees=3, max_depth=2, lr=0.5, target_splitter="RandomGroups", multioutput_sketch=sketch, gd_steps=2, **QUIET).fit(rows, FEATURES, ["t0", "t1", "t2"], "id")
        for tree in fitted.model.trees:
            assert sorted(k for outs in tree.outputs for k in outs) == [0, 1, 2] and sorted(v.shape[1] for v in tree.values) == [1, 2]
        scored = fitted.predict(rows).select("t0", "t1", "t2", "prediction").collect()
        right = np.mean([[(r.prediction[k] > 0.5) == (r[f"t{k}"] == 1) for k in range(3)] for r in scored])
        assert right > 0.8


@pytest.mark.parametrize("part_rows", [10, 10_000])
def test_running_sums_in_segments_over_parts(spark, part_rows):
    rng = np.random.default_rng(6)
    rows = [(k, None if k % 11 == 0 else str(int(rng.integers(3)) * int(k % 7 > 0)), float(rng.integers(20)), None if k % 5 == 0 else float(k)) for k in range(200)]
    frame = spark.createDataFrame(rows, "id bigint, s string, x double, `v alue` double").repartition(3)
    found = ordered.running_sums(frame, "x", {"upto": F.coalesce(F.col("`v alue`"), F.lit(0.0)), "n": F.lit(1).cast("bigint")}, ["id"], "s", part_rows)
    assert found.columns == ["id", "s", "x", "v alue", "upto", "n"]
    got = {r.id: (r.upto, r.n) for r in found.collect()}
    for s in {r[1] for r in rows}:
        total = 0.0
        for n, (k, _, _, v) in enumerate(sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0])), 1):
            total += v or 0.0
            assert got[k] == (total, n)


def test_ranks_by_parts(spark, monkeypatch):
    frame = spark.range(0, 500, numPartitions=3).withColumnRenamed("id", "key")
    whole = {r.key: r["rank"] for r in ordered.ranked(frame, "key").collect()}
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 40)
    assert {r.key: r["rank"] for r in ordered.ranked(frame, "key").collect()} == whole and sorted(whole.values()) == list(range(1, 501))


def test_softmax_of_a_hundred_classes(spark):
    rng = np.random.default_rng(8)
    p, y = rng.normal(scale=3, size=(50, 100)), rng.integers(0, 100, 50)
    frame = spark.createDataFrame([(k, [float(v) for v in a], [float(c)]) for k, (a, c) in enumerate(zip(p, y, strict=True))], "id bigint, p array<double>, y array<double>")
    g, h = losses.CrossEntropyLoss().grad_hess(F.col("y"), F.col("p"))
    found = {r.id: (r.g, r.h) for r in frame.select("id", g.alias("g"), h.alias("h")).collect()}
    e = np.exp(p - p.max(axis=1, keepdims=True))
    q = np.clip(e / e.sum(axis=1, keepdims=True), 1e-6, 1 - 1e-6)
    np.testing.assert_allclose([found[k][0] for k in range(50)], q - np.eye(100)[y], rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose([found[k][1] for k in range(50)], q * (1 - q) * 100 / 99, rtol=1e-12)


def test_borders_are_the_values_at_even_ranks(spark):
    rng = np.random.default_rng(10)
    for n in (257, 300, 1000, 4999):
        values = np.sort(rng.normal(size=n).round(3))
        found = binning.QuantileBinner(max_bin=200).fit(spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "id bigint, x double"), ["x"], "id").borders[0]
        if len(np.unique(values)) > 199:
            assert found.tolist() == sorted({values[r] for r in binning.quantile_places(199, n)})


@pytest.fixture(scope="module")
def many_events(spark, tmp_path_factory):
    """More rows than a booster's sample takes by default; the greatest value is in a row that the sample leaves out."""
    folder, rows, i = tmp_path_factory.mktemp("many"), 2_100_000, F.col("event_id")
    last = max((k for k in range(1000) if k % 7), key=lambda k: hashlib.md5(f"42:bins:{k}".encode()).hexdigest())
    value = F.when(i == last, 2e6).otherwise((i * 7919 % 1_000_003).cast("double"))
    spark.range(rows).toDF("event_id").select(i, value.alias("value"), F.lit("click").alias("event_type")).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["bin_apply", "bin_missing"])
def test_codes_come_from_borders_of_all_rows(spark, many_events, tmp_path, name):
    queries.QUERIES[name](spark, str(many_events)).write.parquet(f"{tmp_path}/ours")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{many_events}/events.parquet/*.parquet'")
    con.execute(f"CREATE TABLE theirs AS {queries.ORACLE_SQL[name]}")
    ours = f"SELECT id, code FROM '{tmp_path}/ours/*.parquet'"
    assert con.execute(f"SELECT count(*) FROM ({ours})").fetchone()[0] == con.execute("SELECT count(*) FROM theirs").fetchone()[0] == 2_100_000
    assert con.execute(f"SELECT count(*) FROM ({ours} EXCEPT ALL SELECT id, code FROM theirs)").fetchone()[0] == 0


@pytest.mark.parametrize("name", ["bin_apply", "bin_missing"])
def test_codes_of_repeated_identifiers(spark, tmp_path, name):
    spark.range(200).selectExpr("id % 50 AS event_id", "CAST(id * 37 % 101 AS DOUBLE) AS value", "'click' AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    ours = queries.QUERIES[name](spark, str(tmp_path)).select("id", "code").collect()
    assert sorted(map(tuple, ours)) == sorted(con.execute(f"SELECT id, code FROM ({queries.ORACLE_SQL[name]})").fetchall())


def test_metrics_of_many_outputs(spark):
    rng = np.random.default_rng(12)
    y, p, w = rng.integers(0, 2, size=(300, 4)).astype(float), rng.random((300, 4)).round(2), rng.integers(1, 4, 300).astype(float)
    y[rng.random(y.shape) < 0.3] = np.nan
    y[:, 3] = np.nan
    frame = spark.createDataFrame([(list(map(float, a)), list(map(float, b)), float(c)) for a, b, c in zip(y, p, w, strict=True)], "y array<double>, p array<double>, w double")
    areas = []
    for k in range(3):
        known = ~np.isnan(y[:, k])
        a, b, c = y[known, k], p[known, k], w[known]
        one, none = a == 1, a == 0
        wins = ((b[one][:, None] > b[none]) + 0.5 * (b[one][:, None] == b[none])) * c[one][:, None] * c[none]
        areas.append(wins.sum() / (c[one].sum() * c[none].sum()))
    assert metrics.MaskedAUC().evaluate(frame, w="w") == pytest.approx(np.mean([*areas, 0.5]))
    full = frame.select(F.transform("y", lambda v: F.when(F.isnan(v), 0.0).otherwise(v)).alias("y"), "p")
    limits = np.sort(p, axis=0)[int(np.ceil(0.7 * 299))]
    right = np.mean((p >= limits) == (np.nan_to_num(y) == 1), axis=0)
    assert metrics.Accuracy(q=0.7).evaluate(full) == pytest.approx(right.mean())


def test_nested_candidates_and_vector_sums(spark, df, data):
    binner = binning.QuantileBinner(max_bin=16).fit(df, FEATURES, "id")
    path = F.array(*(F.abs(F.col("y0") - i * 5) + F.col("c") * i for i in range(5)))
    rows = binner.transform(df).withColumn("path", path).withColumn("fold", (F.col("id") % 3).cast("int")).persist()
    fitted = adaptive.ClusterCandidates(range(1, 5), 20).fit(rows, "path", 5, binner)
    wide = rows.select("bins", *(F.get("path", F.lit(i)).alias(f"g{i}") for i in range(5)))
    for depth, tree in zip(range(1, 5), fitted.trees, strict=True):
        alone = adaptive.grow_clusters(wide, 3, 5, binner.borders, depth, 20)
        assert (alone.feat, alone.split, alone.left, alone.nan_left) == (tree.feat, tree.split, tree.left, tree.nan_left)
        np.testing.assert_allclose(alone.gain, tree.gain)
    sums = {(r.fold, r.cand, r.clust, r.iter): r.loss for r in adaptive.vector_sums(rows, [None, *fitted.trees]).collect()}
    expected = {}
    for r in rows.collect():
        codes = np.array([r.bins])
        for cand, clust in enumerate([0, *(int(t.ends_of_codes(codes)[0]) for t in fitted.trees)]):
            for i, v in enumerate(r.path):
                expected[r.fold, cand, clust, i] = expected.get((r.fold, cand, clust, i), 0.0) + v
    assert sums.keys() == expected.keys() and np.allclose([sums[k] for k in expected], list(expected.values()))


def ensemble(count, depth, seed=3, outputs=((2, 0), (1,)), columns=3):
    rng = np.random.default_rng(seed)
    trees = []
    for _ in range(count):
        groups = [random_tree(rng, depth, columns) for _ in outputs]
        trees.append(Tree(groups, [list(o) for o in outputs], [rng.normal(size=(len(g.leaves), len(o))) for g, o in zip(groups, outputs, strict=True)]))
    return Model(FEATURES[:columns], losses.loss_from_name("mse"), [0.5, -1.0, 2.0], trees)


def test_sql_of_an_ensemble_equals_batches_and_needs_no_python(df):
    model = ensemble(100, 6)
    scored = model.predict_sql(df.select("id", *FEATURES))
    assert "Arrow" not in scored._jdf.queryExecution().executedPlan().toString()
    want = {r.id: r.margin for r in model.margins(df.select("id", *FEATURES)).collect()}
    assert {r.id: r.prediction for r in scored.collect()} == want
    kept = export.Compiled.convert(model, [0, 2]).predict(df)
    assert {r.id: r.prediction for r in kept.collect()} == {k: [v[0], v[2]] for k, v in want.items()}


def test_the_operators_of_an_ensembles_sql_do_not_follow_its_trees():
    sizes = {len(re.findall(r"\w+\(|\[", re.sub(r"'[^']*'", "''", export.Compiled.convert(ensemble(n, 6)).sums))) for n in (2, 20, 200)}
    assert len(sizes) == 1


@pytest.mark.parametrize("model", [ensemble(0, 0), ensemble(2, 0), Model(FEATURES, losses.loss_from_name("mse"), [1.5], [])])
def test_sql_of_ensembles_without_trees_or_splits(df, model):
    assert {r.id: r.prediction for r in model.predict_sql(df).collect()} == {r.id: r.margin for r in model.margins(df).collect()}


def test_sql_of_awkward_values_and_names(spark):
    awkward = ["x", "a`b.c", "Node"]
    inf = float("inf")
    rows = [(0, None, 1, 0.5), (1, inf, None, -inf), (2, -inf, -3, float("nan")), (3, float("nan"), 2, inf), (4, 0.0, 0, 0.0)]
    frame = spark.createDataFrame(rows, "id int, x double, `a``b.c` int, Node float")
    model = ensemble(12, 5).on(awkward)
    assert {r.id: r.prediction for r in model.predict_sql(frame).collect()} == {r.id: r.margin for r in model.margins(frame).collect()}
    assert model.predict_sql(frame.limit(0)).collect() == []


def gradients(spark, rows=300, outputs=40, rank=6):
    rng = np.random.default_rng(8)
    g = rng.normal(size=(rows, rank)) * 2.0 ** -np.arange(rank) @ rng.normal(size=(rank, outputs)) + rng.normal(size=(rows, outputs)) * 1e-4
    return g, spark.createDataFrame([(k, r.tolist(), [1.0]) for k, r in enumerate(g)], "id bigint, g array<double>, h array<double>").repartition(5).persist()


def test_products_with_a_basis_need_no_products_of_pairs(spark):
    g, rows = gradients(spark)
    basis = np.random.default_rng(1).normal(size=(40, 7))
    np.testing.assert_allclose(multioutput.gram_times(rows, basis), g.T @ g @ basis, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(multioutput.gram_times(rows.limit(0), basis), 0)


def test_sketch_by_passes_equals_the_exact_decomposition(spark):
    _, rows = gradients(spark)
    context = {"n": 300, "seed": 42, "turn": 0, "row_id": "id"}

    def sketched(**options):
        found, k, m = multioutput.SVDSketch(n_components=3, **options).apply(rows, 40, 1, context)
        assert (k, m) == (3, 1)
        return np.array([r.g for r in found.orderBy("id").collect()])

    exact = sketched()
    np.testing.assert_allclose(sketched(algorithm="randomized", wide=0), exact, atol=1e-6)
    np.testing.assert_allclose(sketched(algorithm="randomized", wide=100), exact, atol=1e-6)
    assert sketched(algorithm="randomized", wide=0, sample=120).shape == exact.shape


@pytest.mark.parametrize("splitter", ["Single", "OneVsAll"])
def test_levels_do_not_read_the_rows_of_finished_leaves(spark, monkeypatch, splitter):
    rng = np.random.default_rng(5)
    rows = [(k, float(k % 64), float(rng.normal()), float(rng.normal()) if k % 64 >= 56 else 4.0, 0.0 if k % 64 < 56 else 20.0 + 4 * (k % 8)) for k in range(1280)]
    frame = spark.createDataFrame(rows, "id bigint, a double, b double, y0 double, y1 double").repartition(3).persist()
    kept, living = [], booster.living

    def counted(*args):
        kept.append(living(*args))
        kept[-1].alive = kept[-1].count()
        return kept[-1]

    def fitted():
        made = GradientBoosting("mse", ntrees=1, lr=0.3, max_depth=6, min_data_in_leaf=3, min_gain_to_split=2.0, target_splitter=splitter, **QUIET)
        return made.fit(frame, ["a", "b"], ["y0", "y1"], "id").model.to_json()

    monkeypatch.setattr(booster, "living", counted)
    found = fitted()
    assert kept and all(2 * k.alive <= 1280 for k in kept) and [k.alive for k in kept] == sorted((k.alive for k in kept), reverse=True)
    monkeypatch.setattr(booster, "living", lambda rows, trees, live: rows)
    whole = fitted()
    a, b = Model.from_json(found), Model.from_json(whole)
    for x, y in zip(a.trees[0].groups, b.trees[0].groups, strict=True):
        assert (x.feat, x.split, x.left) == (y.feat, y.split, y.left)
    for x, y in zip(a.trees[0].values, b.trees[0].values, strict=True):
        np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-9)
