"""Early stopping that differs between clusters of rows.

Loss paths (the loss of a held-out row after each iteration) are split by trees that look for groups of rows with
different best iterations; candidates are the trees of several depths and no clustering at all. The candidate whose
leave-one-fold-out choice of iterations errs least is taken, with the best iteration of each of its clusters.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.losses import SIGMOID_CLIP, clip, loss_from_name
from larkspur.operators.binning import Binner
from larkspur.operators.histograms import best_splits, histogram, with_siblings
from larkspur.operators.columns import free
from larkspur.operators.routing import node_of
from larkspur.plans.booster import leaf_column
from larkspur.plans.cv import CrossValidation, mean_of_arrays
from larkspur.plans.model import GroupTree, Model, predict_all
from larkspur.sources.frames import inner_names


def mse_row(y: Column, p: Column) -> Column:
    return F.aggregate(F.zip_with(y, p, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def bce_row(y: Column, p: Column) -> Column:
    def one(a: Column, b: Column) -> Column:
        b = clip(b, SIGMOID_CLIP, 1 - SIGMOID_CLIP)
        return -(a * F.ln(b) + (1 - a) * F.ln(1 - b))

    return F.aggregate(F.zip_with(y, p, one), F.lit(0.0), lambda s, v: s + v)


def crossentropy_row(y: Column, p: Column) -> Column:
    return -F.ln(F.get(p, F.get(y, F.lit(0)).cast("int")))


#: Row scorers by loss (fixed values).
SCORERS = {"mse": mse_row, "bce": bce_row, "crossentropy": crossentropy_row}


def cluster_gains(hist: DataFrame, k: int, min_leaf: int) -> DataFrame:
    """``node, feat, bin, nan_left, gain``: how much lower the least loss over iterations gets if a node's rows are
    stopped apart on both sides. A side needs ``min_leaf`` rows or more (equality is enough here)."""
    names = [f"g{i}" for i in range(k)]
    group = Window.partitionBy("node", "feat")
    order = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    columns = []
    for s in [*names, "n"]:
        columns += [F.sum(s).over(order).alias(s), F.sum(s).over(group).alias(f"{s}_t"), F.sum(F.when(F.col("bin") == 0, F.col(s)).otherwise(0)).over(group).alias(f"{s}_m")]
    run = hist.select("node", "feat", "bin", *columns)

    def least(values: list[Column]) -> Column:
        return F.least(*values) if len(values) > 1 else values[0]

    def side(missing_left: bool) -> Column:
        left = [F.col(s) if missing_left else F.col(s) - F.col(f"{s}_m") for s in names]
        right = [F.col(f"{s}_t") - v for s, v in zip(names, left, strict=True)]
        count = F.col("n") if missing_left else F.col("n") - F.col("n_m")
        gain = least([F.col(f"{s}_t") for s in names]) - least(left) - least(right)
        gain = F.when(F.least(count, F.col("n_t") - count) >= min_leaf, gain).otherwise(0.0)
        return F.struct(F.lit(missing_left).alias("nan_left"), gain.alias("gain"), count.alias("left_n"), F.col("n_t").alias("all_n"))

    both = F.array(side(True), side(False))
    return run.select("node", "feat", "bin", F.explode(both).alias("s")).select("node", "feat", "bin", "s.*")


def grow_clusters(rows: DataFrame, features: int, k: int, borders: list, depth: int, min_leaf: int) -> GroupTree:
    """A tree over loss paths: ``rows`` have codes and g0..g{k-1}, the loss at each iteration. After the root, rows are summed
    for the smaller child of each split alone."""
    tree, live, families, held = GroupTree(), [0], [], []
    base = rows.select("bins", *(f"g{i}" for i in range(k)))
    for _ in range(depth):
        counted = [small for small, _, _ in families] or live
        hist = histogram(base.withColumn("node", node_of(tree)).where(F.col("node").isin(counted)), list(range(features)), k, 0)
        hist = with_siblings(hist, held[-1], families, k, 0) if families else hist
        held.append(hist.persist())
        live, families = [], []
        for r in sorted(best_splits(cluster_gains(hist, k, min_leaf)).collect(), key=lambda r: r["node"]):
            if r["gain"] > 0:
                f, split = r["feat"], int(r["bin"])
                edge = borders[f][split - 1] if 0 < split <= len(borders[f]) else float("-inf" if split == 0 else "inf")
                left, right = tree.grow(int(r["node"]), f, split, float(edge), bool(r["nan_left"]), float(r["gain"]))
                live += [left, right]
                families.append((left, right, int(r["node"])) if 2 * r["left_n"] <= r["all_n"] else (right, left, int(r["node"])))
        if not live:
            break
    for hist in held:
        hist.unpersist()
    return tree


class ClusterCandidates:
    """One cluster tree for each depth. Growth is greedy, so that they are the first levels of the deepest, grown once."""

    def __init__(self, depth_range=range(1, 7), min_data_in_leaf: int = 100):
        self.depths, self.min_leaf = list(depth_range), min_data_in_leaf

    def fit(self, binned: DataFrame, path: str, iterations: int, binner: Binner) -> ClusterCandidates:
        """``binned`` has codes and the array column ``path`` of losses."""
        rows = binned.select("bins", *(F.get(path, F.lit(i)).alias(f"g{i}") for i in range(iterations))).persist()
        deepest = grow_clusters(rows, len(binner.features), iterations, binner.borders, max(self.depths, default=0), self.min_leaf)
        rows.unpersist()
        self.trees, self.features = [deepest.cut(d) for d in self.depths], binner.features
        return self

    def columns(self) -> list[Column]:
        """For each candidate, a row's cluster by its codes; the first candidate has one cluster."""
        return [F.lit(0), *(leaf_column(t) for t in self.trees)]

    def raw_columns(self) -> list[Column]:
        return [F.lit(0), *(t.leaf_column(self.features) for t in self.trees)]


def fold_sums(paths: DataFrame) -> DataFrame:
    """``fold, cand, clust, iter, loss``: summed losses from rows of ``fold, cand, clust, iter, loss``."""
    return paths.groupBy("fold", "cand", "clust", "iter").agg(F.sum("loss").alias("loss"))


def vector_sums(rows: DataFrame, candidates: list[GroupTree | None]) -> DataFrame:
    """The same from rows of ``fold, bins, path``, a loss for each iteration: a task adds up the paths of each fold and
    cluster as vectors, for all candidates (None: one cluster) at once, so that what is shuffled follows neither rows nor the
    iterations of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fold, codes, paths = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(n, -1), batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            for cand, tree in enumerate(candidates):
                clust = np.zeros(n, np.int64) if tree is None else tree.ends_of_codes(codes)
                pairs, place = np.unique(np.stack([fold, clust], axis=1), axis=0, return_inverse=True)
                order = np.argsort(place.ravel(), kind="stable")
                starts = np.searchsorted(place.ravel()[order], np.arange(len(pairs)))
                for pair, total in zip(pairs.tolist(), np.add.reduceat(paths[order], starts, axis=0), strict=True):
                    key = (pair[0], cand, pair[1])
                    held[key] = held[key] + total if key in held else total
        columns = [pa.array([k[i] for k in held], pa.int32()) for i in range(3)]
        yield pa.record_batch([*columns, pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], ["fold", "cand", "clust", "path"])

    parts = rows.select(F.col("fold").cast("int"), "bins", "path").mapInArrow(run, "fold int, cand int, clust int, path array<double>")
    return fold_sums(parts.select("fold", "cand", "clust", F.posexplode("path").alias("iter", "loss")))


def best_iterations(sums: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``cand, error``; ``fold, cand, clust, iter`` chosen without the fold; ``cand, clust, iter`` chosen on all).
    The tables have a row for each fold, candidate, cluster and iteration, however many rows were scored."""
    whole = sums.groupBy("cand", "clust", "iter").agg(F.sum("loss").alias("all"))
    folds = sums.select("fold").distinct()
    grid = whole.join(folds).join(sums, ["fold", "cand", "clust", "iter"], "left").na.fill(0.0, ["loss"])
    rest = grid.withColumn("rest", F.col("all") - F.col("loss"))
    chosen = rest.groupBy("fold", "cand", "clust").agg(F.min_by(F.struct("iter", "loss"), F.struct("rest", "iter")).alias("s"))
    chosen = chosen.select("fold", "cand", "clust", "s.iter", "s.loss")
    final = whole.groupBy("cand", "clust").agg(F.min_by("iter", F.struct("all", "iter")).alias("iter"))
    return chosen.groupBy("cand").agg(F.sum("loss").alias("error")), chosen.select("fold", "cand", "clust", "iter"), final


class AdaptiveESCV(CrossValidation):
    """Cross-validation whose predictions stop at the best iteration of each row's cluster.

    ``iters_to_fit``: the iterations whose losses cluster trees see, or how many of them, evenly spread. ``metric``: a
    function of two array columns (targets, predictions) that gives a row's loss; known losses have their own.
    """

    def __init__(self, booster, depth_range=range(1, 4), min_data_in_leaf: int = 100, iters_to_fit: int | list[int] = 10, metric: Callable[[Column, Column], Column] | None = None):
        base = copy.copy(booster)
        base.es = 0
        super().__init__(base)
        self.candidates, self.iters_to_fit, self.metric = ClusterCandidates(depth_range, min_data_in_leaf), iters_to_fit, metric

    def _scorer(self) -> Callable[[Column, Column], Column]:
        name = loss_from_name(self.booster.loss).name
        if self.metric is None and name not in SCORERS:
            raise ValueError(f"no row loss is known for {name}: give a metric")
        return self.metric or SCORERS[name]

    def _fitted(self, n: int) -> list[int]:
        if isinstance(self.iters_to_fit, int):
            return sorted({round(i * (n - 1) / max(self.iters_to_fit - 1, 1)) for i in range(self.iters_to_fit)})
        found = sorted(set(self.iters_to_fit))
        if not found or found[0] < 0 or found[-1] >= n:
            raise ValueError("iters_to_fit must be iterations of the models")
        return found

    def fit_predict(self, df, features, target, row_id, weight=None, cv=5, stratify=None) -> DataFrame:
        scorer, inner = self._scorer(), inner_names(features)
        rows, binner = self._fits(df, features, target, row_id, weight, cv, stratify)
        models = [b.model.on(inner) for b in self.boosters]
        stages = None
        for k, model in enumerate(models):
            part = model.stages(rows.where(F.col("fold") == k), "stages")
            stages = part if stages is None else stages.unionByName(part)
        path = F.transform("stages", lambda p: scorer(F.col("y"), models[0].loss.postprocess(p)) * F.col("w"))
        paths = binner.transform(stages.withColumn("path", path)).select("fold", "bins", "path").persist()
        fitted = self._fitted(len(models[0].trees))
        self.candidates.fit(paths.withColumn("path", F.array(*(F.get("path", F.lit(i)) for i in fitted))), "path", len(fitted), binner)
        self.candidates.features = list(features)
        sums = vector_sums(paths, [None, *self.candidates.trees]).persist()
        error, chosen, final = best_iterations(sums)
        self.best_candidate = error.orderBy("error", "cand").first()["cand"]
        mine = F.col("cand") == self.best_candidate
        self.best_trees = {r["clust"]: r["iter"] for r in final.where(mine).collect()}
        picked = {(r["fold"], r["clust"]): r["iter"] for r in chosen.where(mine).collect()}  # a few for each fold
        for held in (sums, paths, rows):
            held.unpersist()
        return self._out_of_fold(binner.transform(rows), models, picked)

    def _out_of_fold(self, rows: DataFrame, models: list[Model], picked: dict[tuple[int, int], int]) -> DataFrame:
        """``id, fold, y, clust, iter, prediction``: rows scored by the model that has not seen them, up to their cluster's
        iteration and no further."""
        out = None
        for k, model in enumerate(models):
            own = {clust: last for (fold, clust), last in sorted(picked.items()) if fold == k}
            if not own:
                continue
            steps = sorted(set(own.values()))
            found = model.stages(rows.where(F.col("fold") == k).withColumn("clust", self.candidates.columns()[self.best_candidate]), "stages", steps)
            last = F.element_at(F.create_map(*(F.lit(x) for pair in own.items() for x in pair)), F.col("clust"))
            place = F.element_at(F.create_map(*(F.lit(x) for i, step in enumerate(steps) for x in (step, i))), F.col("iter"))
            part = found.withColumn("iter", last).select("id", "fold", "y", "clust", "iter", model.loss.postprocess(F.get("stages", place)).alias("prediction"))
            out = part if out is None else out.unionByName(part)
        return out

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Each row's mean over folds at the iteration of its cluster; all folds and iterations are scored in one pass."""
        models, held = [b.model for b in self.boosters], free(df, "_stages")
        stages = sorted(set(self.best_trees.values()))
        scored = predict_all(models, df, held, stages)
        place = F.create_map(*(F.lit(x) for clust, last in sorted(self.best_trees.items()) for x in (clust, stages.index(last))))
        stage = F.get(held, F.element_at(place, self.candidates.raw_columns()[self.best_candidate]))
        return scored.withColumn(name, mean_of_arrays([models[0].loss.postprocess(F.get(stage, F.lit(k))) for k in range(len(models))])).drop(held)
