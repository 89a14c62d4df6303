"""Gradient boosting over DataFrames.

A fit bins the features once and keeps one frame: identifier, codes, targets, weight and margins. An iteration adds
gradients as columns, finds a tree level by level (one grouped aggregate a level, of which only the best split of each
node comes back), sums leaf values (one aggregate), and adds them to the margins by a projection. Rows reach nodes by
generated conditions, so growing a tree shuffles histograms and nothing else. The frame is written to the checkpoint
folder every ``checkpoint_every`` iterations, which cuts the lineage.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.losses import Loss, loss_from_name
from larkspur.functions.metrics import Metric, metric_from_name
from larkspur.operators import multioutput, summaries  # noqa: F401  the latter adds its binner to those with names
from larkspur.operators.binning import binner_from_name
from larkspur.operators.histograms import SQL_NODES, STRUCTURE, best_splits, best_splits_dense, dense, gains, group_histogram, histogram, running, with_siblings
from larkspur.operators.routing import leaf_values, node_of
from larkspur.operators.sampling import ColumnSampler, RowSampler
from larkspur.plans.callbacks import Callback, CallbackPipeline, EarlyStopping, EvalHistory
from larkspur.plans.model import GroupTree, Model, Tree
from larkspur.sources.frames import inner_names, scan


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the session's checkpoint folder; only in local mode (tests) is a temporary one made where none is set."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="larkspur-"))
    return df.checkpoint(eager=True)


def values_column(group: GroupTree, values: np.ndarray, bins: str = "bins") -> Column:
    """An array of output values for a row, by the leaf that its codes lead to."""
    number = {node: k for k, node in enumerate(group.leaves)}
    cases = {node: F.array(*(F.lit(float(v)) for v in values[k])) for node, k in number.items()}

    def at(node: int) -> Column:
        if group.left[node] < 0:
            return cases[node]
        code = F.get(bins, F.lit(group.feat[node]))
        right = code > group.split[node] if group.nan_left[node] else (code > group.split[node]) | (code == 0)
        return F.when(right, at(group.right[node])).otherwise(at(group.left[node]))

    return at(0)


def moved(frame: DataFrame, tree: Tree) -> DataFrame:
    """The frame (with ``bins`` and ``pred``) with a tree's values added to its margins."""
    if sum(v.size for v in tree.values) > SQL_VALUES:
        return _moved_by_batch(frame, tree)
    parts: dict[int, Column] = {}
    for group, outs, values in zip(tree.groups, tree.outputs, tree.values, strict=True):
        column = values_column(group, values)
        parts |= {out: F.get(column, F.lit(j)) for j, out in enumerate(outs)}
    if len(tree.groups) == 1 and tree.outputs[0] == sorted(tree.outputs[0]):
        added = values_column(tree.groups[0], tree.values[0])
    else:
        added = F.array(*(parts[k] for k in range(len(parts))))
    return frame.withColumn("pred", F.zip_with("pred", added, lambda a, b: a + b))


def _moved_by_batch(frame: DataFrame, tree: Tree) -> DataFrame:
    bins_at, pred_at = frame.columns.index("bins"), frame.columns.index("pred")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, columns = batch.num_rows, list(batch.columns)
            if n:
                codes = batch.column(bins_at).flatten().to_numpy().reshape(n, -1)
                out = batch.column(pred_at).flatten().to_numpy().reshape(n, -1).copy()
                for group, outs, values in zip(tree.groups, tree.outputs, tree.values, strict=True):
                    out[:, outs] += values[group.ends_of_codes(codes)]
                columns[pred_at] = pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return frame.mapInArrow(run, frame.schema)


def leaf_column(group: GroupTree, bins: str = "bins") -> Column:
    node, number = node_of(group, bins), {n: k for k, n in enumerate(group.leaves)}
    return F.element_at(F.create_map(*(F.lit(x) for kv in number.items() for x in kv)), node)


#: Cells (nodes x features x bins x sums) of a level's histogram up to which the driver searches it; a larger one is
#: searched where it lies, and only the best split of each node is sent.
DRIVER_CELLS = 2_000_000
#: Leaf values (over the outputs) of a tree up to which margins are moved by generated conditions; beyond, on Arrow batches.
SQL_VALUES = 512


class _Level:
    """Histograms of the nodes of a level. Rows are summed for the smaller child of each split alone; its sibling's
    histogram is the parent's less that. Small histograms are kept as arrays on the driver, larger ones as frames."""

    def __init__(self, features: int, widest: int, outputs: int, hessians: int, lam: float, min_leaf: int):
        self.shape, self.sums, self.limits = (features, widest), (outputs, hessians), (lam, min_leaf)
        self.arrays: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.frame: DataFrame | None = None
        self.older: list[DataFrame] = []

    def small(self, nodes: int) -> bool:
        return nodes * self.shape[0] * self.shape[1] * sum(self.sums) <= DRIVER_CELLS

    def counted(self, live: list[int], families: list[tuple[int, int, int]]) -> list[int]:
        """The nodes whose rows must be summed: of a family (smaller child, larger child, parent) the first only, if the
        parent's histogram is at hand in the same form."""
        kept = bool(self.arrays) if self.small(len(live)) else self.frame is not None
        self.families = families if kept else []
        return [small for small, _, _ in self.families] or live

    def search(self, hist: DataFrame, live: list[int], counted: list[int]) -> list[tuple]:
        """node, feature position, bin, missing left, gain, left and all rows, left sums and all sums, of each live node's
        best split."""
        k, m = self.sums
        if self.small(len(live)):
            g, h, n = dense(hist.toArrow(), counted, *self.shape, k, m)
            arrays = {node: (g[:, i], h[:, i], n[i]) for i, node in enumerate(counted)}
            for small, large, parent in self.families:
                rest = [a - b for a, b in zip(self.arrays[parent], arrays[small], strict=True)]
                arrays[large] = tuple(np.where(rest[2] > 0, x, 0.0) for x in rest)  # no rounding where no rows are
            self.arrays, self.frame = arrays, None
            cells = [np.stack([arrays[node][i] for node in live], axis=1) for i in range(2)]
            best = best_splits_dense(*cells, np.stack([arrays[node][2] for node in live]), *self.limits)
            return [(node, *b[:4], b[6], float(arrays[node][2][0].sum()), b[4], b[5], arrays[node][0][:, 0].sum(axis=1), arrays[node][1][:, 0].sum(axis=1)) for node, b in zip(live, best, strict=True)]
        if self.families:
            hist = with_siblings(hist, self.frame, self.families, k, m)
        self.older += [self.frame] if self.frame is not None else []
        self.frame, self.arrays = hist.persist(), {}
        best = best_splits(gains(running(self.frame, k, m), k, m, *self.limits, sums=True)).collect()
        return [(int(r["node"]), r["feat"], int(r["bin"]), bool(r["nan_left"]), float(r["gain"]), r["left_n"], r["all_n"], *(np.array(r[c]) for c in ("left_g", "left_h", "all_g", "all_h"))) for r in sorted(best, key=lambda r: r["node"])]

    def done(self) -> None:
        for held in [*self.older, *([self.frame] if self.frame is not None else [])]:
            held.unpersist()


def living(rows: DataFrame, trees: list[GroupTree], live: list[int]) -> DataFrame:
    """The rows that are in a node of ``live`` in one of the structures at least."""
    inside = [node_of(t).isin([key % STRUCTURE for key in live if key // STRUCTURE == s]) for s, t in enumerate(trees)]
    return rows.where(reduce(lambda a, b: a | b, inside))


def grow(rows: DataFrame, features: list[int], columns: list[tuple[list[int], list[int]]], borders: list[np.ndarray], max_depth: int, lam: float, min_leaf: int, min_gain: float, path: str | None = None) -> tuple[list[GroupTree], list[dict[int, tuple]]]:
    """The structures of a turn's trees from ``rows`` (codes, arrays g and h), all of them together depth by depth until
    nothing splits: a level is one grouped sum over (structure, node, feature, code), however many structures there are.

    ``columns``: the places in g and h that each structure sees. Also the sums of gradients and hessians in each node of each
    structure: a right child's are its parent's less the left child's.

    Once at most half of the rows that a level reads are in nodes that may still split, these are kept apart, and later
    levels read them alone: the rows of finished leaves are not read again.
    """
    trees, sums = [GroupTree() for _ in columns], [{} for _ in columns]
    live, families = [STRUCTURE * s for s in range(len(columns))], []
    k, m = (max(len(c[i]) for c in columns) for i in (0, 1))
    level = _Level(len(features), max((len(borders[f]) for f in features), default=0) + 2, k, m, lam, min_leaf)
    if len(columns) == 1:
        ((g, h),) = columns
        base = rows.select("bins", *(F.get("g", F.lit(at)).alias(f"g{i}") for i, at in enumerate(g)), *(F.get("h", F.lit(at)).alias(f"h{i}") for i, at in enumerate(h)))
    apart, reading = [], None
    for depth in range(max_depth):
        counted = level.counted(live, families)
        if len(columns) == 1:
            placed = base.withColumn("node", node_of(trees[0]))
            if len(counted) < len(trees[0].leaves):
                placed = placed.where(F.col("node").isin(counted))
            hist = histogram(placed, features, k, m, path=path)
        else:
            hist = group_histogram(rows, features, trees, counted, columns, path=path)
        found, live, families, alive = level.search(hist, live, counted), [], [], 0
        reading = max(b[6] for b in found) if reading is None else reading
        for key, position, split, nan_left, gain, left_n, all_n, left_g, left_h, all_g, all_h in found:
            s, node = divmod(key, STRUCTURE)
            sums[s].setdefault(node, (all_g, all_h))
            if gain > min_gain:
                f = features[position]
                edge = borders[f][split - 1] if 0 < split <= len(borders[f]) else (-np.inf if split == 0 else np.inf)
                left, right = trees[s].grow(node, f, split, float(edge), nan_left, gain)
                sums[s][left], sums[s][right] = (left_g, left_h), (sums[s][node][0] - left_g, sums[s][node][1] - left_h)
                pair = (key - node + left, key - node + right)
                live += pair
                alive += all_n
                families.append((*pair, key) if 2 * left_n <= all_n else (*pair[::-1], key))
        if not live:
            break
        if 2 * alive <= reading and depth + 2 < max_depth and (len(trees) == 1 or sum(len(t.feat) for t in trees) <= SQL_NODES):
            apart.append(living(base if len(trees) == 1 else rows, trees, live).persist())
            base = rows = apart[-1]
            reading = alive
    for held in apart:
        held.unpersist()
    level.done()
    return trees, sums


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a, dtype=float), where=b != 0)


class GradientBoosting:
    """Gradient boosted trees with vector leaves. Parameters have the usual names and defaults; ``loss`` and
    ``metric`` are names or objects, samplers, splitters, sketches and binners names, numbers or objects."""

    def __init__(self, loss: str | Loss, metric: str | Metric | None = None, ntrees: int = 100, lr: float = 0.05, min_gain_to_split: float = 0, lambda_l2: float = 1,
                 gd_steps: int = 1, max_depth: int = 6, min_data_in_leaf: int = 10, colsample=1.0, subsample=1.0, target_splitter="Single", multioutput_sketch=None,
                 use_hess: bool = True, quantization="Quantile", quant_sample: int = 2_000_000, max_bin: int = 256, min_data_in_bin: int = 3, es: int = 100, seed: int = 42,
                 verbose: int = 10, callbacks: list[Callback] | None = None, debug: bool = False, checkpoint_every: int = 10):
        if min_gain_to_split < 0:
            raise ValueError("min_gain_to_split must not be negative")
        self.params = {k: v for k, v in locals().items() if k not in ("self", "callbacks")}
        for k, v in self.params.items():
            setattr(self, k, v)
        self.callbacks = list(callbacks or [])

    # parts

    def _parts(self) -> tuple[Loss, Metric]:
        loss = loss_from_name(self.loss)
        metric = metric_from_name(self.metric or loss.metric, loss.multiclass)
        return loss, metric

    def _groups(self):
        if isinstance(self.target_splitter, str):
            if self.target_splitter not in multioutput.SPLITTERS:
                raise ValueError(f"unknown splitter: {self.target_splitter}")
            return multioutput.SPLITTERS[self.target_splitter]()
        return self.target_splitter

    def fit(self, df: DataFrame, features: list[str], target, row_id: str, weight: str | None = None, eval_sets: list[DataFrame] | None = None) -> GradientBoosting:
        """Trains on ``df``. ``target``: a column (of numbers or arrays) or several; evaluation sets have the same."""
        loss, _ = self._parts()
        names = inner_names(features)
        train = scan(df, row_id, features, target, weight, names)
        binner = binner_from_name(self.quantization, sample=self.quant_sample, max_bin=self.max_bin, min_data_in_bin=self.min_data_in_bin, seed=self.seed)
        binner.fit(train, names, "id")
        sets = [scan(e, row_id, features, target, weight, names) for e in eval_sets or []]
        self.fit_binned(train, sets, binner, features, weight is not None)
        return self

    def fit_binned(self, train: DataFrame, sets: list[DataFrame], binner, features: list[str], weighted: bool) -> GradientBoosting:
        """Trains on scanned frames with a fitted binner."""
        loss, metric = self._parts()
        names = ["id", "bins", "y", "w"]

        def ready(df: DataFrame) -> DataFrame:
            return binner.transform(df).withColumn("y", loss.preprocess(F.col("y"))).select(names)

        frame = ready(train).persist()
        n, targets = frame.agg(F.count("*"), F.max(F.size("y"))).first()
        outputs = loss.outputs(frame, "y", targets or 1)
        base = loss.base_score(frame, "y", outputs)
        start = F.array(*(F.lit(float(b)) for b in base))
        frame, valid = frame.withColumn("pred", start), [ready(s).withColumn("pred", start).persist() for s in sets]
        self.model = Model(features, loss, base)
        history, stopping = EvalHistory(self.verbose), EarlyStopping(self.es)
        samplers = [s for s in (self.subsample, self.colsample, self.target_splitter, self.multioutput_sketch) if isinstance(s, Callback)]
        pipeline = CallbackPipeline(*samplers, *self.callbacks, history, stopping)
        state = {"model": self.model, "metric": metric, "train": frame, "valid": valid, "weighted": weighted, "borders": binner.borders, "builder": self, "num_iter": 0, "n": n, "leaves": [], "iter_score": None}
        pipeline.before_train(state)
        splitter, older = self._groups(), []
        for turn in range(self.ntrees):
            state["num_iter"] = turn
            pipeline.before_iteration(state)
            tree, leaves = self._iteration(state, splitter, outputs, turn)
            state["leaves"] = [*state["leaves"][-8:], leaves]
            # a frame is cached by the jobs of the turn after it; only then may the one that it came from go
            for held in older:
                held.unpersist()
            older = [state["train"], *state["valid"]] if turn else []
            state["train"] = self._moved(state["train"], tree, turn)
            state["valid"] = [self._moved(v, tree, turn) for v in state["valid"]]
            self.model.trees.append(tree)
            if pipeline.after_iteration(state):
                break
        pipeline.after_train(state)
        for held in (state["train"], frame, *older, *state["valid"], *valid):
            held.unpersist()
        self.history, self.best_round = history.history, stopping.best_round
        return self

    def _moved(self, frame: DataFrame, tree: Tree, turn: int) -> DataFrame:
        """The frame with a tree's values added to its margins."""
        ahead = moved(frame, tree)
        if (turn + 1) % self.checkpoint_every == 0:
            return checkpointed(ahead).persist()
        return ahead.persist()

    def _iteration(self, state: dict, splitter, outputs: int, turn: int) -> tuple[Tree, list[Column]]:
        loss, rows = self.model.loss, state["train"]
        g, h = loss.grad_hess(F.col("y"), F.col("pred"))
        rows = rows.withColumn("g", g).withColumn("h", h)
        one = isinstance(h, Column) and loss.name in ("mse", "msle")
        hessians = 1 if one or outputs == 1 else int(rows.select(F.size("h")).first()[0])
        sampler = self.subsample
        if isinstance(sampler, (int, float)):
            rows = RowSampler(sampler).mark(rows, "id", state["n"], self.seed, turn)
        elif hasattr(sampler, "probabilities"):
            rows = sampler.mark(rows, "id", self.seed, turn, outputs, hessians)
        else:
            rows = sampler.mark(rows, "id", state["n"], self.seed, turn)
        whole = isinstance(sampler, (int, float)) and sampler == 1
        inside = rows if whole else rows.where("_in")
        inside = inside.select("id", "bins", "w", *(F.transform(c, lambda v: v * F.col("w")).alias(c) for c in ("g", "h")))
        held = not whole or loss.multiclass  # rows that a level should not find, or gradients that it should not compute, again
        inside = inside.persist() if held else inside
        choice = self.colsample if hasattr(self.colsample, "choose") else ColumnSampler(self.colsample)
        features = choice.choose(len(self.model.features), self.seed, turn, self.model)
        sets = splitter(outputs, self.seed, turn)
        exact = [(list(outs), list(outs) if hessians > 1 else [0]) for outs in sets]
        structure, columns = self._structure(inside, exact, state, turn)
        groups, sums = grow(structure, features, columns, state["borders"], self.max_depth, self.lambda_l2, self.min_data_in_leaf, self.min_gain_to_split)
        if structure is inside:  # the search has summed what leaf values need
            values = [np.array([-self.lr * _over(g[: len(outs)], h[: len(outs) if hessians > 1 else 1] + self.lambda_l2) for g, h in (s[leaf] for leaf in t.leaves)]) for t, s, outs in zip(groups, sums, sets, strict=True)]
        else:
            values = self._values(inside, groups, exact)
        tree = Tree(groups, sets, values)
        for _ in range(self.gd_steps - 1):
            tree.values = self._refined(rows if whole else rows.where("_in"), tree)
        if held:
            inside.unpersist()
        return tree, [leaf_column(t) for t in groups]

    def _structure(self, rows: DataFrame, exact: list[tuple[list[int], list[int]]], state: dict, turn: int) -> tuple[DataFrame, list[tuple[list[int], list[int]]]]:
        """What the search of the structures sees: ``rows`` themselves, or arrays g and h of other columns (sketches, weights
        instead of hessians), and the places of each structure's columns in them."""
        if all(len(g) == 1 or (self.use_hess and self.multioutput_sketch is None) for g, _ in exact):
            return rows, exact
        whole, columns, made = rows.withColumnsRenamed({"g": "_g", "h": "_h"}), [], {"g": [], "h": []}
        for s, (g, h) in enumerate(exact):
            part, k, m = whole.withColumns({"g": F.array(*(F.get("_g", F.lit(c)) for c in g)), "h": F.array(*(F.get("_h", F.lit(c)) for c in h))}), len(g), len(h)
            if k > 1:
                if not self.use_hess:
                    part, m = part.withColumn("h", F.array("w")), 1
                if self.multioutput_sketch is not None:
                    context = {"row_id": "id", "n": state["n"], "seed": self.seed, "turn": turn, "lam": self.lambda_l2, "leaves": state["leaves"]}
                    part, k, m = self.multioutput_sketch.apply(part, k, m, context)
            columns.append(tuple([len(made[c]) + i for i in range(n)] for c, n in (("g", k), ("h", m))))
            for c, n in (("g", k), ("h", m)):
                made[c] += [F.get(f"_{c}{s}", F.lit(i)) for i in range(n)]
            whole = part.withColumnsRenamed({"g": f"_g{s}", "h": f"_h{s}"})
        return whole.select("bins", *(F.array(*cells).alias(c) for c, cells in made.items())), columns

    def _values(self, rows: DataFrame, groups: list[GroupTree], columns: list[tuple[list[int], list[int]]]) -> list[np.ndarray]:
        """Leaf values of all structures from one grouped sum."""
        parts = []
        for s, (tree, (g, h)) in enumerate(zip(groups, columns, strict=True)):
            cells = [F.array(*(F.get(c, F.lit(at)) for at in places)).alias(c) for c, places in (("g", g), ("h", h))]
            parts.append(F.struct((leaf_column(tree).cast("bigint") + STRUCTURE * s).alias("leaf"), *cells))
        k, m = (max(len(c[i]) for c in columns) for i in (0, 1))
        out = [np.zeros((len(tree.leaves), len(g))) for tree, (g, _) in zip(groups, columns, strict=True)]
        long = rows.select(F.explode(F.array(*parts)).alias("part")).select("part.*")
        for r in leaf_values(long, k, m, self.lr, self.lambda_l2).collect():
            s, leaf = divmod(r["leaf"], STRUCTURE)
            out[s][leaf] = r["value"][: out[s].shape[1]]
        return out

    def _refined(self, rows: DataFrame, tree: Tree) -> list[np.ndarray]:
        """A further Newton step of the leaf values at the margins that they lead to, without sample weights."""
        rows = moved(rows.select(*(c for c in rows.columns if c not in ("g", "h"))), tree)
        g, h = self.model.loss.grad_hess(F.col("y"), F.col("pred"))
        rows = rows.withColumn("g", g).withColumn("h", h)
        hessians = int(rows.select(F.size("h")).first()[0])
        columns = [(list(outs), list(outs) if hessians > 1 else [0]) for outs in tree.outputs]
        return [old + new for old, new in zip(tree.values, self._values(rows, tree.groups, columns), strict=True)]

    # the fitted model

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return self.model.predict(df, name)

    def predict_staged(self, df: DataFrame, iterations: list[int] | None = None) -> DataFrame:
        return self.model.predict_staged(df, iterations)

    def predict_leaves(self, df: DataFrame, iterations: list[int] | None = None) -> DataFrame:
        return self.model.predict_leaves(df, iterations)

    def feature_importance(self, kind: str = "split") -> np.ndarray:
        return self.model.feature_importance(kind)

    def dump(self, path: str) -> None:
        self.model.dump(path)

    def load(self, path: str) -> GradientBoosting:
        self.model = Model.load(path, self.loss)
        return self


#: Sketches by name (fixed values), each from the number of outputs and further parameters.
SKETCHES = {
    "filter": lambda k, p: multioutput.FilterSketch(k, **p), "svd": lambda k, p: multioutput.SVDSketch(n_components=k, **p),
    "topk": lambda k, p: multioutput.TopOutputsSketch(k, **p), "rand": lambda k, p: multioutput.RandomSamplingSketch(k, **p),
    "proj": lambda k, p: multioutput.RandomProjectionSketch(k, **p), None: lambda k, p: None,
}


class SketchBoost(GradientBoosting):
    """Boosting of many outputs with one tree for all, whose structure is found on a sketch of the gradients."""

    def __init__(self, loss: str | Loss, sketch_outputs: int = 1, sketch_method: str | None = "proj", sketch_params: dict | None = None, use_hess: bool = False, **params):
        if sketch_method not in SKETCHES:
            raise ValueError(f"unknown sketch: {sketch_method}")
        if {"target_splitter", "multioutput_sketch"} & set(params):
            raise ValueError("the splitter and the sketch are set by this class")
        super().__init__(loss, use_hess=use_hess, target_splitter="Single", multioutput_sketch=SKETCHES[sketch_method](sketch_outputs, sketch_params or {}), **params)
