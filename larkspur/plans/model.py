"""Trees and ensembles: scoring, staged predictions, leaf indices, importance, tables and files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.losses import Loss, loss_from_name
from larkspur.operators.binning import missing_to_null
from larkspur.operators.columns import constants, free, map_batches, named


@dataclass
class GroupTree:
    """The structure for one group of outputs. Node 0 is the root; ``left`` is -1 for leaves."""

    feat: list[int] = field(default_factory=lambda: [-1])
    split: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    nan_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def grow(self, node: int, feat: int, split: int, threshold: float, nan_left: bool, gain: float) -> tuple[int, int]:
        """Splits a leaf; its children get the next two numbers, so that numbers are in level order."""
        self.feat[node], self.split[node], self.threshold[node], self.nan_left[node], self.gain[node] = feat, split, threshold, nan_left, gain
        self.left[node], self.right[node] = len(self.feat), len(self.feat) + 1
        for _ in range(2):
            for values, new in zip((self.feat, self.split, self.threshold, self.nan_left, self.left, self.right, self.gain), (-1, 0, 0.0, True, -1, -1, 0.0), strict=True):
                values.append(new)
        return self.left[node], self.right[node]

    @property
    def leaves(self) -> list[int]:
        """Nodes that are leaves, in level order: their place is their leaf number."""
        return [k for k, x in enumerate(self.left) if x < 0]

    def cut(self, depth: int) -> GroupTree:
        """The tree as it was when it had ``depth`` levels of splits: as numbers are in level order, its nodes come first."""
        level = [0] * len(self.feat)
        for node, left in enumerate(self.left):
            if left >= 0:
                level[left] = level[left + 1] = level[node] + 1
        keep = sum(x <= depth for x in level)
        made = GroupTree(*(list(c[:keep]) for c in (self.feat, self.split, self.threshold, self.nan_left, self.left, self.right, self.gain)))
        for node in range(keep):
            if level[node] == depth:
                made.feat[node], made.split[node], made.threshold[node], made.nan_left[node], made.left[node], made.right[node], made.gain[node] = -1, 0, 0.0, True, -1, -1, 0.0
        return made

    def nodes_of_codes(self, codes: np.ndarray) -> np.ndarray:
        """The leaf node where each row of a matrix of codes (0: missing) ends."""
        feat, split, nan_left = np.array(self.feat), np.array(self.split), np.array(self.nan_left)
        left, right = np.array(self.left), np.array(self.right)
        node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while len(rows):
            now = node[rows]
            inner = left[now] >= 0
            rows, now = rows[inner], now[inner]
            code = codes[rows, feat[now]]
            node[rows] = np.where((code > split[now]) | ((code == 0) & ~nan_left[now]), right[now], left[now])
        return node

    def ends_of_codes(self, codes: np.ndarray) -> np.ndarray:
        """The leaf number of each row."""
        number = np.full(len(self.feat), -1)
        number[self.leaves] = np.arange(len(self.leaves))
        return number[self.nodes_of_codes(codes)]

    def leaf_column(self, features: list[str]) -> Column:
        """The leaf number as one nested condition over raw features, for whole-stage code."""
        number = {node: k for k, node in enumerate(self.leaves)}

        def at(node: int) -> Column:
            if self.left[node] < 0:
                return F.lit(number[node])
            x = missing_to_null(named(features[self.feat[node]]))
            right = F.when(x.isNull(), F.lit(not self.nan_left[node])).otherwise(x > F.lit(float(self.threshold[node])))
            return F.when(right, at(self.right[node])).otherwise(at(self.left[node]))

        return at(0)


@dataclass
class Tree:
    """``groups`` of outputs, each with its structure; ``values[group]`` has a row of output values for each leaf."""

    groups: list[GroupTree]
    outputs: list[list[int]]
    values: list[np.ndarray]


class Packed:
    """An ensemble as flat arrays for scoring: nodes of all structures one after the other, leaves leading to themselves.

    ``low[node] + (value > threshold[node])`` is a node's child, as children have neighbouring numbers. Missing values are
    read from one of two copies of a feature, where they are infinitely low (they go left) or high, so that they need no
    case of their own. Structures of a block are walked together for a block of rows, a level at a time.
    """

    #: Rows and structures of a block: its arrays stay in a core's cache.
    ROWS, TREES = 2048, 32

    def __init__(self, trees: list[Tree], features: int):
        self.features = features
        groups = [g for t in trees for g in t.groups]
        self.first = np.cumsum([0, *(len(t.groups) for t in trees)])  # of each tree's structures
        sizes = np.array([len(g.feat) for g in groups], np.int64)
        self.roots = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        self.threshold, self.low, self.copy = np.full(n, np.inf), np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
        self.leaf, self.depths = np.zeros(n, np.int32), []
        for root, g in zip(self.roots, groups, strict=True):
            left, own = np.array(g.left), slice(root, root + len(g.left))
            inner = left >= 0
            if (np.array(g.right)[inner] != left[inner] + 1).any():
                raise ValueError("a node's children must have neighbouring numbers")
            self.threshold[own][inner] = np.array(g.threshold, float)[inner]
            self.low[own][inner] = root + left[inner]
            self.copy[own][inner] = (np.array(g.feat) + np.where(g.nan_left, 0, features))[inner]
            self.leaf[own][~inner] = np.arange(int((~inner).sum()))
            depth = np.zeros(len(left), int)
            for node in np.flatnonzero(inner):  # parents come before their children
                depth[left[node]] = depth[left[node] + 1] = depth[node] + 1
            self.depths.append(int(depth.max()))
        self.outputs = [np.array(o) for t in trees for o in t.outputs]
        self.values = [np.asarray(v, float) for t in trees for v in t.values]

    def leaves(self, columns: np.ndarray, low: int, high: int) -> np.ndarray:
        """Leaf numbers (structures from ``low`` to ``high``, rows) of rows whose features are ``doubled``."""
        n = columns.shape[1]
        flat, row = columns.ravel(), np.arange(n, dtype=np.int32)
        at = self.copy * np.int32(n)
        node = np.repeat(self.roots[low:high, None].astype(np.int32), n, axis=1)
        for _ in range(max(self.depths[low:high], default=0)):
            value = flat.take(at.take(node) + row)
            node = self.low.take(node) + (value > self.threshold.take(node))
        return self.leaf.take(node)

    @staticmethod
    def doubled(columns: list[np.ndarray]) -> np.ndarray:
        """Features (a row each), missing values lowest, and again with missing values highest."""
        x = np.stack(columns)
        return np.concatenate([np.where(np.isnan(x), -np.inf, x), np.where(np.isnan(x), np.inf, x)])

    def walk(self, columns: np.ndarray, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each structure of trees ``low`` to ``high`` in turn, with the leaf number of every row."""
        for at in range(int(self.first[low]), int(self.first[high]), self.TREES):
            stop = min(at + self.TREES, int(self.first[high]))
            yield from zip(range(at, stop), self.leaves(columns, at, stop), strict=True)

    def add(self, columns: np.ndarray, into: np.ndarray, low: int, high: int) -> None:
        """Adds the values of trees ``low`` to ``high``, tree by tree, to margins (rows, outputs)."""
        whole = np.arange(into.shape[1])
        for k, leaf in self.walk(columns, low, high):
            outs = self.outputs[k]
            if into.shape[1] == 1:
                into[:, 0] += self.values[k][:, 0].take(leaf)
            elif np.array_equal(outs, whole):
                into += self.values[k].take(leaf, axis=0)
            else:
                into[:, outs] += self.values[k].take(leaf, axis=0)

    def sql(self, features: list[str], base: list[float], keep: list[int]) -> str:
        """The sums of the outputs in ``keep``, as an array, in SQL: every structure is walked over constant arrays, then each
        output adds its values tree by tree. The text has more constants for more trees, but no more operators."""
        places: dict[int, list[tuple[int, int]]] = {out: [] for out in keep}
        at = 0
        for s, (outs, values) in enumerate(zip(self.outputs, self.values, strict=True)):
            for j, out in enumerate(outs):
                if out in places:
                    places[out].append((s, at + j * len(values)))
            at += values.size
        pairs = [p for out in keep for p in places[out]]
        many = [len(places[out]) for out in keep]
        flat = np.concatenate([v.T.ravel() for v in self.values]) if self.values else np.zeros(0)

        def cells(edge: str) -> list[str]:
            found = ("CAST(`" + f.replace("`", "``") + "` AS DOUBLE)" for f in features)
            return [f"coalesce(nanvl({x}, CAST(NULL AS DOUBLE)), double('{edge}'))" for x in found]

        row = ", ".join([*cells("-Infinity"), *cells("Infinity")]) or "double('-Infinity')"
        low, copy, leaf = (constants(c, "INT") for c in (self.low, self.copy, self.leaf))
        child = f"{low}[node] + IF(x[{copy}[node]] > {constants(self.threshold, 'DOUBLE')}[node], 1, 0)"
        walk = f"aggregate(array_repeat(0, {max(self.depths, default=0)}), root, (node, step) -> {child}, node -> {leaf}[node])"
        own = f"slice({constants(range(len(pairs)), 'INT')}, {constants(np.cumsum([0, *many])[:-1] + 1, 'INT')}[k], {constants(many, 'INT')}[k])"
        value = f"{constants(flat, 'DOUBLE')}[{constants([p[1] for p in pairs], 'INT')}[pair] + ends[{constants([p[0] for p in pairs], 'INT')}[pair]]]"
        sums = f"transform({constants([base[out] for out in keep], 'DOUBLE')}, (start, k) -> aggregate({own}, start, (total, pair) -> total + {value}))"
        # arrays of one element bind the row and its leaves, so that they are found once
        ends = f"array(transform({constants(self.roots, 'INT')}, root -> {walk}))"
        return f"transform(array(array({row})), x -> transform({ends}, ends -> {sums})[0])[0]"


def blocks_of_rows(score: Callable[[np.ndarray], np.ndarray]) -> Callable[[list[np.ndarray]], np.ndarray]:
    """``score`` of ``Packed.doubled`` features, for blocks of rows one after the other."""

    def whole(columns: list[np.ndarray]) -> np.ndarray:
        n = len(columns[0])
        parts = [score(Packed.doubled([c[at : at + Packed.ROWS] for c in columns])) for at in range(0, max(n, 1), Packed.ROWS)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    return whole


def _columns(batch: pa.RecordBatch, at: int, n: int) -> list[np.ndarray]:
    """``n`` columns as doubles; one of missing values where there are no features."""
    found = [batch.column(at + k).to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for k in range(n)]
    return found or [np.full(batch.num_rows, np.nan)]


def _lists(cells: np.ndarray) -> pa.Array:
    """An array of two or more dimensions as nested lists, one for each row."""
    out = pa.array(cells.ravel())
    for width in cells.shape[:0:-1]:
        out = pa.ListArray.from_arrays(np.arange(0, len(out) + 1, width, dtype=np.int32), out)
    return out


class Model:
    """An ensemble: base score, trees and the loss whose postprocessing its predictions get."""

    def __init__(self, features: list[str], loss: Loss, base: list[float], trees: list[Tree] | None = None):
        self.features, self.loss, self.base, self.trees = list(features), loss, list(base), trees or []

    def on(self, features: list[str]) -> Model:
        """The same model for a frame whose features have other names."""
        return Model(features, self.loss, self.base, self.trees)

    # scoring

    def _scored(self, df: DataFrame, name: str, kind: T.DataType, score) -> DataFrame:
        """``df`` with a column computed by ``score`` (``Packed.doubled`` features to an array, a row for each) on Arrow
        batches; the model travels with the task."""
        n, whole = len(self.features), blocks_of_rows(score)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = batch.num_columns - n
                yield pa.RecordBatch.from_arrays([*batch.columns[:keep], _lists(whole(_columns(batch, keep, n)))], names=[*batch.schema.names[:keep], name])

        rest = [c for c in df.columns if c != name]
        x = free(df, "_x")
        wide = df.select(*map(named, rest), *(missing_to_null(named(c)).alias(f"{x}{k}") for k, c in enumerate(self.features)))
        fields = [df.schema[c] for c in rest]
        return map_batches(wide, run, [*fields, T.StructField(name, kind)])

    def margins(self, df: DataFrame, name: str = "margin") -> DataFrame:
        """Raw margins: the base score and every tree's values."""
        packed, base, trees = Packed(self.trees, len(self.features)), np.array(self.base), len(self.trees)

        def score(x: np.ndarray) -> np.ndarray:
            out = np.tile(base, (x.shape[1], 1))
            packed.add(x, out, 0, trees)
            return out

        return self._scored(df, name, T.ArrayType(T.DoubleType()), score)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with an array of postprocessed outputs; works on streams, as rows are scored one for one."""
        return self.margins(df, name).withColumn(name, self.loss.postprocess(F.col(name)))

    transform = predict

    def predict_sql(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """The same by SQL alone: no Python on the executors, and a plan whose size does not follow the trees."""
        packed = Packed(self.trees, len(self.features))
        summed = df.withColumn(name, F.expr(packed.sql(self.features, self.base, list(range(len(self.base))))))
        return summed.withColumn(name, self.loss.postprocess(named(name)))

    def _iterations(self, iterations: list[int] | None) -> list[int]:
        chosen = list(range(len(self.trees))) if iterations is None else list(iterations)
        if not chosen or chosen[0] < 0 or chosen[-1] >= len(self.trees) or any(a >= b for a, b in zip(chosen, chosen[1:], strict=False)):
            raise ValueError("iterations must be given, in range, unique and ascending")
        return chosen

    def predict_staged(self, df: DataFrame, iterations: list[int] | None = None) -> DataFrame:
        """A row for each row and iteration: ``df``'s other columns, ``iter`` and ``prediction`` after trees 0 to iter."""
        chosen, stages = self._iterations(iterations), free(df, "_stages")
        scored, place, margin = self.stages(df, stages, chosen), free(df, "_place"), free(df, "_margin")
        steps, rest = F.array(*map(F.lit, chosen)), [named(c) for c in df.columns if c not in ("iter", "prediction")]
        long = scored.select(*rest, F.posexplode(stages).alias(place, margin))
        return long.select(*rest, F.element_at(steps, F.col(place) + 1).alias("iter"), self.loss.postprocess(F.col(margin)).alias("prediction"))

    def stages(self, df: DataFrame, name: str, iterations: list[int] | None = None) -> DataFrame:
        """``df`` with an array of raw margins after each of the iterations."""
        chosen = self._iterations(iterations)
        packed, base = Packed(self.trees[: chosen[-1] + 1], len(self.features)), np.array(self.base)

        def score(x: np.ndarray) -> np.ndarray:
            out, stages = np.tile(base, (x.shape[1], 1)), np.empty((x.shape[1], len(chosen), len(base)))
            for k, (low, last) in enumerate(zip([0, *(c + 1 for c in chosen)], chosen, strict=False)):
                packed.add(x, out, low, last + 1)
                stages[:, k] = out
            return stages

        return self._scored(df, name, T.ArrayType(T.ArrayType(T.DoubleType())), score)

    def predict_leaves(self, df: DataFrame, iterations: list[int] | None = None) -> DataFrame:
        """A row for each row and iteration: ``df``'s other columns, ``iter`` and ``leaf``, an array over groups."""
        chosen = self._iterations(iterations)
        trees = [self.trees[k] for k in chosen]
        groups = {len(t.groups) for t in trees}
        if len(groups) != 1:
            raise ValueError("leaf indices need equally many groups in all trees")
        (g,), packed = groups, Packed(trees, len(self.features))

        def score(x: np.ndarray) -> np.ndarray:
            ends = np.stack([leaf for _, leaf in packed.walk(x, 0, len(chosen))], axis=1)
            return ends.reshape(x.shape[1], len(chosen), g)

        ends, place, found = free(df, "_ends"), free(df, "_place"), free(df, "_found")
        scored = self._scored(df, ends, T.ArrayType(T.ArrayType(T.IntegerType())), score)
        rest = [named(c) for c in df.columns if c not in ("iter", "leaf")]
        long = scored.select(*rest, F.posexplode(ends).alias(place, found))
        return long.select(*rest, F.element_at(F.array(*map(F.lit, chosen)), F.col(place) + 1).alias("iter"), F.col(found).alias("leaf"))

    # what the model tells

    def feature_importance(self, kind: str = "split") -> np.ndarray:
        """How often each feature splits, or the sum of the gains of its splits."""
        if kind not in ("split", "gain"):
            raise ValueError(f"unknown importance: {kind}")
        out = np.zeros(len(self.features))
        for tree in self.trees:
            for group in tree.groups:
                for node, f in enumerate(group.feat):
                    if f >= 0:
                        out[f] += 1.0 if kind == "split" else group.gain[node]
        return out

    def nodes_frame(self, spark: SparkSession) -> DataFrame:
        """``iter, grp, node, feat, split, threshold, nan_left, left, right, gain, leaf`` of all nodes."""
        rows = []
        for i, tree in enumerate(self.trees):
            for g, t in enumerate(tree.groups):
                number = {node: k for k, node in enumerate(t.leaves)}
                rows += [(i, g, k, t.feat[k], t.split[k], float(t.threshold[k]), t.nan_left[k], t.left[k], t.right[k], float(t.gain[k]), number.get(k)) for k in range(len(t.feat))]
        return spark.createDataFrame(rows, "iter int, grp int, node int, feat int, split int, threshold double, nan_left boolean, left int, right int, gain double, leaf int")

    def values_frame(self, spark: SparkSession) -> DataFrame:
        """``iter, grp, leaf, out, value`` of all leaves."""
        rows = []
        for i, tree in enumerate(self.trees):
            for g, (outs, values) in enumerate(zip(tree.outputs, tree.values, strict=True)):
                rows += [(i, g, leaf, out, float(values[leaf, j])) for leaf in range(len(values)) for j, out in enumerate(outs)]
        return spark.createDataFrame(rows, "iter int, grp int, leaf int, out int, value double")

    # files

    def to_json(self) -> str:
        trees = [{"groups": [vars(g) for g in t.groups], "outputs": t.outputs, "values": [v.tolist() for v in t.values]} for t in self.trees]
        return json.dumps({"features": self.features, "loss": self.loss.name, "base": self.base, "trees": trees})

    @classmethod
    def from_json(cls, text: str, loss: str | Loss | None = None) -> Model:
        read = json.loads(text)
        trees = [Tree([GroupTree(**g) for g in t["groups"]], t["outputs"], [np.array(v) for v in t["values"]]) for t in read["trees"]]
        return cls(read["features"], loss_from_name(loss or read["loss"]), read["base"], trees)

    def dump(self, path: str) -> None:
        with open(path, "w") as file:
            file.write(self.to_json())

    @classmethod
    def load(cls, path: str, loss: str | Loss | None = None) -> Model:
        with open(path) as file:
            return cls.from_json(file.read(), loss)

    def save_tables(self, spark: SparkSession, path: str) -> None:
        """The model as Parquet tables ``nodes`` and ``values`` and a line of JSON, at a path that Spark writes."""
        self.nodes_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        self.values_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/values")
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")

    @classmethod
    def load_tables(cls, spark: SparkSession, path: str, loss: str | Loss | None = None) -> Model:
        return cls.from_json(spark.read.text(f"{path}/model").first()[0], loss)


def predict_all(models: list[Model], df: DataFrame, name: str, iterations: list[int] | None = None) -> DataFrame:
    """``df`` with raw margins of several models on the same features, in one pass: an array of iterations (only the last
    trees where none are given) of arrays of models of outputs."""
    chosen = iterations or [None]
    n = len(models[0].features)
    packed, bases = [(Packed(m.trees, n), len(m.trees)) for m in models], [np.array(m.base) for m in models]
    outputs = len(bases[0])

    def score(x: np.ndarray) -> np.ndarray:
        made = np.empty((x.shape[1], len(chosen), len(models), outputs))
        for k, ((own, trees), base) in enumerate(zip(packed, bases, strict=True)):
            out, done = np.tile(base, (x.shape[1], 1)), 0
            for i, last in enumerate(chosen):
                stop = trees if last is None else last + 1
                own.add(x, out, done, stop)
                made[:, i, k], done = out, stop
        return made

    return models[0]._scored(df, name, T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))), score)
