"""Export of models for other scorers: a flat table of tree-ensemble attributes, with a choice of outputs.

The table has the attributes of a tree-ensemble regressor (branch on ``<=``, missing values by flag, values summed on
top of base values). ``onnx_bytes`` writes the same as an ONNX file, ``score_onnx`` scores with one, and ``Compiled`` is a
model as generated SQL.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.losses import sigmoid, softmax
from larkspur.operators.binning import missing_to_null
from larkspur.operators.columns import free, map_batches, named
from larkspur.plans.model import Model, Packed

#: What a scorer may do with the sums (fixed values).
POST_TRANSFORMS = ("NONE", "SOFTMAX", "LOGISTIC", "SOFTMAX_ZERO", "PROBIT")


def chosen_outputs(model: Model, fltr: list[int] | None) -> list[int]:
    """The outputs to keep, ascending; a warning tells where the given order differs."""
    if fltr is None:
        return list(range(len(model.base)))
    if list(fltr) != sorted(set(fltr)):
        warnings.warn("outputs are exported in ascending order", stacklevel=2)
    return sorted(set(fltr))


def node_table(model: Model, spark: SparkSession, fltr: list[int] | None = None) -> DataFrame:
    """``tree, node, mode, feat, value, true_node, false_node, missing_true``: the branches and leaves of every group
    of every tree that has a kept output, trees numbered densely."""
    keep = set(chosen_outputs(model, fltr))
    kept = F.array(*map(F.lit, sorted(keep)))
    values = model.values_frame(spark).where(F.array_contains(kept, F.col("out"))).select("iter", "grp").distinct()
    nodes = model.nodes_frame(spark).join(F.broadcast(values), ["iter", "grp"])
    tree = F.dense_rank().over(Window.orderBy("iter", "grp")) - 1  # a model's nodes: few, and on the driver before
    leaf = F.col("left") < 0
    return nodes.select(
        tree.alias("tree"), "node", F.when(leaf, "LEAF").otherwise("BRANCH_LEQ").alias("mode"), F.greatest("feat", F.lit(0)).alias("feat"),
        "threshold", F.greatest("left", F.lit(0)).alias("true_node"), F.greatest("right", F.lit(0)).alias("false_node"), F.when(leaf, False).otherwise(F.col("nan_left")).alias("missing_true"),
    )


def target_table(model: Model, spark: SparkSession, fltr: list[int] | None = None) -> DataFrame:
    """``tree, node, target, value``: what each leaf adds to each kept output, outputs renumbered densely."""
    keep = chosen_outputs(model, fltr)
    values = model.values_frame(spark).where(F.col("out").isin(keep))
    leaves = model.nodes_frame(spark).where("leaf is not null").select("iter", "grp", "node", "leaf")
    number = F.create_map(*(F.lit(x) for kv in {o: k for k, o in enumerate(keep)}.items() for x in kv))
    tree = F.dense_rank().over(Window.orderBy("iter", "grp")) - 1
    return values.join(F.broadcast(leaves), ["iter", "grp", "leaf"]).select(tree.alias("tree"), "node", F.element_at(number, F.col("out")).alias("target"), "value")


def post_transform(p: Column, kind: str) -> Column:
    if kind not in POST_TRANSFORMS:
        raise ValueError(f"unknown transform: {kind}")
    if kind == "LOGISTIC":
        return F.transform(p, sigmoid)
    if kind == "SOFTMAX":
        return softmax(p, 0.0)
    if kind == "SOFTMAX_ZERO":
        top = F.array_max(p)
        e = F.transform(p, lambda v: F.when(v == 0, 0.0).otherwise(F.exp(v - top)))
        return F.transform(e, lambda v: F.coalesce(F.try_divide(v, F.aggregate(e, F.lit(0.0), lambda a, x: a + x)), F.lit(0.0)))
    if kind == "PROBIT":
        # Winitzki's inverse error function
        def probit(v: Column) -> Column:
            x = 2 * v - 1
            log, a = F.ln(1 - x * x), 0.147
            part = 2 / (math.pi * a) + log / 2
            return math.sqrt(2) * F.signum(x) * F.sqrt(F.sqrt(part * part - log / a) - part)

        return F.transform(p, probit)
    return p


class Scorer:
    """Scores with the exported form: sums of kept outputs, then a transform, or the loss's own if that is NONE."""

    def __init__(self, model: Model, fltr: list[int] | None = None, transform: str = "NONE", postprocess: bool = True):
        self.model, self.keep, self.kind, self.postprocess = model, chosen_outputs(model, fltr), transform, postprocess

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        scored = self.model.margins(df, name)
        kept = F.array(*(F.get(name, F.lit(k)) for k in self.keep))
        if self.kind != "NONE":
            return scored.withColumn(name, post_transform(kept, self.kind))
        return scored.withColumn(name, self.model.loss.postprocess(kept) if self.postprocess else kept)


def _number(value: int) -> bytes:
    """A protocol buffer's variable-length integer."""
    value, out = value & (1 << 64) - 1, bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    raw = value.encode() if isinstance(value, str) else value
    return _number(number << 3 | 2) + _number(len(raw)) + raw


#: Kinds of attributes in an ONNX file, with the field that has their values (fixed values).
_STRING, _FLOATS, _INTS, _STRINGS = (3, 4), (6, 7), (7, 8), (8, 9)


def _attribute(name: str, value) -> bytes:
    if isinstance(value, str):
        kind, body = _STRING, _field(_STRING[1], value)
    elif isinstance(value, np.ndarray) and value.dtype == np.float32:
        kind, body = _FLOATS, _field(_FLOATS[1], value.astype("<f4").tobytes())
    elif value and isinstance(value[0], str):
        kind, body = _STRINGS, b"".join(_field(_STRINGS[1], v) for v in value)
    else:
        kind, body = _INTS, _field(_INTS[1], b"".join(map(_number, value)))
    return _field(5, _field(1, name) + body + _field(20, kind[0]))


def _tensor(name: str, width: int) -> bytes:
    """A matrix of floats with any number of rows."""
    shape = _field(1, _field(2, "n")) + _field(1, _field(1, width))
    return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))


def onnx_bytes(model: Model, spark: SparkSession, fltr: list[int] | None = None, transform: str = "NONE") -> bytes:
    """An ONNX file with one tree-ensemble regressor from ``X`` (floats, NaN for missing) to ``Y`` (kept outputs).
    Thresholds are rounded like features: values on a border stay on its side, values a rounding error apart meet."""
    if transform not in POST_TRANSFORMS:
        raise ValueError(f"unknown transform: {transform}")
    nodes = node_table(model, spark, fltr).orderBy("tree", "node").collect()
    targets = target_table(model, spark, fltr).orderBy("tree", "node", "target").collect()
    keep = chosen_outputs(model, fltr)

    def whole(rows, column: str) -> list[int]:
        return [int(r[column]) for r in rows]

    attributes = {
        "aggregate_function": "SUM", "post_transform": transform, "n_targets": None, "base_values": np.array([model.base[k] for k in keep], dtype=np.float32),
        "nodes_treeids": whole(nodes, "tree"), "nodes_nodeids": whole(nodes, "node"), "nodes_featureids": whole(nodes, "feat"), "nodes_modes": [r["mode"] for r in nodes],
        "nodes_values": np.array([r["threshold"] for r in nodes], dtype=np.float32), "nodes_truenodeids": whole(nodes, "true_node"), "nodes_falsenodeids": whole(nodes, "false_node"),
        "nodes_missing_value_tracks_true": whole(nodes, "missing_true"), "target_treeids": whole(targets, "tree"), "target_nodeids": whole(targets, "node"),
        "target_ids": whole(targets, "target"), "target_weights": np.array([r["value"] for r in targets], dtype=np.float32),
    }
    made = b"".join(_attribute(k, v) for k, v in attributes.items() if v is not None)
    made += _field(5, _field(1, "n_targets") + _field(3, len(keep)) + _field(20, 2))
    node = _field(1, "X") + _field(2, "Y") + _field(4, "TreeEnsembleRegressor") + made + _field(7, "ai.onnx.ml")
    graph = _field(1, node) + _field(2, "larkspur") + _field(11, _tensor("X", len(model.features))) + _field(12, _tensor("Y", len(keep)))
    versions = _field(8, _field(1, "ai.onnx.ml") + _field(2, 3)) + _field(8, _field(1, "") + _field(2, 15))
    return _field(1, 8) + _field(2, "larkspur") + _field(7, graph) + versions


def to_onnx(model: Model, spark: SparkSession, path: str, fltr: list[int] | None = None, transform: str = "NONE") -> None:
    """Writes an ONNX file."""
    with open(path, "wb") as file:
        file.write(onnx_bytes(model, spark, fltr, transform))


def score_onnx(df: DataFrame, onnx: bytes, features: list[str], name: str = "prediction") -> DataFrame:
    """``df`` with what the runtime for ONNX files makes of its features, batch by batch on the executors."""
    rest, n = [c for c in df.columns if c != name], len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(onnx, options, providers=["CPUExecutionProvider"])
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(rest) :]], axis=1).astype(np.float32)
            y = session.run(["Y"], {"X": x})[0].reshape(batch.num_rows, -1).astype(np.float64)
            lists = pa.ListArray.from_arrays(np.arange(0, y.size + 1, max(y.shape[1], 1), dtype=np.int32), y.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], lists], names=[*batch.schema.names[: len(rest)], name])

    x = free(df, "_x")
    wide = df.select(*map(named, rest), *(missing_to_null(named(c)).alias(f"{x}{k}") for k, c in enumerate(features[:n])))
    return map_batches(wide, run, [*(df.schema[c] for c in rest), T.StructField(name, T.ArrayType(T.DoubleType()))])


class Compiled:
    """A model as SQL text, which walks all trees over constant arrays (``Packed.sql``) as part of the plan, whose size does
    not follow the trees. The text can be kept in a file and read back without the model. ``sums``: SQL of the array of
    outputs' sums."""

    def __init__(self, sums: str):
        self.sums = sums

    @classmethod
    def convert(cls, model: Model, fltr: list[int] | None = None) -> Compiled:
        return cls(Packed(model.trees, len(model.features)).sql(model.features, model.base, chosen_outputs(model, fltr)))

    def dump(self, path: str) -> None:
        with open(path, "w") as file:
            json.dump(self.sums, file)

    @classmethod
    def load(cls, path: str) -> Compiled:
        with open(path) as file:
            return cls(json.load(file))

    def predict(self, df: DataFrame, name: str = "prediction", transform: str = "NONE") -> DataFrame:
        """``df`` with the array of sums, transformed."""
        summed = df.withColumn(name, F.expr(self.sums))
        return summed if transform == "NONE" else summed.withColumn(name, post_transform(named(name), transform))
