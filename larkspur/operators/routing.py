"""Routing of rows to nodes and leaves, node counts and leaf values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Nodes up to which a level's table is broadcast; beyond, it is joined by shuffle.
BROADCAST_NODES = 1 << 16


def _level(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes


def goes_right(bins: str, feat: int, split: int, nan_left: bool) -> Column:
    code = F.get(bins, F.lit(feat))
    return code > split if nan_left else (code > split) | (code == 0)


def node_of(group, bins: str = "bins") -> Column:
    """The node where a row ends, as nested conditions over its codes; nothing is shuffled or looked up."""

    def at(node: int) -> Column:
        if group.left[node] < 0:
            return F.lit(node)
        right = goes_right(bins, group.feat[node], group.split[node], group.nan_left[node])
        return F.when(right, at(group.right[node])).otherwise(at(group.left[node]))

    return at(0)


def route_by_table(rows: DataFrame, splits: DataFrame, bins: str = "bins") -> DataFrame:
    """The same for one level, by a lookup join with ``splits`` (node, feat, bin, nan_left, left, right). ``splits``
    has one row for a node of a level, and is broadcast up to ``BROADCAST_NODES``. Rows of other nodes keep theirs."""
    code = F.get(bins, F.col("feat"))
    right = (code > F.col("bin")) | ((code == 0) & ~F.col("nan_left"))
    node = F.when(F.col("feat").isNull(), F.col("node")).when(right, F.col("right")).otherwise(F.col("left"))
    joined = rows.join(_level(splits), "node", "left")
    return joined.select(*(node.alias("node") if c == "node" else F.col(c) for c in rows.columns))


def child_ids(best: DataFrame, last: int, min_gain: float = 0.0) -> DataFrame:
    """Splits with more than ``min_gain``, their children numbered densely from ``last + 1`` in the order of nodes.
    A level has 2 ** depth nodes at most, so one task can number them."""
    place = F.row_number().over(Window.orderBy("node"))
    return best.where(F.col("gain") > min_gain).withColumn("left", last + 2 * place - 1).withColumn("right", last + 2 * place)


def members(rows: DataFrame, wanted: DataFrame, key: str = "node") -> DataFrame:
    """``rows`` with ``pos``, the place of their key in the sorted ``wanted`` keys, or -1. Wanted are nodes of a level,
    2 ** depth at most, so they are numbered in one task."""
    places = wanted.select(key).distinct().withColumn("pos", F.row_number().over(Window.orderBy(key)) - 1)
    return rows.join(_level(places), key, "left").na.fill(-1, ["pos"])


def active(rows: DataFrame, nodes: list[int]) -> DataFrame:
    """Rows that are still in a node that may split."""
    return rows.where(F.col("node").isin(nodes))


def node_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.count("*").alias("n"))


def leaf_values(rows: DataFrame, outputs: int, hessians: int, lr: float, lam: float, key: str = "leaf") -> DataFrame:
    """``leaf, value``: for each output, minus lr times the gradients' sum over the hessians' sum and lam."""
    g = [F.sum(F.get("g", F.lit(k))) for k in range(outputs)]
    h = [F.sum(F.get("h", F.lit(k))) for k in range(hessians)]
    values = F.array(*(-lr * F.coalesce(F.try_divide(g[k], h[k if hessians > 1 else 0] + lam), F.lit(0.0)) for k in range(outputs)))
    return rows.groupBy(key).agg(values.alias("value"))
