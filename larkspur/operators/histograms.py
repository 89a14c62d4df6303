"""Histograms of gradients, running sums over bins, split gains and the best split of each node.

Histogram rows are ``node, feat, bin, g0.., h0.., n``; only bins that have rows exist, as an empty bin repeats the
gain of the one before it and is never chosen first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.routing import node_of

#: Features up to which histograms are built by exploding rows; beyond, by counting on Arrow batches.
SQL_FEATURES = 8


def total(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def _schema(sums: list[str]) -> str:
    return ", ".join(["node bigint, feat int, bin smallint", *(f"{s} double" for s in sums), "n bigint"])


def _cells_of(held: dict[int, np.ndarray], sums: list[str]) -> Iterator[pa.RecordBatch]:
    """The cells that have rows, a batch for each node; the last row of ``cells`` counts."""
    for node, cells in held.items():
        full = np.flatnonzero(cells[-1] > 0)
        columns = [pa.array(np.full(len(full), node)), pa.array((full // 256).astype(np.int32)), pa.array((full % 256).astype(np.int16))]
        columns += [pa.array(c[full]) for c in cells[:-1]] + [pa.array(cells[-1][full].astype(np.int64))]
        yield pa.record_batch(columns, ["node", "feat", "bin", *sums, "n"])


def histogram(rows: DataFrame, features: list[int], k: int, m: int, bins: str = "bins", path: str | None = None) -> DataFrame:
    """Sums over ``rows`` (``node``, codes, g0..g{k-1}, h0..h{m-1}) by node, feature position and code."""
    sums = [f"g{i}" for i in range(k)] + [f"h{i}" for i in range(m)]
    if (path or ("sql" if len(features) <= SQL_FEATURES else "arrow")) == "sql":
        used = F.array(*(F.get(bins, F.lit(f)) for f in features))
        long = rows.select("node", *sums, F.posexplode(used).alias("feat", "bin"))
        return long.groupBy("node", "feat", "bin").agg(*(F.sum(s).alias(s) for s in sums), F.count("*").alias("n"))
    picked = np.array(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # a node's sums by feature, code and column
        for batch in batches:
            codes = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)[:, picked].astype(np.int64)
            nodes = batch.column(0).to_numpy()
            values = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[2:]]
            for node in np.unique(nodes):
                mine = nodes == node
                place = (codes[mine] + np.arange(len(picked)) * 256).ravel()
                cells = np.stack([np.bincount(place, np.repeat(v[mine], len(picked)), 256 * len(picked)) for v in [*values, np.ones(len(nodes))]])
                held[int(node)] = held[int(node)] + cells if int(node) in held else cells
        yield from _cells_of(held, sums)

    parts = rows.select(F.col("node").cast("bigint"), bins, *(F.col(s).cast("double") for s in sums)).mapInArrow(run, _schema(sums))
    return parts.groupBy("node", "feat", "bin").agg(*(F.sum(s).alias(s) for s in [*sums, "n"]))


#: Node numbers of a structure: those of the next begin at this distance, so that one level of many trees has one key.
STRUCTURE = 1 << 32
#: Structures times their nodes up to which rows find their nodes by generated conditions; beyond, on Arrow batches.
SQL_NODES = 64


def group_histogram(rows: DataFrame, features: list[int], trees: list, wanted: list[int], columns: list[tuple[list[int], list[int]]], bins: str = "bins", path: str | None = None) -> DataFrame:
    """One level of many trees in one pass: sums by (structure, node), feature position and code, over the ``wanted`` nodes.

    ``rows`` have codes and arrays ``g`` and ``h``; ``columns`` names the places in them that each structure sums. Node numbers
    are ``STRUCTURE * structure + node``. Structures with fewer columns than others have zeros in the rest.
    """
    k, m = (max(len(c[i]) for c in columns) for i in (0, 1))
    sums = [f"g{i}" for i in range(k)] + [f"h{i}" for i in range(m)]
    if (path or ("sql" if len(features) <= SQL_FEATURES and sum(len(t.feat) for t in trees) <= SQL_NODES else "arrow")) == "sql":
        parts = []
        for s, (tree, (g, h)) in enumerate(zip(trees, columns, strict=True)):
            cells = [(names[i] if i < len(names) else None, array, f"{array}{i}") for array, names, n in (("g", g, k), ("h", h, m)) for i in range(n)]
            parts.append(F.struct((node_of(tree, bins).cast("bigint") + STRUCTURE * s).alias("node"), *((F.lit(0.0) if at is None else F.get(array, F.lit(at))).alias(name) for at, array, name in cells)))
        placed = rows.select(bins, F.explode(F.array(*parts)).alias("part")).select(bins, "part.*")
        if len(wanted) < sum(len(t.leaves) for t in trees):
            placed = placed.where(F.col("node").isin(wanted))
        return histogram(placed, features, k, m, bins, "sql")
    picked, asked = np.array(features), np.array(sorted(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            codes = batch.column(0).flatten().to_numpy().reshape(n, -1)
            arrays = [batch.column(c).flatten().to_numpy().reshape(n, -1) for c in (1, 2)] if n else []
            place = None
            for s, (tree, names) in enumerate(zip(trees, columns, strict=True)) if n else ():
                node = tree.nodes_of_codes(codes) + STRUCTURE * s
                for one in np.intersect1d(np.unique(node), asked):
                    mine = np.flatnonzero(node == one)
                    if place is None:
                        place = codes[:, picked].astype(np.int64) + np.arange(len(picked)) * 256
                    at = place[mine].ravel()
                    cells = np.zeros((len(sums) + 1, 256 * len(picked)))
                    for first, array, own in ((0, arrays[0], names[0]), (k, arrays[1], names[1])):
                        for c, column in enumerate(own):
                            cells[first + c] = np.bincount(at, np.repeat(array[mine, column], len(picked)), 256 * len(picked))
                    cells[-1] = np.bincount(at, minlength=256 * len(picked))
                    held[int(one)] = held[int(one)] + cells if int(one) in held else cells
        yield from _cells_of(held, sums)

    parts = rows.select(bins, *(F.col(c).cast("array<double>") for c in ("g", "h"))).mapInArrow(run, _schema(sums))
    return parts.groupBy("node", "feat", "bin").agg(*(F.sum(s).alias(s) for s in [*sums, "n"]))


def sibling(parent: DataFrame, small: DataFrame, k: int, m: int) -> DataFrame:
    """The larger child's histogram: the parent's less the smaller child's (both by feat and bin of one node)."""
    sums = [f"g{i}" for i in range(k)] + [f"h{i}" for i in range(m)] + ["n"]
    other = small.select("node", "feat", "bin", *(F.col(s).alias(f"_{s}") for s in sums))
    left = parent.join(other, ["node", "feat", "bin"], "left")
    rest = left.select("node", "feat", "bin", *((F.col(s) - F.coalesce(F.col(f"_{s}"), F.lit(0))).alias(s) for s in sums))
    return rest.where("n > 0")


def with_siblings(hist: DataFrame, parents: DataFrame, families: list[tuple[int, int, int]], k: int, m: int) -> DataFrame:
    """``hist``, which has the smaller child of each family (smaller, larger, parent), with the larger children too."""
    family = hist.sparkSession.createDataFrame(families, "small bigint, large bigint, parent bigint")
    family = F.broadcast(family)  # a row for a node of the level: they are few, as the driver grows the tree
    by_parent = hist.join(family, F.col("node") == F.col("small")).withColumn("node", F.col("parent")).drop("small", "large", "parent")
    rest = sibling(parents, by_parent, k, m).join(family, F.col("node") == F.col("parent"))
    return hist.unionByName(rest.withColumn("node", F.col("large")).select(hist.columns))


def running(hist: DataFrame, k: int, m: int) -> DataFrame:
    """Running sums over a node's and feature's bins, with node totals (``*_t``) and the missing bin's sums (``*_m``)."""
    sums = [f"g{i}" for i in range(k)] + [f"h{i}" for i in range(m)] + ["n"]
    group = Window.partitionBy("node", "feat")
    order = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    columns = []
    for s in sums:
        columns += [F.sum(s).over(order).alias(s), F.sum(s).over(group).alias(f"{s}_t"), F.sum(F.when(F.col("bin") == 0, F.col(s)).otherwise(0)).over(group).alias(f"{s}_m")]
    return hist.select("node", "feat", "bin", *columns)


def _part(g: Column, h: Column, lam: float) -> Column:
    return F.coalesce(F.try_divide(g * g, h + F.lit(lam)), F.lit(0.0))


def gains(run: DataFrame, k: int, m: int, lam: float = 1.0, min_leaf: int = 10, sums: bool = False) -> DataFrame:
    """``node, feat, bin, nan_left, gain`` for both directions of missing values; an output adds nothing where one of
    its sides has ``min_leaf`` rows or fewer, by its own hessian's share of the node's rows. With ``sums``, also the
    rows, gradients and hessians that go left and those of the node: ``left_n, all_n, left_g, left_h, all_g, all_h``."""

    def side(i: int, missing_left: bool) -> Column:
        h = f"h{i if m > 1 else 0}"
        g, gt, gm = (F.col(f"g{i}{e}") for e in ("", "_t", "_m"))
        hs, ht, hm = (F.col(f"{h}{e}") for e in ("", "_t", "_m"))
        if not missing_left:
            g, hs_ = g - gm, hs - hm
        else:
            hs_ = hs
        left = F.coalesce(F.try_divide(hs_, ht), F.lit(0.0)) * F.col("n_t")
        fine = F.least(F.col("n_t") - left, left) > min_leaf
        if not missing_left:
            fine = fine & (hm > 0) & (hs < ht)
        return F.when(fine, _part(g, hs_, lam) + _part(gt - g, ht - hs_, lam) - _part(gt, ht, lam)).otherwise(0.0)

    def going_left(s: str, missing_left: bool) -> Column:
        return F.col(s) if missing_left else F.col(s) - F.col(f"{s}_m")

    def told(left: bool) -> list[Column]:
        if not sums:
            return []
        g, h = [f"g{i}" for i in range(k)], [f"h{i}" for i in range(m)]
        parts = [F.array(*(going_left(s, left) for s in names)).alias(f"left_{n}") for n, names in (("g", g), ("h", h))]
        return [going_left("n", left).alias("left_n"), F.col("n_t").alias("all_n"), *parts, *(F.array(*(F.col(f"{s}_t") for s in names)).alias(f"all_{n}") for n, names in (("g", g), ("h", h)))]

    both = F.array(*(F.struct(F.lit(left).alias("nan_left"), total([side(i, left) for i in range(k)]).alias("gain"), *told(left)) for left in (True, False)))
    return run.select("node", "feat", "bin", F.explode(both).alias("s")).select("node", "feat", "bin", "s.*")


def best_splits(gain: DataFrame) -> DataFrame:
    """The split with the largest gain of each node; of equal ones, the first by feature position, bin, missing left."""
    what = F.struct(*(c for c in gain.columns if c != "node"))
    rank = F.struct(F.col("gain"), -F.col("feat"), -F.col("bin"), F.col("nan_left").cast("int"))
    return gain.groupBy("node").agg(F.max_by(what, rank).alias("s")).select("node", "s.*")


def dense(hist: pa.Table, nodes: list[int], features: int, bins: int, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A collected histogram as arrays: gradients (k, node, feature, bin), hessians (m, ...), rows (node, feature, bin)."""
    place = {node: i for i, node in enumerate(nodes)}
    node = np.array([place[v] for v in hist.column("node").to_pylist()], dtype=np.int64)
    at = (node, hist.column("feat").to_numpy().astype(np.int64), hist.column("bin").to_numpy().astype(np.int64))
    out = []
    for names in ([f"g{i}" for i in range(k)], [f"h{i}" for i in range(m)], ["n"]):
        cells = np.zeros((len(names), len(nodes), features, bins))
        for i, name in enumerate(names):
            cells[(i, *at)] = hist.column(name).to_numpy()
        out.append(cells)
    return out[0], out[1], out[2][0]


def best_splits_dense(g: np.ndarray, h: np.ndarray, n: np.ndarray, lam: float, min_leaf: int) -> list[tuple[int, int, bool, float, np.ndarray, np.ndarray, float]]:
    """For each node the best split as by ``gains`` and ``best_splits`` (feature position, bin, missing left, gain), and
    the sums of gradients and hessians and the rows that go left. Bins without rows repeat a gain and are never first."""
    running_g, running_h, running_n = np.cumsum(g, axis=3), np.cumsum(h, axis=3), np.cumsum(n, axis=2)
    all_g, all_h, rows = running_g[..., -1:], running_h[..., -1:], n.sum(axis=2, keepdims=True)

    def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a * a, b + lam, out=np.zeros(np.broadcast_shapes(a.shape, b.shape)), where=b + lam != 0)

    sides = []
    for left_g, left_h, missing_right in ((running_g, running_h, False), (running_g - g[..., :1], running_h - h[..., :1], True)):
        count = np.divide(left_h, all_h, out=np.zeros_like(left_h), where=all_h != 0) * rows
        fine = np.minimum(rows - count, count) > min_leaf
        if missing_right:
            fine &= (h[..., :1] > 0) & (running_h < all_h)
        gain = part(left_g, left_h) + part(all_g - left_g, all_h - left_h) - part(all_g, all_h)
        sides.append(np.where(fine, gain, 0.0).sum(axis=0))
    both = np.stack(sides, axis=3)
    out = []
    for i in range(both.shape[0]):
        f, b, side = np.unravel_index(int(both[i].argmax()), both.shape[1:])
        less = (g[:, i, f, 0], h[:, i, f, 0], n[i, f, 0]) if side else (0.0, 0.0, 0.0)
        out.append((int(f), int(b), bool(side == 0), float(both[i, f, b, side]), running_g[:, i, f, b] - less[0], running_h[:, i, f, b] - less[1], float(running_n[i, f, b] - less[2])))
    return out


def split_search(rows: DataFrame, features: list[int], k: int, m: int, lam: float, min_leaf: int, path: str | None = None) -> DataFrame:
    return best_splits(gains(running(histogram(rows, features, k, m, path=path), k, m), k, m, lam, min_leaf))
