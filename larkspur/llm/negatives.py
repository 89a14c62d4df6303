"""Hard negatives by one-dimensional distance keys.

Vectors get one more component, so that all have the largest norm M and a smaller Euclidean distance to an anchor (whose own
further component is 0) means a larger inner product. Every row belongs to its nearest pivot, and the index is stored sorted by (pivot,
distance to the pivot). A row within r of an anchor has a key within r of the anchor's own distance to that pivot, so a search reads
key intervals. Radii grow from round to round, a round reads only the annuli that are new, and an anchor is done when
its radius covers the distance that its last wanted score stands for. All anchors of a round are searched by one job.

Pivots are centres of a sample of ``SAMPLE`` rows at most. They bear on what is read, never on what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import stored
from larkspur.llm.vectors import QUERIES, Shape, first_of_groups, in_blocks, in_passes, longs, matrix, measured, whole_numbers

#: Rows from which pivots are learnt and the bytes that these may take, pivots, rounds of learning; rows in a chunk.
SAMPLE, SAMPLE_BYTES, PIVOTS, ROUNDS, CHUNK = 2048, 16 << 20, 32, 4, 2048
#: Negatives are worth this share of their positive's score at least, in percent.
LEAST_PERCENT = 80
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


@dataclass
class Index:
    """The stored keys: chunks of rows of one pivot, sorted by distance; what distances are measured with."""

    chunks: DataFrame
    pivots: np.ndarray
    shape: Shape

    @property
    def slack(self) -> float:
        """More than what rounding does to a distance."""
        return 1e-6 * (self.shape.norm**0.5 + 1)

    def radius(self, norm: Column, score: Column) -> Column:
        """The distance at which an anchor of squared norm ``norm`` has a score, or a little more."""
        return F.sqrt(F.greatest(norm + F.lit(self.shape.norm) - 2 * score.cast("double"), F.lit(0.0))) + self.slack


def distances(x: np.ndarray, more: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    whole = np.concatenate([x, more[:, None]], axis=1)
    return np.stack([np.sqrt(((whole - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def further(x: np.ndarray, norm: float) -> np.ndarray:
    """The component that brings each row's squared norm to ``norm``."""
    return np.sqrt(np.maximum(norm - (x * x).sum(axis=1), 0.0))


def learnt_pivots(rows: DataFrame, shape: Shape, pivots: int = PIVOTS) -> np.ndarray:
    """Centres of a sample of the rows with the smallest hashes, by a few rounds of k-means."""
    dims = len(shape.order)
    n = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * (dims + 1))))
    sample = rows.orderBy(F.xxhash64("id", "v")).limit(n).select("v").toArrow().column(0).combine_chunks()
    if not len(sample):
        return np.zeros((1, dims + 1))
    x = matrix(sample, dims, np.float64)[:, shape.order]
    whole = np.concatenate([x, further(x, shape.norm)[:, None]], axis=1)
    centres = whole[np.linspace(0, len(whole) - 1, min(pivots, len(whole))).astype(int)]
    for _ in range(ROUNDS):
        nearest = distances(x, whole[:, -1], centres).argmin(axis=1)
        centres = np.stack([whole[nearest == k].mean(axis=0) if (nearest == k).any() else c for k, c in enumerate(centres)])
    return centres


def index(rows: DataFrame, shape: Shape, pivots: int = PIVOTS, chunk: int = CHUNK) -> Index:
    """Keys of all ``rows`` (id, label, v), range-partitioned and sorted by pivot, distance, and then row, so that
    neither a large pivot nor many equal vectors meet in one task."""
    made, dims = learnt_pivots(rows, shape, pivots), len(shape.order)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), dims)[:, shape.order]
            far = distances(x.astype(np.float64), further(x.astype(np.float64), shape.norm), made)
            pivot = far.argmin(axis=1)
            vectors = pa.array([r.tobytes() for r in x.astype(shape.kind)], pa.binary())
            yield pa.record_batch([pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(x)), pivot]), batch.column(0), batch.column(1), vectors], ["pivot", "dist", "id", "label", "vector"])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot = batch.column(0).to_numpy()
            cuts = np.union1d(np.flatnonzero(np.diff(pivot)) + 1, np.arange(0, len(pivot), chunk)).tolist()
            for low, high in zip(cuts, [*cuts[1:], len(pivot)], strict=False):
                part = batch.slice(low, high - low)
                dist = part.column(1).to_numpy()
                lists = [pa.ListArray.from_arrays([0, part.num_rows], part.column(c)) for c in (2, 3)]
                payload = [pa.array([x], pa.binary()) for x in (dist.tobytes(), b"".join(part.column(4).to_pylist()))]
                yield pa.record_batch([part.column(0)[:1], pa.array(dist[:1]), pa.array(dist[-1:]), *lists, *payload], ["pivot", "low", "high", "ids", "labels", "dists", "rows"])

    keys = rows.select("id", "label", "v").mapInArrow(keyed, "pivot int, dist double, id bigint, label bigint, vector binary")
    order = ["pivot", "dist", "id"]
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "pivot int, low double, high double, ids array<bigint>, labels array<bigint>, dists binary, rows binary"
    return Index(stored(dealt.mapInArrow(chunked, schema), "keys"), made, shape)


class _Asked:
    """The open anchors of a block: vectors, radii, distances to pivots, and the scores that each slot admits."""

    def __init__(self, shape: Shape, vectors: bytes, ids: pa.Array, labels: pa.Array, asked: list[dict]):
        self.place = np.array([a["place"] for a in asked])
        self.x = np.frombuffer(vectors, shape.kind).reshape(len(ids), -1)[self.place].astype(shape.exact)
        (self.ids, self.null), self.labels = (c[self.place] for c in longs(ids)), longs(labels)[0][self.place]
        self.inner, self.outer, self.near = (np.array([a[c] for a in asked])[:, None] for c in ("inner", "outer", "near"))
        self.keys = np.array([a["keys"] for a in asked])
        self.slots = max(s["slot"] for a in asked for s in a["slots"]) + 1
        self.least, self.high = np.full((len(asked), self.slots), np.iinfo(np.int64).max), np.full((len(asked), self.slots), np.iinfo(np.int64).min)
        for k, a in enumerate(asked):
            for s in a["slots"]:
                self.least[k, s["slot"]], self.high[k, s["slot"]] = s["least"], s["high"]
        self.found = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool)]  # anchor and slot, score, row, is it null

    def read(self, pivot: int, dist: np.ndarray, ids: np.ndarray, null: np.ndarray, labels: np.ndarray, x: np.ndarray, same: bool, k: int) -> None:
        """Rows of one pivot, by distance: those in the new annuli of each anchor count, if they have its label or not."""
        key = self.keys[:, pivot][:, None]
        low = int(np.searchsorted(dist, key - self.outer, "left").min())
        high = int(np.searchsorted(dist, key + self.outer, "right").max())
        if low >= high:
            return
        dist, ids, null, labels = dist[low:high], ids[low:high], null[low:high], labels[low:high]
        gap = np.abs(dist - key)
        inside = (gap <= self.outer) & (gap > self.inner) & (dist + key >= self.near) & ((labels == self.labels[:, None]) == same)
        score = self.x @ x[low:high].T.astype(self.x.dtype)
        inside &= (score >= self.least.min(axis=1)[:, None]) & (score <= self.high.max(axis=1)[:, None])
        i, j = np.nonzero(inside)
        own = (ids[j] == self.ids[i]) & ~null[j] & ~self.null[i]
        i, j = i[~own], j[~own]
        score = score[i, j].astype(np.int64)
        pair, slot = np.nonzero((score[:, None] >= self.least[i]) & (score[:, None] <= self.high[i]))
        new = (i[pair] * self.slots + slot, score[pair], ids[j[pair]], null[j[pair]])
        merged = [np.concatenate(two) for two in zip(self.found, new, strict=True)]
        kept = first_of_groups(*merged, k)
        self.found = [c[kept] for c in merged]


class _Search:
    """Anchors in blocks, and rounds of scans over an index."""

    def __init__(self, anchors: DataFrame, found: Index, per: int):
        self.index, self.per = found, per
        self.blocks, self.count = in_blocks(anchors, ["id", "label"], found.shape, per)
        self.anchors = self._keyed()

    def _keyed(self) -> DataFrame:
        """``block, place, anchor_id, norm, keys`` of every anchor: its squared norm and its distances to the pivots."""
        shape, pivots = self.index.shape, self.index.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    ids = batch.column(1)[r].values
                    x = np.frombuffer(batch.column(2)[r].as_py(), shape.kind).reshape(len(ids), -1).astype(np.float64)
                    far = distances(x, np.zeros(len(x)), pivots)
                    keys = pa.ListArray.from_arrays(np.arange(0, far.size + 1, far.shape[1], dtype=np.int32), far.ravel())
                    block, place = np.full(len(x), batch.column(0)[r].as_py(), np.int32), np.arange(len(x), dtype=np.int32)
                    yield pa.record_batch([pa.array(block), pa.array(place), ids, pa.array((x * x).sum(axis=1)), keys], ["block", "place", "anchor_id", "norm", "keys"])

        made = self.blocks.select("block", "id", "vectors").mapInArrow(run, "block int, place int, anchor_id bigint, norm double, keys array<double>")
        return stored(made, "anchors")

    def scan(self, slots: DataFrame, same: bool, k: int) -> DataFrame:
        """One round: ``block, place, slot, score, row_id``, the ``k`` first rows that each task finds for each open slot."""
        shape, row = self.index.shape, np.dtype(self.index.shape.kind).itemsize * len(self.index.shape.order)
        one = slots.groupBy("block", "place").agg(
            *(F.max(c).alias(c) for c in ("inner", "outer")), F.min("near").alias("near"), F.collect_list(F.struct("slot", "least", "high")).alias("slots")
        )
        one = one.join(self.anchors.select("block", "place", "keys"), ["block", "place"])
        spans = one.select("block", "outer", F.posexplode("keys").alias("pivot", "key")).groupBy("block", "pivot")
        spans = spans.agg(F.min(F.col("key") - F.col("outer")).alias("from"), F.max(F.col("key") + F.col("outer")).alias("to"))
        asked = one.groupBy("block").agg(F.collect_list(F.struct("place", "inner", "outer", "near", "keys", "slots")).alias("asked"))
        asked = self.blocks.select("block", F.col("id").alias("own_ids"), F.col("label").alias("own_labels"), "vectors").join(asked, "block")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, _Asked] = {}
            for batch in batches:
                column = {name: batch.column(name) for name in batch.schema.names}
                for r in range(batch.num_rows):
                    at = {name: c[r] for name, c in column.items()}
                    block = at["block"].as_py()
                    if block not in held:
                        held[block] = _Asked(shape, at["vectors"].as_py(), at["own_ids"].values, at["own_labels"].values, at["asked"].as_py())
                    ids, null = longs(at["ids"].values)
                    x = np.frombuffer(at["rows"].as_py(), shape.kind).reshape(len(ids), -1)
                    held[block].read(at["pivot"].as_py(), np.frombuffer(at["dists"].as_py()), ids, null, longs(at["labels"].values)[0], x, same, k)
            for block, a in held.items():
                group, score, ids, null = a.found
                columns = [np.full(len(group), block, np.int32), a.place[group // a.slots].astype(np.int32), (group % a.slots).astype(np.int32), score]
                yield pa.record_batch([*map(pa.array, columns), pa.array(ids, mask=null)], ["block", "place", "slot", "score", "row_id"])

        def part(low: int, high: int) -> DataFrame:
            some = F.col("block").between(low, high)  # of PASS_BYTES at most
            near = self.index.chunks.join(F.broadcast(spans.where(some)), "pivot").where("high >= from and low <= to").drop("from", "to")
            return near.join(F.broadcast(asked.where(some)), "block").mapInArrow(run, "block int, place int, slot int, score bigint, row_id bigint")

        return in_passes(self.count, self.per * (row + 8 * len(self.index.pivots) + 256), part)

    def first(self, slots: DataFrame, same: bool, k: int) -> DataFrame:
        """``block, place, slot, score, row_id, rank``: the ``k`` first rows of each slot. ``slots`` has the least and highest
        score (``least, high``) that a slot admits, the radius beyond which no row is wanted (``limit``), the radius that rows
        must reach (``near``) and the first radius (``outer``). Rounds end when no slot is open: a slot is done when
        all rows within ``limit``, or within the distance of its k-th score, have been read."""
        keys = ["block", "place", "slot"]
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("row_id")))
        found, slots = None, stored(slots.withColumn("inner", F.lit(-1.0)), "slots")
        while not slots.isEmpty():
            new = self.scan(slots, same, k)
            new = new if found is None else new.unionByName(found.drop("rank"))
            found = stored(new.withColumn("rank", place).where(F.col("rank") <= k), "found")
            last = found.where(F.col("rank") == k).select(*keys, F.col("score").alias("last"))
            norms = self.anchors.select("block", "place", "norm")
            told = slots.join(last, keys, "left").join(norms, ["block", "place"])
            certain = F.when(F.col("last").isNull(), F.col("limit")).otherwise(F.least("limit", self.index.radius(F.col("norm"), F.col("last"))))
            wider = F.least("limit", F.when(F.col("last").isNull(), 2 * F.col("outer") - F.col("near")).otherwise(certain))
            still = told.where(certain > F.col("outer")).select(*keys, "least", "high", "limit", "near", F.col("outer").alias("inner"), wider.alias("next"))
            whole = Window.partitionBy("block", "place")  # the slots of an anchor move on together
            slots = stored(still.withColumn("outer", F.max("next").over(whole)).drop("next"), "slots")
        return found


def mine(rows: DataFrame, anchors: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", k: int = 5, negatives: int = 5, least_percent: int = LEAST_PERCENT, pivots: int = PIVOTS, chunk: int = CHUNK, per: int = QUERIES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor (rows where ``anchors``
    holds) its ``k`` first other rows of its label, and for each of these the ``negatives`` first rows of other labels with scores from
    ``least_percent`` of the positive's up to the positive's. Higher scores come first, ties by smaller identifier, null ones last.

    Rows without a label, or whose vectors are null or have null or non-finite components, take no part. Rows with an
    anchor's identifier are its own. Repeated anchors are answered each, repeated other rows count each. A positive
    without such negatives gives no rows, nor does an empty table; other columns are ignored.
    """
    taken = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), whole_numbers(F.col(vector)).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    taken = stored(taken.where("label is not null and v is not null"), "vectors")
    shape = measured(taken)
    found = index(taken, shape, pivots, chunk)
    search, most, m = _Search(taken.where("anchor"), found, per), F.lit(2**63 - 1), shape.norm**0.5
    slots = search.anchors.select(
        "block", "place", F.lit(0).alias("slot"), F.lit(-(2**63)).cast("bigint").alias("least"), most.alias("high"),
        (F.sqrt("norm") + m + found.slack).alias("limit"), F.lit(0.0).alias("near"), F.lit(m / 4 + found.slack).alias("outer"),
    )
    own = search.first(slots, True, k)
    if own is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    norms = search.anchors.select("block", "place", "anchor_id", "norm")
    positives = own.join(norms, ["block", "place"]).select("block", "place", (F.col("rank") - 1).alias("slot"), "anchor_id", F.col("row_id").alias("positive_id"), F.col("score").alias("high"), "norm")
    positives = stored(positives, "positives")
    least = F.ceil(F.col("high").cast("decimal(20,0)") * least_percent / 100).cast("bigint")
    near = F.greatest(F.min(found.radius(F.col("norm"), F.col("high"))).over(Window.partitionBy("block", "place")) - 3 * found.slack, F.lit(0.0))
    slots = positives.withColumn("least", least).where("least <= high").select(
        "block", "place", "slot", "least", "high", found.radius(F.col("norm"), F.col("least")).alias("limit"), near.alias("near"), (near + m / 16 + found.slack).alias("outer"),
    )
    hard = search.first(slots, False, negatives)
    if hard is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    hard = hard.select("block", "place", "slot", "rank", F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    told = positives.select("block", "place", "slot", "anchor_id", "positive_id", F.col("high").alias("positive_score"))
    return told.join(hard, ["block", "place", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
