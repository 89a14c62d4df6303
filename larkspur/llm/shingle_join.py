"""Near-duplicate components by the exact similarity of shingle sets of ``SIMILARITY`` or more.

A text is read as the set of its 5-word shingles (words as in ``simhash``), each a 64-bit hash. Two texts link if
their sets' Jaccard similarity is 4/5 or more. Equal sets are one node, so copies never multiply. Candidates come from

* SimHash: nodes of equal fingerprints, and the spanning forest of fingerprints ``simhash.BUDGET`` bits apart, found by
  the trie self-join. Texts at a similarity of 0.8 lie 5 to 13 bits apart as a rule, where a self-join of fingerprints
  would have to look at a share of all pairs that does not shrink with the corpus;
* bands of minima: ``ROWS`` smallest hashes of a set under as many orders make a band, of which there are ``BANDS``. Two
  sets of similarity s have a band in common with probability ``1 - (1 - s ** ROWS) ** BANDS``: all but one in two million
  at 0.8, one in three hundred at 0.2, so that a passage that many texts share makes few candidates.

Large groups are tied first: SimHash's candidates, and each band's smallest node with its other nodes. Then
only nodes of one band that are still in different components are compared with each other, in chunks as in
``simhash``. Candidates pass filters that never drop a link: sizes, and parities of the shingles' hashes in classes (sets
differ in as many shingles as parities at least), 512 classes first and then, for larger sets, as many as twice their
shingles. What is left is decided by whole sets.

Defined results: null, empty and blank texts are copies of each other; documents with fewer words than a shingle
are one shingle; texts are read whole; repeated rows get the same component; an empty table gives no rows.
Component identifiers are the smallest document identifier reachable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import simhash
from larkspur.llm.common import in_batches, stored, text_bytes
from larkspur.llm.components import components

SHINGLE, SIMILARITY = 5, (4, 5)
#: Longs of parities, and nodes of a shingle (or of a chunk of them) that one task compares.
PARITIES, CHUNK = 8, 1024
#: Nodes up to which those whose texts are read again are broadcast; beyond, they are joined by shuffle.
BROADCAST_NODES = 300_000
#: Orders in a band, and bands of a node. More bands miss less, more orders make fewer candidates.
ROWS, BANDS = 6, 48
#: Odd multipliers of the orders.
_ORDERS = np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_ORDERS = (_ORDERS ^ _ORDERS >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
_MAPS = [f"p{k}" for k in range(PARITIES)]


def shingle_set(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The ascending hashes of a text's different shingles."""
    return np.unique(np.frombuffer(simhash.digests(raw, shingle), ">u8").astype(np.uint64))


def _node(values: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(values.tobytes()), "big", signed=True)


def bands(values: np.ndarray) -> np.ndarray:
    """A key for each band of a set's minima; none for an empty set."""
    if not len(values):
        return np.zeros(0, np.int64)
    least = np.full(len(_ORDERS), (1 << 64) - 1, np.uint64)
    for at in range(0, len(values), 128):
        np.minimum(least, (values[at : at + 128, None] * _ORDERS).min(axis=0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _parities(values: np.ndarray, longs: int = PARITIES) -> np.ndarray:
    """The parities of the numbers of values in ``64 * longs`` classes; longs is a power of two."""
    odd = np.bincount((values & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _wide(values: np.ndarray) -> np.ndarray:
    """Parities in two classes a value at least; none where ``PARITIES`` longs have as many."""
    longs = 1 << max(0, 2 * len(values) - 1).bit_length() >> 6
    return _parities(values, longs) if longs > PARITIES else np.zeros(0, np.int64)


def _apart(x: Column, y: Column) -> Column:
    """In how many parities two wide maps differ, the larger one folded to the smaller one's classes."""

    def folded(a: Column, b: Column) -> Column:
        half = F.size(a) / 2
        return F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, F.lit(1), half.cast("int")), F.slice(a, half.cast("int") + 1, half.cast("int")), lambda u, v: u.bitwiseXOR(v))).otherwise(a)

    # sets whose sizes pass have maps of one size or of two neighbouring ones
    counts = F.zip_with(folded(x, y), folded(y, x), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.aggregate(counts, F.lit(0), lambda a, v: a + v)).otherwise(0)


def _described(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``key, node, fp, n``, the parities, ``bands`` and ``wide`` of every document."""
    kind = dict(docs.dtypes)[key]

    def listed(arrays: list[np.ndarray]) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            fixed, keys, wide = [], [], []
            for raw in text_bytes(batch.column(1)):
                all_ = simhash.digests(raw, shingle)
                values = np.unique(np.frombuffer(all_, ">u8").astype(np.uint64))
                n = len(values)
                print_ = np.array([simhash.majority(all_)], np.uint64).view(np.int64)
                fixed.append(np.concatenate([[_node(values)], print_, [n], _parities(values)]))
                keys.append(bands(values))
                wide.append(_wide(values))
            columns = np.array(fixed, np.int64).reshape(len(fixed), 3 + PARITIES).T
            lists = [listed(keys), listed(wide)]
            return pa.record_batch([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in columns), *lists], ["key", "node", "fp", "n", *_MAPS, "bands", "wide"])

        return work

    schema = f"key {kind}, node bigint, fp bigint, n bigint, {', '.join(f'{m} bigint' for m in _MAPS)}, bands array<bigint>, wide array<bigint>"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(in_batches(make), schema)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Columns of long as rows of an array, cut between values of the first, by which they are sorted."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns])
        last = np.flatnonzero(rows[0] != rows[0][-1])
        whole = last[-1] + 1 if len(last) else 0
        if held and (whole or held[-1][0, -1] != rows[0, 0]):
            yield np.concatenate([*held, rows[:, :whole]], axis=1)
            held = []
        elif whole:
            yield rows[:, :whole]
        held.append(rows[:, whole:])
    if held:
        yield np.concatenate(held, axis=1)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (band, node, n) in order: the rows of bands with several nodes, with the smallest of them. Of what went before,
    only the last row is kept, and its band's first node: a band never meets in memory."""
    last: np.ndarray | None = None  # band, node, n, lead, lead_n of the last row
    waits = False  # it is its band's only one so far, and has not been handed on
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns])
        if last is not None:
            rows = np.concatenate([last[:3, None], rows], axis=1)
        # a node may have a band twice
        differ = np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
        rows = rows[:, differ]
        start = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        size = np.diff(start, append=rows.shape[1])
        lead, lead_n = rows[1, start], rows[2, start]
        several = size > 1
        if last is not None:
            lead[0], lead_n[0] = last[3:]
            several[0] |= not waits
        kept = np.repeat(several, size)
        if last is not None:
            kept[0] &= waits  # else it has been handed on
        lead, lead_n = np.repeat(lead, size), np.repeat(lead_n, size)
        yield pa.record_batch([pa.array(x[kept]) for x in (*rows, lead, lead_n)], ["band", "node", "n", "lead", "lead_n"])
        last, waits = np.array([*rows[:, -1], lead[-1], lead_n[-1]]), not several[-1]


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (task, node, lead, label, n, parities) sorted by task: pairs of a task's nodes that the filter passes."""
    for rows in _groups(batches):
        task, node, lead, label, n = rows[:5]
        maps, at, ahead = rows[5:].T, np.arange(len(task)), 0
        while len(at):
            ahead += 1
            at = at[at + ahead < len(task)]
            at = at[task[at] == task[at + ahead]]
            i, j = at, at + ahead
            fits = (label[i] != label[j]) & (node[i] != lead[i]) & (node[j] != lead[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
            i, j = i[fits], j[fits]
            near = 9 * np.bitwise_count(maps[i].view(np.uint64) ^ maps[j].view(np.uint64)).sum(axis=1, dtype=np.int64) <= n[i] + n[j]
            if near.any():
                a, b = node[i[near]], node[j[near]]
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _fit(n: Column, m: Column) -> Column:
    """May sets of these sizes be similar enough?"""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _verified(pairs: DataFrame, first: DataFrame, docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """The pairs of nodes ``a, b`` whose sets are similar enough."""

    def joined(pairs: DataFrame, facts: list[str]) -> DataFrame:
        for s in "ab":
            pairs = pairs.join(first.select(F.col("node").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in facts)), s)
        return pairs

    both = joined(pairs, ["n", *_MAPS])
    differ = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in _MAPS), F.lit(0))
    most = F.col("a_n") + F.col("b_n")
    pairs = both.where(_fit(F.col("a_n"), F.col("b_n")) & (9 * differ <= most)).select("a", "b", "a_n", "b_n")
    pairs = joined(pairs, ["wide"]).where(9 * _apart(F.col("a_wide"), F.col("b_wide")) <= most)
    pairs = stored(pairs.select("a", "b", "a_n", "b_n"), "candidates")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(first.select("node", "first"), "node"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, sets = [], []
            for wanted, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                values = shingle_set(raw, shingle)
                node = _node(values)
                if wanted is None or wanted == node:  # an identifier may have other texts as well
                    nodes.append(node)
                    sets.append(values.view(np.int64))
            return pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "grams"])

        return work

    texts = docs.select(F.col(key).alias("first"), F.col(text).alias("text"))
    nameless = texts.where("first is null").select(F.lit(None).cast("bigint").alias("node"), "text")
    texts = texts.join(wanted, "first").select("node", "text").unionByName(nameless)
    sets = texts.mapInArrow(in_batches(make), "node bigint, grams array<bigint>").groupBy("node").agg(F.first("grams").alias("grams"))
    sets = stored(sets, "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    return stored(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.col("a_n") + F.col("b_n"))).select("a", "b"), "links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key, component_id`` for every document."""
    told = stored(_described(docs, key, text, shingle), "shingles")
    # any row of a node has the node's facts; its text is read again by a document's identifier
    first = stored(told.groupBy("node").agg(F.min("key").alias("first"), *(F.min(c).alias(c) for c in ("fp", "n", *_MAPS)), *(F.first(c).alias(c) for c in ("wide", "bands"))), "nodes")
    banded = first.select(F.explode("bands").alias("band"), "node", "n").repartition("band").sortWithinPartitions("band", "node")
    shared = stored(banded.mapInArrow(_shared, "band bigint, node bigint, n bigint, lead bigint, lead_n bigint"), "shared")

    prints = stored(first.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    reps = [prints.select(F.col("fp").alias(s), F.col("rep").alias(f"rep_{s}")) for s in "ab"]
    forest = simhash.links(prints.select("fp")).join(reps[0], "a").join(reps[1], "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    alike = first.join(prints, "fp").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    star = shared.where(_fit(F.col("n"), F.col("lead_n"))).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    pairs = forest.unionByName(alike).unionByName(star).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tied = _verified(pairs, first, docs, key, text, shingle)

    label = stored(components(tied).withColumnRenamed("root", "label"), "labels")
    rows = stored(shared.join(label, "node", "left").select("band", "node", "lead", F.coalesce("label", "node").alias("label")), "labelled")
    open_ = stored(rows.groupBy("band").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("size > 2 and low != high").select("band", "size"), "open")
    chunks = F.ceil(F.col("size") / F.lit(CHUNK))
    own = F.pmod(F.xxhash64("node"), chunks)
    dealt = (
        rows.join(open_, "band")
        .join(first.select("node", "n", *_MAPS), "node")
        .select("*", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("other"))
        .select(F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "node", "lead", "label", "n", *_MAPS)
    )
    pairs = dealt.repartition("task").sortWithinPartitions("task").mapInArrow(_crossing, "a bigint, b bigint").distinct()
    late = _verified(pairs, first, docs, key, text, shingle)

    root = stored(components(tied.unionByName(late)), "classes")
    rooted = stored(first.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first"), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    member = stored(rooted.join(least, "root").select("node", "component_id"), "members")
    return told.join(member, "node").select(F.col("key").alias(key), "component_id")
