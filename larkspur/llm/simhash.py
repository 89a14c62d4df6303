"""SimHash fingerprints and their near-duplicate components, by a binary trie self-join.

A document's text is lower-cased (A-Z), cut in words at white space and read as 4-word shingles, repeats included.
A fingerprint bit is set if it is set in more than half of the shingles' XXH64 hashes (seed 42). Two fingerprints
link at ``BUDGET`` or fewer differing bits.

The join works on distinct fingerprints, so copies never multiply. With six blocks of bits and at most four
differing bits, two blocks of a linked pair agree; for each of the fifteen pairs of blocks, fingerprints that agree
on both form a trie. The trie is joined with itself: pairs of nodes are taken down together, bit by bit, differing
bits are added up, and a pair is dropped as soon as it exceeds the budget. A node is a range of the sorted
fingerprints, and all pairs of a level are handled at once in numpy. What leaves a task is a spanning forest of the
links it found, never the links themselves: as many edges as fingerprints at most.

A trie with more than ``SPLIT`` fingerprints is split again in the same way: the bits that its fingerprints do not share
yet make six blocks, of which two agree in a linked pair, and each pair of blocks gives narrower tries. So a
fingerprint goes to fifteen tries more, not to as many as the trie is large. After ``LEVELS`` levels 45 bits or more are
shared. What then has more than ``CHUNK`` fingerprints is dealt out by hash as pairs of chunks, each a task's worth,
which compares every pair of its fingerprints exactly once or more. No candidate is dropped anywhere.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; documents with fewer
words than a shingle are one shingle; texts are read whole; repeated rows get the same component; an empty table
gives no rows; columns other than the identifier and the text are not read. Component identifiers are the smallest
document identifier reachable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import in_batches, stored, text_bytes
from larkspur.llm.components import components

SHINGLE, SEED, BUDGET = 4, 42, 4
#: Lowest bit and width of the six blocks; BUDGET + 2 blocks, so that two always agree.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Fingerprints of a trie (or of a chunk of it) that one task joins, of a trie that is not split again, and levels of
#: splitting. A split costs fifteen copies, as many as chunks in a trie of this size.
CHUNK, SPLIT, LEVELS = 1024, 15 * 1024, 3
#: Pairs of trie nodes with so many pairs of leaves are compared leaf by leaf.
LEAVES = 64


def digests(raw: bytes, shingle: int = SHINGLE) -> bytes:
    """The eight-byte hashes of a text's shingles, repeats included; none if it has no words."""
    words = raw.lower().split()  # bytes: only A-Z change, only the six white-space bytes separate
    if not words:
        return b""
    plain = b" ".join(words)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], stop[:-1] + 1])
    if len(words) > shingle:
        start, stop = start[: 1 - shingle], stop[shingle - 1 :]
    else:
        start, stop = start[:1], stop[-1:]
    digest = xxhash.xxh64_digest
    return b"".join([digest(plain[s:e], SEED) for s, e in zip(start.tolist(), stop.tolist(), strict=True)])


def majority(raw_hashes: bytes) -> int:
    """The 64 bits that are set in more than half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    hashes = np.frombuffer(raw_hashes, dtype=np.uint8).reshape(-1, 8)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text's bytes."""
    return majority(digests(raw, shingle))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key`` and ``fp``, the fingerprint as a signed long."""
    kind = dict(docs.dtypes)[key]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(x, shingle) for x in text_bytes(batch.column(1))], dtype=np.uint64)
            return pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["key", "fp"])

        return work

    pairs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return pairs.mapInArrow(in_batches(make), f"key {kind}, fp bigint").withColumnRenamed("key", key)


def _ranges(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range, its number repeated, and its positions: flattened."""
    which = np.repeat(np.arange(len(start)), length)
    ahead = np.cumsum(length) - length
    return which, np.arange(len(which)) - ahead[which] + start[which]


def trie_links(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of linked values inside each range; values ascend (unsigned) inside a range."""
    pair = np.stack([starts, ends, starts, ends, np.zeros(len(starts), np.int64)])[:, ends - starts > 1].astype(np.int64)
    for bit in range(63, -2, -1):
        a0, a1, b0, b1, d = pair
        small = ((a1 - a0) * (b1 - b0) <= LEAVES) | (bit < 0)
        leaf = pair[:, small]
        for at in range(0, leaf.shape[1], 1 << 14):
            la0, la1, lb0, lb1, _ = leaf[:, at : at + (1 << 14)]
            which, i = _ranges(la0, la1 - la0)
            again, j = _ranges(lb0[which], (lb1 - lb0)[which])
            i = i[again]
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if near.any():
                yield i[near], j[near]
        pair = pair[:, ~small]
        if not pair.shape[1]:
            return
        a0, a1, b0, b1, d = pair
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        itself = a0 == b0
        children = [
            np.stack([a0, am, b0, bm, d]),
            np.stack([am, a1, bm, b1, d]),
            np.stack([a0, am, bm, b1, d + 1]),
            np.stack([am, a1, b0, bm, d + 1])[:, ~itself],
        ]
        pair = np.concatenate(children, axis=1)
        twins = (pair[0] == pair[2]) & (pair[1] - pair[0] < 2)
        pair = pair[:, (pair[0] < pair[1]) & (pair[2] < pair[3]) & (pair[4] <= budget) & ~twins]


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merges the classes of i and j; root[x] <= x points to the class's smallest position."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return root
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by trie and fingerprint; a trie that a batch cuts off waits for the next batch."""
    held = None

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((rows[1].view(np.uint64), rows[0]))
        trie, values = rows[0][order], rows[1][order].view(np.uint64)
        cut = np.flatnonzero(np.concatenate([[True], trie[1:] != trie[:-1], [True]]))
        root = np.arange(len(values))
        for i, j in trie_links(values, cut[:-1], cut[1:]):
            root = unite(root, i, j)
        tied = np.flatnonzero(root != np.arange(len(root)))
        signed = values.view(np.int64)
        return pa.record_batch([pa.array(signed[tied]), pa.array(signed[root[tied]])], ["a", "b"])

    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns])
        if held is not None:
            rows = np.concatenate([held, rows], axis=1)
        last = np.flatnonzero(rows[0] != rows[0][-1])
        whole = last[-1] + 1 if len(last) else 0
        held = rows[:, whole:]
        if whole:
            yield edges(rows[:, :whole])
    if held is not None:
        yield edges(held)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _pairs_of_blocks(blocks: list[int]) -> list[int]:
    return [x | y for k, x in enumerate(blocks) for y in blocks[k + 1 :]]


def _narrower(mask: int) -> list[int]:
    """The masks of a trie's tries: its own bits and two of the six blocks of the others."""
    free = [b for b in range(64) if not mask >> b & 1]
    ends = [len(free) * k // 6 for k in range(7)]
    return [mask | more for more in _pairs_of_blocks([sum(1 << b for b in free[a:z]) for a, z in zip(ends, ends[1:], strict=False)])]


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: a spanning forest of the links between the distinct fingerprints ``fp``."""
    spark = distinct.sparkSession
    masks = _pairs_of_blocks([(1 << width) - 1 << low for low, width in BLOCKS])
    rows = distinct.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    chunks = F.ceil(F.col("n") / F.lit(CHUNK))
    own = F.pmod(F.xxhash64("fp"), chunks)
    dealt = None
    for level in range(LEVELS):
        rows = rows.withColumn("trie", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        sizes = stored(rows.groupBy("trie").agg(F.count("*").alias("n")).where("n > 1"), "tries")
        large = sizes.where(F.col("n") > SPLIT).select("trie")
        deeper = level + 1 < LEVELS and not large.isEmpty()
        part = (
            rows.join(sizes.where(F.col("n") <= SPLIT) if deeper else sizes, "trie")
            .select("trie", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("other"))
            .select(F.xxhash64("trie", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "fp")
        )
        dealt = part if dealt is None else dealt.unionByName(part)
        if not deeper:
            break
        # fifteen masks for each of fifteen, and once more: a table of fixed size
        inner = spark.createDataFrame([(_signed(m), [_signed(x) for x in _narrower(m)]) for m in masks], "mask bigint, inner array<bigint>")
        masks = sorted({x for m in masks for x in _narrower(m)})
        split = stored(rows.join(large, "trie", "left_semi").select("fp", "mask"), "split")
        rows = split.join(F.broadcast(inner), "mask").select("fp", F.explode("inner").alias("mask"))
    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(_forest, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key, fp, component_id`` for every document."""
    prints = stored(fingerprints(docs, key, text, shingle), "fingerprints")
    first = stored(prints.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    tied = stored(components(links(first.select("fp"))).withColumnRenamed("node", "fp"), "classes")
    rooted = first.join(tied, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    rooted = stored(rooted, "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    member = stored(rooted.join(least, "root").select("fp", "component_id"), "members")
    return prints.join(member, "fp").select(key, "fp", "component_id")
