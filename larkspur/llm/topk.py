"""Exact top-k search by inner product: columnar branch-and-bound.

Candidates are stored in chunks whose dimensions lie one after the other (vertical layout), in blocks of dimensions by
falling mass, with each candidate's remaining norm after every block. Partial scores grow block by block for all queries of
a block at once. After each block, a pair whose partial score and product of remaining norms cannot reach the query's
present k-th score goes; once few are left, the survivors are compacted to a list of pairs and only these are carried on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import stored
from larkspur.llm.vectors import QUERIES, Shape, first_of_groups, in_blocks, in_passes, longs, matrix, measured, whole_numbers

#: Candidates in a chunk, and those of a task's first chunk that give each query its first bound.
CHUNK, FIRST = 4096, 256
#: Dimensions in a block, and the share of pairs alive at which they are compacted.
WIDTH, FEW = 8, 0.125


def remaining(x: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Norms of what is left of each row after each block of dimensions, one row for each block."""
    tail = np.cumsum((x.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.stack([tail[:, at] if at < x.shape[1] else np.zeros(len(x)) for at in _ends(x.shape[1], width)]))


def _ends(dims: int, width: int) -> list[int]:
    return [min(at + width, dims) for at in range(0, max(dims, 1), width)]


def vertical(rows: DataFrame, shape: Shape, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """A stored table of chunks: ``ids``, ``rest`` (remaining norms) and ``b0, b1, ...``, a block of dimensions each."""
    dims, ends = len(shape.order), _ends(len(shape.order), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                x = matrix(part.column(1), dims)[:, shape.order]
                blocks = [x[:, a:z].T.astype(shape.kind).tobytes() for a, z in zip([0, *ends], ends, strict=False)]
                ids = pa.ListArray.from_arrays([0, part.num_rows], part.column(0))
                yield pa.record_batch([ids, *(pa.array([b], pa.binary()) for b in (remaining(x, width).tobytes(), *blocks))], ["ids", "rest", *(f"b{k}" for k in range(len(ends)))])

    schema = ", ".join(["ids array<bigint>, rest binary", *(f"b{k} binary" for k in range(len(ends)))])
    return stored(rows.select("id", "v").mapInArrow(run, schema), "vertical")


class _Best:
    """The best candidates so far of a block of queries."""

    def __init__(self, ids: pa.Array, vectors: bytes, shape: Shape, k: int, width: int):
        self.ids, self.null = longs(ids)
        self.x = np.frombuffer(vectors, shape.kind).reshape(len(self.ids), -1).astype(shape.exact)
        self.rest, self.ends, self.k, self.slack = remaining(self.x, width), _ends(self.x.shape[1], width), k, shape.slack
        self.found = [np.zeros(0, np.int64), np.zeros(0, shape.exact), np.zeros(0, np.int64), np.zeros(0, bool)]  # query, score, candidate, is it null
        self.floor = np.full(len(self.ids), -np.inf)

    def look(self, ids: np.ndarray, null: np.ndarray, blocks: list[np.ndarray], rest: np.ndarray) -> None:
        score, i, j = np.zeros((len(self.ids), len(ids)), self.x.dtype), None, None
        for b, (low, high) in enumerate(zip([0, *self.ends], self.ends, strict=False)):
            q, own, theirs = self.x[:, low:high], self.rest[b], rest[b]
            if i is None:
                score += q @ blocks[b]
                alive = score + (own[:, None] * theirs + self.slack) >= self.floor[:, None]
                if np.count_nonzero(alive) <= FEW * alive.size or high == self.ends[-1]:
                    i, j = np.nonzero(alive)
                    score = score[i, j]
            else:
                score = score + np.einsum("ij,ji->i", q[i], blocks[b][:, j])
                alive = score + (own[i] * theirs[j] + self.slack) >= self.floor[i]
                i, j, score = i[alive], j[alive], score[alive]
        other = (ids[j] != self.ids[i]) | null[j] | self.null[i]
        i, j, score = i[other], j[other], score[other]
        merged = [np.concatenate(two) for two in zip(self.found, (i, score, ids[j], null[j]), strict=True)]
        kept = first_of_groups(*merged, self.k)
        self.found = [c[kept] for c in merged]
        filled = np.bincount(self.found[0], minlength=len(self.ids)) == self.k
        last = np.cumsum(np.bincount(self.found[0], minlength=len(self.ids))) - 1
        self.floor[filled] = self.found[1][last[filled]]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH, chunk: int = CHUNK, per: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` candidates with the highest inner products, ties by smaller
    identifier, null identifiers last; all of them if there are fewer.

    Rows with a query's identifier are its own and never its candidates. Vectors that are null or have null or
    non-finite components take no part. Repeated candidate rows are candidates each; repeated query rows are answered each.
    Vectors without components score 0. Empty tables give no rows; other columns are ignored.
    """
    asked, given = (df.select(F.col(key).cast("bigint").alias("id"), whole_numbers(F.col(vector)).alias("v")).where("v is not null") for df in (queries, candidates))
    shape = measured(given.unionByName(asked))
    blocks, count = in_blocks(asked, ["id"], shape, per)
    blocks, chunks = blocks.withColumnRenamed("id", "asked"), vertical(given, shape, width, chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            names, n = batch.schema.names, len(_ends(len(shape.order), width))
            column = {name: batch.column(name) for name in names}
            for r in range(batch.num_rows):
                block = column["block"][r].as_py()
                if block not in best:
                    best[block] = _Best(column["asked"][r].values, column["vectors"][r].as_py(), shape, k, width)
                ids, null = longs(column["ids"][r].values)
                parts = [np.frombuffer(column[f"b{b}"][r].as_py(), shape.kind).reshape(-1, len(ids)).astype(shape.exact) for b in range(n)]
                rest = np.frombuffer(column["rest"][r].as_py()).reshape(n, len(ids))
                first = FIRST if not len(best[block].found[0]) else 0
                for part in (slice(0, first), slice(first, None)):
                    best[block].look(ids[part], null[part], [p[:, part] for p in parts], rest[:, part])
        for block, b in best.items():
            query, score, row, null = b.found
            yield pa.record_batch(
                [pa.array(np.full(len(query), block, np.int32)), pa.array(query.astype(np.int32)), pa.array(b.ids[query], mask=b.null[query]), pa.array(row, mask=null), pa.array(score.astype(np.int64))],
                ["block", "place", "query_id", "vec_id", "score"],
            )

    def scan(low: int, high: int) -> DataFrame:
        some = F.broadcast(blocks.where(F.col("block").between(low, high)))  # PASS_BYTES at most
        pairs = chunks.withColumn("block", F.explode(F.sequence(F.lit(low), F.lit(high)))).join(some, "block")
        return pairs.mapInArrow(run, "block int, place int, query_id bigint, vec_id bigint, score bigint")

    found = in_passes(count, per * len(shape.order) * np.dtype(shape.kind).itemsize, scan)
    place = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

