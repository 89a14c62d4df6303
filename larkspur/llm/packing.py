"""Vector bin packing of token sequences by the dot-product heuristic.

Each document's identifiers (with an end identifier) are cut into pieces, and pieces are placed in sequences under
three limits at once: tokens, pieces (segments), and loss-bearing tokens. Whole sequences are cut off a long
document first. What is left of each document waits in a window; the open sequence takes the waiting piece that
fits and has the largest dot product of its size vector with the sequence's free room, both as shares of the three
limits. When none fits, the piece with the largest product is cut to fill the room. A sequence that is closed short
of its tokens, because its segments or loss-bearing tokens are used up, is cut at powers of two, which need no padding.

Which tokens bear loss is told by ``parts``: texts of a document in order, each with or without loss, as
``instructions`` makes them of the roles of conversations. Without parts every token but the end identifier bears
loss; its limit is then idle, as it is not below that of tokens.

A partition packs its own documents, so that nothing is shuffled; a partition's last sequences are cut to powers
of two as well. Identifiers of sequences are the partition's number and a counter, so that a task
that runs again, on another executor, gives the same rows.

Defined results: null and empty texts, null and empty lists of parts have the end identifier alone; repeated rows are
packed each for itself; no limit is put on a text's length; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.tokens import VOCABULARY, Encoder

END_ID = 0
#: Pieces that wait in a task: the choice is made among these.
WINDOW = 256
#: A partition's last sequence keeps at most so much padding; else it is cut at a power of two.
SPARE = 32
#: Turn numbers of a conversation that are read as one document.
TURNS = 64


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens) < 1:
            raise ValueError("limits must be 1 or more")


@dataclass
class Piece:
    """Tokens of a document. ``marks`` has the loss-bearing tokens before each of the document's tokens; without it
    they are the piece's first ones."""

    doc: int
    start: int
    length: int
    loss: int
    marks: np.ndarray | None = None

    def loss_of(self, length: int) -> int:
        """Loss-bearing tokens among the first ``length``."""
        return min(self.loss, length) if self.marks is None else int(self.marks[self.start + length] - self.marks[self.start])

    def fitting(self, tokens: int, loss: int) -> int:
        """How many of its first tokens fit in the room."""
        most = min(self.length, tokens)
        if self.marks is None:
            return most if self.loss <= loss else min(most, loss)
        return min(most, int(np.searchsorted(self.marks, self.marks[self.start] + loss, side="right")) - 1 - self.start)


class Packer:
    """Places pieces as they come; ``placed`` lists (piece, sequence, offset), to be taken away by the caller."""

    def __init__(self, limits: Limits, first_sequence: int, window: int = WINDOW):
        self.limits, self.next, self.window = limits, first_sequence, window
        self.placed: list[tuple[Piece, int, int]] = []
        self.waiting: list[Piece] = []
        self.sizes = np.zeros((window + 1, 3))
        self._open()

    def _open(self) -> None:
        self.current: list[Piece] = []
        self.used, self.loss = 0, 0

    def _close(self, pieces: list[Piece]) -> None:
        offset = 0
        for piece in pieces:
            self.placed.append((piece, self.next, offset))
            offset += piece.length
        self.next += 1

    def _close_open(self) -> None:
        """Closes the open sequence, cut at powers of two where it would be padded by more than ``SPARE``."""
        queue, left = self.current, self.used
        while left:
            take = left if self.limits.tokens - left <= SPARE else 1 << (left.bit_length() - 1)
            left, pieces = left - take, []
            while take:
                pieces.append(queue.pop(0) if queue[0].length <= take else self._cut(queue[0], take))
                take -= pieces[-1].length
            self._close(pieces)
        self._open()

    def _place(self, piece: Piece) -> None:
        self.current.append(piece)
        self.used += piece.length
        self.loss += piece.loss
        if self.used == self.limits.tokens or len(self.current) == self.limits.segments:
            self._close_open()

    def _cut(self, piece: Piece, length: int) -> Piece:
        """Takes the first ``length`` tokens off."""
        loss = piece.loss_of(length)
        head = Piece(piece.doc, piece.start, length, loss, piece.marks)
        piece.start, piece.length, piece.loss = piece.start + length, piece.length - length, piece.loss - loss
        return head

    def add(self, piece: Piece) -> None:
        while piece.length >= self.limits.tokens and piece.fitting(self.limits.tokens, self.limits.loss_tokens) == self.limits.tokens:
            self._close([self._cut(piece, self.limits.tokens)])
        if piece.length:
            self.sizes[len(self.waiting)] = self._size(piece)
            self.waiting.append(piece)
            while len(self.waiting) > self.window:
                self._step()

    def _size(self, piece: Piece) -> tuple[float, float, float]:
        return piece.length / self.limits.tokens, 1 / self.limits.segments, piece.loss / self.limits.loss_tokens

    def _take(self, k: int) -> Piece:
        piece, last = self.waiting[k], self.waiting.pop()
        if last is not piece:
            self.waiting[k], self.sizes[k] = last, self.sizes[len(self.waiting)]
        return piece

    def _step(self) -> None:
        """The waiting piece with the largest dot product of size and free room is placed, or cut to the room."""
        free = self.limits.tokens - self.used, self.limits.segments - len(self.current), self.limits.loss_tokens - self.loss
        room = np.array([free[0] / self.limits.tokens, free[1] / self.limits.segments, free[2] / self.limits.loss_tokens])
        sizes = self.sizes[: len(self.waiting)]
        score = sizes @ room
        fits = (sizes <= room + 1e-12).all(axis=1)
        if fits.any():
            self._place(self._take(int(np.where(fits, score, -1.0).argmax())))
            return
        k = int(score.argmax())
        piece = self.waiting[k]
        length = piece.fitting(free[0], free[2])
        if not length:  # nothing without loss is left for this sequence
            self._close_open()
            return
        head = self._cut(piece, length)
        self.sizes[k] = self._size(piece)
        self._place(head)

    def finish(self) -> None:
        """Empties the window and closes the last sequence."""
        while self.waiting:
            self._step()
        self._close_open()


_SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint"


def instructions(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",), stretch: int = TURNS) -> DataFrame:
    """``key`` (a struct of the conversation and the number of its stretch) and ``parts``: conversations for ``pack``.

    The turns of the given roles bear loss. A conversation is read in stretches of ``stretch`` turn numbers, so that
    no task gets a whole one however long it is; repeated turns count once, a null turn number stands first.
    """
    part = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(role).isin(*loss_roles), F.lit(False)).alias("loss"))
    number = F.coalesce(F.floor(F.col(turn) / stretch), F.lit(0)).alias("stretch")
    grouped = turns.groupBy(F.col(key).alias("conversation"), number).agg(F.array_sort(F.collect_set(part)).alias("parts"))
    return grouped.select(F.struct("conversation", "stretch").alias("key"), F.transform("parts", lambda p: F.struct(p["text"].alias("text"), p["loss"].alias("loss"))).alias("parts"))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits(), vocabulary: str = VOCABULARY, with_ids: bool = False, parts: str | None = None) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence; ``ids`` too if asked for.

    ``parts``: a column of ``array<struct<text: string, loss: boolean>>`` that is read in place of ``text``.
    """
    kind = dict(docs.dtypes)[key]
    end = END_ID.to_bytes(4, "little")

    def encoded(encoder: Encoder, value) -> tuple[bytes, int, np.ndarray | None]:
        """A document's identifiers, its loss-bearing tokens and where they are."""
        if parts is None:
            ids = encoder.encode(value or "") + end
            return ids, len(ids) // 4 - 1, None
        made = [(encoder.encode(p["text"] or ""), bool(p["loss"])) for p in value or [] if p is not None] + [(end, False)]
        marks = np.cumsum(np.concatenate([[0], np.repeat([loss for _, loss in made], [len(ids) // 4 for ids, _ in made])]))
        return b"".join(ids for ids, _ in made), int(marks[-1]), marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        held: dict[int, tuple[object, bytes, int]] = {}  # number of a document: key, ids, tokens not yet handed over
        number = 0

        def out() -> pa.RecordBatch:
            done, packer.placed, rows = packer.placed, [], []
            for piece, sequence, offset in done:
                name, ids, left = held[piece.doc]
                part = ids[4 * piece.start : 4 * (piece.start + piece.length)]
                rows.append((name, piece.start, piece.length, zlib.crc32(part), len(ids) // 4, sequence, offset, piece.loss, part))
                if left == piece.length:
                    del held[piece.doc]
                else:
                    held[piece.doc] = (name, ids, left - piece.length)
            names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"]
            types = [keys, *[pa.int64()] * 7, pa.binary()]
            n = len(names) if with_ids else len(names) - 1
            return pa.record_batch([pa.array([r[k] for r in rows], types[k]) for k in range(n)], names[:n])

        keys = pa.int64()
        for batch in batches:
            keys = batch.column(0).type
            for row in range(batch.num_rows):  # one text at a time leaves the batch
                ids, loss, marks = encoded(encoder, batch.column(1)[row].as_py())
                n = len(ids) // 4
                held[number] = (batch.column(0)[row].as_py(), ids, n)
                packer.add(Piece(number, 0, n, loss, marks))
                number += 1
                if len(packer.placed) > 1024:
                    yield out()
        packer.finish()
        if packer.placed:
            yield out()

    schema = f"key {kind}, {_SCHEMA}" + ", ids binary" * with_ids
    pairs = docs.select(F.col(key).alias("key"), F.col(parts or text).alias("text"))
    return pairs.mapInArrow(run, schema).withColumnRenamed("key", key)
