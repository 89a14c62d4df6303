"""Removal of repeated passages: every byte covered by a string of 100 bytes that also starts earlier.

Earlier means in a document with a smaller identifier, or before in the same one; strings are judged on the input.
Strings that are equal must meet in one task, without every position of the corpus travelling there:

1. Each string of 100 bytes has an anchor, its 24-byte part with the smallest hash (the first of these). Neighbouring
   strings share their anchor, so a document becomes about one *segment* for 39 bytes: the strings with one anchor,
   together. Equal strings have equal anchors. A task collapses equal segments of its slice before anything is sent.
2. Segments meet by anchor. Equal ones are settled by their hashes: all but the earliest repeat. An anchor with one
   segment only is done. What is left are anchors with different segments, as at the edges of shared passages; they are
   numbered as they pass, so that no task holds an anchor's segments.
3. Their bytes form shards, whose suffixes are sorted by external induced sorting (``induced.py``). Runs of suffixes
   with common prefixes of 100 bytes are equal strings; all but the earliest of a run repeat.
4. Anchors with ``OFTEN`` different segments or more, by that exact number, are dealt out string by string, by the
   strings' own hashes, so that no task sorts them all. Those that are found ``STRETCH_OFTEN`` times in a stretch of the
   corpus are not even sent to step 2, which spreads the work and leaves the result as it is.
5. Repeated strings go back to their documents, where they are joined to removed runs.

Nothing is dropped or capped: a frequent anchor changes only the way in which its strings meet. Positions travel
back by a shuffle join with the documents, at every size alike.

Defined results: null texts are empty; texts of fewer than 100 bytes lose nothing; rows with equal identifier and
text count as one document and all get its result (identifiers are expected to tell different texts apart); a null
identifier counts as larger than all others; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import induced
from larkspur.llm.common import in_batches, slices, stored, text_bytes

WINDOW, GRAM = 100, 24
#: Different segments at an anchor from which on its strings are dealt out one by one. Anchors whose counts in stretches
#: of ``STRETCH`` segments, where they are ``STRETCH_OFTEN`` or more, come to as many are known before; of the others, a
#: stretch has fewer each.
OFTEN, STRETCH_OFTEN, STRETCH = 4096, 4, 1 << 21
#: Bytes of text in a slice, and of segments in a shard that is sorted at a time.
SLICE_BYTES, SHARD_BYTES = 1 << 20, 3 << 20
#: Frequent anchors up to which their table is broadcast.
BROADCAST_OFTEN = 100_000
LAST = (1 << 63) - 1

_SCHEMA = "kind tinyint, doc bigint, lo bigint, w bigint, anchor bigint, seg bigint"
_NAMES = ["kind", "doc", "lo", "w", "anchor", "seg"]
SEGMENT, REPEATED, COUNTED, OPEN = range(4)


class Hashes:
    """Polynomial hashes (modulo 2 ** 64) of all parts of a buffer."""

    def __init__(self, seed: int):
        self.base = (0x9E3779B97F4A7C15 * (2 * seed + 1) | 1) & (1 << 64) - 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def read(self, data: np.ndarray) -> None:
        if len(self.up) <= len(data):
            n = len(data) + 1
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(n, self.base, np.uint64)]))
            self.down = np.cumprod(np.concatenate([one, np.full(n, self.inverse, np.uint64)]))
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        value = (self.sums[stop] - self.sums[start]) * self.down[start]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        return value ^ value >> np.uint64(32)


def segments(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, grams: Hashes, whole: Hashes):
    """document number, first string's place in the buffer, number of strings, anchor hash, segment hash."""
    n, width = len(data), WINDOW - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams.read(data)
    whole.read(data)
    place = np.arange(n - GRAM + 1)
    low = np.uint64((1 << 32) - 1)
    least = (grams.of(place, place + GRAM) & ~low) | place.astype(np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    least = np.minimum(least[: len(least) - rest], least[rest:])
    at = (least & low).astype(np.int64)
    many = np.maximum(stops - starts - WINDOW + 1, 0)  # strings of each document
    doc = np.repeat(np.arange(len(starts)), many)
    string = starts[doc] + np.arange(len(doc)) - (np.cumsum(many) - many)[doc]
    if not len(string):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor_at = at[string]
    first = np.flatnonzero(np.concatenate([[True], (anchor_at[1:] != anchor_at[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.append(first, len(string)))
    lo, p = string[first], anchor_at[first]
    return doc[first], lo, count, grams.of(p, p + GRAM), whole.of(lo, lo + count + WINDOW - 1)


def _rows(kind: int, doc, lo, w, anchor=None, seg=None) -> pa.RecordBatch:
    n = len(doc)
    empty = pa.nulls(n, pa.int64())
    columns = [pa.array(np.full(n, kind, np.int8)), pa.array(doc), pa.array(lo), pa.array(w)]
    columns += [empty if x is None else pa.array(x.view(np.int64)) for x in (anchor, seg)]
    return pa.record_batch(columns, _NAMES)


def _collapsed(doc, lo, w, anchor, seg) -> tuple[pa.RecordBatch, np.ndarray]:
    """One slice's segments: the earliest of equal ones, the others as repeated. And the anchors of the earliest."""
    order = np.lexsort((lo, doc, seg, anchor))
    doc, lo, w, anchor, seg = doc[order], lo[order], w[order], anchor[order], seg[order]
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    again = (doc != doc[head]) | (lo != lo[head])
    parts = [_rows(SEGMENT, doc[new], lo[new], w[new], anchor[new], seg[new]), _rows(REPEATED, doc[again], lo[again], w[again])]
    if not len(doc):
        return parts[0], anchor
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0], anchor[new]


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.frombuffer(b"".join(texts), np.uint8), stops - np.diff(stops, prepend=0), stops


def _windows(texts: list[bytes], most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of texts: place in the text where the buffer begins, bytes, starts and stops of its texts. A text of more
    than ``most`` bytes (``SLICE_BYTES``) is cut in windows that have all but one byte of a string in common: each of its strings
    lies in one window, and a segment that a cut divides becomes two, which anchors bring together like any others."""
    most = most or SLICE_BYTES
    if len(texts) != 1 or len(texts[0]) <= most:
        yield (0, *_buffer(texts))
        return
    for at in range(0, max(len(texts[0]) - WINDOW + 1, 1), most):
        yield (at, *_buffer([texts[0][at : at + most + WINDOW - 1]]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents: the segments of each slice, and counts of anchors that are frequent in a stretch of slices."""
    grams, whole = Hashes(1), Hashes(2)
    anchors: list[np.ndarray] = []

    def counts() -> pa.RecordBatch:
        found, times = np.unique(np.concatenate([*anchors, np.zeros(0, np.uint64)]), return_counts=True)
        found, times = found[times >= STRETCH_OFTEN], times[times >= STRETCH_OFTEN]
        zero = np.zeros(len(found), np.int64)
        anchors.clear()
        return _rows(COUNTED, times.astype(np.int64), zero, zero, found)

    for batch in slices(batches, SLICE_BYTES):
        texts, keys = text_bytes(batch.column(1)), batch.column(0).to_numpy()
        for first, data, starts, stops in _windows(texts):
            doc, lo, w, anchor, seg = segments(data, starts, stops, grams, whole)
            out, found = _collapsed(keys[doc], first + lo - starts[doc], w, anchor, seg)
            anchors.append(found)
            yield out
        if sum(map(len, anchors)) >= STRETCH:
            yield counts()
    yield counts()
    pa.default_memory_pool().release_unused()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with marked segments: each string of these as a segment of its own. Only the segments' bytes are hashed,
    about ``SLICE_BYTES`` at a time, so that memory does not follow the number of strings of a long text."""
    one, two = Hashes(3), Hashes(4)

    def told(pieces: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        doc, lo, w = (np.array([p[k] for p in pieces], np.int64) for k in range(3))
        data, starts, _ = _buffer([p[3] for p in pieces])
        one.read(data)
        two.read(data)
        own = np.repeat(np.arange(len(w)), w)
        step = np.arange(len(own)) - np.repeat(np.cumsum(w) - w, w)
        at = starts[own] + step
        return _collapsed(doc[own], lo[own] + step, np.ones(len(own), np.int64), one.of(at, at + WINDOW), two.of(at, at + WINDOW))[0]

    held, size = [], 0
    for batch in slices(batches, SLICE_BYTES):
        for doc, raw, los, ws in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), *(batch.column(k).to_pylist() for k in (2, 3)), strict=True):
            for lo, w in zip(los, ws, strict=True):
                held.append((doc, lo, w, raw[lo : lo + w + WINDOW - 1]))
                size += w + WINDOW
                if size >= SLICE_BYTES:
                    yield told(held)
                    held, size = [], 0
    if held:
        yield told(held)
    pa.default_memory_pool().release_unused()


def _by_anchor(batches: Iterator[pa.RecordBatch], column: int, least_rows: int = 1) -> Iterator[pa.Table]:
    """Tables of whole anchors from batches sorted by anchor, with ``least_rows`` rows or more but for the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column(column).to_numpy()
        new = np.flatnonzero(anchor != anchor[-1])
        cut = int(new[-1]) + 1 if len(new) else 0
        if held and not cut and held[-1].column(column)[-1].as_py() != anchor[-1]:
            pass  # the held rows are whole; the batch is one anchor and begins a new one
        elif cut:
            held.append(batch.slice(0, cut))
            rows += cut
            batch = batch.slice(cut)
        if rows >= least_rows and (cut or held[-1].column(column)[-1].as_py() != anchor[-1]):
            yield pa.Table.from_batches(held)
            held, rows = [], 0
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in the order of (anchor, seg, document, place): all but the first of equal ones are repeated. Where an
    anchor has several different ones, these stay open, with their number at the anchor in place of ``seg``. Of what went
    before, only the last row's segment and a first segment that has not met another yet are kept."""
    last: np.ndarray | None = None  # doc, lo, w, anchor, seg of the last different segment
    number, waits = -1, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns])
        if last is not None:
            rows = np.concatenate([last[:, None], rows], axis=1)
        doc, lo, w, anchor, seg = rows
        n = len(doc)
        start = np.ones(n, bool)
        start[1:] = anchor[1:] != anchor[:-1]
        new = start.copy()
        new[1:] |= seg[1:] != seg[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        again = (doc != doc[head]) | (lo != lo[head])
        # numbers of the different segments at their anchors; the first row's goes on from the batch before
        group = np.cumsum(start) - 1
        count = np.cumsum(new)
        place = count - count[np.flatnonzero(start)][group]
        if last is not None:
            place[group == 0] += number
        several = np.bincount(group[new], minlength=group[-1] + 1) > 1
        if last is not None and number > 0:
            several[0] = True
        open_ = new & several[group]
        if last is not None and not waits:
            open_[0] = False  # it has been handed on
        yield _rows(REPEATED, doc[again], lo[again], w[again])
        yield _rows(OPEN, doc[open_], lo[open_], w[open_], anchor[open_], place[open_])
        last, number, waits = rows[:, head[-1]], int(place[head[-1]]), not several[group[-1]]


def _cut():
    """Documents with open segments: the segments' bytes."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, raw, los, ws, anchors in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            rows += [(doc, lo, w, anchor, raw[lo : lo + w + WINDOW - 1]) for lo, w, anchor in zip(los, ws, anchors, strict=True)]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc", "lo", "w", "anchor", "bytes"])

    return work


def repeated_strings(doc: np.ndarray, lo: np.ndarray, texts: list[bytes], folder: str | None = None):
    """Strings of WINDOW bytes in the segments that also start earlier: document, first place, number of places.

    The segments stand one after the other in the order of (document, place), each ended by a character of its own
    kind, so that places in the shard's text follow the order of the corpus.
    """
    order = np.lexsort((lo, doc))
    doc, lo, texts = doc[order], lo[order], [texts[k] for k in order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1])  # a repeated row is the same document
    doc, lo, texts = doc[new], lo[new], [t for t, n in zip(texts, new, strict=True) if n]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()), np.uint16)
    inside = np.ones(len(text), bool)
    inside[begin + size] = False
    text[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    owner = np.repeat(np.arange(len(doc), dtype=np.int32), size + 1)
    turn = np.zeros(len(text), np.int8)  # whole: places where a string of WINDOW bytes starts
    turn[begin] = 1
    turn[(begin + size - WINDOW + 1)[size >= WINDOW]] = -1
    turn[begin[size < WINDOW]] = 0
    whole = np.cumsum(turn, dtype=np.int8).astype(bool)
    repeated = np.zeros(len(text), bool)
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def judge(position: np.ndarray, common: np.ndarray) -> None:
        run = np.cumsum(common < WINDOW)
        run -= run[0]
        keep = whole[position]
        position, run = position[keep], run[keep]
        first = np.full(int(run[-1]) + 1 if len(run) else 0, len(text), np.int64)
        np.minimum.at(first, run, position)
        repeated[position[position > first[run]]] = True

    for position, common in induced.suffixes(text, WINDOW, folder=folder):
        # a run never crosses the types of a first character in part only: it is carried on to the next block
        pending.append((position, common))
        cut = np.flatnonzero(common < WINDOW)
        if len(cut):
            end = int(cut[-1])
            pending[-1] = (position[:end], common[:end])
            p, c = np.concatenate([x[0] for x in pending]), np.concatenate([x[1] for x in pending])
            if len(p):
                judge(p, c)
            pending = [(position[end:], common[end:])]
    if pending:
        judge(np.concatenate([x[0] for x in pending]), np.concatenate([x[1] for x in pending]))
    place = np.flatnonzero(repeated)
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1] + 1) | (owner[place[1:]] != owner[place[:-1]])]))
    head = place[first]
    return doc[owner[head]], lo[owner[head]] + head - begin[owner[head]], np.diff(np.append(first, len(place)))


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _by_anchor(batches, 3, SHARD_BYTES // (WINDOW + 40)):
        doc, lo, w = repeated_strings(table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(4).to_pylist())
        yield _rows(REPEATED, doc, lo, w)


def _finish():
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for raw, los, ws in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            kept, removed, runs, end = [], 0, 0, 0
            if los:
                start = np.array(los)
                order = np.argsort(start, kind="stable")
                start = start[order]
                stop = np.maximum.accumulate(start + np.array(ws)[order] + WINDOW - 1)
                new = np.concatenate([[True], start[1:] > stop[:-1]])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(start)) - 1
                for a, b in zip(start[first].tolist(), stop[last].tolist(), strict=True):
                    kept.append(raw[end:a])
                    end = b
                    removed, runs = removed + b - a, runs + 1
            kept.append(raw[end:])
            rest = b"".join(kept)
            rows.append((len(raw), removed, runs, hashlib.sha256(rest).hexdigest(), rest))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.record_batch([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["key", *names])

    return work


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> list[DataFrame]:
    """Stored tables whose rows of kind REPEATED say which strings (document, first place, number) also start earlier."""
    own = docs.select(F.coalesce(F.col(key), F.lit(LAST)).cast("bigint").alias("doc"), F.col(text).alias("text"))
    found = stored(own.mapInArrow(_scan, _SCHEMA), "segments")
    single = found.where(F.col("kind") == SEGMENT)
    columns = ["doc", "lo", "w", "anchor", "seg"]

    def settled(rows: DataFrame, *by: str) -> DataFrame:
        return rows.select(columns).repartition(*by).sortWithinPartitions("anchor", "seg", "doc", "lo").mapInArrow(_settle, _SCHEMA)

    def split(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The rows without and with the anchors."""
        several = anchors.count()
        few = F.broadcast(anchors) if several <= BROADCAST_OFTEN else anchors
        return (rows.join(few, "anchor", "left_anti"), rows.join(few, "anchor", "left_semi")) if several else (rows, None)

    counted = found.where(F.col("kind") == COUNTED).groupBy("anchor").agg(F.sum("doc").alias("times"))
    meeting, dealt = split(single, stored(counted.where(F.col("times") >= OFTEN).select("anchor"), "often"))
    tables = [found, stored(settled(meeting, "anchor"), "settled")]
    open_ = tables[1].where(F.col("kind") == OPEN)
    open_, more = split(open_, stored(open_.where(F.col("seg") >= OFTEN).select("anchor").distinct(), "often"))

    marks = open_.groupBy("doc").agg(*(F.collect_list(c).alias(c) for c in ("lo", "w", "anchor")))
    cut = own.join(marks, "doc").select("doc", "text", "lo", "w", "anchor")
    cut = cut.mapInArrow(in_batches(_cut, SLICE_BYTES), "doc bigint, lo bigint, w bigint, anchor bigint, bytes binary")
    tables.append(stored(cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort, _SCHEMA), "sorted"))

    often = [x.select("doc", "lo", "w") for x in (dealt, more) if x is not None]
    if often:
        rows = often[0].unionByName(often[-1]) if len(often) > 1 else often[0]
        marks = rows.groupBy("doc").agg(F.collect_list("lo").alias("lo"), F.collect_list("w").alias("w"))
        strings = own.join(marks, "doc").select("doc", "text", "lo", "w")
        strings = stored(strings.mapInArrow(_strings, _SCHEMA), "strings")
        tables += [strings, stored(settled(strings.where(F.col("kind") == SEGMENT), "anchor", "seg"), "met")]
    return tables


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes) of every document."""
    kind = dict(docs.dtypes)[key]
    marks = None
    for t in repeated(docs, key, text):
        rows = t.where(F.col("kind") == REPEATED).select("doc", "lo", "w")
        marks = rows if marks is None else marks.unionByName(rows)
    marks = marks.groupBy("doc").agg(F.collect_list("lo").alias("lo"), F.collect_list("w").alias("w"))
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key), F.lit(LAST)).cast("bigint").alias("doc"), F.col(text).alias("text"))
    joined = own.join(marks, "doc", "left").select("key", "text", "lo", "w")
    schema = f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return joined.mapInArrow(in_batches(_finish, SLICE_BYTES), schema).withColumnRenamed("key", key)
