"""External induced sorting of suffixes, with their common-prefix lengths.

A suffix is S-type if it is smaller than the one after it, else L-type; an S-type suffix behind an L-type one is
LMS. The LMS suffixes are sorted first: their substrings get names, and names are paired and named again, level by
level, until they are unique or their common prefixes reach ``depth``. Then one pass over the buckets of first
characters, upwards, induces the order of the L-type suffixes from that of the LMS suffixes, and one pass downwards
induces the S-type ones. Whatever a pass meets, it sends the suffix one place to the left to the priority queue of
that suffix's first character, together with the length of the prefix that it shares with the queue's last entry: one
more than the least common prefix met since. So suffixes leave each queue sorted, and common prefixes come for free.

Queues are files: entries (position, common prefix) are buffered and appended to one file for each character when
the buffers exceed ``memory`` entries, and read back in blocks when the pass gets there. The text may be a memory
map. All work on blocks is done in numpy. Common prefixes are told up to ``depth`` (at most 255); suffixes that agree
so far stand in any order.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

BLOCK = 1 << 18
#: Queue entries held in memory, over all queues, before they go to disk: a small part of a full shard's.
MEMORY = 1 << 18


class Queues:
    """One first-in-first-out queue of (position, common prefix) for each character, on disk beyond ``memory``."""

    def __init__(self, characters: int, folder: str, memory: int):
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(characters)]
        self.files: dict[int, int] = {}
        self.folder, self.memory, self.count = folder, memory, 0

    def push(self, c: int, position: np.ndarray, common: np.ndarray) -> None:
        self.held[c].append((position, common))
        self.count += len(position)
        if self.count > self.memory:
            self._flush()

    def _flush(self) -> None:
        for c, blocks in enumerate(self.held):
            if blocks:
                with open(f"{self.folder}/{c}.position", "ab") as p, open(f"{self.folder}/{c}.common", "ab") as q:
                    for position, common in blocks:
                        position.tofile(p)
                        common.tofile(q)
                        self.files[c] = self.files.get(c, 0) + len(position)
                self.held[c] = []
        self.count = 0

    def take(self, c: int):
        """Blocks of the queue in order, emptying it; entries may be pushed meanwhile."""
        done = 0
        while True:
            if done < self.files.get(c, 0):
                many = min(BLOCK, self.files[c] - done)
                position = np.fromfile(f"{self.folder}/{c}.position", np.int64, many, offset=8 * done)
                common = np.fromfile(f"{self.folder}/{c}.common", np.uint8, many, offset=done)
                done += many
            elif self.held[c]:
                blocks, self.held[c] = self.held[c], []
                self.count -= sum(len(b[0]) for b in blocks)
                position, common = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
            else:
                break
            for at in range(0, len(position), BLOCK):
                yield position[at : at + BLOCK], common[at : at + BLOCK]
        if c in self.files:
            os.remove(f"{self.folder}/{c}.position")
            os.remove(f"{self.folder}/{c}.common")
            del self.files[c]


class _Sorted:
    """Entries in their final order, in one file, with each character's place in it."""

    def __init__(self, folder: str, name: str, characters: int):
        self.path = f"{folder}/{name}"
        self.start, self.many, self.total = np.zeros(characters, np.int64), np.zeros(characters, np.int64), 0
        self.position, self.common = open(f"{self.path}.position", "wb"), open(f"{self.path}.common", "wb")

    def append(self, c: int, position: np.ndarray, common: np.ndarray) -> np.ndarray:
        """The common prefixes, with 0 for the first of its character."""
        if not self.many[c]:
            self.start[c] = self.total
            common = np.concatenate([np.zeros(1, np.uint8), common[1:]])
        position.tofile(self.position)
        common.tofile(self.common)
        self.many[c] += len(position)
        self.total += len(position)
        return common

    def done(self) -> None:
        self.position.close()
        self.common.close()

    def read(self, c: int, at: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        if stop <= at:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        first = int(self.start[c]) + at
        position = np.fromfile(f"{self.path}.position", np.int64, stop - at, offset=8 * first)
        return position, np.fromfile(f"{self.path}.common", np.uint8, stop - at, offset=first)


class _Least:
    """For each character, the least common prefix met since its queue last got an entry."""

    def __init__(self, characters: int):
        self.since = np.zeros(characters, np.uint8)

    def send(self, queues: Queues, position: np.ndarray, common: np.ndarray, target: np.ndarray, depth: int) -> None:
        """position, common: what the pass met, in order. target: the character in front if that suffix is due now, or -1."""
        n = len(position)
        chosen = np.flatnonzero(target >= 0)
        whole = common.min() if n else 255
        before = self.since.copy()
        np.minimum(self.since, whole, out=self.since)
        if not len(chosen):
            return
        levels = [common]
        while len(levels[-1]) > (1 << (len(levels) - 1)):
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))

        def least(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
            k = np.frexp((stop - start).astype(np.float64))[1] - 1
            out = np.empty(len(start), np.uint8)
            for level in np.unique(k):
                of = k == level
                table = levels[level]
                out[of] = np.minimum(table[start[of]], table[stop[of] - (1 << int(level))])
            return out

        order = chosen[np.argsort(target[chosen].astype(np.int16), kind="stable")]
        to = target[order]
        first = np.concatenate([[True], to[1:] != to[:-1]])
        start = np.where(first, 0, np.concatenate([[0], order[:-1] + 1]))
        shared = least(start, order + 1)
        shared[first] = np.minimum(shared[first], before[to[first]])
        shared = np.minimum(shared.astype(np.int16) + 1, depth).astype(np.uint8)
        ends = np.concatenate([np.flatnonzero(first)[1:], [len(order)]])
        for a, b in zip(np.flatnonzero(first), ends, strict=True):
            queues.push(int(to[a]), position[order[a:b]] - 1, shared[a:b])
        last = order[ends - 1]
        rest = np.full(len(last), 255, np.uint8)
        inside = last + 1 < n
        if inside.any():
            rest[inside] = least(last[inside] + 1, np.full(inside.sum(), n))
        self.since[to[ends - 1]] = rest


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """The common prefix of the suffixes at a and b, by comparing characters, up to depth."""
    n, out, live = len(text), np.zeros(len(a), np.uint8), np.arange(len(a))
    for k in range(depth):
        x, y = a[live] + k, b[live] + k
        same = (x < n) & (y < n)
        same[same] = text[x[same]] == text[y[same]]
        live = live[same]
        if not len(live):
            break
        out[live] = k + 1
    return out


def _types(text: np.ndarray) -> np.ndarray:
    """True for S-type. The end of the text is smaller than every character."""
    ends = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))
    runs = np.diff(ends, prepend=-1)
    rising = np.zeros(len(ends), bool)
    rising[:-1] = text[ends[:-1]] < text[ends[:-1] + 1]
    return np.repeat(rising, runs)


def _sorted_lms(text: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """LMS positions in the order of their suffixes; ties only where depth characters agree."""
    many = len(lms)
    if many < 2:
        return lms
    n = len(text)
    stop = np.concatenate([lms[1:] + 1, [n]])  # a substring includes the first character of the next one
    pad = (1 << 9) - 1  # where one is the start of the other, the shorter one is the larger
    rank, at, live = np.zeros(many, np.int64), 0, np.arange(many)
    while len(live):
        key = np.zeros(len(live), np.int64)
        for k in range(7):
            place = lms[live] + at + k
            inside = place < stop[live]
            char = np.where(live == many - 1, 0, pad)  # the last one ends with the text, which is smaller than all
            char[inside] = text[place[inside]].astype(np.int64) + 1
            key = key << 9 | char
        rank[live] = _dense(rank, live, key)
        at += 7
        tied = np.bincount(rank, minlength=many)[rank[live]] > 1
        live = live[tied & (lms[live] + at <= stop[live])]  # one that ends here still meets its padding
    return _paired(rank, lms, n, depth)


def _dense(rank: np.ndarray, live: np.ndarray, key: np.ndarray) -> np.ndarray:
    """New ranks of the live entries: those of one old rank are told apart by key, within the rank's own range."""
    order = np.lexsort((key, rank[live]))
    old, k = rank[live][order], key[order]
    group = np.concatenate([[True], old[1:] != old[:-1]])
    new = group | np.concatenate([[True], k[1:] != k[:-1]])
    place = np.arange(len(order))
    first_new = np.maximum.accumulate(np.where(new, place, 0))
    first_group = np.maximum.accumulate(np.where(group, place, 0))
    out = np.empty(len(order), np.int64)
    out[order] = old + first_new - first_group
    return out


def _paired(rank: np.ndarray, lms: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Names are paired with the name 1, 2, 4, ... substrings on, until all are unique or agree over depth characters."""
    many, step = len(lms), 1
    while True:
        tied = np.bincount(rank, minlength=many)[rank] > 1
        reach = np.minimum(np.arange(many) + step, many)
        covered = np.where(reach < many, lms[np.minimum(reach, many - 1)], n) - lms
        live = np.flatnonzero(tied & (covered < depth) & (np.arange(many) + step <= many))
        if not len(live):
            break
        after = np.where(live + step < many, rank[np.minimum(live + step, many - 1)] + 1, 0)
        rank[live] = _dense(rank, live, after)
        step *= 2
    return lms[np.argsort(rank, kind="stable")]


def suffixes(text: np.ndarray, depth: int, characters: int = 257, folder: str | None = None, memory: int = MEMORY):
    """Yields blocks (positions, common prefixes with the suffix before) of all suffixes in order.

    ``text``: an array (or memory map) of characters below ``characters``. Blocks of a bucket come L-type first.
    """
    n = len(text)
    if not n:
        return
    home = tempfile.mkdtemp(prefix="induced-", dir=folder)
    try:
        rising = _types(text)
        lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
        seeds = _sorted_lms(text, lms, depth)
        seed_common = np.zeros(len(seeds), np.uint8)
        if len(seeds) > 1:
            seed_common[1:] = _common(text, seeds[:-1], seeds[1:], depth)
        seed_first = np.searchsorted(text[seeds], np.arange(characters + 1))

        def front(position: np.ndarray, s_type: bool) -> np.ndarray:
            """The character in front of each position if the suffix there has the wanted type, else -1."""
            ahead = np.maximum(position - 1, 0)
            due = (position > 0) & (rising[ahead] == s_type)
            return np.where(due, text[ahead].astype(np.int32), -1)

        os.makedirs(f"{home}/up")
        queues, least = Queues(characters, f"{home}/up", memory), _Least(characters)
        # the pass starts with the end of the text, whose left neighbour is L-type
        queues.push(int(text[n - 1]), np.array([n - 1]), np.zeros(1, np.uint8))
        last_large, large = np.full(characters, -1), _Sorted(home, "large", characters)
        for c in range(characters):
            for position, common in queues.take(c):
                common = large.append(c, position, common)
                last_large[c] = position[-1]
                least.send(queues, position, common, front(position, False), depth)
            for at in range(seed_first[c], seed_first[c + 1], BLOCK):
                stop = min(at + BLOCK, seed_first[c + 1])
                common = seed_common[at:stop].copy()
                if at == seed_first[c]:
                    common[0] = _common(text, last_large[c : c + 1], seeds[at : at + 1], depth)[0] if last_large[c] >= 0 else 0
                least.send(queues, seeds[at:stop], common, front(seeds[at:stop], False), depth)

        os.makedirs(f"{home}/down")
        queues, least = Queues(characters, f"{home}/down", memory), _Least(characters)
        small = _Sorted(home, "small", characters)
        large.done()
        for c in range(characters - 1, -1, -1):
            last = -1
            for position, common in queues.take(c):
                common = small.append(c, position, common)
                last = position[-1]
                least.send(queues, position, common, front(position, True), depth)
            many = large.many[c]
            # downwards, an entry's common prefix is with the entry after it
            after = 0
            if many and last >= 0:
                after = int(_common(text, last_large[c : c + 1], np.array([last]), depth)[0])
            for stop in range(many, 0, -BLOCK):
                at = max(stop - BLOCK, 0)
                position, own = (x[::-1] for x in large.read(c, at, stop))
                common = np.concatenate([[np.uint8(after)], own[:-1]])
                after = int(own[-1])
                least.send(queues, position, common, front(position, True), depth)

        small.done()
        for c in range(characters):
            last = None
            for at in range(0, large.many[c], BLOCK):
                position, own = large.read(c, at, min(at + BLOCK, large.many[c]))
                last = position[-1:]
                yield position, own
            before = None  # the common prefix of a block's first entry with the entry before it
            for stop in range(small.many[c], 0, -BLOCK):
                after, own = (x[::-1] for x in small.read(c, max(stop - BLOCK, 0), stop))
                if before is None:
                    before = _common(text, last, after[:1], depth) if last is not None else np.zeros(1, np.uint8)
                yield after, np.concatenate([before, own[:-1]])
                before = own[-1:]
    finally:
        shutil.rmtree(home, ignore_errors=True)
