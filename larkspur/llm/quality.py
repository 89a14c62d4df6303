"""Quality rules as a short-circuit cascade.

Each rule needs a few statistics of a text and rejects it or not. On a bounded sample (``SAMPLE_DOCS`` documents,
the smallest hashes of their identifiers) the operator measures, for each rule, the seconds it takes and the share
it rejects, and orders the rules by rejections per second. A document leaves the cascade at the first rule that
rejects it, and no later statistic is computed for it, unless the caller asks for all of them. The verdict is the
same in any order; only the time differs.

Words are ``[^\\x20\\x09-\\x0D]+``. A null text has no words. Defined results: texts of fewer than 20 words, empty
and null ones among them, are rejected; ties in the ordering go to the rule listed first; with an empty table the
listed order stands; columns other than the identifier and the text pass through ``keep`` untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import WORD_BREAKS, in_batches, text_bytes

#: Documents of the sample on which costs and selectivities are estimated.
SAMPLE_DOCS = 500
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: One odd multiplier for each place in a window.
_MIX = np.random.default_rng(8).integers(1 << 62, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_window_words(words: list[bytes]) -> int:
    """Words that stand in a window of eight words found twice or more in the text, the first occurrence included.

    A hash of each window shows that no window repeats, which holds for most texts; where two hashes are equal, the
    windows themselves are counted.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.uint64)
    if len(known) == len(words):
        return 0
    ids += np.uint64(1)
    hashed = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        hashed += ids[k : k + n] * _MIX[k]
    hashed ^= hashed >> np.uint64(29)
    ordered = np.sort(hashed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    rank = ids.astype(np.int64)
    for step in (1, 2, 4):  # the rank of 2, 4, then 8 words from each position
        pairs = rank[:-step] * (len(words) + 1) + rank[step:]
        rank = np.unique(pairs, return_inverse=True)[1]
    again = np.zeros(len(words), dtype=np.int64)
    again[:n] = np.bincount(rank)[rank] > 1
    so_far = np.cumsum(again)
    cover = so_far.copy()
    cover[WINDOW:] -= so_far[:-WINDOW]
    return int((cover > 0).sum())


class Statistics:
    """The statistics of one text, each computed when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        value = getattr(self, f"_{name}")()
        setattr(self, name, value)
        return value

    def _words(self) -> list[bytes]:
        return self.raw.split()

    def _n_words(self) -> int:
        return len(self.words)

    def _solid(self) -> bytes:
        return self.raw.translate(None, WORD_BREAKS)

    def _word_chars(self) -> int:
        return len(self.solid.decode()) if not self.solid.isascii() else len(self.solid)

    def _n_symbols(self) -> int:
        return len(self.solid) - len(self.solid.translate(None, SYMBOLS))

    def _lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        return repeated_window_words(self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Statistics], bool]
    base: bool = False


#: Thresholds of the rules. The first two are the base rules; the others reject junk well outside running prose.
LEAST_WORDS, MOST_REPEAT_PERCENT = 20, 30
MOST_SYMBOLS_PERCENT, MOST_DUP_LINES_PERCENT, SHORTEST_MEAN, LONGEST_MEAN = 50, 50, 2, 25

RULES = (
    Rule("few_words", lambda s: s.n_words < LEAST_WORDS, base=True),
    Rule("repeated_windows", lambda s: 100 * s.n_repeat_words > MOST_REPEAT_PERCENT * s.n_words, base=True),
    Rule("symbols", lambda s: 100 * s.n_symbols > MOST_SYMBOLS_PERCENT * s.n_words),
    Rule("duplicate_lines", lambda s: 100 * s.n_dup_lines > MOST_DUP_LINES_PERCENT * len(s.lines)),
    Rule("word_length", lambda s: not SHORTEST_MEAN * s.n_words <= s.word_chars <= LONGEST_MEAN * s.n_words),
)


@dataclass
class Cascade:
    """Rules in the order in which they are asked, with what the sample told of each."""

    rules: tuple[Rule, ...] = RULES
    told: dict[str, tuple[float, float]] = field(default_factory=dict)

    def kept(self, text: Statistics) -> bool:
        return not any(rule.rejects(text) for rule in self.rules)

    def estimate(self, texts: list[bytes]) -> Cascade:
        """The rules ordered by share rejected per second, both measured on ``texts``."""
        told = {}
        for rule in self.rules:
            began, rejected = time.perf_counter(), 0
            for raw in texts:
                rejected += rule.rejects(Statistics(raw))
            told[rule.name] = (max((time.perf_counter() - began) / max(len(texts), 1), 1e-9), rejected / max(len(texts), 1))
        return Cascade(tuple(sorted(self.rules, key=lambda r: -told[r.name][1] / told[r.name][0])), told)


def sample_texts(docs: DataFrame, key: str, text: str, most: int = SAMPLE_DOCS) -> list[bytes]:
    """Texts of at most ``most`` documents, those whose identifiers' hashes are smallest. Only identifiers are
    sorted; the texts are then fetched by a join with at most ``most`` of them."""
    ids = docs.select(F.col(key).alias("k")).orderBy(F.xxhash64("k"), "k").limit(most).distinct()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = rows.join(F.broadcast(ids), "k", "left_semi").select("t").limit(most).collect()
    return [(r.t or "").encode() for r in found]


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, statistics: bool = True) -> DataFrame:
    """``key``, ``kept`` and, with ``statistics``, the five statistics and ``base_failed`` of every document."""
    order = Cascade(rules).estimate(sample_texts(docs, key, text)).rules
    kind = dict(docs.dtypes)[key]
    base = tuple(r for r in rules if r.base)
    names = [*STATISTICS, "base_failed"] if statistics else []

    def make():
        cascade = Cascade(order)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, kept = [], []
            for raw in text_bytes(batch.column(1)):
                s = Statistics(raw)
                kept.append(cascade.kept(s))
                if statistics:
                    rows.append((*(getattr(s, n) for n in STATISTICS), any(r.rejects(s) for r in base)))
            columns = [pa.array([r[k] for r in rows], pa.bool_() if n == "base_failed" else pa.int64()) for k, n in enumerate(names)]
            return pa.record_batch([batch.column(0), *columns, pa.array(kept, pa.bool_())], ["key", *names, "kept"])

        return work

    schema = ", ".join([f"key {kind}", *(f"{n} {'boolean' if n == 'base_failed' else 'bigint'}" for n in names), "kept boolean"])
    pairs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return pairs.mapInArrow(in_batches(make), schema).withColumnRenamed("key", key)


def keep(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns, in one pass without a shuffle."""
    order = Cascade(rules).estimate(sample_texts(docs, key, text)).rules
    at = docs.columns.index(text)

    def make():
        cascade = Cascade(order)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            mask = [cascade.kept(Statistics(raw)) for raw in text_bytes(batch.column(at))]
            return batch.filter(pa.array(mask, pa.bool_()))

        return work

    return docs.mapInArrow(in_batches(make), docs.schema)
