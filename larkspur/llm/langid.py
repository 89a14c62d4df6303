"""Language identification of words by a linear-chain conditional random field.

Every word has features: its prefixes and suffixes of one to three characters, its n-grams of one to three
characters, and itself if the training lexicon has it. Each feature has a weight for each language; a transition
matrix says how likely the language changes between two words. Forward-backward gives each word's distribution, which
labels code-switched text word by word; a document's language is the one with the largest sum over its words.

Training reads a bounded sample: at most ``TRAIN_DOCS`` documents of each language (those whose identifiers' hashes
are smallest, whole texts) and at most ``TRAIN_WORDS`` words in all. Stretches of documents are put together, across
languages in one of four cases, so that transitions are learned from switches as well. Weights are fitted by
stochastic gradient on the driver and travel to the executors, ``2 ** HASH_BITS`` rows of one float a language.

Inference runs forward and backward over many documents at once, word by word, on documents of like length. Words'
scores are cached, a bounded number of them, and computed in numpy for all new words of a batch together.

Defined results: a null text, or one without letters, is ``und`` with score 0; words without letters take their
neighbours' language and do not count; if no labelled text is given for training, all are ``und``; repeated rows get
equal results; texts are read whole (a stretch of more than ``LENGTH`` characters without white space, as in Chinese,
counts as several words); columns other than those named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import in_batches, slices

TRAIN_DOCS, TRAIN_WORDS = 400, 400_000
HASH_BITS, LENGTH, CACHE_WORDS = 17, 20, 200_000
SPAN, BATCH, EPOCHS, RATE = 24, 64, 2, 0.15
_FEATURE_KINDS = 10  # three prefixes, three suffixes, three n-gram lengths, the word itself
_PUNCTUATION = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡0123456789"


def words_of(text: str) -> list[str]:
    """Lower-cased words without punctuation and digits at their ends; a word may become empty. Longer words than LENGTH
    are cut in pieces, each a word, that have two characters in common with the next one: no n-gram is lost."""
    out = []
    for w in text.lower().split():
        w = w.strip(_PUNCTUATION)
        if len(w) <= LENGTH:
            out.append(w)
        else:
            out += [w[k : k + LENGTH] for k in range(0, len(w) - 2, LENGTH - 2)]
    return out


def features(words: list[str], lexicon: np.ndarray) -> np.ndarray:
    """(words, features) of weight rows; row 0 has no weight. Words have LENGTH characters at most, as from ``words_of``."""
    n = len(words)
    chars = np.array(words, dtype=f"U{LENGTH}").view(np.uint32).reshape(n, LENGTH).astype(np.uint64)
    size = (chars != 0).sum(axis=1)
    mask, place = np.uint64((1 << HASH_BITS) - 1), np.arange(n)
    columns = []

    def hashed(kind: int, value: np.ndarray, there: np.ndarray) -> np.ndarray:
        value = (value + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(32)
        return np.where(there, (value * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) & mask, 0)

    prefix, suffix = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(3):
        prefix = prefix * np.uint64(1 << 21) + chars[:, k]
        suffix = suffix + chars[place, np.maximum(size - 1 - k, 0)] * np.uint64(1 << 21 * k)
        columns += [hashed(2 * k, prefix, size > k), hashed(2 * k + 1, suffix, size > k)]
    gram, whole = chars, np.zeros(n, np.uint64)
    for k in range(1, 4):
        if k > 1:
            gram = gram[:, :-1] * np.uint64(1 << 21) + chars[:, k - 1 :]
        columns += list(hashed(5 + k, gram, (np.arange(gram.shape[1]) + k)[None, :] <= size[:, None]).T)
    for k in range(LENGTH):
        whole = whole * np.uint64(1_099_511_628_211) + chars[:, k]
    known = np.isin(whole, lexicon)
    return np.stack([*columns, hashed(9, whole, known)], axis=1).astype(np.int32), whole


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    change: np.ndarray
    lexicon: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word for each language; a word without letters has none."""
        out = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        for at in range(0, len(words), 4096):
            rows, _ = features(words[at : at + 4096], self.lexicon)
            out[at : at + 4096] = self.weights[rows].sum(axis=1)
        return out


def forward_backward(emission: np.ndarray, change: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of (time, sequence, label) scores, with the scaled forward and backward messages."""
    steps, many, labels = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    move = np.exp(change - change.max())
    forward, backward = np.empty_like(e), np.empty_like(e)
    now = np.full((many, labels), 1.0 / labels, e.dtype)
    for t in range(steps):
        now = e[t] * (now @ move if t else now)
        now /= now.sum(axis=1, keepdims=True)
        forward[t] = now
    now = np.ones((many, labels), e.dtype)
    for t in range(steps - 1, -1, -1):
        if t < steps - 1:
            now = (e[t + 1] * now) @ move.T
            now /= now.sum(axis=1, keepdims=True)
        now[sizes <= t + 1] = 1.0  # the last word of a sequence, or beyond it
        backward[t] = now
    both = forward * backward
    return both / both.sum(axis=2, keepdims=True), forward, backward * e


def lettered(text: str) -> list[str]:
    """The words with letters, of which training reads an equal share for each language."""
    return [w for w in words_of(text) if any(c.isalpha() for c in w)]


def turns_needed(counts: list[int], share: int) -> int:
    """Turns of ``SPAN // 2`` words each after which documents of so many words have given ``share`` words, or all."""
    turns, most = 0, -(-max(counts, default=0) // (SPAN // 2))
    while turns < most and sum(min(n, turns * (SPAN // 2)) for n in counts) < share:
        turns += 1
    return turns


def train(texts: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (text, language) pairs."""
    return train_on_words([(lettered(text), lang) for text, lang in texts], seed)


def train_on_words(texts: list[tuple[list[str], str]], seed: int = 7) -> Model:
    """A model from (words with letters, language) pairs."""
    languages = sorted({lang for _, lang in texts})
    rng, label_of = np.random.default_rng(seed), {x: k for k, x in enumerate(languages)}
    spans = []
    for lang in languages:  # each has an equal share of the words, which its texts give by turns
        cut = []
        for words in (words for words, x in texts if x == lang):
            cut.append([words[at : at + SPAN // 2] for at in range(0, len(words), SPAN // 2)])
        left = TRAIN_WORDS // len(languages)
        for turn in range(max(map(len, cut), default=0)):
            for own in cut:
                if turn < len(own) and left > 0:
                    spans.append((own[turn], label_of[lang]))
                    left -= len(own[turn])
    every = {}
    for words, _ in spans:
        for w in words:
            every[w] = every.get(w, 0) + 1
    vocabulary = list(every)
    number = {w: k for k, w in enumerate(vocabulary)}
    labels = len(languages)
    if not vocabulary:
        return Model(languages, np.zeros((1 << HASH_BITS, labels), np.float32), np.zeros((labels, labels), np.float32), np.zeros(0, np.uint64))
    rows, whole = [], []
    for at in range(0, len(vocabulary), 4096):
        whole.append(features(vocabulary[at : at + 4096], np.zeros(0, np.uint64))[1])
    counts = np.array(list(every.values()))
    lexicon = np.unique(np.concatenate(whole)[counts > 1])
    for at in range(0, len(vocabulary), 4096):
        rows.append(features(vocabulary[at : at + 4096], lexicon)[0])
    rows = np.concatenate(rows)
    weights, change = np.zeros((1 << HASH_BITS, labels), np.float32), np.zeros((labels, labels), np.float32)
    # two spans make a sequence: of one language in three of four cases, of any languages in the others
    by_language = [[s for s in spans if s[1] == k] for k in range(labels)]
    for epoch in range(EPOCHS):
        order = rng.permutation(len(spans))
        for at in range(0, len(order), BATCH):
            firsts = [spans[k] for k in order[at : at + BATCH]]
            seconds = []
            for _, lang in firsts:
                pool = by_language[lang] if rng.random() < 0.75 else by_language[rng.integers(labels)]
                seconds.append(pool[rng.integers(len(pool))] if pool else ([], lang))
            sizes = np.array([len(a[0]) + len(b[0]) for a, b in zip(firsts, seconds, strict=True)])
            ids, gold = np.full((SPAN, len(firsts)), -1), np.zeros((SPAN, len(firsts)), int)
            for c, (a, b) in enumerate(zip(firsts, seconds, strict=True)):
                ids[: sizes[c], c] = [number[w] for w in (*a[0], *b[0])]
                gold[: sizes[c], c] = [a[1]] * len(a[0]) + [b[1]] * len(b[0])
            there = ids >= 0
            used = rows[np.where(there, ids, 0)]
            used[~there] = 0
            emission = weights[used].sum(axis=2, dtype=np.float64)
            posterior, forward, back = forward_backward(emission, change.astype(np.float64), sizes)
            slope = -posterior
            np.put_along_axis(slope, gold[:, :, None], np.take_along_axis(slope, gold[:, :, None], 2) + 1, 2)
            slope[~there] = 0
            rate = RATE / (1 + epoch) / 8
            flat, part = used[there].ravel(), np.repeat(slope[there], used.shape[2], axis=0)
            for k in range(labels):
                step = np.bincount(flat, part[:, k], 1 << HASH_BITS)
                weights[:, k] += (rate * step).astype(np.float32)
            weights[0] = 0
            move = np.exp(change - change.max())
            joint = forward[:-1, :, :, None] * move[None, None] * back[1:, :, None, :]
            joint /= joint.sum(axis=(2, 3), keepdims=True)
            pairs = there[1:]
            expected = joint[pairs].sum(axis=0)
            seen = np.bincount((gold[:-1] * labels + gold[1:])[pairs], minlength=labels * labels).reshape(labels, labels)
            change += (rate * (seen - expected) / 16).astype(np.float32)
    return Model(languages, weights, change, lexicon)


class _Scores:
    """Words' numbers and scores, at most CACHE_WORDS of them from one batch to the next."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.languages)), np.float32)
        self.letters = np.zeros(0, bool)

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.number) > CACHE_WORDS:
            self.clear()
        known = self.number
        before = len(known)
        found = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in texts]
        new = list(known)[before:] if before == 0 else [w for w in dict.fromkeys(w for ws in texts for w in ws) if known[w] >= before]
        if new:
            self.rows = np.concatenate([self.rows, self.model.emissions(new)])
            self.letters = np.concatenate([self.letters, np.array([any(c.isalpha() for c in w) for w in new])])
        return found


def label(texts: list[str | None], model: Model, scores: _Scores | None = None) -> list[tuple[str, float, np.ndarray]]:
    """For each text: its language, the mean share of that language over its words, and each word's language."""
    scores = scores or _Scores(model)
    labels = len(model.languages)
    if not labels:
        return [("und", 0.0, np.zeros(0, int))] * len(texts)
    numbers = scores.numbers([words_of(t or "") for t in texts])
    sizes = np.array([len(x) for x in numbers])
    out: list = [("und", 0.0, np.zeros(0, int))] * len(texts)
    order = np.argsort(sizes, kind="stable")
    change = model.change.astype(np.float32)
    at = 0
    order = order[sizes[order] > 0]
    while at < len(order):
        # like lengths together; the padded block stays below two million words
        most = max(1, min(512, 2_000_000 // max(int(sizes[order[min(at + 511, len(order) - 1)]]), 1)))
        group = order[at : at + most]
        at += most
        steps = int(sizes[group].max())
        emission = np.zeros((steps, len(group), labels), np.float32)
        for c, k in enumerate(group):
            emission[: sizes[k], c] = scores.rows[numbers[k]]
        posterior, _, _ = forward_backward(emission, change, sizes[group])
        for c, k in enumerate(group):
            each = posterior[: sizes[k], c]
            lettered = scores.letters[numbers[k]]
            if lettered.any():
                mean = each[lettered].mean(axis=0, dtype=np.float64)
                best = int(mean.argmax())
                out[k] = (model.languages[best], float(min(max(mean[best], 0.0), 1.0)), each.argmax(axis=1))
    return out


def held_out(key: Column) -> Column:
    """Documents that training leaves out: crc32 of the identifier as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from the bounded sample of the documents that are not held out and have a language. Executors count the
    sample's words and cut each document to those that its language's share can need, so that what comes to the driver is
    bounded by ``TRAIN_WORDS`` and one turn of each document, however long documents are."""
    known = docs.where(F.col(lang).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("k"), F.col(lang).alias("l"))
    languages = [r.l for r in known.select("l").distinct().orderBy("l").collect()]
    pick = None
    for x in languages:
        best = known.where(F.col("l") == x).orderBy(F.xxhash64("k"), "k").limit(TRAIN_DOCS)
        pick = best if pick is None else pick.unionByName(best)
    if pick is None:
        return train([])
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    found = rows.join(F.broadcast(pick.distinct()), ["k", "l"], "left_semi").where("t is not null")
    kind = dict(found.dtypes)["k"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words that ``most`` (null: none, only their number is asked for) says."""
        for batch in slices(batches):
            each = [lettered(t) for t in batch.column(1).to_pylist()]
            kept = [w[:m] if m is not None else None for w, m in zip(each, batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(map(len, each), pa.int64()), pa.array(kept, pa.list_(pa.string()))], ["k", "l", "n", "words"])

    def asked(most: Column) -> DataFrame:
        return found.select("k", "t", "l", most.cast("int").alias("most")).mapInArrow(cut, f"k {kind}, l string, n bigint, words array<string>")

    counts = asked(F.lit(None)).select("l", "n").collect()  # TRAIN_DOCS for each language
    present = sorted({r.l for r in counts})
    if not present:
        return train([])
    turns = {x: turns_needed([r.n for r in counts if r.l == x], TRAIN_WORDS // len(present)) for x in present}
    most = F.element_at(F.create_map(*(F.lit(v) for x, n in turns.items() for v in (x, n * (SPAN // 2)))), F.col("l"))
    told = sorted({(zlib.crc32(str(r.k).encode()), r.k, tuple(r.words), r.l) for r in asked(most).collect()})
    return train_on_words([(list(words), lang_) for _, _, words, lang_ in told])


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score``: nothing but the text goes into a prediction."""
    kind = dict(docs.dtypes)[key]
    # plain values: a broadcast names its classes by module, and executors have no copy of this one
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.change, model.lexicon))

    def make():
        model = Model(*shared.value)
        scores = _Scores(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = label(batch.column(1).to_pylist(), model, scores)
            return pa.record_batch([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["key", "lang_pred", "score"])

        return work

    pairs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return pairs.mapInArrow(in_batches(make, 4 << 20), f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
