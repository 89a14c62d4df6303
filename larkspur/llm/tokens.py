"""Token identifiers of a public byte-level BPE vocabulary, encoded with a bounded cache of words.

Byte-level BPE splits a text before it merges: a space that stands before a visible character always begins a piece,
and a line feed between visible characters is a piece. So a text in which no white space follows white space can be cut
there, each part encoded alone, and the parts' identifiers joined. Other texts are encoded whole. Identifiers are
those of the ``tokenizers`` library with ``add_special_tokens=False``: an added token of the vocabulary that stands in
a text has its own identifier. Texts that hold one are left to that library. The vocabulary stays where it is; it is
never copied.
"""

from __future__ import annotations

import re
import sys
from array import array

#: The vocabulary's file name, given to the tokenizer package's ``path``.
VOCABULARY = "byte_bpe_50k.json"
#: Words kept in a worker's cache; beyond it, words are encoded anew each time.
CACHE_WORDS = 150_000

_TWO_SPACES = re.compile(r"\s\s")


def _little_endian(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Words(dict):
    """What each word between two spaces is encoded to, with ``lead`` in front; lines in it are looked up alone."""

    def __init__(self, lead: str, make, join, most: int, bare=None):
        super().__init__()
        self.lead, self.make, self.join, self.most, self.bare = lead, make, join, most, self if bare is None else bare
        self.line = make("\n")

    def __missing__(self, word: str):
        if "\n" in word:
            first, *rest = word.split("\n")
            found = [self[first]]
            for line in rest:
                found += [self.line, self.bare[line]]
            return self.join(found)
        text = self.lead + word
        made = self.make(text) if text else self.join([])
        if len(self) < self.most:
            self[word] = made
        return made


class Encoder:
    """``encode(text)``: the identifiers, as little-endian unsigned 32-bit bytes; ``count(text)``: how many they are."""

    def __init__(self, vocabulary: str = VOCABULARY, cache_words: int = CACHE_WORDS):
        import public_tokenizers

        self.added: tuple[str, ...] = ()
        self.exact = self.whole = self._ranked(public_tokenizers, vocabulary) if vocabulary.startswith("byte_bpe") else None
        if vocabulary.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
            self.added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
            self.exact = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
            self.whole = self.whole or self.exact
        self.cut = vocabulary.startswith("byte_bpe")
        self.ids, self.counts = ([_Words(lead, make, join, cache_words) for lead in ("", " ")] for make, join in ((self._packed, b"".join), (self._number, sum)))
        for bare, led in (self.ids, self.counts):
            led.bare = bare

    def _packed(self, text: str) -> bytes:
        return _little_endian(self.whole(text))

    def _number(self, text: str) -> int:
        return len(self.whole(text))

    @staticmethod
    def _ranked(source, vocabulary: str):
        """The same vocabulary as merge ranks: equal identifiers for texts without added tokens (tested), a quarter of the time."""
        import base64

        import tiktoken

        with open(source.path(vocabulary.rsplit(".", 1)[0] + ".tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("own", pat_str=source.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _by_words(self, text: str, words: list[_Words]):
        first, *rest = text.split(" ")
        return words[0].join([words[0][first], *map(words[1].__getitem__, rest)])

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return _little_endian(self.exact(text))
        return self._by_words(text, self.ids) if self.cut and not _TWO_SPACES.search(text) else self._packed(text) if text else b""

    def count(self, text: str) -> int:
        if any(t in text for t in self.added):
            return len(self.exact(text))
        return self._by_words(text, self.counts) if self.cut and not _TWO_SPACES.search(text) else self._number(text) if text else 0
