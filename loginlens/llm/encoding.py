"""Encoding of whole texts with the tokenizers library, remembering pieces.

A text is cut only where every encoding of the whole is the joined encodings of
the parts, so the ids are those of one call on the whole text:

* `words`: the tokenizer drops white space, none of its rules look across it, and
  it lowers letters first (so those of ASCII may be lowered before).
* `bytes`: byte-level rules in which a single space opens the word after it. A
  cut before a space, or around a newline, is safe where the neighbours are not
  white space themselves. Longer runs of white space stay with what follows.

Both also cut between a letter and a point, comma or sign, so that a word is known with
and without one.
* `whole`: no cutting, for any other tokenizer.

Most new pieces are single words. No rule of such a tokenizer changes a word of letters, so
these go to its byte-pair model at once; a tokenizer that proves otherwise on a few words
takes them the long way.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain, compress, repeat
from operator import is_

import numpy as np

#: White space as Unicode and the tokenizers' patterns define it (fixed values).
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and signs between which every pattern cuts; a subset of either is enough. No apostrophe: it opens endings.
LETTER, POINT = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f", r".,;:!?|&$#%*+=/()\[\]\"@~^-"
CUTS = {
    "words": re.compile(f"[{LETTER}]++(?:(?=[{POINT}])|[^{WHITE}]*)|[^{WHITE}]+"),
    "bytes": re.compile(f" ?[{LETTER}]++(?:(?=[{POINT}])|[^{WHITE}]*)|\n(?=[^{WHITE}])|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+"),
}
PLAIN = re.compile(f" ?[^{WHITE}]+")
WORD = re.compile(f" ?[{LETTER}]+")
LONGEST = 64
#: Pieces remembered in one generation; the older of two generations is dropped.
REMEMBER = 600_000
#: Words on which a tokenizer and its model must agree before words are given to the model alone.
PROBES = ("the", "unwritten", "xqzvkjw", "\xfcbergr\xf6\xdfe", "\xe9l\xe8ve", "ni\xf1o", "\u0153uvre", "\u0111\u01a1n", "antidisestablishmentarianism")


def _shown_bytes() -> dict[int, int]:
    """The character by which byte-level vocabularies show each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(hidden)}


SHOWN = _shown_bytes()
SPACE = chr(SHOWN[32])
BEYOND_ASCII = [(chr(b), chr(shown)) for b, shown in SHOWN.items() if b > 127]


class Encoder:
    """Texts to token ids as little-endian unsigned integers of `dtype`."""

    def __init__(self, path: str, cut: str, dtype: str = "<u4", remember: int = REMEMBER) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut, self.dtype, self.remember = cut, np.dtype(dtype), remember
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.model = self._word_model()

    def _word_model(self):
        """The tokenizer's model if it gives words the ids that the tokenizer gives them, else None."""
        if self.cut == "whole":
            return None
        probes = [*PROBES] if self.cut == "words" else [form for w in PROBES for form in (w, " " + w, w.title(), " " + w.title())]
        whole = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in probes]
        model = self.tokenizer.model
        alone = [[t.id for t in model.tokenize(self._shown(p))] for p in probes]
        return model if alone == whole else None

    @staticmethod
    def _shown(word: str) -> str:
        if word.isascii():
            return word.replace(" ", SPACE)
        return word.encode().decode("latin-1").translate(SHOWN)

    @staticmethod
    def _all_shown(words: list[str]) -> list[str]:
        """`_shown` of words of letters, all at once."""
        if not words:
            return []
        text = "\0".join(words)
        if not text.isascii():
            text = text.encode().decode("latin-1")
            for hidden, shown in BEYOND_ASCII:
                text = text.replace(hidden, shown)
        return text.replace(" ", SPACE).split("\0")

    def _words_of(self, pieces: list[str]) -> list[str]:
        # Rules of `words` lower letters; a word with capitals is left to them.
        fits = WORD.fullmatch
        words = [p for p in pieces if len(p) <= LONGEST and fits(p)]
        return words if self.cut == "bytes" else [w for w in words if w.islower()]

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; a null text counts as empty."""
        if self.cut == "whole":
            return [self._bytes(e.ids) for e in
                    self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if self.cut == "words":  # no special token is spelt in capitals, so none may come into being
            texts = [t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                     if t and "<|" not in t else t for t in texts]
        pieces = [CUTS[self.cut].findall(t) if t else [] for t in texts]
        if len(self.known) > self.remember:
            self.known, self.older = {}, self.known
        # Pieces are looked up once; of texts with new ones only these are looked up again.
        find = self.known.get
        found = [list(map(find, p)) for p in pieces]
        partly = [i for i, ids in enumerate(found) if None in ids]
        new = list(set(chain.from_iterable(compress(pieces[i], map(is_, found[i], repeat(None))) for i in partly)))
        if self.older:
            again = [p for p in new if p in self.older]
            self.known.update((p, self.older[p]) for p in again)
            new = [p for p in new if p not in self.older]
        long = {}
        if new:
            rest = new
            if self.model is not None:
                words = self._words_of(new)
                self.known.update(zip(words, self._of_words(words)))
                rest = [p for p in new if p not in self.known]
            short = [p for p in rest if len(p) <= LONGEST and PLAIN.fullmatch(p)]
            self.known.update(zip(short, self._joined(short)))
            rest = [p for p in rest if p not in self.known]
            alone = list(zip(rest, (self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(
                rest, add_special_tokens=False))))
            self.known.update((p, ids) for p, ids in alone if len(p) <= LONGEST)
            long = {p: ids for p, ids in alone if len(p) > LONGEST}
        for i in partly:
            found[i] = [(long[p] if p in long else self.known[p]) if ids is None else ids for p, ids in zip(pieces[i], found[i])]
        return [self._merged(ids) for ids in found]

    _merged = staticmethod(b"".join)

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _parts(self, encoded, low: np.ndarray, high: np.ndarray) -> list[bytes]:
        """The ids from each `low` up to `high`."""
        raw, width = self._bytes(encoded.ids), self.dtype.itemsize
        return [raw[i:j] for i, j in zip((low * width).tolist(), (high * width).tolist())]

    def _of_words(self, words: list[str]) -> list[bytes]:
        tokenize, ids, ends = self.model.tokenize, array("I"), []
        for word in self._all_shown(words):
            ids.extend([t.id for t in tokenize(word)])
            ends.append(len(ids))
        raw, width = self._bytes(ids), self.dtype.itemsize
        ends = [n * width for n in ends]
        return [raw[i:j] for i, j in zip([0, *ends], ends)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, from one text in which every piece stands by itself."""
        found: list[bytes] = []
        for first in range(0, len(pieces), 20_000):
            some = pieces[first:first + 20_000]
            parts = [p if p[0] == " " else "\n" + p for p in some]  # a space or newline starts anew
            ends = np.cumsum([len(p) for p in parts])
            own = ends - [len(p) for p in some]
            encoded = self.tokenizer.encode("".join(parts), add_special_tokens=False)
            at = np.array(encoded.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            found += self._parts(encoded, np.searchsorted(at, own), np.searchsorted(at, ends))
        return found


class TokenCounter(Encoder):
    """Texts to their numbers of token ids: of a piece only the number is remembered, and numbers are added up."""

    _merged = staticmethod(sum)

    def _bytes(self, ids: list[int]) -> int:
        return len(ids)

    def _of_words(self, words: list[str]) -> list[int]:
        tokenize = self.model.tokenize
        return [len(tokenize(w)) for w in self._all_shown(words)]

    def _parts(self, encoded, low: np.ndarray, high: np.ndarray) -> list[int]:
        return (high - low).tolist()


@lru_cache(maxsize=4)
def encoder(path: str, cut: str, dtype: str, remember: int = REMEMBER) -> Encoder:
    """One encoder per worker process, so that what it remembers outlives a task."""
    return Encoder(path, cut, dtype, remember)


@lru_cache(maxsize=4)
def token_counter(path: str, cut: str, remember: int = REMEMBER) -> TokenCounter:
    """One counter per worker process."""
    return TokenCounter(path, cut, remember=remember)


def id_type(vocabulary_size: int) -> str:
    """The narrowest unsigned type that holds every id."""
    return "<u2" if vocabulary_size <= 65_536 else "<u4"
