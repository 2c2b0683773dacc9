"""Matching that overlooks case, accents, ligatures, dashes and broken spacing.

Spark has neither NFKD nor case folding, so these run as Arrow functions on parts of batches. A part's
texts are folded together: a table from code points to folded code points, which grows as
characters come up, is applied with array operations. A loose match is then a search for the
needle's signs (folded characters that are neither white space nor hyphens) among
the text's signs, whose gaps must be such as the needle allows.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import by_parts
from .machine import FEW, Machine

# Code points that count as a hyphen, and what is stripped from a token before it is looked up.
DASHES = (0x00AD, 0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2212)
STRIPPED = ".,;:!?()[]{}<>«»\"'"
HYPHEN, APOSTROPHE, UNDERSCORE = 45, 39, 95
SPAN = "array<struct<start:int,end:int>>"
#: Languages whose function words are no mentions; Spark brings lists of them.
LANGUAGES = ("german", "french", "italian", "english")
#: Characters that are folded together: each takes about 50 bytes meanwhile.
PIECE = 1 << 18
#: Kinds of signs.
LETTER, ALNUM, SPACE = 1, 2, 4


class FoldTable:
    """Folded code points of every code point met so far, end to end, and the kinds of code points."""

    def __init__(self):
        self.start, self.size = np.full(0x110000, -1, dtype=np.int32), np.zeros(0x110000, dtype=np.int32)
        self.kind = np.full(0x110000, 255, dtype=np.uint8)
        self.pool, self.used = np.zeros(1024, dtype=np.uint32), 0

    def _learn(self, codes: np.ndarray) -> None:
        for c in codes.tolist():
            folded = [ord(x) for x in unicodedata.normalize("NFKD", chr(c)).casefold() if not unicodedata.combining(x)]
            if self.used + len(folded) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            self.pool[self.used : self.used + len(folded)] = [HYPHEN if x in DASHES else x for x in folded]
            self.start[c], self.size[c] = self.used, len(folded)
            self.used += len(folded)

    def expand(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(folded code points, the place that each comes from)."""
        new = codes[self.start[codes] < 0]
        if len(new):
            self._learn(np.unique(new))
        size = self.size[codes]
        upto = np.cumsum(size)
        origin = np.repeat(np.arange(len(codes)), size)
        within = np.arange(len(origin)) - np.repeat(upto - size, size)
        return self.pool[np.repeat(self.start[codes], size) + within], origin

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        new = codes[self.kind[codes] == 255]
        for c in np.unique(new).tolist() if len(new) else ():
            ch = chr(c)
            self.kind[c] = LETTER * ch.isalpha() + ALNUM * ch.isalnum() + SPACE * ch.isspace()
        return self.kind[codes]


@lru_cache(1)
def table() -> FoldTable:
    return FoldTable()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def string(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def fold(text: str) -> tuple[str, list[int]]:
    """The folded text, and for each of its characters the place it comes from."""
    codes, origin = table().expand(code_points(text))
    return string(codes), origin.tolist()


def fold_batch(texts: list[str]) -> list[str]:
    """Folded texts of a batch. They are folded end to end in pieces, as each character folds by itself."""
    whole, ends = "".join(texts), np.cumsum([0, *map(len, texts)])
    cut, folded, done = np.zeros_like(ends), [], 0
    for at in range(0, len(whole), PIECE):
        codes, origin = table().expand(code_points(whole[at : at + PIECE]))
        own = slice(*np.searchsorted(ends, (at, at + PIECE), "right"))
        cut[own] = done + np.searchsorted(origin, ends[own] - at)
        folded.append(string(codes))
        done += len(codes)
    every = "".join(folded)
    return [every[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


@dataclass
class Signs:
    """A folded text without white space and hyphens, and what stood between its signs.

    spaces, hyphens: how many of each stand before a sign, and behind the last one. origin: a sign's
    place in the text. kind: LETTER, ALNUM. hyphen_before: whether the character right
    before a sign, or at the end, is a hyphen.
    """

    text: str
    codes: np.ndarray
    kind: np.ndarray
    origin: np.ndarray
    spaces: np.ndarray
    hyphens: np.ndarray
    hyphen_before: np.ndarray
    hyphen_after: np.ndarray


def signs(text: str) -> Signs:
    known = table()
    codes, origin = known.expand(code_points(text))
    codes = np.where(codes == 0x131, 0x69, codes)  # a dotless i is an i
    kind = known.kinds(codes)
    space, hyphen = (kind & SPACE) > 0, codes == HYPHEN
    at = np.flatnonzero(~space & ~hyphen)
    gaps = []
    for mark in (space, hyphen):
        upto = np.concatenate(([0], np.cumsum(mark)))
        edge = upto[np.append(at, len(codes))]
        gaps.append(np.diff(np.append(0, edge)))
    padded = np.concatenate(([False], hyphen, [False]))
    return Signs(string(codes[at]), codes[at], kind[at], origin[at], gaps[0], gaps[1], padded[at], padded[at + 2])


#: What may stand between two signs of a needle.
NOTHING, ONE_HYPHEN, ANYTHING, WHITE = range(4)


class Needle:
    """The signs of a needle and what may part them: white space where it has white space, anything
    blank or hyphenated between two letters, one hyphen at most where it has hyphens, nothing elsewhere."""

    def __init__(self, needle: str):
        s = signs(needle)
        self.text, self.size = s.text, len(s.codes)
        letters = (s.kind & LETTER) > 0
        both = letters[1:] & letters[:-1]
        spaces, hyphens = s.spaces[1 : self.size], s.hyphens[1 : self.size]
        self.gaps = np.where(spaces > 0, WHITE, np.where(both, ANYTHING, np.where(hyphens > 0, ONE_HYPHEN, NOTHING)))

    def places(self, text: Signs, starts: list[int] | None = None) -> list[tuple[int, int]]:
        """Where the needle stands alone: no letter, digit, apostrophe or hyphen right before or after it.

        starts: all places of its signs in the text's, if known.
        """
        out, n, free = [], self.size, 0
        for at in (self._starts(text.text) if starts is None else starts) if n else ():
            if at >= free and self._fits(text, at) and not self._held(text, at, before=True) and not self._held(text, at + n - 1, before=False):
                out.append((int(text.origin[at]), int(text.origin[at + n - 1]) + 1))
                free = at + n
        return out

    def _starts(self, text: str) -> Iterator[int]:
        at = text.find(self.text)
        while at >= 0:
            yield at
            at = text.find(self.text, at + 1)

    def _fits(self, text: Signs, at: int) -> bool:
        spaces, hyphens = text.spaces[at + 1 : at + self.size], text.hyphens[at + 1 : at + self.size]
        allowed = np.choose(self.gaps, ((spaces == 0) & (hyphens == 0), (spaces == 0) & (hyphens <= 1), np.ones(len(spaces), bool), (hyphens == 0) & (spaces > 0)))
        return bool(allowed.all())

    @staticmethod
    def _held(text: Signs, at: int, before: bool) -> bool:
        """Whether a sign belongs to a longer word on one side."""
        if (text.hyphen_before if before else text.hyphen_after)[at]:
            return True
        gap, other = (at, at - 1) if before else (at + 1, at + 1)
        if not 0 <= other < len(text.codes) or text.spaces[gap] or text.hyphens[gap]:
            return False
        return bool(text.kind[other] & ALNUM) or text.codes[other] == APOSTROPHE


@lru_cache(10_000)
def needle(text: str) -> Needle:
    return Needle(text)


def find(wanted: str, text: str) -> list[tuple[int, int]]:
    """Places where the needle stands alone in text, in code points of text; they don't overlap."""
    return needle(wanted).places(signs(text)) if wanted and text else []


@lru_cache(1)
def stopwords() -> frozenset[str]:
    """Function words of LANGUAGES from Spark's lists, folded. Needs a session, so it is called on the driver."""
    from pyspark.ml.feature import StopWordsRemover

    return frozenset(fold_batch([w for language in LANGUAGES for w in StopWordsRemover.loadDefaultStopWords(language)]))


def scrap_flags(texts: list[str], small: frozenset[str]) -> list[bool]:
    """Whether each detection is no mention: no two letters or digits in a row, or function words in small letters alone."""
    out = []
    for text, folded in zip(texts, fold_batch(texts), strict=True):
        alnum = (table().kinds(code_points(folded)) & ALNUM) > 0
        paired = bool((alnum[1:] & alnum[:-1]).any())
        out.append(not paired or (text.islower() and small.issuperset(t.strip(STRIPPED) for t in folded.split())))
    return out


def is_scrap(text: str) -> bool:
    return scrap_flags([text], stopwords())[0]


def fold_text(texts: Column | str) -> Column:
    """Folded texts; null stays null."""

    def run(texts: list[str | None]) -> list[str | None]:
        return [None if t is None else f for t, f in zip(texts, fold_batch([t or "" for t in texts]), strict=True)]

    return by_parts(run, "string")(texts)


def scrap(texts: Column | str) -> Column:
    """Whether each text is a scrap; null for null."""
    small = stopwords()

    def run(texts: list[str | None]) -> list[bool | None]:
        flags = scrap_flags([t or "" for t in texts], small)
        return [None if t is None else f for t, f in zip(texts, flags, strict=True)]

    return by_parts(run, "boolean")(texts)


def scraps(lists: Column | str) -> Column:
    """For each text of a list whether it is a scrap."""
    small = stopwords()

    def run(lists: pa.Array) -> pa.Array:
        words = lists.flatten().dictionary_encode()  # most of a batch's words come again
        flags = pa.array(scrap_flags(words.dictionary.to_pylist(), small), pa.bool_()).take(words.indices)
        ends = np.cumsum(np.append(0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flags, mask=lists.is_null())

    return F.arrow_udf(run, "array<boolean>").asNondeterministic()(lists)


def find_all(needles: list[str], text: str) -> list[list[dict]]:
    """find() for several needles, folding the text once and looking for the signs of all in one pass."""
    if not len(needles):
        return []
    body, known = signs(text), [needle(n) if n else None for n in needles]
    starts = Machine(n.text for n in known if n).starts(body.text) if len(known) >= FEW else None
    each = [n.places(body, None if starts is None else starts.get(n.text, [])) if n else [] for n in known]
    return [[{"start": a, "end": b} for a, b in places] for places in each]


def find_folded(needles: Column | str, texts: Column | str) -> Column:
    def run(needles: list[str | None], texts: list[str | None]) -> list[list[dict]]:
        return [find_all([n], t)[0] if n and t else [] for n, t in zip(needles, texts, strict=True)]

    return by_parts(run, SPAN)(needles, texts)


def find_all_folded(needles: Column | str, texts: Column | str) -> Column:
    """For each needle of a list its places."""

    def run(needles: list[list[str] | None], texts: list[str | None]) -> list[list[list[dict]]]:
        return [find_all(ns, t) if ns is not None and t else [] for ns, t in zip(needles, texts, strict=True)]

    return by_parts(run, f"array<{SPAN}>")(needles, texts)
