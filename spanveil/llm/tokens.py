"""Token ids of whole texts by the ``tokenizers`` library, with a cache of words.

The library spends its time on merges, and words come again and again. Texts whose
characters are plain (see ``PLAIN``) are cut into the library's own pre-tokens with
array operations; each distinct pre-token is encoded by the library once and kept by
its 64-bit hash (two of 10 million words collide with a chance of 3 in a million).
Any other text, and any that holds an added token's string, goes to the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from itertools import chain

import numpy as np

from .common import BASE, mix, prefix_hash, span_hash

#: Up to this code point, and between the two others, the classes below are those of the library.
LATIN, PUNCTUATION = 0x250, (0x2010, 0x2028)
SPACE, LETTER, NUMBER, OTHER, STRANGE = range(5)


def _classes() -> np.ndarray:
    out = np.full(0x2028, STRANGE, dtype=np.uint8)
    for c in (*range(LATIN), *range(*PUNCTUATION)):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else SPACE if c in (9, 10, 11, 12, 13, 32, 0xA0) else OTHER
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x130]] = STRANGE
    return out


CLASSES = _classes()
PLAIN = CLASSES != STRANGE
CODES = mix(np.arange(len(CLASSES), dtype=np.uint64) * BASE + np.uint64(1))
#: The most words that a worker keeps before it starts anew.
MOST_WORDS = 400_000


def letters_after_quote(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lengths of the contractions ('s 't 'm 'd 're 've 'll) that begin at quotes; 0 for none. codes end with two zeros."""
    one, two = codes[at + 1], codes[at + 2]
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    return np.where(single, 2, np.where(double, 3, 0))


def pretokens(codes: np.ndarray, ends: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of plain texts that lie end to end in codes.

    ends: where each text ends. spaced: a space goes with the token after it and
    other white space makes tokens (byte-level pattern); else white space is dropped,
    and each number is a token.
    """
    n = len(codes)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = CLASSES[codes]
    fresh = np.zeros(n + 1, dtype=bool)  # texts begin
    fresh[0] = True
    fresh[ends] = True
    cut = np.empty(n, dtype=bool)
    cut[0] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    cut |= fresh[:n]
    if spaced:
        last = np.append(cut[1:], True) & (kind == SPACE) & ~fresh[1:]  # the last white space before a token
        after = np.flatnonzero(last)
        cut[after] = True
        attached = after[codes[after] == 32]
        cut[attached + 1] = False
        quotes = np.flatnonzero(cut & (codes == 39))  # an attached space isn't followed by a cut
    else:
        cut |= kind == NUMBER
        quotes = np.flatnonzero(cut & (codes == 39))
    if len(quotes):
        padded = np.concatenate((codes, [0, 0]))
        size = letters_after_quote(padded, quotes)
        stop = ends[np.searchsorted(ends, quotes, side="right")]
        run_of_one = np.append(kind, SPACE)[quotes + 1] == LETTER
        held = (size > 0) & run_of_one & (quotes + size <= stop)
        at, size = quotes[held], size[held]
        cut[at + 1] = False
        inner = at + size
        inside = inner < n
        cut[inner[inside]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    if not spaced:
        keep = kind[start] != SPACE
        start, end = start[keep], end[keep]
    return start, end


class Encoder:
    """Ids, or their number, for batches of texts."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.library.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.special = [t["content"] for t in form["added_tokens"]]
        steps = [form["pre_tokenizer"], *form["pre_tokenizer"].get("pretokenizers", [])] if form.get("pre_tokenizer") else []
        kinds = [s["type"] for s in steps]
        names = [x["type"] for x in (form.get("normalizer") or {}).get("normalizers", [])]
        byte_level = kinds == ["ByteLevel"] and steps[0]["use_regex"] and not steps[0]["add_prefix_space"] and form.get("normalizer") is None
        word_ends = kinds == ["Sequence", "Split", "ByteLevel"] and names == ["NFC", "Replace", "Lowercase"] and "[\\p{L}]+|[\\p{N}]|" in steps[1]["pattern"].get("Regex", "")
        self.fast, self.spaced = (byte_level or word_ends) and form["model"]["type"] == "BPE" and form.get("post_processor") is None, byte_level
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.young_keys, self.young_place = self.keys, self.place
        self.offsets, self.ids, self.used = np.zeros(1, np.int64), np.empty(0, np.uint32), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _find(self, keys, place, h):
        if not len(keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, place[at], -1)

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        got = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        first = len(self.offsets) - 1
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(sizes)))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))))
        keys = np.concatenate((self.young_keys, h))
        place = np.concatenate((self.young_place, np.arange(first, first + len(h))))
        order = np.argsort(keys)
        self.young_keys, self.young_place = keys[order], place[order]
        if len(keys) > 20_000 + len(self.keys) // 4:
            keys, place = np.concatenate((self.keys, self.young_keys)), np.concatenate((self.place, self.young_place))
            order = np.argsort(keys)
            self.keys, self.place = keys[order], place[order]
            self.young_keys, self.young_place = np.empty(0, np.uint64), np.empty(0, np.int64)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts end to end: the place of each pre-token's ids, and the texts' first and last pre-tokens."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        joined = "".join(texts)
        if not self.spaced:
            joined = joined.lower()  # plain texts keep their lengths
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        start, end = pretokens(codes, ends, self.spaced)
        hashes = span_hash(prefix_hash(CODES[codes]), start, end)
        if len(self.offsets) > MOST_WORDS:
            self.forget()
        known, where = np.unique(hashes, return_index=True)
        place = self._find(self.keys, self.place, known)
        young = place < 0
        place[young] = self._find(self.young_keys, self.young_place, known[young])
        missing = np.flatnonzero(place < 0)
        if len(missing):
            first = len(self.offsets) - 1
            at = where[missing]
            self._learn(known[missing], [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            place[missing] = np.arange(first, first + len(missing))
        first = np.searchsorted(start, ends - sizes)
        return place[np.searchsorted(known, hashes)], first, np.searchsorted(start, ends)

    def _split(self, texts: list[str]) -> tuple[list[int], list[int]]:
        plain, odd = [], []
        for i, t in enumerate(texts):
            easy = self.fast and not any(s in t for s in self.special)
            if easy and not t.isascii():
                codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
                easy = codes.max() < len(PLAIN) and bool(PLAIN[codes].all())
            elif easy:
                easy = not any(c in t for c in "\x1c\x1d\x1e\x1f")
            (plain if easy else odd).append(i)
        return plain, odd

    def _pieces(self, texts: list[str], at: list[int], most: int = 2_000_000):
        """Runs of plain texts of bounded size together."""
        run, size = [], 0
        for i in at:
            if run and size + len(texts[i]) > most:
                yield run
                run, size = [], 0
            run.append(i)
            size += len(texts[i])
        if run:
            yield run

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        plain, odd = self._split(texts)
        for run in self._pieces(texts, plain):
            place, first, last = self._plain([texts[i] for i in run])
            sums = np.concatenate(([0], np.cumsum(np.diff(self.offsets)[place])))
            out[run] = sums[last] - sums[first]
        for i in odd:
            out[i] = len(self.whole([texts[i]])[0])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain, odd = self._split(texts)
        for run in self._pieces(texts, plain):
            place, first, last = self._plain([texts[i] for i in run])
            size = self.offsets[place + 1] - self.offsets[place]
            sums = np.concatenate(([0], np.cumsum(size)))
            ids = self.ids[np.repeat(self.offsets[place] - sums[:-1], size) + np.arange(sums[-1])]
            for i, a, b in zip(run, sums[first].tolist(), sums[last].tolist(), strict=True):
                out[i] = ids[a:b]
        for i in odd:
            out[i] = self.whole([texts[i]])[0]
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if (path, special_as_text) not in _ENCODERS:
        _ENCODERS[path, special_as_text] = Encoder(path, special_as_text)
    return _ENCODERS[path, special_as_text]
