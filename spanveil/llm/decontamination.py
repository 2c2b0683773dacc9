"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts are normalised: letters and digits in lower case, anything else between them one
space. A benchmark item of m characters is found in a document if some region is within
k = floor(ERROR_PERCENT / 100 * m) edits of it. A region within k edits shares at least
m + 1 - q - k * q of the item's q-grams (the q-gram lemma), all on diagonals within k of
each other. q is Q, or for short items the largest number for which that bound is 1 at least.
Shared q-grams are counted in diagonal bands, each twice as wide as the edit budget and
overlapping the next by half; bands whose distinct shared q-grams reach the bound are kept
and verified by an alignment that fills the band's diagonals and no other cell. The filter
loses no match; nothing of a document is skipped.

The q-grams of the benchmark go to every executor. Its size is checked: a benchmark beyond
MOST_ITEM_CHARS characters is dealt into blocks of about half that size by the hash of
item_id, with a pass over the documents for each; the driver holds one block at a time.
"""

from __future__ import annotations

from bisect import bisect_left

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, table

Q, ERROR_PERCENT, MOST_ITEM_CHARS, TABLE_BITS = 8, 10, 2_000_000, 22
SCHEMA = "item_id long, start int, end int, edits int"


@cache
def _fold_table() -> np.ndarray:
    """For each code point its small letter, or a space for what is no letter or digit."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x30000):
        ch = chr(c)
        if not ch.isalnum() and unicodedata.category(ch)[0] != "M":
            out[c] = 32
        elif len(low := ch.lower()) == 1:
            out[c] = ord(low)
    out[0x30000:0x110000] = np.where(np.arange(0x30000, 0x110000) < 0x32000, out[0x30000:0x110000], 32)
    return out


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end: (normalised code points, each one's place in the joined text, each one's text).

    Every text's part begins and ends with a space, so that no q-gram crosses texts
    unseen: two spaces in a row stand between texts and nowhere else.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64) + 2
    codes = _fold_table()[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    ends = np.cumsum(sizes)
    first, last = ends - sizes, ends - 1
    space = codes == 32
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first space of a run stays
    keep[first] = True
    keep[last] |= True
    if len(texts):
        # a run of spaces before a text's last place leaves two: drop the earlier one
        before = last - 1
        drop = before[(codes[before] == 32) & (before > first)]
        keep[drop] = False
    at = np.flatnonzero(keep)
    return codes[at], at, np.repeat(np.arange(len(texts)), sizes)[at]


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    h = np.zeros(max(0, len(codes) - q + 1), dtype=np.uint64)
    for k in range(q):
        h *= np.uint64(0x100000001B3)
        h += codes[k : len(h) + k]
    return mix(h)


def item_text(text: str) -> np.ndarray:
    """An item's normalised code points, without spaces around them."""
    codes = normalise([text or ""])[0]
    inner = np.flatnonzero(codes != 32)
    return codes[inner[0] : inner[-1] + 1] if len(inner) else codes[:0]


def gram_size(m: int, k: int, q: int = Q) -> int:
    """The largest q-gram, up to q, of which an item of m characters keeps one at least through any k edits."""
    return min(q, m // (k + 1))


class Benchmark:
    """Items by the size of their q-grams; those below Q characters match as whole words."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, percent: int = ERROR_PERCENT):
        coded = sorted(((i, item_text(t)) for i, t in items if i is not None and t), key=lambda x: x[0])
        self.tiny = [(i, c) for i, c in coded if 0 < len(c) < q]
        sizes: dict[int, list] = {}
        for i, c in coded:
            if len(c) >= q:
                k = percent * len(c) // 100
                sizes.setdefault(gram_size(len(c), k, q), []).append((i, c, k))
        self.grams = [Grams(x, part) for x, part in sorted(sizes.items())]

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of the regions; start and end in code points of the text."""
        if not texts:
            return []
        codes, at, text_of = normalise(texts)
        offsets = np.concatenate(([0], np.cumsum([len(t) + 2 for t in texts])))[:-1]
        out = self._tiny(codes, at, text_of, offsets)
        for part in self.grams:
            for t, i, a, b, e in part.find(codes, text_of):
                out.append((t, i, int(at[a] - offsets[t] - 1), int(at[b - 1] - offsets[t]), e))
        return out

    def _tiny(self, codes, at, text_of, offsets) -> list[tuple[int, int, int, int, int]]:
        """Items shorter than q: whole words equal to them."""
        out = []
        for i, c in self.tiny:
            word = np.concatenate(([32], c, [32]))
            hit = np.ones(max(0, len(codes) - len(word) + 1), dtype=bool)
            for k, x in enumerate(word):
                hit &= codes[k : len(hit) + k] == x
            for p in np.flatnonzero(hit).tolist():
                t = int(text_of[p + 1])
                out.append((t, i, int(at[p + 1] - offsets[t] - 1), int(at[p + len(c)] - offsets[t]), 0))
        return out


class Grams:
    """The q-grams of items (id, codes, edit budget), sorted by hash, with a bit table before them."""

    def __init__(self, q: int, items: list[tuple[int, np.ndarray, int]]):
        self.q = q
        self.ids, self.codes = [i for i, _, _ in items], [c for _, c, _ in items]
        self.budget = np.array([k for _, _, k in items], dtype=np.int64)
        self.least = np.array([len(c) + 1 - q - k * q for _, c, k in items], dtype=np.int64)
        parts = [grams(c, q) for c in self.codes]
        h = np.concatenate(parts)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner = np.repeat(np.arange(len(parts)), [len(g) for g in parts])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in parts])[order]
        self.bits = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.bits[(self.hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def find(self, codes: np.ndarray, text_of: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) in places of the normalised codes."""
        g = grams(codes, self.q)
        maybe = np.flatnonzero(self.bits[(g >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        low, high = np.searchsorted(self.hashes, g[maybe], "left"), np.searchsorted(self.hashes, g[maybe], "right")
        hit = high > low
        maybe, low, n = maybe[hit], low[hit], (high - low)[hit]
        if not len(maybe):
            return []
        # Texts and items may share q-grams without end, so hits are made in runs of bounded size: first the cells are counted, then those that are full are kept.
        ends = np.cumsum(n)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) + HITS, HITS)))
        runs = [slice(int(x), int(y)) for x, y in zip(cuts, [*cuts[1:], len(n)], strict=True) if y > x]
        counts = None
        if len(runs) > 1:
            counts = np.zeros((2, CELLS), dtype=np.int32)
            for r in runs:
                for shift, (*_, cell) in enumerate(self._cells(maybe[r], low[r], n[r], text_of)):
                    counts[shift] += np.bincount(cell, minlength=CELLS).astype(np.int32)
        found = []
        for r in runs:
            for shift, (text, item, band, j, cell) in enumerate(self._cells(maybe[r], low[r], n[r], text_of)):
                total = np.bincount(cell, minlength=1) if counts is None else counts[shift]
                full = total[cell] >= self.least[item]
                found.append(np.stack((text[full], item[full], band[full], j[full]), axis=1))
        rows = np.concatenate(found)
        if not len(rows):
            return []
        rows = rows[np.lexsort(rows.T[::-1])]
        rows = rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))]  # a q-gram of the item counts once in a band
        starts = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1))))
        bands = rows[starts][np.diff(np.append(starts, len(rows))) >= self.least[rows[starts, 1]]]
        out = []
        for i in np.unique(bands[:, 1]).tolist():
            mine = bands[bands[:, 1] == i]
            first = np.searchsorted(text_of, mine[:, 0], "left") + 1  # without the spaces around the text
            stop = np.searchsorted(text_of, mine[:, 0], "right") - 1
            w = int(self.budget[i]) + 1
            begin, end, edits = exact(self.codes[i], codes, mine[:, 2] * w, first, stop, 2 * w)
            left = np.flatnonzero(edits)  # an exact place in the band has the fewest edits of all
            if len(left):
                begin[left], end[left], edits[left] = align(self.codes[i], codes, mine[left, 2] * w, first[left], stop[left], 2 * w)
            good = np.flatnonzero((edits < w) & (end > begin))
            good = good[np.lexsort((end[good], begin[good], edits[good], mine[good, 0]))]
            out += [(t, self.ids[i], a, b, e) for t, a, b, e in apart(zip(*(x[good].tolist() for x in (mine[:, 0], begin, end, edits)), strict=True))]
        return out

    def _cells(self, maybe: np.ndarray, low: np.ndarray, n: np.ndarray, text_of: np.ndarray):
        """Hits of a run, once for each of the two bands that they lie in: (text, item, band, place in the item, cell).

        A hit is a position in the documents and one in an item with the same q-gram. Repeated hits and hits of bands
        that share a cell only raise a cell's count: what stays below the bound can go.
        """
        which = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        p, item, j = np.repeat(maybe, n), self.owner[which], self.place[which]
        band = (p - j) // (self.budget[item] + 1)  # band b has the diagonals [b * width, (b + 2) * width): a hit lies in b and in b - 1
        text = text_of[p]
        for shift in (0, 1):
            cell = (mix((((text * len(self.ids) + item) << 24) ^ (band - shift)).astype(np.uint64)) >> np.uint64(42)).astype(np.int64)
            yield text, item, band - shift, j, cell


#: Hits that are looked at together; cells in which bands are counted.
HITS, CELLS = 1 << 20, 1 << 22


def apart(regions) -> list[tuple[int, int, int, int]]:
    """Of (text, start, end, edits), those with the fewest edits come first: a region stays if it overlaps none that stays before it.

    Bands overlap, so one place may come from two of them, with more edits from one.
    """
    out: list[tuple[int, int, int, int]] = []
    text, starts, ends = None, [], []
    for t, a, b, e in regions:
        if t != text:
            text, starts, ends = t, [], []
        k = bisect_left(starts, b)
        if not k or ends[k - 1] <= a:
            starts.insert(k, a)
            ends.insert(k, b)
            out.append((t, a, b, e))
    return sorted(out)


def exact(item: np.ndarray, codes: np.ndarray, low: np.ndarray, first: np.ndarray, stop: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each band the first place of the item in it without any edit: (start, end, 0), or edits of 1 where there is none."""
    part, n = item.astype("<u4").tobytes(), len(item)
    start, found = np.zeros(len(low), dtype=np.int64), np.ones(len(low), dtype=np.int64)
    for r, (a, b) in enumerate(zip(np.maximum(low, first).tolist(), np.minimum(low + width + n - 1, stop).tolist(), strict=True)):
        whole = codes[a:b].astype("<u4").tobytes() if b - a >= n else b""
        at = whole.find(part)
        while at % 4 and at >= 0:
            at = whole.find(part, at + 1)
        if at >= 0:
            start[r], found[r] = a + at // 4, 0
    return start, start + n, found


#: Bands that are aligned side by side.
TOGETHER = 4096


def align(item: np.ndarray, codes: np.ndarray, low: np.ndarray, first: np.ndarray, stop: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each band the region with the fewest edits to the whole item among paths inside the band: (start, end, edits).

    A band has the diagonals low .. low + width - 1, where a diagonal is the place in codes less
    the place in the item; its text is codes[first:stop]. Row i of the table has a cell for each
    diagonal: the least cost of an alignment of the item's first i characters that ends
    there. Of equal costs the lowest diagonal counts.
    """
    if len(low) > TOGETHER:
        parts = [align(item, codes, *(x[k : k + TOGETHER] for x in (low, first, stop)), width) for k in range(0, len(low), TOGETHER)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    steps, far = np.arange(width), 1 << 20
    place = low[:, None] + steps  # of the next character on each diagonal
    first, stop = first[:, None], stop[:, None]
    cost = np.where((place >= first) & (place <= stop), 0, far)
    begin = place.copy()
    for x in item:
        new = np.where(place < stop, cost + (codes[np.clip(place, 0, len(codes) - 1)] != x), far)
        shorter = np.append(cost[:, 1:] + 1, np.full((len(low), 1), far), axis=1)  # a character of the item left out
        better = shorter < new
        new = np.where(better, shorter, new)
        source = np.where(better, np.append(begin[:, 1:], begin[:, -1:], axis=1), begin)
        slope = new - steps  # characters of the text put in: the least of new[d] + (e - d) over d <= e
        best = np.minimum.accumulate(slope, axis=1)
        origin = np.maximum.accumulate(np.where(slope == best, steps, 0), axis=1)
        place = place + 1
        cost, begin = np.where(place <= stop, best + steps, far), np.take_along_axis(source, origin, axis=1)
    at = cost.argmin(axis=1)[:, None]
    return tuple(np.take_along_axis(x, at, axis=1)[:, 0] for x in (begin, place, cost))


def _blocks(benchmark: DataFrame):
    """The benchmark's items in lists of bounded size, one list at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 if total <= MOST_ITEM_CHARS else -(-2 * total // MOST_ITEM_CHARS)
    for k in range(n):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64(F.lit(17), "item_id"), F.lit(n)) == k).collect()]


def _texts(column: pa.Array, most: int = 250_000):
    """(first row, texts) in runs of bounded size; null is empty."""
    run, first, size = [], 0, 0
    for i, t in enumerate(column.to_pylist()):
        if run and size + len(t or "") > most:
            yield first, run
            run, first, size = [], i, 0
        run.append(t or "")
        size += len(t or "")
    if run:
        yield first, run


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (key, item_id, start, end, edits) for each region of a document that is a benchmark item.

    Null or empty texts and items match nothing; an empty table on either side gives no
    rows. Equal items are each reported. Items with fewer than Q normalised characters match
    as whole words only. Repeated documents are each reported. Texts of any length are taken
    whole. Of regions with equally few edits in a band, the one that ends first is given.
    Other columns of docs are not read.
    """
    out = None
    for items in _blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(items)  # MOST_ITEM_CHARS at most

        def find(batches, held=held):
            known = Benchmark(held.value)
            for b in slices(batches):
                rows = [(b.column(0)[first + t].as_py(), i, s, e, d) for first, run in _texts(b.column(1)) for t, i, s, e, d in known.find(run)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((b.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32()))], [key, "item_id", "start", "end", "edits"])

        part = docs.select(key, text).mapInArrow(find, f"`{key}` {docs.schema[key].dataType.simpleString()}, {SCHEMA}")
        out = part if out is None else out.unionByName(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item; columns and other rows as they are. See ``contaminated_regions`` for the odd cases."""
    for items in _blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches, held=held):
            known = Benchmark(held.value)
            for b in slices(batches):
                bad = {first + t for first, run in _texts(b.column(b.schema.get_field_index(text))) for t, *_ in known.find(run)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents: doc_id, item_id, start, end, edits."""
    return contaminated_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
