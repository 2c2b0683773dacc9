"""Words of pages to their lines and regions, and to a document's text units: rows of a document that lie together, then arrays in the task.

Rows come together by one shuffle, or are made so in a document's own row and need none. Boxes and points meet in the cells of a grid, so a page's work follows its words and not words times boxes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.batches import give_back
from .layout import UNIT_GAP

#: Points to a side of the grid's cells; pairs of a point and a box that are looked at together; words that are placed together.
CELL, AT_ONCE, ROWS = 128.0, 1 << 20, 20_000
WORD, LINE, REGION = 0, 1, 2
SIDES = ("l", "t", "r", "b")
#: A letter and a hyphen at a word's end, before a line's end if there is one, as Java's $ has it.
BROKEN = r"\p{L}-(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?$"
PLACED = f"doc_id {{}}, page_no {{}}, word_idx long, text string, box {G.BOX}, line_idx long, line_first long, read boolean, region_idx long, hidden boolean"


def _key(page: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A number for each cell; far cells may share one, which costs a look and no result."""
    return (page << 40) | ((x & 0xFFFFF) << 20) | (y & 0xFFFFF)


def _cells(v: np.ndarray) -> np.ndarray:
    return np.floor(np.nan_to_num(v) / CELL).astype(np.int64)


def holders(page: np.ndarray, box: np.ndarray, at_page: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(point, box) of all boxes (l, t, r, b) that hold a point of their page, edges included, in parts."""
    if not len(page) or not len(at_page):
        return
    x0, y0 = _cells(box[:, 0]), _cells(box[:, 1])
    wide, high = np.maximum(_cells(box[:, 2]) - x0, 0) + 1, np.maximum(_cells(box[:, 3]) - y0, 0) + 1
    n = wide * high
    own = np.repeat(np.arange(len(page)), n)
    k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    key = _key(page[own], x0[own] + k % wide[own], y0[own] + k // wide[own])
    order = np.argsort(key, kind="stable")
    key, own = key[order], own[order]
    wanted = _key(at_page, _cells(at[:, 0]), _cells(at[:, 1]))
    first = np.searchsorted(key, wanted)
    n = np.searchsorted(key, wanted, "right") - first
    sums, begin = np.cumsum(n), 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + AT_ONCE)))
        m = n[begin:end]
        point = np.repeat(np.arange(begin, end), m)
        mine = own[np.arange(len(point)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[begin:end], m)]
        b, p = box[mine], at[point]
        hit = (b[:, 0] <= p[:, 0]) & (p[:, 0] <= b[:, 2]) & (b[:, 1] <= p[:, 1]) & (p[:, 1] <= b[:, 3])
        yield point[hit], mine[hit]
        begin = end


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.cast(column, pa.float64()), np.nan).to_numpy()


def _sides(boxes: pa.ChunkedArray) -> np.ndarray:
    whole = boxes.combine_chunks()
    return np.column_stack([_numbers(pc.struct_field(whole, s)) for s in SIDES])


def _centres(box: np.ndarray) -> np.ndarray:
    return (box[:, :2] + box[:, 2:]) / 2


def _pages_of(t: pa.Table, by: tuple[str, ...] = ("doc_id", "page_no")) -> np.ndarray:
    """A number for each run of rows of one page; a row without a document or a page is a page of its own."""
    fresh = np.zeros(len(t), dtype=bool)
    for c in (t.column(c).combine_chunks() for c in by):
        fresh[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
    return np.cumsum(fresh)


def _read_over_drawn(page: np.ndarray, box: np.ndarray, drawn: np.ndarray, read: np.ndarray) -> np.ndarray:
    """Whether each word is read from pixels and its centre lies in a drawn word's box."""
    over = np.zeros(len(page), dtype=bool)
    ink, seen = np.flatnonzero(drawn & ~read), np.flatnonzero(read)
    for p, _ in holders(page[ink], box[ink], page[seen], _centres(box[seen])):
        over[seen[p]] = True
    return over


def _smallest(page: np.ndarray, box: np.ndarray, idx: np.ndarray, at_page: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the smallest region that holds it, the first of equal ones, and whether there is one."""
    none = np.iinfo(np.int64).max
    area = np.maximum(0, box[:, 2] - box[:, 0]) * np.maximum(0, box[:, 3] - box[:, 1])
    rank = np.empty(len(page), dtype=np.int64)
    by_size = np.lexsort((idx, area))
    rank[by_size] = np.arange(len(page))
    best = np.full(len(at_page), none)
    for p, h in holders(page, box, at_page, at):
        np.minimum.at(best, p, rank[h])
    inside = best != none
    out = np.zeros(len(at_page), dtype=np.int64)
    out[inside] = idx[by_size[best[inside]]]
    return out, inside


def placed_pages(t: pa.Table) -> pa.Table:
    """The words of whole pages(doc_id, page_no, kind, idx, text, box, drawn, read) with their line and region, see placed()."""
    page = _pages_of(t)
    kind, idx = t.column("kind").to_numpy(), t.column("idx").to_numpy()
    box = _sides(t.column("box"))
    word, line, region = (np.flatnonzero(kind == k) for k in (WORD, LINE, REGION))
    drawn, read = (pc.fill_null(t.column(c), False).to_numpy()[word] for c in ("drawn", "read"))
    centre = _centres(box[word])
    page_w, number = page[word], idx[word]

    none = np.iinfo(np.int64).max
    line_idx = np.full(len(word), none)
    for p, h in holders(page[line], box[line], page_w, centre):
        np.minimum.at(line_idx, p, idx[line][h])
    line_idx = np.where(line_idx == none, -1 - number, line_idx)
    order = np.lexsort((number, line_idx, page_w))
    head = np.append(True, (np.diff(page_w[order]) != 0) | (np.diff(line_idx[order]) != 0)) if len(order) else np.zeros(0, dtype=bool)
    line_first = np.empty(len(word), dtype=np.int64)
    line_first[order] = number[order][head][np.cumsum(head) - 1]

    keep = ~_read_over_drawn(page_w, box[word], drawn, read)
    region_idx, inside = _smallest(page[region], box[region], idx[region], page_w, centre)

    out = t.take(pa.array(word[keep]))
    columns = {c: out.column(c) for c in ("doc_id", "page_no")} | {"word_idx": out.column("idx"), "text": out.column("text"), "box": out.column("box")}
    columns |= {"line_idx": pa.array(line_idx[keep]), "line_first": pa.array(line_first[keep]), "read": pa.array(read[keep])}
    return pa.table(columns | {"region_idx": pa.array(region_idx[keep], mask=~inside[keep]), "hidden": pa.array(~(drawn | read)[keep])})


def uncovered(t: pa.Table) -> pa.Table:
    """The words of whole pages without those read over drawn ones."""
    drawn, read = (pc.fill_null(t.column(c), False).to_numpy() for c in ("drawn", "read"))
    return t.filter(pa.array(~_read_over_drawn(_pages_of(t), _sides(t.column("box")), drawn, read)))


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any of the keys; the first row does."""
    fresh = np.zeros(len(keys[0]), dtype=bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(fresh)


def _before(n: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each number the sum of those before it in its group; begin: where the groups begin."""
    sums = np.cumsum(n) - n
    return sums - np.repeat(sums[begin], np.diff(np.append(begin, len(n))))


def _lists(begin: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(begin, len(values)), pa.int32()), values)


def _in_order(w: pa.Table, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order in which placed words stand in their documents' units, where units begin in it, and which words end a line: see layout.text_units."""
    page, number, line, first = (w.column(c).to_numpy() for c in ("page_no", "word_idx", "line_idx", "line_first"))
    read, hidden = (w.column(c).to_numpy().astype(np.int64) for c in ("read", "hidden"))
    loose = w.column("region_idx").is_null().to_numpy().astype(np.int64)
    place = np.where(loose, first, pc.fill_null(w.column("region_idx"), 0).to_numpy())
    unit = (doc * 4 + hidden * 2 + loose, np.where(loose, page.astype(np.int64) * 2 + read, 0), place)
    run = (page.astype(np.int64) * 2 + read, line)
    order = np.lexsort((*_text_ranks(w, doc, page, number), number, *reversed(run), *reversed(unit)))
    unit, run = [k[order] for k in unit], [k[order] for k in run]
    begin = _begins(*unit, *run)
    n = np.diff(np.append(begin, len(order)))
    of_unit = np.zeros(len(order), dtype=np.int64)
    of_unit[_begins(*unit)] = 1
    of_unit = np.cumsum(of_unit)[begin]
    side = _sides(w.column("box").take(pa.array(order)))
    left, top = (np.minimum.reduceat(side[:, i], begin) for i in (0, 1))
    runs = np.lexsort((number[order][begin], first[order][begin], read[order][begin], left, top, of_unit))
    n = n[runs]
    ends = np.cumsum(n)
    order = order[np.arange(len(order)) - np.repeat(ends - n, n) + np.repeat(begin[runs], n)]
    last = np.zeros(len(order), dtype=bool)
    last[ends - 1] = True
    return order, (ends - n)[_begins(of_unit[runs])], last


def _text_ranks(w: pa.Table, doc: np.ndarray, page: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
    """The order of texts, where a page has two words of one number."""
    order = np.lexsort((number, page, doc))
    if len(_begins(doc[order], page[order], number[order])) == len(order):
        return []
    return [pc.rank(w.column("text").combine_chunks(), tiebreaker="dense").to_numpy()]


def unit_documents(t: pa.Table, boxes: bool = False) -> pa.Table:
    """Whole documents' rows (see placed_pages) to a row for each document that has words, see units()."""
    w = placed_pages(t)
    if not len(w):
        return w
    doc = _pages_of(w, ("doc_id",))
    order, begin, last = _in_order(w, doc)
    w, doc = w.take(pa.array(order)), doc[order]
    text, box = (w.column(c).combine_chunks() for c in ("text", "box"))
    first = np.zeros(len(w), dtype=bool)
    first[begin] = True
    # A broken word ends a line and goes on with a letter in the next one of its unit.
    at = np.flatnonzero(last[:-1] & ~first[1:])
    at = at[pc.match_substring_regex(text.take(pa.array(at)), BROKEN).to_numpy(zero_copy_only=False)]
    at = at[pc.match_substring_regex(text.take(pa.array(at + 1)), r"^\p{L}").to_numpy(zero_copy_only=False)]
    broken = np.zeros(len(w), dtype=bool)
    broken[at] = True
    text = pc.if_else(pa.array(broken), pc.utf8_slice_codeunits(text, 0, -1), text) if len(at) else text
    gap = ~first
    gap[1:] &= ~broken[:-1]
    pieces = pc.binary_join_element_wise(pc.if_else(pa.array(gap), " ", ""), text, "")
    n = pc.utf8_length(text).to_numpy().astype(np.int64)
    start = _before(n + gap, begin) + gap

    u_text = pc.binary_join(_lists(begin, pieces), "")
    of_doc = _begins(doc[begin])
    u_n = pc.utf8_length(u_text).to_numpy().astype(np.int64)
    u_start = _before(u_n + len(UNIT_GAP), of_doc)
    ints = lambda v: pa.array(v, pa.int32())
    columns = {"text": u_text, "page_no": pc.struct_field(box.take(pa.array(begin)), "page_no"), "start": ints(u_start), "end": ints(u_start + u_n)}
    if boxes:
        columns["words"] = _lists(begin, pa.StructArray.from_arrays([box, ints(start), ints(start + n)], ["box", "start", "end"]))
    units = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.table({"doc_id": w.column("doc_id").take(pa.array(begin[of_doc])), "text": pc.binary_join(_lists(of_doc, u_text), UNIT_GAP), "units": _lists(of_doc, units)})


def _whole_pages(batches: Iterable[pa.RecordBatch], make: Callable[[pa.Table], pa.Table] = placed_pages, by: tuple[str, ...] = ("doc_id", "page_no")) -> Iterator[pa.RecordBatch]:
    """Rows by page (or document) through make, so many together as whole pages have."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n < ROWS:
            continue
        t = pa.Table.from_batches(held)
        other = pc.fill_null(reduce(pc.or_kleene, (pc.not_equal(t.column(c), t.column(c)[-1]) for c in by)), True).to_numpy()
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            yield from make(t.slice(0, cut)).to_batches(10_000)
        held = t.slice(cut).to_batches()
        n = 0 if cut else -len(t)  # a page that is longer is looked at again when it has grown by as much
    if held:
        yield from make(pa.Table.from_batches(held)).to_batches(10_000)


def not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def together(words: DataFrame, lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows (doc_id, page_no, kind, idx, box, drawn, read, text) of words(doc_id, page_no, word_idx, text, box, drawn, read), lines and regions,
    those of a document and a page together: one shuffle of the words.

    Blank words go; words without a document or a page go, as they meet no line.
    """

    def rows(df: DataFrame, kind: int, idx: str, page: str = "page_no", own: bool = False) -> DataFrame:
        more = [F.col(c) if own else F.lit(None).cast(t).alias(c) for c, t in (("drawn", "boolean"), ("read", "boolean"), ("text", "string"))]
        return df.select("doc_id", F.col(page).cast("int").alias("page_no"), F.lit(kind).alias("kind"), F.col(idx).cast("long").alias("idx"), F.col("box").cast(G.BOX).alias("box"), *more)

    full = words.where(not_blank(F.col("text")))
    every = rows(full, WORD, "word_idx", own=True).unionByName(rows(lines, LINE, "line_idx")).unionByName(rows(regions, REGION, "region_idx", "box.page_no"))
    return every.where("doc_id is not null and page_no is not null").repartition("doc_id").sortWithinPartitions("doc_id", "page_no")


def placed(words: DataFrame, lines: DataFrame, regions: DataFrame) -> DataFrame:
    """words with ``line_idx``, ``line_first``, ``region_idx`` and ``hidden``.

    The same as words_to_lines, drop_read_over_drawn and words_to_regions one after the other (see there), with the words
    shuffled once, see together().
    """
    return together(words, lines, regions).mapInArrow(_whole_pages, PLACED.format(dict(words.dtypes)["doc_id"], "int"))


def units(rows: DataFrame, boxes: bool = False) -> DataFrame:
    """A row for each document of together()'s rows: doc_id, text, and units (text, page_no, and start and end in the document's text).

    The units of layout.text_units() and the text of layout.join_units(), without another shuffle; page_no is that of the
    unit's box. With ``boxes`` a unit has its words (box, and start and end in the unit's text). A document's words are in
    memory together.
    """
    words = f",words:array<struct<box:{G.BOX},start:int,end:int>>" if boxes else ""
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, text string, units array<struct<text:string,page_no:int,start:int,end:int{words}>>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in _whole_pages(batches, partial(unit_documents, boxes=boxes), ("doc_id",)):
            if len(made):
                yield made
        give_back()

    return rows.mapInArrow(run, schema)


def without_read_over_drawn(words: DataFrame) -> DataFrame:
    """layout.drop_read_over_drawn with one shuffle of the words and no join."""
    dealt = words.where("read is not null").repartition("doc_id").sortWithinPartitions("doc_id", "page_no")
    return dealt.mapInArrow(lambda batches: _whole_pages(batches, uncovered), words.schema)
