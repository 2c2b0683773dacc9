"""Carry detections to their repeats in the same document.

Everything happens inside a row; needles are looked up and repeats chosen in parts of Arrow batches. Labels go in
sorted order, longer needles first; a repeat is taken if it overlaps nothing taken before, detections of all labels included.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import by_parts
from ..functions.catalog import REPEATING_LABELS
from ..functions.folding import SPAN as PLACES
from ..functions.folding import find_all_folded
from ..functions.machine import FEW, Machine
from ..functions.text import strip
from .detect import SPANS

SURNAME = r"^\p{L}[\p{L}\p{N}_'\-]{2,}$"
NEEDLE = "array<struct<label:string,neg:int,needle:string>>"
REPEATS = "array<struct<label:string,start:int,end:int,before:int>>"


def needles(spans: Column, everywhere: bool = False) -> Column:
    """Distinct (label, -length, needle), in the order in which they are looked for."""
    own = spans if everywhere else F.filter(spans, lambda s: s["label"].isin(list(REPEATING_LABELS)))

    def of(s: Column) -> Column:
        whole = strip(s["text"])
        last = F.element_at(F.split(whole, r"(?U)\s+"), -1)
        made = F.array(whole, F.when((s["label"] == "person") & last.rlike(SURNAME), last))
        return F.transform(F.filter(made, lambda n: n.isNotNull() & (F.length(n) > 2)), lambda n: F.struct(s["label"].alias("label"), (-F.length(n)).alias("neg"), n.alias("needle")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(own, of)).cast(NEEDLE)))


def find_exact(needle: str, text: str, starts: list[int] | None = None) -> list[tuple[int, int]]:
    """Places where needle stands alone in text, letter by letter; they don't overlap. starts: all its places, if known."""
    out, free = [], 0
    for at in _each(needle, text) if starts is None else starts:
        end = at + len(needle)
        if at >= free and not (at and _in_word(text[at - 1])) and not (end < len(text) and _in_word(text[end])):
            out.append((at, end))
            free = end
    return out


def _each(needle: str, text: str) -> Iterator[int]:
    at = text.find(needle)
    while at >= 0:
        yield at
        at = text.find(needle, at + 1)


def find_all_exact(needles: list[str], text: str) -> list[list[tuple[int, int]]]:
    """find_exact for each needle, with one pass of the text for all of them."""
    if len(needles) < FEW:
        return [find_exact(n, text) for n in needles]
    starts = Machine(needles).starts(text)
    return [find_exact(n, text, starts.get(n, [])) for n in needles]


@lru_cache(100_000)
def _in_word(ch: str) -> bool:
    return ch in "_'-" or unicodedata.category(ch)[0] in "LN"


def exact_places(text: Column, found: Column) -> Column:
    """For each needle its places in the text."""

    def run(needles: list[list[str] | None], texts: list[str | None]) -> list[list[list[dict]]]:
        return [[[{"start": a, "end": b} for a, b in places] for places in find_all_exact(ns, t)] if ns is not None and t else [] for ns, t in zip(needles, texts, strict=True)]

    return by_parts(run, f"array<{PLACES}>")(F.transform(found, lambda n: n["needle"]), text)


def accept(taken: list[tuple[int, int]], candidates: list[tuple]) -> list[tuple]:
    """Candidates (.., start, end), in order, that overlap nothing taken before them. What is taken is kept as sorted
    intervals that don't overlap, so that one of them decides."""
    starts, ends = [], []
    for a, b in sorted(taken):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for c in candidates:
        a, b = c[-2:]
        i = bisect_left(starts, b)
        if not i or ends[i - 1] <= a:
            starts.insert(i, a)
            ends.insert(i, b)
            out.append(c)
    return out


def repeats(spans: Column, found: Column, places: Column) -> Column:
    """Repeats (label, start, end, nth of its label) that overlap nothing taken before them."""

    def run(*columns: list) -> list[list[dict] | None]:
        rows = []
        for s, e, names, lists in zip(*columns, strict=True):
            if s is None or lists is None:
                rows.append(None)
                continue
            each = [(n, p["start"], p["end"]) for n, ps in zip(names, lists, strict=False) for p in ps]
            seen: Counter = Counter()
            row = []
            for n, a, b in accept(list(zip(s, e, strict=True)), each):
                row.append({"label": n, "start": a, "end": b, "before": seen[n]})
                seen[n] += 1
            rows.append(row)
        return rows

    return by_parts(run, REPEATS)(F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"]), F.transform(found, lambda n: n["label"]), places)


def of_labels(spans: Column) -> Column:
    """For each label: its ordinal, its last place and id, its least confidence."""
    names = F.array_distinct(F.transform(spans, lambda s: s["label"]))

    def of(name: Column) -> Column:
        same = F.filter(spans, lambda s: s["label"] == name)
        return F.struct(F.element_at(same, 1)["label_ord"].alias("label_ord"), F.array_max(F.transform(same, lambda s: s["ord"])).alias("ord"), F.array_max(F.transform(same, lambda s: s["id"])).alias("id"), F.array_min(F.transform(same, lambda s: s["confidence"])).alias("confidence"))

    return F.map_from_arrays(names, F.transform(names, of))


def numbered(labels: Column, text: Column, found: Column) -> Column:
    """Repeats as spans: the label's least confidence, ids and places in the list after the label's last."""

    def of(c: Column) -> Column:
        last = labels[c["label"]]
        return F.struct(c["label"], last["label_ord"], last["ord"] + 1 + c["before"], last["id"] + 1 + c["before"], F.substring(text, c["start"] + 1, c["end"] - c["start"]), c["start"], c["end"], last["confidence"])

    return F.transform(found, of).cast(SPANS)


def propagate(docs: DataFrame, everywhere: bool = False, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with repeats added to their spans; ``everywhere`` takes all labels and matches loosely, in Arrow batches.

    Each step is a column of its own, used more than once by the next: it is worked out once for each row.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_needles", needles(F.col(spans), everywhere))
    places = find_all_folded(F.transform("_needles", lambda n: n["needle"]), body) if everywhere else exact_places(body, F.col("_needles"))
    out = out.withColumn("_places", places).withColumn("_repeats", repeats(F.col(spans), F.col("_needles"), F.col("_places"))).withColumn("_labels", of_labels(F.col(spans)))
    return out.withColumn(spans, F.concat(F.col(spans), numbered(F.col("_labels"), body, F.col("_repeats")))).drop("_needles", "_places", "_repeats", "_labels")
