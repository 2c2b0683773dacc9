"""Redaction marks: merging, annotations for review, and the records that a PDF writer takes."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

SAME_MARK, COMMENT_LIMIT = 0.6, 120
MARKS_IN_BATCH = 10_000

# Outline colours by label.
COLOURS = {
    "person": (0.85, 0.1, 0.1),
    "organisation": (0.9, 0.5, 0.0),
    "adresse": (0.1, 0.35, 0.85),
    "telefonnummer": (0.1, 0.6, 0.2),
    "e-mail-adresse": (0.55, 0.2, 0.7),
    "signature": (0.0, 0.0, 0.0),
}
OTHER_COLOUR = (0.45, 0.45, 0.45)
MARK = "doc_id long, ord int, id string, box " + G.BOX + ", label string, confidence double, text string"


def merge_named(marks: DataFrame) -> DataFrame:
    """Marks with an id: one for each id and label, around all boxes, on the first one's page, with its text."""
    first = lambda c: F.min_by(c, "ord")
    box = G.box(first("box.page_no"), F.min("box.l"), F.min("box.t"), F.max("box.r"), F.max("box.b"))
    return marks.where("id <> ''").groupBy("doc_id", "id", "label").agg(F.min("ord").alias("ord"), box.alias("box"), F.max("confidence").alias("confidence"), first("text").alias("text")).select("doc_id", "ord", "id", "box", "label", "confidence", "text")


def _bands(marks: DataFrame, keys: list[str], low: str, high: str, name: str) -> DataFrame:
    """marks with a number ``name`` for each run of boxes that overlap along one axis; boxes of two runs never meet, however they are united."""
    lo, hi = F.least(f"box.{low}", f"box.{high}"), F.greatest(f"box.{low}", f"box.{high}")
    w = Window.partitionBy(*keys).orderBy("_lo")
    begins = F.coalesce(F.col("_lo") > F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return marks.withColumns({"_lo": lo, "_hi": hi}).withColumn("_begins", begins.cast("int")).withColumn(name, F.sum("_begins").over(w)).drop("_lo", "_hi", "_begins")


class Near:
    """Numbered boxes (l, t, r, b) and which of them a box may overlap: each lies in at most four cells of a grid as wide as its longer side."""

    def __init__(self) -> None:
        self.grids: dict[int, dict[tuple[int, int], set[int]]] = {}
        self.sizes: dict[int, int] = {}

    @staticmethod
    def _range(size: float, b: tuple) -> tuple[int, int, int, int]:
        return math.floor(b[0] / size), math.floor(b[1] / size), math.floor(b[2] / size), math.floor(b[3] / size)

    def _cells(self, b: tuple) -> tuple[int, list[tuple[int, int]]]:
        level = math.frexp(max(b[2] - b[0], b[3] - b[1]))[1]
        x0, y0, x1, y1 = self._range(2.0**level, b)
        return level, [(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]

    def put(self, n: int, b: tuple) -> None:
        level, cells = self._cells(b)
        grid = self.grids.setdefault(level, {})
        self.sizes[level] = self.sizes.get(level, 0) + 1
        for c in cells:
            grid.setdefault(c, set()).add(n)

    def drop(self, n: int, b: tuple) -> None:
        level, cells = self._cells(b)
        self.sizes[level] -= 1
        for c in cells:
            self.grids[level][c].discard(n)

    def meeting(self, b: tuple) -> set[int]:
        out: set[int] = set()
        for level, grid in self.grids.items():
            if not self.sizes[level]:
                continue
            x0, y0, x1, y1 = self._range(2.0**level, b)
            if (x1 - x0 + 1) * (y1 - y0 + 1) > len(grid):
                out.update(*grid.values())
            else:
                out.update(*(grid.get((x, y), ()) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)))
        return out


def _same(a: tuple, b: tuple) -> bool:
    shared = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return any(size > 0 and shared / size >= SAME_MARK for size in ((x[2] - x[0]) * (x[3] - x[1]) if x[2] > x[0] and x[3] > x[1] else 0.0 for x in (a, b)))


def _united(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and order, to the marks that are left; a group's united marks are held, not its rows."""
    key, kept, near, schema, ready = None, [], Near(), None, []
    for batch in batches:
        schema = batch.schema
        for row in batch.to_pylist():
            if row["_key"] != key:
                ready += kept
                key, kept, near = row["_key"], [], Near()
                if len(ready) >= MARKS_IN_BATCH:
                    yield pa.RecordBatch.from_pylist(ready, schema=schema)
                    ready = []
            box = (row["l"], row["t"], row["r"], row["b"])
            n = min((i for i in near.meeting(box) if _same(kept[i]["_box"], box)), default=None)
            if n is None:
                kept.append(row | {"_box": box})
                if box[2] > box[0] and box[3] > box[1]:
                    near.put(len(kept) - 1, box)
                continue
            first = kept[n]
            old, wide = first["_box"], (min(first["l"], box[0]), min(first["t"], box[1]), max(first["r"], box[2]), max(first["b"], box[3]))
            if wide != old:
                near.drop(n, old)
                near.put(n, wide)
            first |= {"_box": wide, "confidence": max((c for c in (first["confidence"], row["confidence"]) if c is not None), default=None)} | dict(zip("ltrb", wide, strict=True))
    if ready or kept:
        yield pa.RecordBatch.from_pylist(ready + kept, schema=schema)


def merge_unnamed(marks: DataFrame) -> DataFrame:
    """Marks without an id: one that covers six tenths of another of its label, or is covered so, is the same mark.

    In order, each is united with the first before it that it is the same as; that one's place and text stay.
    The order matters only among boxes that can come to overlap, so a page is first cut between rows of boxes and then
    between columns. Each part is gone through once, in order, and a mark is compared with near ones alone.
    A mark whose page or box isn't wholly known stands alone.
    """
    lone = marks.where("id = ''").select("doc_id", "ord", "id", "box", "label", "confidence", "text")
    known = F.coalesce(F.col("box.page_no").isNotNull() & F.forall(F.array("box.l", "box.t", "box.r", "box.b"), lambda v: F.abs(v) < float("inf")), F.lit(False))
    keys = ["doc_id", "label", "_page"]
    rows = _bands(lone.where(known).withColumn("_page", F.col("box.page_no")), keys, "t", "b", "_row")
    parts = _bands(rows, [*keys, "_row"], "l", "r", "_column")
    part = F.struct(*keys, "_row", "_column")
    inner = parts.select("doc_id", "label", "ord", "box.*", "confidence", "text", part.alias("_key"))
    order = ["_key", "ord", "page_no", "l", "t", "r", "b", "confidence", "text"]
    folded = inner.repartition("_key").sortWithinPartitions(*order).mapInArrow(_united, inner.schema)
    box = G.box(F.col("page_no"), F.col("l"), F.col("t"), F.col("r"), F.col("b"))
    return folded.select("doc_id", "ord", F.lit("").alias("id"), box.alias("box"), "label", "confidence", "text").unionByName(lone.where(~known))


def merge_marks(marks: DataFrame) -> DataFrame:
    return merge_named(marks).unionByName(merge_unnamed(marks))


def annotations(marks: DataFrame) -> DataFrame:
    """One row for each mention or picture with all its boxes, in the order first seen."""
    key = F.when(F.col("id") != "", F.col("id")).otherwise(F.concat_ws(":", F.lit("picture"), F.col("box.page_no").cast("string"), F.col("box.t").cast("string"), F.col("box.l").cast("string")))
    first = lambda c: F.min_by(c, "ord")
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("ord", "box"))), lambda x: x["box"])
    return marks.groupBy("doc_id", key.alias("id")).agg(F.min("ord").alias("ord"), first("label").alias("label"), first("text").alias("text"), first("confidence").alias("confidence"), boxes.alias("boxes"))


def boxes_from_json(c: Column) -> Column:
    """Boxes of a reviewed mark: objects with page, left, top, right, bottom, or bare arrays of five."""
    named = F.from_json(c, "array<struct<page:int,left:double,top:double,right:double,bottom:double>>")
    bare = F.from_json(c, "array<array<double>>")
    of_named = F.transform(named, lambda b: G.box(b["page"], b["left"], b["top"], b["right"], b["bottom"]))
    of_bare = F.transform(bare, lambda b: G.box(F.get(b, F.lit(0)), F.get(b, F.lit(1)), F.get(b, F.lit(2)), F.get(b, F.lit(3)), F.get(b, F.lit(4))))
    good = lambda a: a.isNotNull() & F.forall(a, lambda b: F.coalesce(b["page_no"] >= 1, F.lit(False)) & b["b"].isNotNull())
    return F.when(good(of_named), of_named).when(good(of_bare), of_bare)


def reviewed(marks: DataFrame) -> DataFrame:
    """One row for each box of reviewed marks(doc_id, ord, id, label, confidence, text, boxes, overlay), with its annotation's name."""
    each = marks.select("*", F.posexplode("boxes").alias("_i", "box")).drop("boxes")
    n = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("ord", "_i")) - 1
    name = F.when(F.col("id") == "", F.uuid()).otherwise(F.concat(F.col("id"), F.when(n > 0, F.concat(F.lit(":"), n.cast("string"))).otherwise("")))
    return each.withColumn("name", name).drop("_i")


def past_the_end(marks: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Documents with a mark beyond their last page, and the first such page."""
    return marks.join(page_counts, "doc_id").where(F.col("box.page_no") > F.col("pages")).groupBy("doc_id").agg(F.min("box.page_no").alias("page_no"))


def comment(label: Column, confidence: Column, text: Column) -> Column:
    covered = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    short = F.when(F.length(covered) > COMMENT_LIMIT, F.concat(F.substring(covered, 1, COMMENT_LIMIT - 1), F.lit("…"))).otherwise(covered)
    said = F.concat(label, F.lit(", Konfidenz "), F.format_string("%.2f", F.bround(confidence, 2)))
    return F.when(covered == "", said).otherwise(F.concat(said, F.lit(": «"), short, F.lit("»")))


def colour(label: Column) -> Column:
    out = F.array(*map(F.lit, OTHER_COLOUR))
    for name, rgb in COLOURS.items():
        out = F.when(label == name, F.array(*map(F.lit, rgb))).otherwise(out)
    return out


def records(marks: DataFrame, author: str = "spanveil") -> DataFrame:
    """Annotation records for marks joined with their pages' rotation, left, bottom, width, height, and the time ``at``."""
    rect = G.user_rect(F.col("box"), F.col("rotation"), F.col("left"), F.col("bottom"), F.col("width"), F.col("height"))
    date = F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "'D:'yyyyMMddHHmmss'Z'")
    return marks.withColumn("_rect", rect).select(
        "doc_id", F.col("box.page_no").alias("page_no"), F.lit("/Annot").alias("type"), F.lit("/Redact").alias("subtype"), F.transform("_rect", lambda x: F.bround(x, 3)).alias("rect"), G.quad_points(F.col("_rect")).alias("quad_points"),
        colour(F.col("label")).alias("c"), F.array(*[F.lit(0.0)] * 3).alias("ic"), F.lit(4).alias("f"), F.lit(author).alias("t"), F.concat(F.lit("Schwärzung: "), "label").alias("subj"), comment(F.col("label"), F.col("confidence"), F.col("text")).alias("contents"), F.col("name").alias("nm"), date.alias("created"), F.nullif(F.col("overlay"), F.lit("")).alias("overlay_text"),
    )
