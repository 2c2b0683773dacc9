"""Boxes as structs of page_no, l, t, r, b (points, top-left origin), in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<page_no:int,l:double,t:double,r:double,b:double>"


def box(page: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(page.cast("int").alias("page_no"), left.cast("double").alias("l"), top.cast("double").alias("t"), right.cast("double").alias("r"), bottom.cast("double").alias("b"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["r"] - b["l"]) * F.greatest(F.lit(0.0), b["b"] - b["t"])


def centre(b: Column) -> tuple[Column, Column]:
    return (b["l"] + b["r"]) / 2, (b["t"] + b["b"]) / 2


def contains(b: Column, x: Column, y: Column) -> Column:
    """Edges count as inside; the page is not looked at."""
    return (b["l"] <= x) & (x <= b["r"]) & (b["t"] <= y) & (y <= b["b"])


def covered_by(a: Column, b: Column) -> Column:
    """The part of a that b covers; 0 on another page or for an empty a."""
    w = F.greatest(F.lit(0.0), F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"]))
    h = F.greatest(F.lit(0.0), F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"]))
    return F.when((a["page_no"] != b["page_no"]) | (area(a) == 0), F.lit(0.0)).otherwise(w * h / area(a))


def union(a: Column, b: Column) -> Column:
    """The box around both, on the page of the first."""
    return box(a["page_no"], F.least(a["l"], b["l"]), F.least(a["t"], b["t"]), F.greatest(a["r"], b["r"]), F.greatest(a["b"], b["b"]))


def padded(b: Column) -> Column:
    by = 1.0 + 0.15 * F.least(b["r"] - b["l"], b["b"] - b["t"])
    return box(b["page_no"], b["l"] - by, b["t"] - by, b["r"] + by, b["b"] + by)


def top_left(page: Column, left: Column, top: Column, right: Column, bottom: Column, height: Column, bottom_up: Column) -> Column:
    """A box whose origin may be at the bottom left, from the top left."""
    return box(page, left, F.when(bottom_up, height - top).otherwise(top), right, F.when(bottom_up, height - bottom).otherwise(bottom))


def user_rect(b: Column, rotation: Column, left: Column, bottom: Column, width: Column, height: Column) -> Column:
    """A box on the page as shown, in the PDF's own space: array of left, bottom, right, top.

    rotation turns the page clockwise; left, bottom, width and height are the crop box as stored.
    """
    turn = F.pmod(F.coalesce(rotation, F.lit(0)), F.lit(360))
    corners = (
        F.when(turn == 90, F.array(left + b["t"], bottom + b["l"], left + b["b"], bottom + b["r"]))
        .when(turn == 180, F.array(left + width - b["r"], bottom + b["t"], left + width - b["l"], bottom + b["b"]))
        .when(turn == 270, F.array(left + width - b["b"], bottom + height - b["r"], left + width - b["t"], bottom + height - b["l"]))
    )
    return corners.otherwise(F.array(left + b["l"], bottom + height - b["b"], left + b["r"], bottom + height - b["t"]))


def quad_points(rect: Column) -> Column:
    """Upper left, upper right, lower left, lower right, to three places."""
    l, b, r, t = (rect[i] for i in range(4))
    return F.transform(F.array(l, t, r, t, l, b, r, b), lambda x: F.bround(x, 3))
