"""Choose between overlapping spans and write the placeholders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, scan
from . import spans as S
from .detect import SPANS
from .propagate import propagate


def resolved(spans: Column) -> Column:
    """Spans that are written: by start, longer first, then by label and place in its list; one that begins before
    the last written one ends is passed over and moves nothing, so a tail beyond that end stays readable."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["label_ord"].alias("c"), s["ord"].alias("d"), s.alias("s"))))
    return scan(order, SPANS, F.lit(0), lambda cursor, x: (F.when(x["a"] >= cursor, x["s"]["end"]).otherwise(cursor), F.when(x["a"] >= cursor, F.array(x["s"])).otherwise(F.array().cast(SPANS))))


def united(spans: Column) -> Column:
    """Another choice, off by default: overlapping spans become one, under the first one's label and id; no tail stays."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["label_ord"].alias("c"), s["ord"].alias("d"), s.alias("s"))))
    empty = F.array().cast(SPANS)

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        joins = (F.size(kept) > 0) & (x["a"] < last["end"])
        wider = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(last.withField("end", F.greatest(last["end"], x["s"]["end"]))))
        return F.when(joins, wider.cast(SPANS)).otherwise(F.concat(kept, F.array(x["s"])).cast(SPANS))

    return F.aggregate(order, empty, step)


def placeholder(span: Column) -> Column:
    return F.concat(F.lit("["), span["label"], F.lit(":"), span["id"].cast("string"), F.lit("]"))


def splice(text: Column, kept: Column, replacement: Callable[[Column], Column] = placeholder) -> Column:
    """The text with each kept span replaced; all else as it is. Pieces are joined once."""

    def joined(x: Column) -> Column:
        whole, spans = x["whole"], x["spans"]
        end = lambda i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
        pieces = F.transform(spans, lambda s, i: F.concat(F.substring(whole, end(i) + 1, s["start"] - end(i)), replacement(s)))
        return F.concat(F.array_join(pieces, ""), F.substring(whole, end(F.size(spans)) + 1, F.length(whole)))

    return let(F.struct(text.alias("whole"), kept.alias("spans")), joined)


def redact(docs: DataFrame, blacklist: list[str] | None = None, everywhere: bool = False, drop_scraps: bool = False, unite: bool = False, replacement: Callable[[Column], Column] = placeholder) -> DataFrame:
    """docs(text, spans) with the final ``spans`` and ``redacted_text``: malformed and scrap detections go, repeats come,
    listed words are let through, and the rest is replaced. No row moves between tasks."""
    docs = docs.withColumn("spans", S.drop_malformed(F.col("spans")))
    if drop_scraps:
        docs = S.drop_scraps(docs)
    docs = propagate(docs, everywhere)
    docs = docs.withColumn("spans", S.drop_blacklisted(F.col("spans"), blacklist or []))
    choose = united if unite else resolved
    return docs.withColumn("_kept", choose(F.col("spans"))).withColumn("redacted_text", splice(F.coalesce("text", F.lit("")), F.col("_kept"), replacement)).drop("_kept")
