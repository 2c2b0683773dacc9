"""Filters on a document's spans; order and ids of what stays don't change."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folding import scrap, scraps
from ..functions.machine import machine
from ..functions.text import strip


def well_formed(label: Column, text: Column) -> Column:
    """Postal codes have four digits and no leading zero; other labels are free."""
    return (label != "plz") | strip(text).rlike(r"^[1-9]\p{Nd}{3}$")


def drop_malformed(spans: Column) -> Column:
    return F.filter(spans, lambda s: well_formed(s["label"], s["text"]))


def above(spans: Column, threshold: float) -> Column:
    return F.filter(spans, lambda s: s["confidence"] >= threshold)


def blacklisted(text: Column, words: list[str]) -> Column:
    """Whether a text holds a listed word, whatever the case; an empty word is in every text."""
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(text), w)) if words else F.lit(False)


#: From so many words on a blacklist is looked for by an automaton; beyond the second figure it is no list but a table.
MANY_WORDS, MOST_WORDS = 64, 2_000_000


def drop_blacklisted(spans: Column, words: list[str]) -> Column:
    """spans without those whose text holds a listed word, whatever the case. A long list is one automaton in each worker."""
    words = sorted({w.lower() for w in words})
    if len(words) > MOST_WORDS:
        raise ValueError(f"a blacklist has {MOST_WORDS} words at most")
    if len(words) < MANY_WORDS or not words[0]:
        return F.filter(spans, lambda s: ~blacklisted(s["text"], words)) if words else spans
    shared = SparkSession.active().sparkContext.broadcast(tuple(words))

    def run(lists: pa.Array) -> pa.Array:
        known, seen = machine(shared.value), {}
        rows = []
        for texts in lists.to_pylist():
            for t in texts or ():
                if t not in seen:
                    seen[t] = t is not None and known.any(t.lower())
            rows.append(None if texts is None else [seen[t] for t in texts])
        return pa.array(rows, pa.list_(pa.bool_()))

    listed = F.arrow_udf(run, "array<boolean>").asNondeterministic()(F.transform(spans, lambda s: s["text"]))
    pairs = F.filter(F.arrays_zip(spans.alias("s"), listed.alias("f")), lambda z: ~z["f"])
    return F.transform(pairs, lambda z: z["s"])


def drop_scraps(docs: DataFrame, spans: str = "spans", key: str = "doc_id") -> DataFrame:
    """docs without spans that are no mentions. The texts, not the documents, go through Python."""
    flagged = docs.withColumn("_scrap", scraps(F.transform(spans, lambda s: s["text"])))
    kept = F.filter(F.arrays_zip(F.col(spans).alias("s"), F.col("_scrap").alias("f")), lambda z: ~z["f"])
    return flagged.withColumn(spans, F.transform(kept, lambda z: z["s"])).drop("_scrap")


def scrap_rows(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.where(~scrap(F.col(text)))


def entities_map(spans: Column, labels: list[str]) -> Column:
    """Map of label to spans with a key for every label, empty lists included."""

    def of(label: str) -> Column:
        return F.filter(spans, lambda s: s["label"] == label)

    return F.map_from_arrays(F.lit(labels), F.array(*map(of, labels)))
