"""Detectors: rules as JVM expressions, ready-made tables, word lists, or a caller's own model.

Spans are kept as an array in the document's row, so that the pipeline after it moves no
rows. Rules find shapes and have confidence 1.0; they are no model.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import scan
from ..sources.files import SUCCEEDED, followed

SPAN = "struct<label:string,label_ord:int,ord:int,id:int,text:string,start:int,end:int,confidence:double>"
SPANS = f"array<{SPAN}>"

#: Shapes that Java and RE2 read alike (no look-around).
RULES = {
    "e-mail-adresse": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip-adresse": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "telefonnummer": r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}|\+?[0-9]{2,3} [0-9]{2,3} [0-9]{3} [0-9]{2} [0-9]{2}|[0-9]{3}-[0-9]{3}-[0-9]{4}",
    "iban": r"CH[0-9]{2} ?[0-9]{4} ?[0-9]{4} ?[0-9]{4} ?[0-9]{4} ?[0-9]",
    "ahv-nummer": r"756\.[0-9]{4}\.[0-9]{4}\.[0-9]{2}",
    "mac-adresse": r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}",
    "kfz-kennzeichen": r"(?:AG|AI|AR|BE|BL|BS|FR|GE|GL|GR|JU|LU|NE|NW|OW|SG|SH|SO|SZ|TG|TI|UR|VD|VS|ZG|ZH) [0-9]{1,6}",
    "uid-nummer": r"CHE-[0-9]{3}\.[0-9]{3}\.[0-9]{3}",
    "url": r"https?://[^ \t\r\n<>\"]+",
    "datum": r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}",
    "geldbetrag": r"(?:CHF|Fr\.) ?[0-9][0-9']*(?:\.[0-9]{2}|\.-)?",
    "plz": r"[1-9][0-9]{3}",
}


#: What every match of a pattern holds.
LITERALS = {RULES[k]: v for k, v in (("e-mail-adresse", "@"), ("iban", "CH"), ("ahv-nummer", "756."), ("uid-nummer", "CHE-"), ("url", "://"))}
FOUND = "array<struct<text:string,start:int,end:int>>"


def occurrences(text: Column, pattern: Column | str) -> Column:
    """array<struct<text,start,end>> of a pattern's matches, in order: what is split off and what is extracted add up.

    One scan of both lists, so that neither is made anew for each match.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("part"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["part"])
        end = begin + F.length(x["hit"])
        found = F.array(F.struct(x["hit"].alias("text"), begin.alias("start"), end.alias("end"))).cast(FOUND)
        return F.coalesce(end, at), F.when(x["hit"].isNull(), F.array().cast(FOUND)).otherwise(found)

    return scan(pairs, FOUND, F.lit(0), step)


def _labelled(found: Column, label: str, ordinal: int, confidence: float = 1.0) -> Column:
    return F.transform(found, lambda x, i: F.struct(F.lit(label).alias("label"), F.lit(ordinal).alias("label_ord"), i.alias("ord"), (i + 1).alias("id"), x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), F.lit(confidence).alias("confidence")))


def if_any(text: Column, pattern: str) -> Column:
    """occurrences() where there are any: most texts lack most shapes, and one look is cheaper than splitting and extracting."""
    some = text.rlike(pattern)
    if pattern in LITERALS:
        some = F.contains(text, F.lit(LITERALS[pattern])) & some
    return F.when(some, occurrences(text, pattern)).otherwise(F.array().cast(FOUND))


def rule_spans(text: Column, rules: dict[str, str]) -> Column:
    """Numbered spans of all rules, label by label."""
    return F.concat(*[_labelled(if_any(F.coalesce(text, F.lit("")), p), label, i) for i, (label, p) in enumerate(rules.items())]).cast(SPANS)


class Detector(Protocol):
    def detect(self, docs: DataFrame, types: list[str], threshold: float) -> DataFrame:
        """docs with a column ``spans`` (SPANS) of the types, of the threshold's confidence at least."""


class RuleDetector:
    def __init__(self, rules: dict[str, str] | None = None):
        self.rules = rules or RULES

    def detect(self, docs: DataFrame, types: list[str], threshold: float = 0.8) -> DataFrame:
        return docs.withColumn("spans", rule_spans(F.col("text"), {t: self.rules[t] for t in types if t in self.rules}) if any(t in self.rules for t in types) else F.array().cast(SPANS))


class TableDetector:
    """Detections made elsewhere: (doc_id, label, pos, text, start, end, confidence)."""

    def __init__(self, detections: DataFrame):
        self.detections = detections

    def detect(self, docs: DataFrame, types: list[str], threshold: float = 0.8) -> DataFrame:
        order = F.array_position(F.lit(types), F.col("label")) - 1
        found = self.detections.where(F.col("label").isin(types) & (F.col("confidence") >= threshold)).withColumn("label_ord", order.cast("int"))
        return docs.join(collect_spans(found), "doc_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


class CallableDetector:
    """A caller's model: fn(texts, types, threshold) gives for each text a list of (label, start, end, confidence)."""

    def __init__(self, fn: Callable[[list[str], list[str], float], list[list[tuple[str, int, int, float]]]]):
        self.fn = fn

    def detect(self, docs: DataFrame, types: list[str], threshold: float = 0.8) -> DataFrame:
        fn = self.fn
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))

        def run(texts: pa.Array) -> pa.Array:
            each = fn([t or "" for t in texts.to_pylist()], types, threshold)
            return pa.array([[{"label": x[0], "start": x[1], "end": x[2], "confidence": x[3]} for x in found if x[3] >= threshold] for found in each], kind)

        # Texts alone go through Python: a document's row may hold all its words.
        called = F.arrow_udf(run, "array<struct<label:string,start:int,end:int,confidence:double>>").asNondeterministic()
        found = docs.withColumn("_found", called("text"))

        def of(label: str, i: int) -> Column:
            own = F.filter("_found", lambda x: x["label"] == label)
            return F.transform(own, lambda x, k: F.struct(F.lit(label), F.lit(i), k, k + 1, F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]), x["start"], x["end"], x["confidence"])).cast(SPANS)

        each = [of(label, i) for i, label in enumerate(types)]
        return found.withColumn("spans", F.concat(*each)).drop("_found")


class ServiceDetector(CallableDetector):
    """A model behind a task service: each Arrow batch of texts is one task, submitted, polled until it ends, and fetched.

    submit(texts, types, threshold) gives a task; poll(task) gives its state, and is tried again where it raises (see
    ``followed``); fetch(task) gives what a CallableDetector's function does. All three run on executors; a failed or
    overdue task fails the Spark task, which is then run again.
    """

    def __init__(self, submit: Callable, poll: Callable, fetch: Callable, interval: float = 1.0, timeout: float = 3600.0):
        def fn(texts: list[str], types: list[str], threshold: float) -> list[list[tuple[str, int, int, float]]]:
            task = submit(texts, types, threshold)
            if (state := followed(task, poll, interval, timeout)) not in SUCCEEDED:
                raise RuntimeError(f"detection task {task}: {state}")
            return fetch(task)

        super().__init__(fn)


def gazetteer(words: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """Rows (doc_id, word, n) for words of a list (``word``) that are words of a document, by an equi-join on words."""
    tokens = docs.select("doc_id", F.explode(F.split("text", r"[^A-Za-z0-9#]+")).alias("word")).where("word <> ''")
    return tokens.groupBy("doc_id", "word").agg(F.count("*").alias("n")).join(words.select("word").distinct(), "word", "left_semi").select("doc_id", F.lit(label).alias("label"), "word", "n")


def explode_spans(docs: DataFrame, spans: str = "spans", key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.explode(spans).alias("s")).select(key, "s.*")


def collect_spans(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Detections to one numbered array for each document: ids count from 1 in each label in the order received."""
    each = F.array_sort(F.collect_list(F.struct("label_ord", F.col("pos").alias("ord"), "label", "text", "start", "end", "confidence")))
    grouped = rows.groupBy(key).agg(each.alias("a"))
    first = lambda x: F.size(F.filter("a", lambda y: y["label_ord"] < x["label_ord"]))
    return grouped.select(key, F.transform("a", lambda x, i: F.struct(x["label"], x["label_ord"], x["ord"], i - first(x) + 1, x["text"], x["start"], x["end"], x["confidence"])).cast(SPANS).alias("spans"))
