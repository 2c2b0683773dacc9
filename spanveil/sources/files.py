"""Files in, results out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Types that are read here; others need a converter of the caller's.
TEXT_TYPES = ("text/plain", "text/markdown", "text/csv", "text/html", "text/asciidoc")
#: States of a service's tasks that have a result, and all in which a task ends.
SUCCEEDED = ("success", "partial_success", "finished")
ENDED = (*SUCCEEDED, "failure", "skipped", "failed")


def read_files(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """(path, length, content, mime): any file store that Spark reads. Without content only the listing is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", *["content"] * content, T.mime_type(F.col("path")).alias("mime"))


def admission(files: DataFrame, limit: int = 104_857_600) -> DataFrame:
    """files(length, mime) with ``error``: null for what is admitted."""
    return files.withColumn("error", F.coalesce(T.size_error(F.col("length"), limit), T.mime_error(F.col("mime"))))


def pdf_only(mime: Column) -> Column:
    """The error of what is no PDF, an unknown type included; null for a PDF."""
    return F.when(~mime.eqNullSafe(F.lit("application/pdf")), F.lit("invalid_mime_type"))


def convert(files: DataFrame, converter: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """files(content, mime) with ``text``, ``page_offsets`` and ``convert_error``.

    Text types are read in the JVM. Others go to the converter(content, mime), which gives
    markdown with page marks; what it raises becomes the row's error.
    """
    plain = F.col("content").cast("string")
    own = F.when(F.col("mime") == "text/html", T.html_to_text(plain)).when(F.col("mime").isin(*TEXT_TYPES), plain)
    if converter is None:
        out = files.withColumn("_md", own).withColumn("convert_error", F.when(own.isNull(), F.lit("no converter")))
    else:

        @F.pandas_udf("struct<md:string,error:string>")
        def run(contents, mimes):
            import pandas as pd

            rows = []
            for c, m in zip(contents, mimes, strict=True):
                try:
                    rows.append({"md": None if m in TEXT_TYPES else converter(bytes(c), m), "error": None})
                except Exception as e:  # noqa: BLE001  the row says so
                    rows.append({"md": None, "error": str(e)})
            return pd.DataFrame(rows, columns=["md", "error"])

        out = files.withColumn("_r", run("content", "mime")).withColumn("_md", F.coalesce(own, "_r.md")).withColumn("convert_error", F.col("_r.error")).drop("_r")
    clean = T.unescape_markdown(F.col("_md"))
    return out.withColumn("text", T.page_text(clean)).withColumn("page_offsets", T.page_offsets(clean)).drop("_md")


def followed(task, poll: Callable, interval: float, timeout: float) -> str:
    """The state in which a task ends, or 'timeout'. Polls that raise are tried again with doubled waits, ten seconds (or the interval) at most."""
    wait, end = interval, time.monotonic() + timeout
    while time.monotonic() < end:
        try:
            state, wait = poll(task), interval
        except OSError:
            state, wait = "", min(wait * 2, max(interval, 10.0))
        if state in ENDED:
            return state
        time.sleep(wait)
    return "timeout"


def call_service(rows: DataFrame, submit: Callable, poll: Callable, fetch: Callable, column: str, result: str = "result", interval: float = 1.0, timeout: float = 3600.0) -> DataFrame:
    """rows with ``result`` (string) and ``service_error`` from a task service.

    submit(value) gives a task; poll(task) gives 'success', 'failure' or anything else while it
    runs; fetch(task) gives the text. Polls that raise are tried again with doubled waits, ten
    seconds (or the interval) at most. Concurrency is the number of tasks: repartition rows to bound it.
    """
    names = rows.columns
    at = names.index(column)

    def one(value) -> tuple[str | None, str | None]:
        try:
            task = submit(value)
            state = followed(task, poll, interval, timeout)
            return (fetch(task), None) if state in SUCCEEDED else (None, state)
        except Exception as e:  # noqa: BLE001  the row says so
            return None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(v) for v in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], [*names, result, "service_error"])

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], f"`{result}` string, service_error string"])
    return rows.mapInArrow(run, ddl)


def write_attempts(attempts: DataFrame, path: str) -> None:
    """Load rows as CSV with fixed decimals."""
    fixed = [F.format_string("%.3f", F.col(c)).alias(c) for c in ("started_at", "submit_s", "queue_s", "work_s", "collect_s")]
    total = F.format_string("%.3f", F.col("submit_s") + F.col("queue_s") + F.col("work_s") + F.col("collect_s")).alias("total_s")
    attempts.select("client", "document", "stage", *fixed, total, "polls", "chars", "max_queue_position", "error").write.mode("overwrite").csv(path, header=True)
