"""Driver tables as this engine's inputs: events stand in for tasks, polls and load attempts."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import give_back, parts
from ..sources import pdf


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Characters of a text on a page of its PDF, and of a line.
PAGE_CHARS, LINE_CHARS = 3000, 100


def pdf_of(doc_id: int, text: str) -> bytes:
    """A text as a PDF: odd documents with packed objects and a stream of places, even ones with a table; every fourth has a note on its first page."""
    pages = [text[i : i + PAGE_CHARS] for i in range(0, max(len(text), 1), PAGE_CHARS)]
    note, kids = 3, range(4, 4 + 2 * len(pages), 2)
    values: dict[int, dict] = {1: {"Type": pdf.Name("Catalog"), "Pages": pdf.Ref(2, 0)}}
    values[2] = {"Type": pdf.Name("Pages"), "Kids": [pdf.Ref(k, 0) for k in kids], "Count": len(pages), "MediaBox": [0, 0, 595, 842]}
    values[note] = {"Type": pdf.Name("Annot"), "Subtype": pdf.Name("Text"), "Rect": [0, 0, 9, 9]}
    for k in kids:
        values[k] = {"Type": pdf.Name("Page"), "Parent": pdf.Ref(2, 0), "Contents": pdf.Ref(k + 1, 0)}
    if doc_id % 4 == 0:
        values[4]["Annots"] = [pdf.Ref(note, 0)]
    out, at = bytearray(b"%PDF-1.7\n"), {}

    def put(n: int, body: bytes) -> None:
        at[n] = len(out)
        out.extend(b"%d 0 obj\n" % n + body + b"\nendobj\n")

    def stream(head: dict, body: bytes) -> bytes:
        body = zlib.compress(body)
        return pdf.write(head | {"Filter": pdf.Name("FlateDecode"), "Length": len(body)}) + b"\nstream\n" + body + b"\nendstream"

    for k, page in zip(kids, pages, strict=True):
        put(k + 1, stream({}, b"BT " + pdf.write(page.encode("utf-8", "replace")) + b" Tj ET"))
    size, root = kids[-1] + 2, pdf.Ref(1, 0)
    if doc_id % 2:
        bodies = {n: pdf.write(v) for n, v in values.items()}
        starts, total = [], 0
        for n, body in bodies.items():
            starts.append(f"{n} {total}")
            total += len(body) + 1
        head = (" ".join(starts) + " ").encode()
        put(size, stream({"Type": pdf.Name("ObjStm"), "N": len(bodies), "First": len(head)}, head + b" ".join(bodies.values())))
        packed = {n: i for i, n in enumerate(bodies)}
        at[size + 1] = len(out)
        rows = [b"\2" + size.to_bytes(6) + packed[n].to_bytes(4) if n in packed else b"\1" + at[n].to_bytes(6) + bytes(4) if n in at else bytes(11) for n in range(size + 2)]
        start = len(out)
        put(size + 1, stream({"Type": pdf.Name("XRef"), "Size": size + 2, "W": [1, 6, 4], "Root": root}, b"".join(rows)))
    else:
        for n, v in values.items():
            put(n, pdf.write(v))
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size + b"".join(b"%010d 00000 n \n" % at[n] for n in range(1, size))
        out += b"trailer\n" + pdf.write({"Size": size, "Root": root}) + b"\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as PDF files(doc_id, content)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in parts(batch.columns):
                made = [pdf_of(i, t or "") for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(made, pa.binary())], ["doc_id", "content"])
        give_back()

    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, content binary")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr("cast(timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) as double)")
    lane = F.when(F.col("event_type") == "purchase", "convert").otherwise("redact")
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("finished")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), lane.alias("lane"), F.col("user_id").cast("string").alias("client"), F.col("user_id").alias("task_id"), status.alias("status"), s.alias("ts"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq")
    d = lambda c: c.cast("double")
    return tasks(spark, sf_dir).select(
        F.col("task_id").cast("int").alias("client"), F.concat(F.lit("doc"), n.cast("string")).alias("document"), F.col("lane").alias("stage"), F.col("ts").alias("started_at"), d(n % 3).alias("submit_s"), d(n * 7 % 50).alias("queue_s"), d(n * 13 % 90).alias("work_s"), d(n % 2).alias("collect_s"),
        (n % 11).cast("int").alias("polls"), (n % 1000).cast("int").alias("chars"), F.when(n % 4 != 0, (n % 17).cast("int")).alias("max_queue_position"), F.when(F.col("status") == "failed", F.when(n % 2 == 0, "429 too many").otherwise("500 broken")).alias("error"),
    )


TASKS_SQL = """tasks AS (SELECT event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'convert' ELSE 'redact' END AS lane, CAST(user_id AS VARCHAR) AS client, user_id AS task_id,
 CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'finished' END AS status,
 CAST(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS DOUBLE) AS ts FROM events)"""
ATTEMPTS_SQL = (
    TASKS_SQL
    + """, attempts AS (SELECT CAST(task_id AS INTEGER) AS client, lane AS stage, ts AS started_at, CAST(seq % 3 AS DOUBLE) AS submit_s, CAST(seq * 7 % 50 AS DOUBLE) AS queue_s, CAST(seq * 13 % 90 AS DOUBLE) AS work_s, CAST(seq % 2 AS DOUBLE) AS collect_s,
 CASE WHEN seq % 4 <> 0 THEN CAST(seq % 17 AS INTEGER) END AS max_queue_position, CASE WHEN status = 'failed' THEN CASE WHEN seq % 2 = 0 THEN '429 too many' ELSE '500 broken' END END AS error FROM tasks)"""
)
