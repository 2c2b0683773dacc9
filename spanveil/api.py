"""The calls a user of the engine makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.catalog import BLACKLISTS, DESCRIPTIONS, ENTITY_TYPES, PRESETS, filled
from .operators import layout, marks, pages
from .operators.detect import Detector, RuleDetector
from .operators.redact import redact
from .sources.files import admission, convert, read_files
from .sources.pdf import pdf_pages, write_marks
from .sources.written import stored


def load_entity_types(preset: str = "default", verbose: bool = False) -> dict:
    """The preset's labels with their descriptions, or with name and description."""
    return {k: {"name": ENTITY_TYPES[k], "description": DESCRIPTIONS[k]} if verbose else DESCRIPTIONS[k] for k in PRESETS[preset]}


def load_blacklist(preset: str = "default") -> list[str]:
    return list(BLACKLISTS[preset])


def anonymize_texts(docs: DataFrame, entity_types: list[str] | None = None, blacklist: list[str] | None = None, threshold: float = 0.8, repeat_everywhere: bool = False, drop_scraps: bool = False, detector: Detector | None = None, preset: str = "default") -> DataFrame:
    """docs(doc_id, text, ...) with spans and redacted_text. Empty types and list are filled from the preset."""
    types, words = filled(entity_types, blacklist, preset)
    return redact((detector or RuleDetector()).detect(docs, types, threshold), words, repeat_everywhere, drop_scraps)


def anonymize_text(spark: SparkSession, text: str, **options) -> tuple[str, list[dict]]:
    """One text: the redacted text and its entities."""
    row = anonymize_texts(spark.createDataFrame([(0, text)], "doc_id long, text string"), **options).first()
    return row.redacted_text, [s.asDict() for s in row.spans]


def anonymize_documents(spark: SparkSession, path: str, converter=None, **options) -> DataFrame:
    """Files below a path: admitted, converted, redacted; a row for each with its error if it has one. Refused files have null text and spans."""
    files = admission(read_files(spark, path))
    good = convert(files.where("error is null"), converter).withColumnRenamed("path", "doc_id").drop("content")
    refused = files.where("error is not null").withColumnRenamed("path", "doc_id").drop("content")
    return anonymize_texts(good, **options).unionByName(refused, allowMissingColumns=True)


def mark_documents(words: DataFrame, lines: DataFrame, regions: DataFrame, pictures: DataFrame, detector: Detector, types: list[str], threshold: float = 0.8) -> DataFrame:
    """Annotations for page layouts: words to units, one detection over each document, mentions to boxes, marks merged.

    words: doc_id, page_no, word_idx, text, box, drawn, read.
    """
    return mark_pages(pages.together(words, lines, regions), pictures, detector, types, threshold)


def mark_pages(rows: DataFrame, pictures: DataFrame, detector: Detector, types: list[str], threshold: float = 0.8) -> DataFrame:
    """mark_documents() for rows of pages that lie together (see pages.together): units, mentions and boxes are made in a document's row."""
    found = detector.detect(pages.units(rows, boxes=True).where(T.strip(F.col("text")) != ""), types, threshold).where(F.size("spans") > 0)
    mentions = redact(found, [], True, True).withColumn("m", layout.in_reading_order(F.col("spans"))).select("doc_id", "units", "m")
    cut = mentions.withColumn("pieces", layout.cut_mentions(F.col("m"), F.col("units")))

    def marked(p: Column) -> Column:
        m, words = F.get("m", p["mention_no"] - 1), F.get("units", p["unit_idx"])["words"]
        boxes = layout.bars(layout.touched_boxes(words, p["start"], p["end"]))
        return F.struct(p["mention_no"].alias("n"), p["unit_idx"].alias("u"), boxes.alias("boxes"), m["label"].alias("label"), m["confidence"].alias("confidence"), m["text"].alias("text"))

    each = cut.select("doc_id", F.explode(F.transform("pieces", marked)).alias("p")).select("doc_id", "p.*").select("*", F.posexplode("boxes").alias("i", "box"))
    order = F.struct(F.lit(1).alias("k"), "n", "u", F.col("i").cast("long").alias("i"))
    spots = stored(each.select("doc_id", order.alias("o"), F.concat(F.lit("d"), F.col("n").cast("string")).alias("id"), "box", "label", "confidence", "text"))
    drawn = layout.picture_marks(pictures).select("doc_id", F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(0).alias("u"), F.monotonically_increasing_id().alias("i")).alias("o"), "id", "box", "label", "confidence", "text")
    from pyspark.sql import Window

    numbered = drawn.unionByName(spots).withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("o"))).drop("o")
    return marks.annotations(marks.merge_marks(numbered))


def annotate_documents(reviewed: DataFrame, pages: DataFrame, at: Column | None = None, author: str = "spanveil") -> tuple[DataFrame, DataFrame]:
    """Annotation records for reviewed marks, and the documents refused for a mark past their last page.

    reviewed: doc_id, ord, id, label, confidence, text, boxes, overlay. pages: doc_id, page_no, rotation, left, bottom, width, height.
    at: the annotations' time, now if not given.
    """
    each = marks.reviewed(reviewed)
    refused = marks.past_the_end(each, pages.groupBy("doc_id").agg(F.max("page_no").alias("pages")))
    placed = each.join(refused.select("doc_id"), "doc_id", "left_anti").withColumn("page_no", F.col("box.page_no")).join(pages, ["doc_id", "page_no"]).drop("page_no")
    return marks.records(placed.withColumn("at", F.current_timestamp() if at is None else at), author), refused


def annotate_files(files: DataFrame, reviewed: DataFrame, at: Column | None = None, author: str = "spanveil") -> DataFrame:
    """PDF files(doc_id, content) with reviewed marks appended: doc_id, content, n_marks, error. A file with a mark past its last page is refused."""
    records, refused = annotate_documents(reviewed, pdf_pages(files).where("error is null").drop("error"), at, author)
    made = write_marks(files.join(refused.select("doc_id"), "doc_id", "left_anti"), records)
    late = refused.select("doc_id", F.concat(F.lit("a mark on page "), F.col("page_no").cast("string"), F.lit(" past the last one")).alias("error"))
    return made.unionByName(late, allowMissingColumns=True)
