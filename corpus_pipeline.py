"""Corpus pipeline: documents through five stages, each written as Parquet and read again.

toxicity (rejected documents go), n-gram Jaccard join (one document of each group stays),
benchmark decontamination, mixing sources to target weights, sharding. Each stage works on
all rows its predecessor kept; the first four return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import decontamination, mixing, ngram_join, sharding, token_counts, toxicity
from spanveil.llm.common import Scratch, table, utf8_bytes

#: Four fifths of the tokens left, none twice: repeats would undo the join's work.
SHARE, MAX_EPOCHS = 0.8, 1
#: Rows of an Arrow batch: a batch of whole texts is held by the JVM and by Python.
BATCH, ROWS_IN_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def _lean(spark: SparkSession) -> Scratch:
    spark.conf.set(BATCH, ROWS_IN_BATCH)
    return Scratch(spark)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored under 0.5 by the nearest labelled examples.

    The examples' texts come from the documents table, so that the stage judges any subset by
    the same examples; labels of the held-out fifth are not learned from.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), _lean(spark), ~toxicity.held_out(), by_label=True)
    return toxicity.remove_toxic(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component under Jaccard of 5-word shingles at 0.8: that with the least doc_id."""
    return ngram_join.keep_one(docs, _lean(spark), 5, 80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's rows, each as often as it is taken; sizes are byte-level tokens."""
    scratch = _lean(spark)
    names = docs.columns
    sized = scratch.save(token_counts.with_token_counts(docs).withColumnRenamed("n_tokens", "_n"), "mixing-docs")
    levels = {"domain": mixing.domain_of_source(), "lang": F.col("lang"), "source": F.col("source")}
    taken = mixing.mix(sized, F.col("_n"), levels, scratch, mixing.WEIGHTS, SHARE, MAX_EPOCHS)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*names)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot; texts give way to their size and checksum."""
    body = utf8_bytes("text")
    sized = docs.select("doc_id", "lang", "source", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    return sharding.assign_shards(sized, tie="text_crc32")


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Models, tries and alignments can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. The session's batch size is put back at the end."""
    scratch, before = Scratch(spark), spark.conf.get(BATCH)
    docs = table(spark, sf_dir, "documents")
    try:
        for name, stage in STAGES:
            docs = scratch.save(stage(spark, docs, sf_dir), name)
    finally:
        spark.conf.set(BATCH, before)
    return docs
