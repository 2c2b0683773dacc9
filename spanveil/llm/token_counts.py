"""Token counts of whole texts through a digest cache.

A cache table (content digest, tokenizer-version digest, n_tokens) is kept as Parquet.
Digests of the texts are joined to it as narrow rows. What the cache lacks is encoded once for
each digest and appended; every document then takes its count by a join of digests.

Texts stay where they are if they can: a digest that the cache lacks and that one row
has is encoded where the row lies. For that, the digests that are known or that several
rows share go to all executors while they are MOST_BROADCAST at most, or else those that are
missing, on the same condition. Only texts of shared digests are shuffled then, one from
each task. With more of both, all texts are, and the cache is joined to them there.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, slices, table, utf8_bytes
from .tokens import encoder

LIMIT, MOST_BROADCAST = 512, 200_000
CACHE_SCHEMA = "content binary, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def stored(spark, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of the cache's rows of this version, one for each digest; none where there is no cache yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    exists = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache) if exists else spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("version") == version).groupBy(F.col("content").alias("digest")).agg(F.max("n_tokens").alias("n_tokens"))


def missing(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """One row (digest, text) of texts for each digest that marks (digest, known, shared) doesn't know."""
    one = lambda df: df.groupBy("digest").agg(F.first("text").alias("text"))
    odd = marks.where("known or shared")
    if odd.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        marked = texts.join(F.broadcast(odd), "digest", "left")
        alone, many = marked.where("known is null"), marked.where("not known")
    elif (new := marks.where("not known")).limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        marked = texts.join(F.broadcast(new), "digest")
        alone, many = marked.where("not shared"), marked.where("shared")
    else:
        return one(texts).join(marks.where("known"), "digest", "left_anti")
    return alone.select("digest", "text").unionByName(one(many))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, scratch: Scratch, text: str = "text") -> DataFrame:
    """docs' columns (without the text) and ``n_bytes``, ``n_tokens``.

    cache: path of the cache table, which may not exist yet; new counts are appended.
    A null text counts as empty, with 0 tokens; texts of any length are encoded whole. Repeated
    rows each get their count. Columns of docs named n_bytes or n_tokens are replaced. An
    empty docs gives no rows and adds none. If a task is run again its rows are written
    once, as Parquet output is committed; two runs at once may add a digest twice, with equal counts.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    body = utf8_bytes(text)
    keyed = docs.drop("n_bytes", "n_tokens").withColumn("_digest", F.unhex(F.sha2(body, 256)))
    digests = keyed.groupBy(F.col("_digest").alias("digest")).agg(F.count("*").alias("n"))
    marks = digests.join(stored(spark, cache, version), "digest", "left").select("digest", F.col("n_tokens").isNotNull().alias("known"), (F.col("n") > 1).alias("shared"))
    marks = scratch.save(marks, "token-marks")

    def counted(batches):
        encode = encoder(tokenizer)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), pa.array(encode.count(b.column(1).to_pylist()), pa.int64())], ["content", "n_tokens"])

    texts = keyed.select(F.col("_digest").alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = missing(texts, marks).select("digest", "text").mapInArrow(counted, "content binary, n_tokens long")
    found.select("content", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    scratch.drop("token-marks")
    # Written, so that a digest which many rows share is split in the join.
    counts = scratch.save(stored(spark, cache, version).join(digests.select("digest"), "digest", "left_semi").withColumnRenamed("digest", "_content"), "token-counts")
    narrow = keyed.withColumn("n_bytes", F.octet_length(body).cast("long")).drop(text)
    return narrow.join(counts, F.col("_digest") == F.col("_content")).drop("_digest", "_content")


def with_token_counts(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """docs with ``n_tokens`` (long), encoded where the rows lie, without a cache. A null text has 0 tokens."""
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    docs = docs.drop("n_tokens")
    names = docs.columns
    at = names.index(text)

    def counted(batches):
        encode = encoder(path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(encode.count([t or "" for t in b.column(at).to_pylist()]), pa.int64())], [*names, "n_tokens"])

    return docs.mapInArrow(counted, StructType([*docs.schema.fields, StructField("n_tokens", LongType())]))


def op9_token_counts(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Byte-level token counts of all documents.

    They come in two deliveries (by a hash of doc_id), as a corpus grows: the second finds the
    digests of the first in the cache.
    """
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache, tokenizer = Scratch(spark).path("token-cache"), tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    second = F.xxhash64("doc_id") < 0
    parts = [count_tokens(docs.where(part), cache, tokenizer, Scratch(spark)) for part in (~second, second)]
    return parts[0].unionByName(parts[1]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
