"""Quality rules: word counts, repeats, and lines that many documents of a host share.

Lines are normalised (white space, case) and hashed to 64 bits. For each host the distinct
documents with a line are counted. Lines in more than LIMIT documents of their host are
removed; a document that keeps less than KEEP of its words is depleted and rejected. The
base rules (too few words, mostly repeated words) come first.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, table

#: Documents of a host that may share a line; part of the words that must stay; frequent lines that may be broadcast.
LIMIT, KEEP, MOST_BROADCAST = 50, 0.5, 200_000
#: Parts into which a line's rows are dealt where the frequent lines are too many to broadcast.
SALTS = 32
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(WORD.findall(line)).lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def measure(text: str) -> tuple[list[int], dict[int, int]]:
    """(words, their code points, symbols, repeated lines, words in repeated 3-word windows), and the words of each distinct line."""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    twice = Counter(windows)
    repeated, upto = 0, 0
    for i, w in enumerate(windows):
        if twice[w] > 1:
            repeated += i + 3 - max(i, upto)
            upto = i + 3
    seen, again, lines = set(), 0, {}
    for line in text.split("\n"):
        n = len(WORD.findall(line))
        if n:
            again += line in seen
            seen.add(line)
            h = line_hash(line)
            lines[h] = lines.get(h, 0) + n
    return [len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), again, repeated], lines


def row_key(key: str, text: str, host: str) -> Column:
    """Equal for equal (key, host, text) only; null differs from any text."""
    return F.xxhash64(*[x for c in (key, host, text) for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))])


def line_verdicts(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", host: str = "source", limit: int = LIMIT, keep: float = KEEP) -> DataFrame:
    """A row for each document: key, the base metrics, base_failed, removed_words, removed lines' hashes, kept.

    A null text is empty and fails the base rules; a null host is a host of its own. A
    document is a key: rows of one host with one key count a line once, whatever their texts;
    rows without a key are told apart by their texts. Repeated rows get equal results, and so
    do texts of any length, taken whole. A line in exactly ``limit`` documents stays, and a
    document that keeps exactly ``keep`` of its words is kept. Empty docs give no rows.
    Other columns of docs are not read.
    """

    def measured(batches):
        for b in slices(batches):
            rows = [measure(t or "") for t in b.column(2).to_pylist()]
            metrics = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(5)]
            lines = pa.array([[{"h": h, "w": w} for h, w in r[1].items()] for r in rows], pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *metrics, lines], ["key", "host", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("key"), F.coalesce(F.col(host).cast("string"), F.lit("\x00")).alias("host"), F.col(text).alias("text"), row_key(key, text, host).alias("row"))
    base = scratch.save(plain.mapInArrow(measured, f"key {kind}, host string, row long, {METRICS}, lines array<struct<h:long,w:long>>"), "lines")
    document = F.when(F.col("key").isNull(), F.xxhash64(F.lit("row"), "row")).otherwise(F.xxhash64(F.lit("key"), F.col("key").cast("string")))
    each = base.select("host", "row", document.alias("document"), F.explode("lines").alias("l")).select("host", "row", "document", "l.h", "l.w")
    frequent = scratch.save(each.groupBy("host", "h").agg(F.count_distinct("document").alias("n")).where(F.col("n") > limit).select("host", "h"), "frequent")
    each = each.select("host", "row", "h", "w")
    if frequent.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        hits = each.join(F.broadcast(frequent), ["host", "h"])
    else:
        dealt = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = each.withColumn("salt", F.pmod(F.xxhash64(F.lit(2), "row"), F.lit(SALTS)).cast("int")).join(dealt, ["host", "h", "salt"])
    hits = hits.groupBy("row", "h").agg(F.max("w").alias("w"))
    removed = hits.groupBy("row").agg(F.sum("w").alias("removed_words"), F.sort_array(F.collect_list("h")).alias("removed_lines"))
    out = base.drop("lines").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_words") - F.col("removed_words") >= keep * F.col("n_words")))
    return out.withColumnRenamed("key", key)


def clean_lines(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", host: str = "source", limit: int = LIMIT, keep: float = KEEP) -> DataFrame:
    """docs' kept rows with frequent lines taken out of their texts. See ``line_verdicts`` for the odd cases."""
    verdicts = line_verdicts(docs, scratch, key, text, host, limit, keep).where("kept").select(F.col("row").alias("_row"), F.col("removed_lines").alias("_gone")).dropDuplicates(["_row"])
    joined = docs.withColumn("_row", row_key(key, text, host)).join(verdicts, "_row").drop("_row")
    names = joined.columns
    at = names.index(text)

    def cleaned(batches):
        for b in slices(batches):
            texts = []
            for t, gone in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                bad = set(gone or ())
                texts.append("\n".join(x for x in t.split("\n") if not WORD.search(x) or line_hash(x) not in bad) if bad else t)
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names[:-1])

    return joined.mapInArrow(cleaned, joined.drop("_gone").schema).select(*docs.columns)


#: The same in DuckDB's SQL; words have no white space, so joined by a space they stand for a window.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
window_ AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2))),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM window_, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
line AS (SELECT doc_id, host, lower(array_to_string(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'), ' ')) AS norm, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n FROM (SELECT doc_id, host, unnest(ls) AS x FROM w)),
frequent AS (SELECT host, norm FROM line GROUP BY host, norm HAVING count(DISTINCT doc_id) > {LIMIT}),
removed AS (SELECT doc_id, sum(n) AS n FROM line JOIN frequent USING (host, norm) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS removed_words FROM w LEFT JOIN repeated USING (doc_id) LEFT JOIN removed USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
 base_failed, NOT base_failed AND n_words - removed_words >= {KEEP} * n_words AS kept, CAST(removed_words AS BIGINT) AS removed_words FROM f"""


def op7_line_rules(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all documents, with their sources as hosts."""
    out = line_verdicts(table(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
