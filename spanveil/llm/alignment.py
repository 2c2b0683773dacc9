"""Alignment of two tokenizers over the same bytes, with how often their tokens meet in the corpus.

Each Arrow partition is taken in runs of texts that lie end to end. DuckDB gets the tokens of both
sides as interval tables; an ASOF join finds for each token the other side's token in which its
last byte lies, window sums of common ends number the groups, and a join within groups gives the links. As the
texts lie end to end, ends of texts are common ends, so no group crosses them. That tokens overlap
only inside a group makes the range join an equality of group numbers. Ids that stand more than once in a group
are counted before they are joined, so that a long group costs the product of its distinct ids only.

DuckDB also counts for each run in how many texts a pair of ids is linked; Spark adds these partial
counts up. The counts then go back to the texts: to all executors while they are MOST_PAIRS at
most, else by a shuffle of the texts' pairs.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import Scratch, give_back, table
from .pieces import codec
from .tokens import encoder

#: Bytes of text that are aligned together; pairs that may be broadcast (16 bytes each).
RUN_BYTES, MOST_PAIRS = 1 << 20, 2_000_000
#: Links up to which a group is short.
SHORT = 1024
COUNTS = ("n_a", "n_b", "n_groups", "n_links")

ALIGN = """
create or replace temp table ga as
select doc, id, e, 1 + coalesce(sum(same) over (order by e rows between unbounded preceding and 1 preceding), 0)::bigint as g
from (select a.doc, a.id, a.e, (a.e = b.e)::int as same from a asof join b on a.e <= b.e);
create or replace temp table gb as
select id, e, 1 + coalesce(sum(same) over (order by e rows between unbounded preceding and 1 preceding), 0)::bigint as g
from (select b.id, b.e, (a.e = b.e)::int as same from b asof join a on b.e <= a.e)
"""
#: Links of short groups pair by pair, and of groups of any length by their distinct ids.
EACH = """
create or replace temp table links as
select doc, x.id::bigint << 20 | y.id::bigint as pair, count(*)::bigint as m from ga x join gb y using (g) group by all
"""
DISTINCT = """
create or replace temp table links as
select doc, pair, sum(m)::bigint as m from (
  select x.doc, x.id::bigint << 20 | y.id::bigint as pair, x.m * y.m as m
  from (select doc, g, id, count(*) as m from ga group by all) x
  join (select g, id, count(*) as m from gb group by all) y using (g)) group by all
"""


def byte_level() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """Ids of a byte-level vocabulary and the bytes they stand for."""

    def __init__(self, path: str):
        self.encoder = encoder(path, special_as_text=True)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        signs, body = byte_level(), {}
        for t in form["added_tokens"]:
            body[t["id"]] = t["content"].encode()
        for entry, i in form["model"]["vocab"].items():
            if i not in body:
                body[i] = bytes(signs[c] for c in entry)
        parts = [body.get(i, b"") for i in range(max(body) + 1)]
        self.size = np.array([len(p) for p in parts], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        sums = np.cumsum(n)
        return self.pool[np.repeat(self.start[ids] - (sums - n), n) + np.arange(int(sums[-1]) if len(sums) else 0)].tobytes()


_BYTES: dict[str, ByteTokens] = {}


def byte_tokens(path: str) -> ByteTokens:
    if path not in _BYTES:
        _BYTES[path] = ByteTokens(path)
    return _BYTES[path]


class Aligner:
    """Runs of texts through DuckDB."""

    def __init__(self, byte_path: str, piece_path: str):
        import duckdb

        self.a, self.b = byte_tokens(byte_path), codec(piece_path)
        self.db = duckdb.connect(config={"threads": 1})
        self.db.execute("set temp_directory = ''")  # a run is small; nothing is spilt to a local folder
        digits = [str(i).encode() for i in range(max(len(self.a.size), len(self.b.byte_size)))]
        self.digits = np.frombuffer(b"".join(b"," + d for d in digits), dtype=np.uint8)
        self.width = np.array([len(d) + 1 for d in digits], dtype=np.int64)
        self.at = np.cumsum(self.width) - self.width

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none for texts that either side doesn't give back byte for byte."""
        spaced = [" " + t if t else "" for t in texts]
        a, b = self.a.encoder.encode(spaced), self.b.encode([t or "" for t in texts])
        none = np.empty(0, np.int64)
        whole = "".join(spaced).encode()
        if all(map(len, a)) and self.a.joined(np.concatenate(a)) == whole == self.b.joined(np.concatenate(b)) and not any("▁" in s for s in spaced):
            return a, b
        for k, s in enumerate(spaced):
            body = s.encode()
            if not body or self.a.joined(a[k]) != body or self.b.joined(b[k]) != body:
                a[k] = b[k] = none
        return a, b

    def align(self, texts: list[str | None]):
        """(counts for each of COUNTS, digests, pairs of each text, their links, partial pair counts)."""
        a, b = self.tokens(texts)
        n = len(texts)
        na, nb = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
        if not na.sum():
            empty = [np.empty(0, np.int64)] * n
            return (na, nb, na, na), [""] * n, empty, empty, (np.empty(0, np.int64), np.empty(0, np.int64))
        ids = [np.concatenate(side).astype(np.int64) for side in (a, b)]
        for name, i, size, count in (("a", ids[0], self.a.size, na), ("b", ids[1], self.b.byte_size, nb)):
            e = np.cumsum(size[i])
            self.db.register(f"{name}_in", pa.table({"doc": np.repeat(np.arange(n, dtype=np.int32), count), "id": i.astype(np.int32), "s": (e - size[i]).astype(np.int32), "e": e.astype(np.int32)}))
            self.db.execute(f"create or replace temp table {name} as select * from {name}_in")
            self.db.unregister(f"{name}_in")
        for step in ALIGN.split(";\n"):
            self.db.execute(step)
        ga, gb = (self.db.execute(f"select g from {t} order by e").fetchnumpy()["g"] for t in ("ga", "gb"))
        self.db.execute(EACH if (np.bincount(ga) * np.bincount(gb)).max() <= SHORT else DISTINCT)
        links = self.db.execute("select doc, pair, m from links order by doc, pair").fetchnumpy()
        part = self.db.execute("select pair, count(*) as n from links group by pair").fetchnumpy()
        first = np.searchsorted(links["doc"], np.arange(n + 1))
        cut = lambda x: [x[i:j] for i, j in zip(first.tolist(), first[1:].tolist(), strict=False)]
        sums = np.append(0, np.cumsum(links["m"]))
        begin, end = np.append(0, np.cumsum(na)[:-1]), np.cumsum(na)
        groups = np.where(na > 0, ga[np.maximum(end - 1, 0)] - ga[np.minimum(begin, len(ga) - 1)] + 1, 0)
        return (na, nb, groups, sums[first[1:]] - sums[first[:-1]]), self._digests(ids, ga, gb, na, nb), cut(links["pair"]), cut(links["m"]), (part["pair"], part["n"])

    def _digests(self, ids, ga, gb, na, nb) -> list[str]:
        """SHA-256 of the groups' ids in order; '' for texts without tokens."""
        # A group's tokens of the first side stand before those of the second.
        at_a = np.arange(len(ga)) + np.searchsorted(gb, ga, side="left")
        at_b = np.arange(len(gb)) + np.searchsorted(ga, gb, side="right")
        order = np.empty(len(ga) + len(gb), np.int64)
        order[at_a], order[at_b] = ids[0], ids[1]
        width = self.width[order]
        stop = np.cumsum(width)
        small = np.int32 if stop[-1] < 1 << 31 else np.int64
        body = self.digits[np.repeat((self.at[order] - (stop - width)).astype(small), width) + np.arange(int(stop[-1]), dtype=small)]
        head = stop - width
        body[head[at_a[np.append(True, ga[1:] != ga[:-1])]]] = ord(";")
        body[head[at_b[np.append(True, gb[1:] != gb[:-1])]]] = ord("|")
        ends = np.append(0, stop)[np.cumsum(na + nb)]
        whole, out, first = memoryview(body.tobytes()), [], 0
        for e in ends.tolist():
            out.append(hashlib.sha256(whole[first + 1 : e]).hexdigest() if e > first else "")
            first = e
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    if (byte_path, piece_path) not in _ALIGNERS:
        _ALIGNERS[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _ALIGNERS[byte_path, piece_path]


def _runs(batches, at: int, most: int):
    """Arrow batches in runs of texts of bounded size; one long text is a run of its own."""
    for b in batches:
        size = np.diff(np.frombuffer(b.column(at).cast(pa.large_string()).buffers()[1], dtype=np.int64)[: b.num_rows + 1]) if b.num_rows else []
        first, held = 0, 0
        for k, n in enumerate(size):
            if held and held + n > most:
                yield b.slice(first, k - first)
                first, held = k, 0
            held += int(n)
        if b.num_rows > first:
            yield b.slice(first)
    give_back()


def aligned(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """docs' other columns with COUNTS, ``groups_sha256``, ``pairs`` (first id << 20 | second id) and ``links`` of each
    (arrays of equal length, by pair); rows with ``_partial`` hold the partial counts of a run of texts instead."""
    new = [*COUNTS, "groups_sha256", "pairs", "links", "_partial"]
    docs = docs.drop(*new)
    rest = [c for c in docs.columns if c != text]
    docs = docs.select(*rest, text)
    kinds = [LongType()] * 4 + [StringType(), ArrayType(LongType()), ArrayType(LongType()), BooleanType()]
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in docs.schema.fields[:-1]), *(StructField(x, t) for x, t in zip(new, kinds, strict=True))])

    def work(batches):
        al = aligner(byte_path, piece_path)
        longs = pa.list_(pa.int64())
        for b in _runs(batches, len(rest), RUN_BYTES):
            counts, sha, pairs, links, (pair, n) = al.align(b.column(len(rest)).to_pylist())
            rows = [*b.columns[:-1], *(pa.array(c) for c in counts), pa.array(sha, pa.string()), pa.array(pairs, longs), pa.array(links, longs), pa.array([False] * b.num_rows)]
            yield pa.RecordBatch.from_arrays(rows, [*rest, *new])
            if len(pair):
                one = [*(pa.nulls(1, c.type) for c in b.columns[:-1]), *(pa.nulls(1, pa.int64()) for _ in COUNTS), pa.nulls(1, pa.string()), pa.array([pair], longs), pa.array([n], longs), pa.array([True])]
                yield pa.RecordBatch.from_arrays(one, [*rest, *new])

    return docs.mapInArrow(work, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many texts each pair is linked, and whether none of its first id's pairs is in more."""
    sums = rows.where("_partial").select(F.explode(F.arrays_zip("pairs", "links")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.links").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 20)))  # an id's pairs are as many as the other vocabulary's ids at most
    return sums.withColumn("best", F.col("n") == most)


def align_tokens(docs: DataFrame, scratch: Scratch, byte_path: str, piece_path: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, pairs): docs' columns, without the text, with COUNTS, ``n_best``, ``count_sum`` and ``groups_sha256``; and
    the corpus's (pair, n, best).

    Null and empty texts, and those that either tokenizer doesn't give back byte for byte (with the space
    before them), have no tokens: zeros and ''. Texts of any length are aligned whole. Repeated rows each get
    their figures, and count as texts of their own. An empty docs gives no rows; columns of docs with
    the names of new ones are replaced.
    """
    spark = docs.sparkSession
    rows = scratch.save(aligned(docs.drop("n_best", "count_sum"), byte_path, piece_path, text), "aligned")
    pairs = scratch.save(pair_counts(rows), "aligned-pairs")
    texts = rows.where("not _partial").drop("_partial")
    if pairs.limit(MOST_PAIRS + 1).count() <= MOST_PAIRS:
        t = pairs.orderBy("pair").toArrow()
        best = t.column("best").to_numpy()
        shared = spark.sparkContext.broadcast((t.column("pair").to_numpy(), t.column("n").to_numpy(), best))
        names = texts.columns
        keep = [c for c in names if c not in ("pairs", "links")]
        at, links = names.index("pairs"), names.index("links")

        def looked_up(batches):
            pair, n, best = shared.value
            for b in batches:
                p, m = b.column(at), b.column(links)
                flat, times = p.flatten().to_numpy(), m.flatten().to_numpy()
                place = np.searchsorted(pair, flat)
                ends = np.append(0, np.cumsum(pa.compute.list_value_length(p).to_numpy()))
                sums = [np.append(0, np.cumsum(x)) for x in (times * best[place], times * n[place])] if len(flat) else [np.zeros(1, np.int64)] * 2
                yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in keep), *(pa.array((s[ends[1:]] - s[ends[:-1]]).astype(np.int64)) for s in sums)], [*keep, "n_best", "count_sum"])

        out = texts.mapInArrow(looked_up, StructType([*(texts.schema[c] for c in keep), StructField("n_best", LongType()), StructField("count_sum", LongType())]))
        return out, pairs
    texts = scratch.save(texts.withColumn("_row", F.monotonically_increasing_id()), "aligned-texts")
    each = texts.select("_row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("m"))
    sums = each.join(pairs, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    out = texts.drop("pairs", "links").join(sums, "_row", "left").drop("_row")
    return out.withColumn("n_best", F.coalesce("n_best", F.lit(0).cast("long"))).withColumn("count_sum", F.coalesce("count_sum", F.lit(0).cast("long"))), pairs


def op11_token_alignment(spark, sf_dir: str, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Alignment of the byte-level and the piece tokenizer over all documents."""
    import public_tokenizers

    byte_path, piece_path = byte_path or public_tokenizers.path("byte_bpe_50k.json"), piece_path or public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts, _ = align_tokens(docs, Scratch(spark), byte_path, piece_path)
    return texts.select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")
