"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``virtual_nodes`` points of a 64-bit ring. A document's identifier
is hashed onto the ring and belongs to the arc of the next point clockwise. Shards
hold a bounded number of rows: with n rows and m shards, n // m or one more, so
the bounds sum to n exactly and every shard ends full. Keys arrive in a fixed order
(epoch, arc, key hash); a key whose shard is full goes on clockwise to the next
shard with room.

Only the number of keys in each cell (epoch x arc) is brought to the driver, at
most ``epochs * shards * virtual_nodes`` rows whatever the input. There the cells are
placed in order, cut where a shard fills, and the pieces go back as a small table;
a key's rank in its cell then gives its shard and slot. One shuffle of narrow rows.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, utf8_bytes

SHARDS, VIRTUAL_NODES, EPOCHS, SALTS = 24, 32, 4, 8


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """Sorted (point, shard) of all virtual nodes; a shard's points don't depend on the others."""
    points = {}
    for s in range(shards):
        for v in range(virtual_nodes):
            points.setdefault(int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True), s)
    return sorted(points.items())


def place(counts: dict[tuple[int, int], int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces (epoch, arc, from rank, to rank, shard, first slot) of the cells, in order of arrival."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, pieces = [0] * shards, []
    for (epoch, arc), n in sorted(counts.items()):
        at, k = 0, arc
        while at < n:
            s = owners[k % len(owners)]
            take = min(n - at, room[s] - filled[s])
            if take:
                pieces.append((epoch, arc, at, at + take, s, filled[s]))
                filled[s] += take
                at += take
            k += 1
    return pieces


def assign_shards(df: DataFrame, key: str = "doc_id", tie: str | None = "text", shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, epochs: int = EPOCHS) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in each shard) to df.

    Counts of the shards differ by one at most. A null key hashes as the text
    'null'; rows with one key and different ties are separate rows; identical rows
    are interchangeable. A hot key's rows are one cell's, ranked in salts by their
    ties' hashes, so that no task sorts a whole cell. The length of a text plays no part in the law
    by rows; it is read for its checksum only. An empty df gives no rows.
    Columns named shard or slot are replaced.
    """
    spark = df.sparkSession
    points = ring(shards, virtual_nodes)
    owners = [s for _, s in points]
    key_hash = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null")))
    bounds = F.array(*[F.lit(p) for p, _ in points])
    # The arc is the number of points below the hash; a table of 256 steps leaves few points to look at.
    coarse = [bisect.bisect_left([p for p, _ in points], -(2**63) + (i << 56)) for i in range(257)]
    steps = F.array(*[F.lit(c) for c in coarse])
    lead = F.shiftright(F.col("_h"), 56).cast("int") + 128  # the ring in 256 equal parts
    low, high = F.element_at(steps, lead + 1), F.element_at(steps, lead + 2)
    found = low + F.array_size(F.filter(F.slice(bounds, low + 1, high - low), lambda p: p < F.col("_h")))
    keyed = df.drop("shard", "slot").withColumn("_h", key_hash).withColumn("_t", F.xxhash64(F.lit(7), F.col("_h"), F.coalesce(F.col(tie), F.lit("")) if tie else F.lit("")))
    keyed = keyed.withColumn("_arc", found % F.lit(len(points))).withColumn("_epoch", F.pmod(F.xxhash64(F.lit(11), F.col("_h")), F.lit(epochs)).cast("int"))
    keyed = keyed.withColumn("_salt", F.pmod(F.col("_t"), F.lit(SALTS)).cast("int"))
    narrow = keyed.select("_epoch", "_arc", "_salt")
    salted = narrow.groupBy("_epoch", "_arc", "_salt").count()
    before = Window.partitionBy("_epoch", "_arc").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).collect()
    counts: dict[tuple[int, int], int] = {}
    for r in offsets:
        counts[r._epoch, r._arc] = counts.get((r._epoch, r._arc), 0) + r["count"]
    cut: dict[tuple[int, int], list] = {}
    for e, a, lo, hi, s, slot in place(counts, owners, shards):
        cut.setdefault((e, a), []).append((lo, hi, s, slot))
    rows = [(r._epoch, r._arc, r._salt, r._before, cut[r._epoch, r._arc]) for r in offsets]
    cells = spark.createDataFrame(rows, "_epoch int, _arc int, _salt int, _before long, _pieces array<struct<lo:long,hi:long,shard:int,slot:long>>")
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_epoch", "_arc", "_salt").orderBy("_t", key)) - 1)
    # At most epochs * arcs * salts rows, a bound without regard to the input.
    placed = ranked.join(F.broadcast(cells), ["_epoch", "_arc", "_salt"]).withColumn("_r", F.col("_r") + F.col("_before"))
    piece = F.element_at(F.filter("_pieces", lambda p: (p.lo <= F.col("_r")) & (F.col("_r") < p.hi)), 1)
    return placed.withColumn("_p", piece).withColumn("shard", F.col("_p.shard")).withColumn("slot", F.col("_p.slot") + F.col("_r") - F.col("_p.lo")).select(*[c for c in df.columns if c not in ("shard", "slot")], "shard", "slot")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into 24 shards, by rows."""
    docs = table(spark, sf_dir, "documents")
    body = utf8_bytes("text")
    sized = docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    out = assign_shards(sized, tie="text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
