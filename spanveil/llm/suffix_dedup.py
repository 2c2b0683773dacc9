"""Removal of repeated 400-byte strings by a sparse, range-partitioned suffix array.

Not every suffix is sorted, only those at anchors. The anchor of a 400-byte string is the
place of the least GRAM-byte hash among its first REACH places (the leftmost of equal ones),
so equal strings have their anchors at equal offsets, and two equal strings have
anchors whose suffixes agree in their first LEAD bytes. About two places in REACH are anchors.

1. A bounded sample of suffixes gives splitters (leading bytes, then a checksum of the
   surroundings and of the place, so that a suffix with any number of copies is split
   over buckets too). Suffixes' leading bytes are range-partitioned by them.
2. Each bucket is sorted by multikey quicksort with eight-byte characters: one character at
   a time, going on only inside groups that are still equal. Suffixes without an equal
   neighbour have no repeated string. Where neighbours also agree in the checksum
   of all their strings, those are repeated. The first and last suffixes of a bucket may
   have equals beyond the boundary and stay open.
3. For suffixes that stay open, the strings themselves are compared, by hashes of every
   400-byte string that has the anchor, within groups of equal suffixes over all buckets. A
   group above HOT suffixes is dealt by string hash to as many tasks as it needs.

Hashes have 64 bits; what is compared by hash is otherwise exact, and all texts are
taken whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, POWERS, Scratch, mix, prefix_hash, slices, span_hash, table, utf8_bytes

WIDTH, REACH, GRAM, LEAD = 400, 320, 16, 80
#: Suffixes in a bucket, as long as there are no more than MOST_BUCKETS: at 100 TB of text a bucket has about 2.3 million.
IN_BUCKET, MOST_BUCKETS, HOT = 20_000, 1 << 18, 20_000
#: Sampled suffixes for each bucket, and all together (or four for each bucket).
SAMPLES, MOST_SAMPLED = 16, 1 << 20
#: Groups up to this size are sorted at once.
SMALL = 48
PIECE = 1 << 22


def window_hashes(prefix: np.ndarray, lo: int, hi: int, width: int = WIDTH) -> np.ndarray:
    """Hashes of the strings that begin at lo..hi."""
    down = POWERS.of(len(prefix))[1]
    return mix((prefix[lo + width : hi + 1 + width] - prefix[lo : hi + 1]) * down[lo : hi + 1])


def anchors(buffer: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all 400-byte strings, with the first and last beginnings of the strings that have each."""
    last = len(buffer) - WIDTH  # strings begin at 0..last
    at, low = [], []
    for base in range(0, last + 1, PIECE):
        n = min(PIECE, last + 1 - base)
        places = n + REACH - 1
        h = window_hashes(prefix, base, base + places - 1, GRAM)
        least = (h >> np.uint64(23) << np.uint64(23)) | np.arange(places, dtype=np.uint64)  # PIECE + REACH < 2**23
        step = 1
        while step < 256:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[: n], least[REACH - 256 : REACH - 256 + n])
        place = (least & np.uint64((1 << 23) - 1)).astype(np.int64) + base
        new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        if at and at[-1][-1] == place[0]:
            new = new[1:]
        at.append(place[new])
        low.append(new + base)
    at, low = np.concatenate(at), np.concatenate(low)
    return at, low, np.append(low[1:] - 1, last)


def suffixes(body: bytes, row: int):
    """(leading bytes as (n, LEAD) array, checksum, tie, anchor, first, last) for a document's anchors, or None."""
    if len(body) < WIDTH:
        return None
    buffer = np.frombuffer(body, dtype=np.uint8)
    prefix = prefix_hash(BYTE_CODES[buffer])
    at, lo, hi = anchors(buffer, prefix)
    lead = np.lib.stride_tricks.sliding_window_view(buffer, LEAD)[at]
    check = span_hash(prefix, lo, hi + WIDTH) + (at - lo).astype(np.uint64)
    tie = mix(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([row], dtype=np.int64).astype(np.uint64))
    return lead, check, tie, at, lo, hi


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of its group) of rows of eight-byte characters; equal rows are one group.

    Multikey quicksort: a group whose characters before d are equal is parted by a pivot into
    those with a less, an equal and a greater character d; the equal ones go on with the next
    character. Small groups are sorted at once.
    """
    n, depth = words.shape
    order, first = np.arange(n), np.zeros(n, dtype=bool)
    todo = [(0, n, 0)]
    while todo:
        low, high, d = todo.pop()
        if d == depth or high - low == 1:
            first[low] = True
            continue
        part = order[low:high]
        if high - low <= SMALL:
            rest = words[part, d:]
            by = np.lexsort(rest.T[::-1])
            order[low:high], rest = part[by], rest[by]
            first[low] = True
            first[low + 1 : high] = (rest[1:] != rest[:-1]).any(axis=1)
            continue
        c = words[part, d]
        pivot = np.sort(c[:: max(1, len(c) // 9)])[min(len(c), 9) // 2]
        less, same = c < pivot, c == pivot
        order[low:high] = np.concatenate((part[less], part[same], part[~(less | same)]))
        one, two = low + int(less.sum()), low + int(less.sum() + same.sum())
        todo += [x for x in ((two, high, d), (one, two, d + 1), (low, one, d)) if x[1] > x[0]]
    return order, first


class Splitters:
    """Buckets of (lead, check, tie) in the order of these."""

    def __init__(self, sample: list[tuple[bytes, int, int]], buckets: int):
        sample = sorted(sample)
        cut = [sample[len(sample) * i // buckets] for i in range(1, buckets)] if sample else []
        self.keys = sorted(set(cut))
        self.words = np.array([int.from_bytes(k[0][:8], "big") for k in self.keys], dtype=np.uint64)

    def of(self, lead: np.ndarray, check: np.ndarray, tie: np.ndarray) -> np.ndarray:
        word = np.ascontiguousarray(lead[:, :8]).view(">u8").ravel().astype(np.uint64)
        low, high = np.searchsorted(self.words, word, "left"), np.searchsorted(self.words, word, "right")
        for i in np.flatnonzero(low != high).tolist():
            low[i] = bisect_right(self.keys, (lead[i].tobytes(), int(check[i]), int(tie[i])), int(low[i]), int(high[i]))
        return low


RANGES = "row long, lo int, hi int"


def repeated_ranges(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs(row, body) to (row, lo, hi): beginnings of strings that are somewhere else too."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    expected = max(1, 2 * total // (REACH + 1))
    buckets = int(min(MOST_BUCKETS, max(1, expected // IN_BUCKET), max(1, expected)))
    samples = max(4, min(SAMPLES, MOST_SAMPLED // buckets))
    limit = np.uint64(min(2**64 - 1, int(2**64 * min(1.0, buckets * samples / expected))))

    def sampled(batches):
        for b in slices(batches):
            out: list[tuple] = []
            for row, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s := suffixes(body, row):
                    # Chosen by another hash than the tie, whose values in the sample must be spread like all.
                    for i in np.flatnonzero(mix(s[2] ^ np.uint64(0xC0FFEE)) < limit).tolist():
                        out.append((s[0][i].tobytes(), int(s[1][i]), int(s[2][i])))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array(np.array([o[1] for o in out], dtype=np.uint64).astype(np.int64)), pa.array(np.array([o[2] for o in out], dtype=np.uint64).astype(np.int64))], ["lead", "c", "tie"])

    sample = []
    if buckets > 1:  # about buckets * samples rows, MOST_SAMPLED at most
        sample = [(bytes(r.lead), r.c & (2**64 - 1), r.tie & (2**64 - 1)) for r in docs.mapInArrow(sampled, "lead binary, c long, tie long").collect()]
    splitters = spark.sparkContext.broadcast(Splitters(sample, buckets))

    def dealt(batches):
        for b in slices(batches):
            got = [(row, s) for row, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (s := suffixes(body, row))]
            for part in (got[i : i + 500] for i in range(0, len(got), 500)):
                lead, check, tie = (np.concatenate([s[k] for _, s in part]) for k in range(3))
                at, lo, hi = (np.concatenate([s[k] for _, s in part]).astype(np.int32) for k in (3, 4, 5))
                row = np.repeat(np.array([r for r, _ in part], dtype=np.int64), [len(s[3]) for _, s in part])
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LEAD), len(row), [None, pa.py_buffer(np.ascontiguousarray(lead).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(splitters.value.of(lead, check, tie).astype(np.int32)), flat, pa.array(check.astype(np.int64)), pa.array(row), pa.array(at), pa.array(lo), pa.array(hi)], ["bucket", "lead", "c", "row", "at", "lo", "hi"])

    def sort_bucket(frame: pa.Table) -> pa.Table:
        n = frame.num_rows
        lead = np.frombuffer(b"".join(frame.column("lead").to_pylist()), dtype=">u8").reshape(n, LEAD // 8).astype(np.uint64)
        check = frame.column("c").to_numpy()
        order, first = multikey_sort(lead)
        run = np.cumsum(first) - 1
        by = np.lexsort((check[order], run))  # inside a run of equal suffixes, by the checksum
        order, run = order[by], run[by]
        c = check[order]
        head = np.ones(n, dtype=bool)
        head[1:] = (run[1:] != run[:-1]) | (c[1:] != c[:-1])
        clazz = np.cumsum(head) - 1
        alike = np.bincount(clazz)[clazz] > 1
        size = np.bincount(run)[run]
        edge = (run == 0) | (run == run[-1])
        open_ = ~alike & ((size > 1) | edge)
        waits = np.zeros(run[-1] + 1, dtype=bool)
        waits[run[open_]] = True
        # A class that is known to repeat sends one of its own to be compared with what is open.
        send = open_ | (alike & head & (waits[run] | edge))
        group = np.zeros(n, dtype=np.uint64)
        for d in range(LEAD // 8):
            group = mix(group + lead[order, d])
        keep = np.flatnonzero(alike | send)
        o = order[keep]
        kept = [pa.array(frame.column(x).to_numpy()[o]) for x in ("row", "at", "lo", "hi")]
        return pa.table([*kept, pa.array(alike[keep]), pa.array(send[keep]), pa.array(group[keep].astype(np.int64))], names=["row", "at", "lo", "hi", "alike", "send", "g"])

    sorted_ = docs.mapInArrow(dealt, "bucket int, lead binary, c long, row long, at int, lo int, hi int").groupBy("bucket").applyInArrow(sort_bucket, "row long, at int, lo int, hi int, alike boolean, send boolean, g long")
    sorted_ = scratch.save(sorted_, "sorted")
    sent = sorted_.where("send").select("row", "at", "lo", "hi", "g").distinct()
    groups = sent.groupBy("g").count()
    sent = sent.join(groups.where("count > 1"), "g").withColumn("salts", F.when(F.col("count") > HOT, F.ceil(F.col("count") / HOT)).otherwise(1).cast("int"))
    todo = sent.groupBy("row").agg(F.collect_list(F.struct("g", "at", "lo", "hi", "salts")).alias("todo"))

    def strings(batches):
        for b in batches:
            out: list[tuple] = []
            for row, body, todo in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for t in todo:
                    part = body[t["lo"] : t["hi"] + WIDTH]
                    if t["salts"] == 1:
                        out.append((t["g"], 0, row, t["lo"], part, b""))
                        continue
                    buffer = np.frombuffer(part, dtype=np.uint8)
                    h = window_hashes(prefix_hash(BYTE_CODES[buffer]), 0, t["hi"] - t["lo"])
                    salt = (h >> np.uint64(32)) % np.uint64(t["salts"])
                    for s in np.unique(salt).tolist():
                        mine = np.flatnonzero(salt == s)
                        out.append((t["g"], int(s), row, t["lo"], h[mine].tobytes(), mine.astype(np.uint16).tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["g", "salt", "row", "lo", "data", "off"])

    def compare(frame: pa.Table) -> pa.Table:
        hashes, rows, starts = [], [], []
        for row, lo, data, off in zip(*(frame.column(c).to_pylist() for c in ("row", "lo", "data", "off")), strict=True):
            if off:
                h, o = np.frombuffer(data, dtype=np.uint64), np.frombuffer(off, dtype=np.uint16).astype(np.int64)
            else:
                buffer = np.frombuffer(data, dtype=np.uint8)
                h = window_hashes(prefix_hash(BYTE_CODES[buffer]), 0, len(buffer) - WIDTH)
                o = np.arange(len(h))
            hashes.append(h)
            rows.append(np.full(len(h), row))
            starts.append(o + lo)
        h, row, start = np.concatenate(hashes), np.concatenate(rows), np.concatenate(starts)
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        row, start = row[twice], start[twice]
        by = np.lexsort((start, row))
        row, start = row[by], start[by]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(row)) - 1 if len(a) else a
        return pa.table({"row": pa.array(row[a], pa.int64()), "lo": pa.array(start[a], pa.int32()), "hi": pa.array(start[b], pa.int32())})

    found = docs.join(todo, "row").select("row", "body", "todo").mapInArrow(strings, "g long, salt int, row long, lo int, data binary, off binary").groupBy("g", "salt").applyInArrow(compare, RANGES)
    return sorted_.where("alike").select("row", "lo", "hi").unionByName(found)


def cut(body: bytes, ranges: list) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left)."""
    kept, removed, spans, at, stop = [], 0, 0, 0, -1
    for r in sorted((r["lo"], r["hi"]) for r in ranges or ()):
        lo, hi = r[0], r[1] + WIDTH
        if lo > stop:
            kept.append(body[at:lo])
            spans += 1
            start = lo
        else:
            start = stop
        if hi > stop:
            removed += hi - start
            stop = at = hi
    kept.append(body[at:])
    return removed, spans, b"".join(kept)


def dedup_substrings(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """A row for each row of docs: key, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes) if with_text.

    Every byte that is part of a WIDTH-byte string which also begins elsewhere, in any
    document, goes, all copies of it alike. A null text is empty; texts under WIDTH bytes
    stay whole, long ones are taken whole. Repeated rows are copies of each other, with a key or
    without; their ranges are gathered once. docs may be empty; other columns aren't read.
    """
    row = F.xxhash64(F.col(key).cast("string"), F.lit("\x1f"), F.col(text)).alias("row")
    plain = docs.select(F.col(key).alias("key"), row, utf8_bytes(text).alias("body"))
    ranges = repeated_ranges(plain.select("row", "body"), scratch).groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    ranges = scratch.save(ranges, "ranges")
    scratch.drop("sorted")
    kind = docs.schema[key].dataType.simpleString()

    def finished(batches):
        for b in slices(batches):
            got = [(len(body), *cut(body, ranges)) for body, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = [b.column(0), *[pa.array([g[k] for g in got], pa.int64()) for k in range(3)], pa.array([hashlib.sha256(g[3]).hexdigest() for g in got], pa.string())]
            names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[3] for g in got], pa.binary())] if with_text else cols, [*names, "kept"] if with_text else names)

    ddl = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return plain.join(ranges, "row", "left").select("key", "body", "ranges").mapInArrow(finished, ddl)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without their repeated 400-byte strings."""
    return dedup_substrings(table(spark, sf_dir, "documents"), Scratch(spark))
