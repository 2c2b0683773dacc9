"""What the training-data operators share: tables, scratch space, hashing of words, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words: space and \x09-\x0D.
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True

#: ASCII capitals to small letters, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(0x5EED)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables in the folder that the cluster shares (``spark.checkpoint.dir``).

    A saved table cuts lineage and survives lost executors. Where the setting is absent, a
    temporary folder of this machine is used if Spark runs on this machine alone; on a
    cluster that is an error. What is not dropped before goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spanveil.scratch.dir", None)
        if not root:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='spanveil-')}"
            spark.conf.set("spanveil.scratch.dir", root)
        self.root = f"{root.rstrip('/')}/spanveil-{uuid.uuid4().hex}"
        path, store = self._at(self.root)
        store.mkdirs(path)
        store.deleteOnExit(path)

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        path, store = self._at(self.path(name))
        store.delete(path, True)


def give_back() -> None:
    """Return free memory of this process to the system: a Python worker stays, and would keep what its task once took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def slices(batches, rows: int = 256):
    """Arrow batches in slices of few rows, so that a task holds few texts as Python strings; free memory is given back at the end."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()


def utf8_bytes(text: str | Column) -> Column:
    """Text as UTF-8 bytes; null gives no bytes."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                a = np.full(size, base, dtype=np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running sums from which any substring's hash is one subtraction and one product."""
    out = np.empty(len(codes) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(codes * POWERS.of(len(codes))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end)."""
    return mix((prefix[end] - prefix[start]) * POWERS.of(len(prefix))[1][start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    word = np.concatenate(([False], ~SEPARATORS[buffer], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash for each word of a text, A-Z as a-z."""
    buffer = LOWER[np.frombuffer(text, dtype=np.uint8)]
    start, end = word_spans(buffer)
    return span_hash(prefix_hash(BYTE_CODES[buffer]), start, end) if len(start) else np.empty(0, dtype=np.uint64)


def _chained(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words."""
    h = np.full(max(0, len(words) - width + 1), width, dtype=np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[k : len(h) + k])
    return h


def sorted_set(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles; fewer words make one, none make none."""
    words = word_hashes(text)
    return sorted_set(_chained(words, min(n, len(words)))) if len(words) else words


def shingle_sets(texts: list[bytes], n: int, most: int = 1 << 20) -> list[np.ndarray]:
    """shingle_set of each text; short texts are hashed together, up to ``most`` bytes."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) < most:
            size += len(texts[end]) + 1
            end += 1
        buffer = LOWER[np.frombuffer(b"\n".join(texts[at:end]), dtype=np.uint8)]  # a line break parts words
        start, stop = word_spans(buffer)
        words = span_hash(prefix_hash(BYTE_CODES[buffer]), start, stop) if len(start) else np.empty(0, dtype=np.uint64)
        runs = _chained(words, n)
        ends = np.cumsum([len(t) + 1 for t in texts[at:end]])
        counts = np.diff(np.searchsorted(start, np.append(0, ends))).tolist()
        first = 0
        for m in counts:
            h = runs[first : first + m - n + 1] if m >= n else _chained(words[first : first + m], m) if m else words[:0]
            out.append(sorted_set(h))
            first += m
        at = end
    return out


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large and small stars.

    Each round sends every node's larger, then smaller, neighbours to the least
    node it knows; rounds grow as the logarithm of a component's size. Returns
    (node, component) for each node of an edge; edge lists never leave the cluster.
    """
    live = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    seen = lambda x: x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    step, before = 0, seen(live)
    while True:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        new = scratch.save(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-{step + 1}")
        now = seen(new)
        scratch.drop(f"{name}-{step}")
        live, step = new, step + 1
        if now == before:
            break
        before = now
    return live.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(live.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
