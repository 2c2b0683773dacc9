"""Phrase collocations of two to four words by position bitmaps, as in sequential pattern mining with bitmaps.

Each shard (some texts of one language) numbers its words' positions, one left free between
pieces, and keeps one compressed bitmap for each word: its non-empty blocks of 16 positions. A phrase's
bitmap marks where its last word stands; shifted by one and ANDed with the words' bitmaps it
gives the bitmaps of all phrases that are one word longer, and popcounts are the
phrases' occurrences. The free positions stop phrases at the ends of pieces. Only blocks that both
sides have are looked at, and many phrases are extended by one array operation.

Counts are summed over shards. What a phrase needs to occur LEAST times is that its words
and its pairs of words do. So the words come first; then all pairs of frequent words are
counted; then each shard goes from its frequent pairs depth-first to three and four words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_CODES, LOWER, Scratch, give_back, mix, prefix_hash, slices, span_hash, table

#: Least occurrences, longest phrase, rows for each language, per cent from which a longer phrase covers a shorter one.
LEAST, LONGEST, TOP, COVERED = 30, 4, 2000, 80
SCALE = 2_000_000
#: Bytes of text in a shard; rows that may be broadcast; expanded block pairs at once; parts into which a hot word or language is dealt.
SHARD_BYTES, MOST_BROADCAST, AT_ONCE, SALTS = 2 << 20, 200_000, 1 << 19, 16
BITS = 16
#: Pairs that may be broadcast (16 bytes each); beyond, a filter of so many bits at most tells them, in parts of so many bits.
MOST_PAIRS, MOST_BITS, PART_BITS = 1_000_000, 1 << 28, 1 << 20
#: The longest gap between blocks that an entry holds.
GAP = 65535

#: Bytes that part words, and those that part pieces.
BLANK, STOP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09]] = True
STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def positions(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of texts, and for each occurrence its word and its position; a position is left free between pieces."""
    body = LOWER[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
    stop = STOP[body]
    word = np.concatenate(([False], ~(BLANK[body] | stop), [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, end = edges[0::2], edges[1::2]
    if not len(start):
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    piece = np.cumsum(stop)[start]
    place = np.arange(len(start)) + np.cumsum(np.append(False, piece[1:] != piece[:-1]))
    _, first, which = np.unique(span_hash(prefix_hash(BYTE_CODES[body]), start, end), return_index=True, return_inverse=True)
    whole = body.tobytes()
    return [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], which, place


def bitmaps(which: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, block, bits) of all non-empty blocks, by word and block."""
    order = np.argsort(which, kind="stable")  # positions ascend already
    which, block, bit = which[order], place[order] // BITS, np.left_shift(np.uint16(1), (place[order] % BITS).astype(np.uint16))
    head = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (block[1:] != block[:-1])))
    return which[head], block[head], np.bitwise_or.reduceat(bit, head)


def pack(word: np.ndarray, block: np.ndarray, bits: np.ndarray) -> pa.Array:
    """One binary for each word: (gap to the block before, bits) of 16 bits each; empty blocks bridge gaps that are too long."""
    fresh = np.append(True, word[1:] != word[:-1])
    gap = np.where(fresh, block, np.diff(block, prepend=0))
    at = np.cumsum(gap // GAP + 1) - 1
    pairs = np.zeros((int(at[-1]) + 1, 2), np.uint16)
    pairs[:, 0] = GAP
    pairs[at, 0], pairs[at, 1] = gap % GAP, bits
    ends = np.append(at[np.flatnonzero(fresh)[1:] - 1] + 1, len(pairs))
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int32).tobytes()), pa.py_buffer(pairs.tobytes())])


def unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, block, bits) of what pack has packed."""
    sizes = np.array([len(p) // 4 for p in packed], dtype=np.int64)
    pairs = np.frombuffer(b"".join(packed), dtype=np.uint16).reshape(-1, 2)
    sums = np.append(0, np.cumsum(pairs[:, 0], dtype=np.int64))
    return np.repeat(np.arange(len(packed)), sizes), sums[1:] - np.repeat(sums[np.cumsum(sizes) - sizes], sizes), pairs[:, 1]


class Shard:
    """The bitmaps of a shard's words, by block."""

    def __init__(self, words: np.ndarray, own: tuple[np.ndarray, np.ndarray, np.ndarray]):
        """words: ids, ascending. own: (place in words, block, bits), by word."""
        self.words, self.own = words, own
        block = own[1]
        order = np.argsort(block, kind="stable")
        self.word, self.bits = own[0][order], own[2][order]
        self.first = np.searchsorted(block[order], np.arange((int(block.max()) if len(block) else 0) + 3))

    def longer(self, node: np.ndarray, block: np.ndarray, bits: np.ndarray):
        """Extend phrases (by number, with the blocks of their bitmaps) by one word: yields (node, word, block, bits)."""
        carry = np.flatnonzero(bits >> np.uint16(BITS - 1))
        node, block = np.concatenate((node, node[carry])), np.concatenate((block, block[carry] + 1))
        bits = np.concatenate((np.left_shift(bits, np.uint16(1)), np.ones(len(carry), np.uint16)))
        full = np.flatnonzero(bits)
        node, block, bits = node[full], block[full], bits[full]
        order = np.argsort(node, kind="stable")
        node, block, bits = node[order], block[order], bits[order]
        first = self.first[block]
        n = self.first[block + 1] - first
        sums = np.cumsum(n)
        at = 0
        while at < len(n):
            end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + AT_ONCE)))
            m = n[at:end]
            left = np.repeat(np.arange(at, end), m)
            right = np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[at:end], m)
            both = bits[left] & self.bits[right]
            hit = np.flatnonzero(both)
            yield node[left[hit]], self.word[right[hit]], block[left[hit]], both[hit]
            at = end

    def pairs(self):
        """(first word, second word, occurrences) of all pairs; a pair may come in several parts."""
        for node, word, _, bits in self.longer(*self.own):
            key, back = np.unique(node * len(self.words) + word, return_inverse=True)
            yield key // len(self.words), key % len(self.words), np.bincount(back, np.bitwise_count(bits)).astype(np.int64)

    def phrases(self, pairs, longest: int):
        """(words, occurrences) of phrases of three to ``longest`` words, all of whose pairs are among ``pairs``.

        Depth-first: what extends some phrases goes on to the longest before the next ones are extended.
        """
        begins = pairs.begins(self.words)[self.own[0]]
        yield from self._deeper(np.arange(len(self.words))[:, None], tuple(x[begins] for x in self.own), pairs, longest)

    def _deeper(self, phrase: np.ndarray, own, pairs, longest: int):
        for node, word, block, bits in self.longer(*own):
            fine = np.flatnonzero(pairs.among(self.words, phrase[node, -1], word))
            key, back = np.unique(node[fine] * len(self.words) + word[fine], return_inverse=True)
            if not len(key):
                continue
            grown = np.column_stack((phrase[key // len(self.words)], key % len(self.words)))
            if grown.shape[1] > 2:
                yield grown, np.bincount(back, np.bitwise_count(bits[fine])).astype(np.int64)
            if grown.shape[1] < longest:
                yield from self._deeper(grown, (back, block[fine], bits[fine]), pairs, longest)


def _shards(batches):
    """(language, texts) of bounded size from Arrow batches of (lang, text)."""
    held: dict[str, tuple[list[bytes], int]] = {}
    for b in slices(batches):
        for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            texts, size = held.get(name, ([], 0))
            texts.append(t)
            held[name] = (texts, size + len(t))
            if size + len(t) >= SHARD_BYTES:
                yield name, held.pop(name)[0]
    for name, (texts, _) in held.items():
        yield name, texts


def _each(shards, make):
    for shard, (name, texts) in enumerate(shards, TaskContext.get().partitionId() << 32):
        words, which, place = positions(texts)
        if words:
            yield make(shard, name, words, which, place)
        give_back()


def _words(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def word_counts(narrow: DataFrame) -> DataFrame:
    """(lang, word, n) of each shard's words."""
    row = lambda shard, name, words, which, place: pa.RecordBatch.from_arrays([pa.array([name] * len(words)), _words(words), pa.array(np.bincount(which))], ["lang", "word", "n"])
    return narrow.mapInArrow(lambda batches: _each(_shards(batches), row), "lang string, word string, n long")


def word_bitmaps(narrow: DataFrame) -> DataFrame:
    """(lang, shard, word, bitmap): the words of each shard."""

    def row(shard, name, words, which, place):
        return pa.RecordBatch.from_arrays([pa.array([name] * len(words)), pa.array(np.full(len(words), shard)), _words(words), pack(*bitmaps(which, place))], ["lang", "shard", "word", "bitmap"])

    return narrow.mapInArrow(lambda batches: _each(_shards(batches), row), "lang string, shard long, word string, bitmap binary")


def _small(df: DataFrame) -> bool:
    return df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


class ListedPairs:
    """All frequent pairs."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second

    def of(self, ids: np.ndarray) -> ListedPairs:
        """Those of a shard's words (ascending ids)."""
        a, b = (np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in (self.first, self.second))
        both = (ids[a] == self.first) & (ids[b] == self.second)
        out = ListedPairs(self.first[both], self.second[both])
        out.keys = np.unique(a[both] * len(ids) + b[both])
        return out

    def begins(self, ids: np.ndarray) -> np.ndarray:
        return np.isin(ids, self.first)

    def among(self, ids: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(first), dtype=bool)
        pair = first * len(ids) + second
        return self.keys[np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)] == pair


def _place(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    return (mix(mix(first.astype(np.uint64)) + second.astype(np.uint64)) % np.uint64(bits)).astype(np.int64)


class FilteredPairs:
    """A bit for each frequent pair, at its hash. A rare pair may meet a set bit; its phrases occur too rarely then and
    go when the shards' counts are summed, so no result depends on the filter."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.bits = packed, 8 * len(packed)

    def of(self, ids: np.ndarray) -> FilteredPairs:
        return self

    def begins(self, ids: np.ndarray) -> np.ndarray:
        return np.ones(len(ids), dtype=bool)

    def among(self, ids: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = _place(ids[first], ids[second], self.bits)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _filter(often: DataFrame, n: int) -> FilteredPairs:
    """The filter of n pairs, 32 bits for each up to MOST_BITS; its parts are made by tasks."""
    bits = min(MOST_BITS, max(PART_BITS, 1 << (32 * n).bit_length()))

    def places(batches):
        for b in batches:
            at = _place(b.column(0).to_numpy(), b.column(1).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at // PART_BITS), pa.array((at % PART_BITS).astype(np.int32))], ["part", "at"])

    def part(t: pa.Table) -> pa.Table:
        flags = np.zeros(PART_BITS, dtype=bool)
        flags[t.column("at").to_numpy()] = True
        return pa.table({"part": t.column("part").slice(0, 1), "packed": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    parts = often.select("w1", "w2").mapInArrow(places, "part long, at int").groupBy("part").applyInArrow(part, "part long, packed binary").toArrow()
    packed = np.zeros(bits // 8, dtype=np.uint8)
    for p, x in zip(parts.column("part").to_pylist(), parts.column("packed"), strict=True):
        packed[p * PART_BITS // 8 : (p + 1) * PART_BITS // 8] = np.frombuffer(x.as_buffer(), dtype=np.uint8)
    return FilteredPairs(packed)


def _broadcast_pairs(often: DataFrame):
    """The frequent pairs for all tasks: listed while they are few, else as a filter of bounded size."""
    n = often.count()
    if n > MOST_PAIRS:
        return often.sparkSession.sparkContext.broadcast(_filter(often, n))
    t = often.select("w1", "w2").toArrow()
    return often.sparkSession.sparkContext.broadcast(ListedPairs(t.column("w1").to_numpy(), t.column("w2").to_numpy()))


def _texts_as_shards(narrow: DataFrame, words: DataFrame):
    """Work on shards made from the texts anew, where the frequent words can be broadcast: nothing is stored or shuffled."""
    ids: dict[str, dict[bytes, int]] = {}
    for name, word, i in zip(*(c.to_pylist() for c in words.select("lang", "word", "id").toArrow().columns), strict=True):
        ids.setdefault(name, {})[word.encode()] = i
    shared = narrow.sparkSession.sparkContext.broadcast(ids)

    def shard(name, words, which, place) -> Shard:
        known = shared.value.get(name, {})
        own = np.array([known.get(w, -1) for w in words], dtype=np.int64)
        order = np.argsort(own, kind="stable")
        order = order[int((own < 0).sum()) :]
        rank = np.full(len(words), -1)
        rank[order] = np.arange(len(order))
        used = rank[which] >= 0
        return Shard(own[order], bitmaps(rank[which[used]], place[used]) if used.any() else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint16)))

    def work(make, schema: str, often: DataFrame | None = None) -> DataFrame:
        pairs = None if often is None else _broadcast_pairs(often)

        def run(batches):
            more = () if pairs is None else (pairs.value,)
            for t in _each(_shards(batches), lambda _, name, words, which, place: make(shard(name, words, which, place), *more)):
                yield from t.to_batches(1 << 16)

        return narrow.mapInArrow(run, schema)

    return work


def _stored_shards(narrow: DataFrame, words: DataFrame, scratch: Scratch):
    """Work on shards whose bitmaps are stored; each meets its own frequent words and pairs by joins."""
    # A hot word has a row in every shard, so its rows are dealt over salts.
    # Without the hint, the small file of words would be broadcast, SALTS times larger than its size tells.
    salted = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    live = word_bitmaps(narrow).withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "word", "salt"])
    live = scratch.save(live.select("shard", "id", "bitmap"), "phrase-live")

    def shard(t) -> Shard:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids)
        return Shard(ids[order], unpack(t.column("bitmap").take(pa.array(order)).to_pylist()))

    def work(make, schema: str, often: DataFrame | None = None) -> DataFrame:
        if often is None:
            return live.groupBy("shard").applyInArrow(lambda t: make(shard(t)), schema)
        pairs = _broadcast_pairs(often)
        return live.groupBy("shard").applyInArrow(lambda t: make(shard(t), pairs.value), schema)

    return work


def frequent_phrases(docs: DataFrame, scratch: Scratch, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, totals, phrases): frequent words (lang, word, id, f), all words of each language (lang, n), and
    phrases (ids array, a) of two to ``longest`` frequent words that occur ``least`` times or more."""
    narrow = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    counts = scratch.save(word_counts(narrow).groupBy("lang", "word").agg(F.sum("n").alias("f")), "phrase-counts")
    totals = scratch.save(counts.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    words = scratch.save(counts.where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), "phrase-words")
    scratch.drop("phrase-counts")
    shards = _texts_as_shards(narrow, words) if _small(words) else _stored_shards(narrow, words, scratch)

    def count_pairs(s: Shard) -> pa.Table:
        parts = [(s.words[a], s.words[b], n) for a, b, n in s.pairs()] or [(np.empty(0, np.int64),) * 3]
        return pa.table(dict(zip(("w1", "w2", "n"), (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True)))

    pairs = shards(count_pairs, "w1 long, w2 long, n long")
    often = scratch.save(pairs.groupBy("w1", "w2").agg(F.sum("n").alias("a")).where(F.col("a") >= least), "phrase-often")

    def longer(shard: Shard, pairs: ListedPairs | FilteredPairs) -> pa.Table:
        """Phrases of three words or more of a shard, whose pairs are all among these."""
        ids = shard.words
        out, counts = [pa.array([], pa.list_(pa.int64()))], [np.empty(0, np.int64)]
        if len(ids):
            for phrase, n in shard.phrases(pairs.of(ids), longest):
                out.append(pa.FixedSizeListArray.from_arrays(pa.array(ids[phrase].ravel()), phrase.shape[1]).cast(pa.list_(pa.int64())))
                counts.append(n)
        return pa.table({"ids": pa.chunked_array(out), "n": np.concatenate(counts)})

    two = often.select(F.array("w1", "w2").alias("ids"), "a")
    if longest > 2:
        two = two.unionByName(shards(longer, "ids array<long>, n long", often).groupBy("ids").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
    found = scratch.save(two, "phrase-found")
    return words, totals, found


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a / (left + right)), exact for all counts of 64 bits."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * F.lit(SCALE).cast("decimal(7,0)"), wide(left) + wide(right)).cast("long")


def collocations(docs: DataFrame, scratch: Scratch, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The first ``top`` phrases of each language (lang, rank, phrase, a, l, r, n, score).

    A null text counts as empty, a null language as ``und``; texts of any length are read whole,
    and repeated rows count as often as they come. An empty docs gives no rows; columns of docs
    other than the two named play no part. Equal scores of cuts go to the shortest first part;
    phrases with equal score and count are ordered by their bytes. No count is cut short:
    ``top`` limits the report alone.
    """
    words, totals, found = frequent_phrases(docs, scratch, text, lang, least, longest)
    known = scratch.save(found.select("ids", F.col("a").alias("f")).unionByName(words.select(F.array("id").alias("ids"), "f")), "phrase-known")
    cuts = found.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.slice("ids", F.lit(1), F.col("k"))).withColumn("rest", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")))
    # A file's size says little of its rows in memory, so the choice is made by their number.
    hinted = F.broadcast if _small(known) else lambda x: x.hint("merge")
    side = lambda key, name: hinted(known.select(F.col("ids").alias(key), F.col("f").alias(name)))
    cuts = cuts.join(side("first", "l"), "first").join(side("rest", "r"), "rest")
    best = cuts.withColumn("score", score_of(F.col("a"), F.col("l"), F.col("r"))).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("ids") - m + 1), lambda i: F.slice("ids", i, m)))
    within = found.where(F.size("ids") > 2).select(F.explode(F.flatten(inner)).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))
    left = best.join(within, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    spelt = left.select("ids", "a", "cut", F.posexplode("ids").alias("at", "id")).join(F.broadcast(words) if _small(words) else words.hint("merge"), "id")
    spelt = spelt.groupBy("ids", "a", "cut").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    for part in (["lang", "salt"], ["lang"]):  # a language's phrases are ranked in parts first, so that no task holds all of them
        spelt = spelt.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return spelt.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language over all documents."""
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"), Scratch(spark))


def _oracle() -> str:
    grams = {k: " || ' ' || ".join(f"w{i}" for i in range(1, k + 1)) for k in range(1, LONGEST + 1)}
    counts = " union all ".join(f"select lang, {k} as k, {g} as phrase, count(*) as f from w where w{k} is not null group by all" for k, g in grams.items())
    cut = lambda k, a, b: f"array_to_string(string_split(phrase, ' ')[{a}:{b}], ' ')"
    inner = " union all ".join(f"select lang, {cut(k, a, a + m - 1)} as phrase, a from c where k = {k}" for k in range(3, LONGEST + 1) for m in range(2, k) for a in range(1, k - m + 2))
    cuts = " union all ".join(f"select lang, phrase, a, {c} as cut, {cut(k, 1, c)} as p1, {cut(k, c + 1, k)} as p2 from c where k = {k}" for k in range(2, LONGEST + 1) for c in range(1, k))
    return f"""
with d as (select coalesce(lang, 'und') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents where text is not null),
p as materialized (select lang, row_number() over () as pid, piece from (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from d)),
u as materialized (select lang, pid, unnest(ws) as w1, generate_subscripts(ws, 1) as i from (select lang, pid, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p)),
w as materialized (select lang, w1, {", ".join(f"lead(w1, {k - 1}) over (partition by pid order by i) as w{k}" for k in range(2, LONGEST + 1))} from u),
g as materialized ({counts}),
t as materialized (select lang, count(*) as n from w group by lang),
c as materialized (select lang, k, phrase, f as a from g where k > 1 and f >= {LEAST}),
h as (select lang, phrase, max(a) as longer from ({inner}) group by all),
x as materialized (select x.*, g.f as l from ({cuts}) x join g on g.lang = x.lang and g.phrase = x.p1),
s as (select x.lang, x.phrase, x.a, x.cut, x.l, g.f as r, ({SCALE}::hugeint * x.a) // (x.l + g.f)::hugeint as score
  from x join g on g.lang = x.lang and g.phrase = x.p2),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
k as (select b.* from b left join h on h.lang = b.lang and h.phrase = b.phrase where h.longer is null or 100 * h.longer < {COVERED} * b.a),
z as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from k)
select z.lang, z.rank::bigint as rank, z.phrase, z.a::bigint as a, z.l::bigint as l, z.r::bigint as r, t.n::bigint as n, z.score::bigint as score
from z join t on t.lang = z.lang where z.rank <= {TOP}"""


ORACLE_SQL = _oracle()
