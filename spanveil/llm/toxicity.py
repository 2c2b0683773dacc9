"""Toxicity by the nearest labelled examples under TF-IDF cosine; with ``by_label`` the weighting is supervised.

Terms are words in small letters, hashed to 64 bits. Every word of a bounded sample of
labelled rows (SAMPLE) is a term. A term weighs (1 + log tf) * log(N / df), with df
counted over all documents. With ``by_label`` that is multiplied by the term's
association with the label where it is beyond chance: chi-squared over CRITICAL, 1 at
least. Plain TF-IDF gives the few words that make a text toxic no more say than its
topic (README has the figures of both); with the factor all words still count, for
either label. The query and the pipeline set it; it is off unless asked for.

The sample is an inverted index whose documents lie in order of their norms, in blocks
of BLOCK, so that weights within a block are alike. A query adds up the postings of its
rarer words; what its common words can add to any document of a block is bounded by
their block maxima. Documents are opened from the highest bound down until no bound
reaches the K-th best cosine: the result is exact.

The neighbours vote by squared cosine; a monotone curve fitted on the sample's own
leave-one-out votes makes the vote a probability.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, prefix_hash, slices, span_hash, table

#: Labelled rows that the index may hold; neighbours; documents in a block.
SAMPLE, K, BLOCK = 20_000, 15, 16
#: Chi-squared that chance exceeds once in a thousand terms.
CRITICAL = 10.83
#: A word in more than one of COMMON sample documents is common.
COMMON = 6
#: Posting lists above this length are sliced one by one.
LONG = 400
#: Bytes of the index that come to the driver in one row.
PACKET = 1 << 20
#: Cosines are compared to six digits: weights are held in single precision.
DIGITS = 6

_FOLD = np.zeros(0x3000, dtype=np.uint64)


def _fold() -> np.ndarray:
    """Codes of characters: 0 for what is no letter or digit, equal for both cases."""
    if not _FOLD[97]:
        for c in range(len(_FOLD)):
            if chr(c).isalnum():
                low = chr(c).lower()
                _FOLD[c] = ord(low) if len(low) == 1 else c
    return _FOLD


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, term hash) of every word of every text, repeats included."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    fold = _fold()
    low = np.where(codes < len(fold), fold[np.minimum(codes, len(fold) - 1)], codes.astype(np.uint64))
    word = np.concatenate(([False], low != 0, [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[0::2], edge[1::2]
    prefix = prefix_hash(mix(low + np.uint64(0x51ED)))
    return np.searchsorted(ends, start, side="right"), span_hash(prefix, start, end)


def runs(texts: list, most: int = 250_000):
    """(first row, texts) in runs of bounded size; null is empty."""
    run, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if run and size + len(t or "") > most:
            yield first, run
            run, first, size = [], i, 0
        run.append(t or "")
        size += len(t or "")
    if run:
        yield first, run


def distinct(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) with their counts."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    at = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.empty(0, np.int64)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def distinct_numbers(owner: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, number below 2**32) with their counts."""
    both = np.sort(owner << 32 | number)
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.empty(0, np.int64)
    return both[at] >> 32, both[at] & 0xFFFFFFFF, np.diff(np.append(at, len(both)))


def cuts(owner: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Where each of n owners' entries begin and end."""
    at = np.searchsorted(owner, np.arange(n + 1)).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


def chi_squared(with_1: np.ndarray, with_0: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    a, b = with_1.astype(float), with_0.astype(float)
    c, d = ones - a, zeros - b
    below = (a + b) * (c + d) * max(1, ones) * max(1, zeros)
    return np.divide((a * d - b * c) ** 2 * (ones + zeros), below, out=np.zeros_like(a), where=below > 0)


class Vocabulary:
    """The sample's terms, by hash, and their weights."""

    def __init__(self, hashes: np.ndarray, weight: np.ndarray):
        """hashes: rising."""
        self.hashes, self.weight = hashes, weight.astype(np.float32)
        self._look()

    def _look(self) -> None:
        """Where the hashes with each leading 20 bits begin."""
        self.first = np.append(0, np.cumsum(np.bincount((self.hashes >> np.uint64(44)).astype(np.int64), minlength=1 << 20))).astype(np.int32)

    def __getstate__(self):
        return self.hashes, self.weight

    def __setstate__(self, state):
        self.hashes, self.weight = state
        self._look()

    def number(self, h: np.ndarray) -> np.ndarray:
        """Each hash's number, -1 for what is no term."""
        out = np.full(len(h), -1, dtype=np.int64)
        lead = (h >> np.uint64(44)).astype(np.int64)
        at, end, left = self.first[lead], self.first[lead + 1], np.arange(len(h))
        while len(left):
            some = at[left] < end[left]
            left = left[some]
            same = self.hashes[at[left]] == h[left]
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
        return out

    def vector(self, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(term numbers, weights of unit length, length before) without the terms that weigh nothing."""
        w = (1 + np.log(n)) * self.weight[term]
        full = w > 0
        term, w = term[full], w[full]
        norm = float(np.sqrt((w * w).sum()))
        return term, (w / norm).astype(np.float32) if norm else w.astype(np.float32), norm

    def vectors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        owner, h = terms(texts)
        term = self.number(h)
        known = term >= 0
        owner, term, n = distinct_numbers(owner[known], term[known])
        return [self.vector(term[a:b], n[a:b])[:2] for a, b in cuts(owner, len(texts))]


class BlockMaxIndex:
    """Exact nearest neighbours by cosine over unit vectors.

    doc, weight: postings, ordered by term and document; begin: where each term's begin.
    Documents are numbered in the order of their blocks.
    """

    def __init__(self, doc: np.ndarray, weight: np.ndarray, begin: np.ndarray, n: int, block: int = BLOCK):
        self.begin, self.n, self.block = begin, n, block
        self.pairs = np.empty(len(doc), dtype=np.int64)  # a posting's document and weight side by side
        self.pairs.view(np.int32)[0::2], self.pairs.view(np.float32)[1::2] = doc, weight
        self._spread()

    def __getstate__(self):
        return self.pairs, self.begin, self.n, self.block

    def __setstate__(self, state):
        self.pairs, self.begin, self.n, self.block = state
        self._spread()

    def _spread(self) -> None:
        doc, weight, begin, n, block = self.pairs.view(np.int32)[0::2], self.pairs.view(np.float32)[1::2], self.begin, self.n, self.block
        df = np.diff(begin)
        common = np.flatnonzero(df > max(8, n // COMMON))
        self.row = np.full(len(df), -1, dtype=np.int32)
        self.row[common] = np.arange(len(common))
        # Of common words each document's weights, side by side, and their maxima over blocks.
        self.blocks = max(1, -(-n // block))
        self.dense = np.zeros((self.blocks * block, len(common)), dtype=np.float32)
        for r, t in enumerate(common.tolist()):
            a, b = int(begin[t]), int(begin[t + 1])
            self.dense[doc[a:b], r] = weight[a:b]
        self.most = self.dense.reshape(self.blocks, block, len(common)).max(axis=1)

    @classmethod
    def of(cls, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK) -> BlockMaxIndex:
        return cls(*postings(vectors, n_terms), len(vectors), block)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(documents, cosines) of the k best with a common term, best first; ties by number."""
        row = self.row[terms]
        rare = row < 0
        start, weight = self.begin[terms[rare]], weights[rare]
        size = self.begin[terms[rare] + 1] - start
        # Short posting lists are gathered at once, long ones are sliced.
        long = size > LONG
        cuts_ = [slice(x, x + n) for x, n in zip(start[long].tolist(), size[long].tolist(), strict=True)]
        start, size, by = start[~long], size[~long], np.concatenate((np.repeat(weight[~long], size[~long]), np.repeat(weight[long], size[long])))
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        found = np.concatenate([self.pairs[at], *[self.pairs[c] for c in cuts_]])
        sums = np.bincount(found.view(np.int32)[0::2], found.view(np.float32)[1::2] * by, minlength=len(self.dense))
        q = np.zeros(self.dense.shape[1], dtype=np.float32)
        q[row[~rare]] = weights[~rare]
        by_block = sums.reshape(self.blocks, self.block)
        bound = (by_block + (self.most @ q)[:, None]).ravel()
        if without >= 0:
            bound[without] = 0
        bound[self.n :] = 0
        best_doc, best_cos, floor, margin = np.empty(0, np.int64), np.empty(0), 0.0, 10.0**-DIGITS
        if self.blocks > k:  # the K-th best of the blocks' best by rare words alone is a bound from below
            if without >= 0:
                sums[without] = 0
            floor = float(np.partition(by_block.max(axis=1), -k)[-k]) - margin
        left = np.flatnonzero(bound >= max(floor, 1e-12))
        first = 8 * k
        while len(left):  # the highest bounds first, then all that can still be among the best
            part = left[np.argpartition(-bound[left], first)[:first]] if len(left) > 2 * first else left
            cos = np.round(sums[part] + self.dense[part] @ q, DIGITS)
            best_doc, best_cos = np.concatenate((best_doc, part[cos > 0])), np.concatenate((best_cos, cos[cos > 0]))
            top = np.lexsort((best_doc, -best_cos))[:k]
            best_doc, best_cos = best_doc[top], best_cos[top]
            if len(part) == len(left):
                break
            if len(best_cos) >= k:
                floor = max(floor, float(best_cos[k - 1]) - margin)
            bound[part] = -1
            left = left[bound[left] >= max(floor, 1e-12)]
            first *= 4
        return best_doc, best_cos


def postings(vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, weight) of all entries, ordered by term and document, and where each term's begin."""
    term = np.concatenate([np.empty(0, np.int32), *[v[0] for v in vectors]]).astype(np.int32)
    doc = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(v[0]) for v in vectors])
    by = np.argsort(term, kind="stable")
    weight = np.concatenate([np.empty(0, np.float32), *[v[1] for v in vectors]])
    return doc[by], weight[by].astype(np.float32), np.append(0, np.cumsum(np.bincount(term, minlength=n_terms)))


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the best rising step curve (pool adjacent violators), with a mean of half a row at each end."""
    values, of = np.unique(x, return_inverse=True)
    rows = np.bincount(of)
    pools: list[list[float]] = []
    for v, mean, n in zip(values.tolist(), (np.bincount(of, y) / rows).tolist(), rows.tolist(), strict=True):
        pools.append([v, mean, n, v])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1] - 1e-12:
            p = pools.pop()
            q = pools[-1]
            q[1] = (q[1] * q[2] + p[1] * p[2]) / (q[2] + p[2])
            q[2] += p[2]
            q[3] = p[3]
    at = np.array([(p[0] + p[3]) / 2 for p in pools])
    return at, np.array([(p[1] * p[2] + 0.25) / (p[2] + 0.5) for p in pools])


class Examples:
    """What scoring tasks hold: vocabulary, index, and each indexed document's id and label. Bounded by SAMPLE."""

    def __init__(self, vocabulary: Vocabulary, index: BlockMaxIndex, ids: np.ndarray, labels: np.ndarray):
        self.vocabulary, self.index, self.ids, self.labels = vocabulary, index, ids, labels

    def vote(self, vector: tuple[np.ndarray, np.ndarray], k: int, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        docs, cos = self.index.nearest(*vector, k, without)
        w = cos * cos
        return (float((w * self.labels[docs]).sum() / w.sum()) if len(docs) else 0.0), docs, cos


class Model:
    """Examples shared with the executors, and the curve that makes votes probabilities."""

    def __init__(self, shared, curve: tuple[np.ndarray, np.ndarray], none: float, k: int):
        self.shared, self.curve, self.none, self.k = shared, curve, none, k

    def scorer(self):
        """A function from texts to (probability, neighbours' ids, cosines); equal vectors in a row of texts are voted on once."""
        seen: dict[bytes, tuple[float, np.ndarray, np.ndarray]] = {}
        held, curve, none, k = self.shared.value, self.curve, self.none, self.k

        def one(v: tuple[np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
            name = hashlib.blake2b(v[0].tobytes() + v[1].tobytes(), digest_size=16).digest()
            if name not in seen:
                if len(seen) > 5_000:
                    seen.clear()
                vote, docs, cos = held.vote(v, k)
                seen[name] = (float(np.clip(np.interp(vote, *curve), 0, 1)) if len(docs) else none, held.ids[docs], cos)
            return seen[name]

        return lambda texts: [one(v) for v in held.vocabulary.vectors(texts)]


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, train: Column | None = None, key: str = "doc_id", sample: int = SAMPLE, k: int = K, by_label: bool = False) -> Model | None:
    """Index of at most ``sample`` labelled documents, those with the least hash of their key; None without any.

    by_label: words that go with a label weigh more. train: condition on labels' rows. A key labelled twice takes the larger label, a key
    with two texts the lesser text; null keys and labels are left out. Document frequencies
    are those of all rows of docs.
    """
    spark = docs.sparkSession
    chosen = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull())
    if train is not None:
        chosen = chosen.where(train)
    chosen = chosen.groupBy(key).agg(F.max("toxic").cast("int").alias("_y")).orderBy(F.xxhash64(F.lit(3), F.col(key)), key).limit(sample)
    held = docs.select(key, F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(chosen), key).groupBy(key).agg(F.max("_y").alias("_y"), F.min("_text").alias("_text"))

    def counted(batches):
        for b in slices(batches):
            for first, run in runs(b.column("_text").to_pylist()):
                owner, h, n = distinct(*terms(run))
                parts = cuts(owner, len(run))
                yield pa.RecordBatch.from_pydict({"id": b.column(key)[first : first + len(run)].cast(pa.int64()), "y": b.column("_y")[first : first + len(run)], "h": [h[x:z].tobytes() for x, z in parts], "n": [n[x:z].astype(np.int32).tobytes() for x, z in parts]})

    bags = scratch.save(held.mapInArrow(counted, "id long, y int, h binary, n binary"), "toxicity-bags")
    of_label = {r.y: r["count"] for r in bags.groupBy("y").count().collect()}
    n0, n1 = of_label.get(0, 0), of_label.get(1, 0)
    if not n0 + n1:
        return None

    def labelled(batches):
        for b in batches:
            h = np.frombuffer(b"".join(b.column("h").to_pylist()), dtype=np.uint64)
            y = np.repeat(np.array(b.column("y").to_pylist()), [len(x) // 8 for x in b.column("h").to_pylist()])
            known, inverse = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"term": known.view(np.int64), "n0": np.bincount(inverse, y == 0, len(known)).astype(np.int32), "n1": np.bincount(inverse, y == 1, len(known)).astype(np.int32)})

    known = bags.mapInArrow(labelled, "term long, n0 int, n1 int").groupBy("term").agg(F.sum("n0").cast("int").alias("n0"), F.sum("n1").cast("int").alias("n1")).toArrow()
    hashes = known.column("term").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, with_0, with_1 = hashes[order], known.column("n0").to_numpy()[order], known.column("n1").to_numpy()[order]
    del known
    vocabulary = Vocabulary(hashes, np.ones(len(hashes)))
    shared = spark.sparkContext.broadcast(vocabulary)  # the sample's words

    def met(batches):
        words, total, rows = shared.value, np.zeros(len(shared.value.hashes), dtype=np.int32), 0
        for b in slices(batches):
            rows += b.num_rows
            for _, run in runs(b.column(0).to_pylist()):
                owner, h = terms(run)
                term = words.number(h)
                at = term >= 0
                total += np.bincount(distinct_numbers(owner[at], term[at])[1], minlength=len(total)).astype(np.int32)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": np.append(some, -1).astype(np.int32), "df": np.append(total[some], rows).astype(np.int64)})

    df = docs.select("text").mapInArrow(met, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    number, n = df.column("term").to_numpy(), df.column("df").to_numpy()
    every, word = int(n[number < 0].sum()), number >= 0
    of_word = np.ones(len(hashes))
    of_word[number[word]] = n[word]
    vocabulary.weight = (np.log(every / of_word) * (np.maximum(1, chi_squared(with_1, with_0, n1, n0) / CRITICAL) if by_label else 1)).astype(np.float32)
    shared.destroy()
    del df, number, n, word, of_word, with_0, with_1, order
    weighed = spark.sparkContext.broadcast(vocabulary)

    def indexed(batches):
        """One task: the sample is bounded."""
        words, rows = weighed.value, []
        for b in batches:
            for i, y, h, m in zip(*[b.column(c).to_pylist() for c in ("id", "y", "h", "n")], strict=True):
                term, w, norm = words.vector(words.number(np.frombuffer(h, dtype=np.uint64)), np.frombuffer(m, dtype=np.int32))
                rows.append((norm, i, y, term.astype(np.int32), w))
        rows.sort(key=lambda r: r[:2])
        doc, weight, begin = postings([r[3:] for r in rows], len(words.hashes))
        packed = [np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.float64), doc, weight, begin]
        for k, x in enumerate(packed):
            body = x.tobytes()
            for at in range(0, len(body), PACKET):
                yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "at": pa.array([at], pa.int64()), "size": pa.array([len(body)], pa.int64()), "body": pa.array([body[at : at + PACKET]], pa.binary())})

    parts: list = [b""] * 5
    packets = bags.repartition(1).mapInArrow(indexed, "part int, at long, size long, body binary").repartition(8)
    for r in packets.toLocalIterator():  # packets, so that neither side holds the index twice
        if not parts[r.part]:
            parts[r.part] = bytearray(r["size"])
        parts[r.part][r.at : r.at + len(r.body)] = r.body
    weighed.destroy()
    ids, y, doc, weight, begin = (np.frombuffer(x, dtype=kind) for x, kind in zip(parts, (np.int64, np.float64, np.int32, np.float32, np.int64), strict=True))
    number_of = {i: d for d, i in enumerate(ids.tolist())}
    examples = spark.sparkContext.broadcast(Examples(vocabulary, BlockMaxIndex(doc, weight, begin, len(ids)), ids, y))
    del doc, weight, begin, vocabulary, parts

    def voted(batches):
        m = examples.value
        number = {i: d for d, i in enumerate(m.ids.tolist())}
        for b in batches:
            got = []
            for i, h, c in zip(*[b.column(x).to_pylist() for x in ("id", "h", "n")], strict=True):
                v = m.vocabulary.vector(m.vocabulary.number(np.frombuffer(h, dtype=np.uint64)), np.frombuffer(c, dtype=np.int32))
                vote, near, _ = m.vote(v[:2], k, number[i])
                got.append((i, vote, len(near)))
            yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], kind) for j, kind in enumerate((pa.int64(), pa.float64(), pa.int32()))], ["id", "vote", "near"])

    votes = bags.repartition(32).mapInArrow(voted, "id long, vote double, near int").toArrow()
    label = y[[number_of[i] for i in votes.column("id").to_pylist()]]
    vote, met_any = votes.column("vote").to_numpy(), votes.column("near").to_numpy() > 0
    by = np.argsort(votes.column("id").to_numpy(), kind="stable")
    vote, label, met_any = vote[by], label[by], met_any[by]
    curve = monotone(vote[met_any], label[met_any]) if met_any.any() else (np.array([0.0]), np.array([0.0]))
    bare = label[~met_any]
    none = float((bare.sum() + 0.25) / (len(bare) + 0.5)) if len(bare) else (n1 + 0.25) / (n0 + n1 + 0.5)
    scratch.drop("toxicity-bags")
    return Model(examples, curve, none, k)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs without their text, with ``score``, ``predicted`` and the evidence: ``neighbours`` (id, cosine).

    Null and empty texts, and those without a word of the sample, have no neighbours; they
    score as the sample's documents without any do (as all of it, where each has one).
    Long texts are taken whole. Neighbours at equal cosines (six digits) come in the index's
    order: rising length, then id. Without labelled rows every score is 0, and empty docs
    give no rows. Rows are scored one by one: repeated rows get equal scores. Columns of
    docs with these names are replaced.
    """
    docs = docs.drop("score", "predicted", "neighbours")
    rest = [f for f in docs.schema.fields if f.name != text]

    def scored(batches):
        judge = model.scorer() if model else lambda texts: [(0.0, np.empty(0, np.int64), np.empty(0))] * len(texts)
        for b in slices(batches):
            got = [x for _, run in runs(b.column(text).to_pylist()) for x in judge(run)]
            p = pa.array([x[0] for x in got], pa.float64())
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([x[k] for x in got])) for k in (1, 2)], ["id", "cosine"])
            near = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(x[1]) for x in got]]), pa.int32()), pairs)
            kept = [b.column(f.name) for f in rest]
            yield pa.RecordBatch.from_arrays([*kept, p, pa.array([int(x[0] >= 0.5) for x in got], pa.int32()), near], [*[f.name for f in rest], "score", "predicted", "neighbours"])

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "score double, predicted int, neighbours array<struct<id:long,cosine:double>>"])
    return docs.mapInArrow(scored, ddl)


def remove_toxic(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs without the rows scored 0.5 or more; columns and other rows as they are. See ``score`` for the odd cases."""

    def clean(batches):
        judge = model.scorer() if model else None
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            ok = [x[0] < 0.5 for _, run in runs(texts) for x in judge(run)] if judge else [True] * b.num_rows
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the key as text divides by 5."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of the held-out fifth are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), Scratch(spark), ~held_out(), by_label=True)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "neighbours")
