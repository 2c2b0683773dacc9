"""Phrase collocations against plain counting, over shards of any size."""

import random
import re
from collections import Counter, defaultdict

import pytest

from spanveil.llm import phrases
from spanveil.llm.common import Scratch


def brute(docs, least, top, covered=80, longest=4):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in some.items()):
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "ß", "ﬁ", "\x00", "a.b", "É", "a b", "x,y", "new", "york", "city", "hall", " ", "É", "z"] + [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["new york city hall", "of the  new york", "the\tthe the the the", "q r s. t u", "z z z z z z"]))
        texts.append((rng.choice([" ", "  ", "\n", ", "]).join(w) if rng.random() < 0.1 else " ".join(w), rng.choice(["en", "en", "de", None, "und"])))
    return [(None, "en"), ("", "de"), (" .\n", "de"), ("...", None), *texts, *texts[:40], ("the new york " * 700, "en"), ("a" * 10_000, "fr")]


@pytest.mark.parametrize("shard,most,pairs,at_once,top", [(2 << 20, 200_000, 10**6, 1 << 20, 2000), (900, 200_000, 10**6, 50, 25), (900, 0, 10**6, 50, 25), (900, 0, 0, 1 << 20, 25)])
def test_equal_to_plain_counting(spark, monkeypatch, shard, most, pairs, at_once, top):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    monkeypatch.setattr(phrases, "MOST_BROADCAST", most)
    monkeypatch.setattr(phrases, "MOST_PAIRS", pairs)
    monkeypatch.setattr(phrases, "AT_ONCE", at_once)
    monkeypatch.setattr(phrases, "GAP", 65535 if most else 3)
    docs = corpus(1)
    frame = spark.createDataFrame([(t, x, "clash", 1) for t, x in docs], "text string, lang string, word string, shard int").repartition(3)
    got = phrases.collocations(frame, Scratch(spark), least=8, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(docs, 8, top)
    assert sorted(map(tuple, got.collect())) == want
    assert len({len(w[2].split(" ")) for w in want}) == 3


@pytest.mark.parametrize("most", [200_000, 0])
def test_many_pairs_reach_the_driver_as_a_filter(spark, monkeypatch, most):
    """Above MOST_PAIRS the list of pairs is never collected: a filter of bounded size stands for it, also one that lets most pairs through."""
    monkeypatch.setattr(phrases, "MOST_PAIRS", 3)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    monkeypatch.setattr(phrases, "PART_BITS", 16)
    monkeypatch.setattr(phrases, "MOST_BROADCAST", most)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 900)
    sizes = []
    of = phrases._broadcast_pairs
    monkeypatch.setattr(phrases, "_broadcast_pairs", lambda often: sizes.append(of(often)) or sizes[-1])
    docs = corpus(3)
    got = phrases.collocations(spark.createDataFrame(docs, "text string, lang string").repartition(3), Scratch(spark), least=8, top=50)
    assert sorted(map(tuple, got.collect())) == brute(docs, 8, 50)
    assert [len(b.value.packed) for b in sizes] == [8]


def test_only_pairs(spark):
    docs = corpus(2, 100)
    got = phrases.collocations(spark.createDataFrame(docs, "text string, lang string"), Scratch(spark), least=5, longest=2)
    assert sorted(map(tuple, got.collect())) == brute(docs, 5, 2000, longest=2)


def test_score_beyond_64_bits(spark):
    """A score's product is taken in decimals, so that counts near 2^63 don't wrap."""
    from pyspark.sql import functions as F

    a = 2**62
    got = spark.createDataFrame([(a, a, a + 1)], "a long, l long, r long").select(phrases.score_of(F.col("a"), F.col("l"), F.col("r")).alias("s")).first().s
    assert got == 2_000_000 * a // (2 * a + 1)


def test_query_of_nothing_and_of_little(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert phrases.op12_phrases(spark, str(tmp_path)).count() == 0
    docs = [("New York", "en")] * 40 + [("new york!", None)] * 29
    spark.createDataFrame(docs, "text string, lang string").write.parquet(f"{tmp_path}/little/documents.parquet")
    got = [tuple(r) for r in phrases.op12_phrases(spark, f"{tmp_path}/little").collect()]
    assert got == [("en", 1, "new york", 40, 40, 40, 80, 1_000_000)]
