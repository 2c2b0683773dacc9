"""The ten operators against brute force, with nulls, empty texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from spanveil.llm import decontamination, line_rules, mixing, ngram_join, quality, sharding, sstable, suffix_dedup, token_counts, toxicity
from spanveil.llm.common import Scratch
from spanveil.llm.tokens import Encoder

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, key string, shard string"


def words(rng, n, top=400):
    return " ".join(f"w{rng.randrange(top)}" for _ in range(n))


def corpus(spark, texts, ids=None):
    """Documents with columns whose names operators use inside."""
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, ("en", "de", None)[k % 3], ("src1", "src2", None, "src13")[k % 4], len(t or ""), k, "r", "k", "s") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def mixed_texts(seed=1):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(30, 220)) for _ in range(14)]
    out = [None, "", " \n\t ", "one", "two words", "x" * 5000, *base, *base[:4], base[0], base[0]]
    for b in base:
        w = b.split()
        for _ in range(2):
            v = list(w)
            for _ in range(rng.randrange(1, 4)):
                v[rng.randrange(len(v))] = f"edit{rng.randrange(10**6)}"
            out.append(" ".join(v).upper() if rng.random() < 0.3 else " ".join(v))
    long = words(rng, 300)
    out += [words(rng, 20, 10**6) + " " + long + " " + words(rng, 30, 10**6) for _ in range(6)]
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- 1 -----------------------------------------------------------------------------------------------------------
def brute_cut(texts, width=400):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + width] for b in bodies for s in range(len(b) - width + 1))
    out = []
    for b in bodies:
        mark = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                mark[s : s + width] = b"\1" * width
        runs = sum(1 for k in range(len(mark)) if mark[k] and not (k and mark[k - 1]))
        out.append((len(b), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("in_bucket,hot", [(20_000, 20_000), (8, 20_000), (8, 2)])
def test_suffix_dedup(spark, monkeypatch, in_bucket, hot):
    monkeypatch.setattr(suffix_dedup, "IN_BUCKET", in_bucket)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = [*mixed_texts(2), "ab" * 900, "é" * 450]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(suffix_dedup.dedup_substrings(corpus(spark, texts), Scratch(spark)))}
    assert got == dict(enumerate(brute_cut(texts)))


def test_suffix_dedup_repeated_rows_null_keys_and_nothing(spark):
    t = words(random.Random(5), 200)
    got = rows(suffix_dedup.dedup_substrings(corpus(spark, [t, t, "short", t[:300]], [7, 7, None, None]), Scratch(spark), with_text=True))
    assert sorted(r["n_removed"] for r in got) == sorted([len(t), len(t), 0, 0])
    assert {bytes(r["kept"]) for r in got} == {b"", b"short", t[:300].encode()}
    assert suffix_dedup.dedup_substrings(corpus(spark, []), Scratch(spark)).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(2)
    for n, top in ((1, 3), (40, 2), (700, 2), (3000, 3), (3000, 10**9), (500, 1)):
        rows_ = rng.integers(0, top, (n, 4)).astype(np.uint64)
        order, first = suffix_dedup.multikey_sort(rows_)
        got = rows_[order]
        assert sorted(order.tolist()) == list(range(n)) and [tuple(r) for r in got.tolist()] == sorted(tuple(r) for r in rows_.tolist())
        assert first.tolist() == [k == 0 or (got[k] != got[k - 1]).any() for k in range(n)]


def test_anchors_follow_content():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 5000).astype(np.uint8)
    moved = np.concatenate((rng.integers(97, 123, 77).astype(np.uint8), text[1000:2000]))
    from spanveil.llm.common import BYTE_CODES, prefix_hash

    def all_(b):
        at, lo, hi = suffix_dedup.anchors(b, prefix_hash(BYTE_CODES[b]))
        assert (at >= hi).all() and (at - lo < suffix_dedup.REACH).all()
        return {s: a - s for a, x, y in zip(at, lo, hi, strict=True) for s in range(x, y + 1)}

    one, two = all_(text), all_(moved)
    assert len(one) == 5000 - 399
    assert all(one[1000 + k] == two[77 + k] for k in range(601))


def test_multikey_sort():
    rng = np.random.default_rng(2)
    w = rng.integers(0, 3, (500, 10)).astype(np.uint64)
    order, first = suffix_dedup.multikey_sort(w)
    want = sorted(map(tuple, w.tolist()))
    assert [tuple(x) for x in w[order].tolist()] == want
    assert first.tolist() == [i == 0 or want[i] != want[i - 1] for i in range(500)]


# --- 2 -----------------------------------------------------------------------------------------------------------
def plain(t):
    return " ".join(re.findall(r"[^\W_]+", (t or "").lower()))


def edits(a, b):
    """Fewest edits from a to any part of b."""
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(prev[j] + (x != y), prev[j + 1] + 1, row[j] + 1))
        prev = row
    return min(prev)


def test_decontamination(spark, monkeypatch):
    rng = random.Random(3)
    items = [words(rng, 12), words(rng, 9, 10**6), "Tiny q", None, "", "ÄPFEL, Birnen & Nüsse sind reif; wir ernten morgen früh."]
    items += ["".join(rng.choice("abcdefgh ") for _ in range(m)).strip().ljust(m, "k") for m in (8, 9, 10, 13, 15, 19, 20, 24, 29, 30, 31, 37, 40)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, start int")
    texts = [None, "", "nothing here at all", f"start {items[0]} end", f"{items[1].upper()}!!", f"a tiny  Q, b tinyq {items[5]}"]
    for _ in range(40):
        t = list(random.Random(rng.random()).choice([items[0], items[1], items[5]]))
        for _ in range(rng.randrange(0, 14)):
            p = rng.randrange(len(t))
            t[p : p + 1] = rng.choice([[], ["z"], [t[p], "q"]])
        texts.append(words(rng, 15) + "\n" + "".join(t) + " " + words(rng, 10))
    for k in range(130):  # short items, with edits about their budget, some at a text's ends
        t = list(items[6 + k % 13])
        for _ in range(len(t) // 10 + rng.randrange(-1, 2)):
            p = rng.randrange(len(t))
            t[p : p + 1] = rng.choice([[], ["z"], [t[p], "q"]])
        texts.append(rng.choice(["", words(rng, 5) + " "]) + "".join(t) + rng.choice(["", " " + words(rng, 4)]))
    texts.append(words(rng, 20_000) + items[0] + words(rng, 20_000))
    docs = corpus(spark, texts)
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontamination.contaminated_regions(docs, bench))}
    budget = {i: len(plain(t)) // 10 for i, t in enumerate(items) if t and len(plain(t)) >= 8}
    want = {(d, i) for d, t in enumerate(texts) for i in budget if (len(t or "") > 10_000 and i == 0) or (len(t or "") < 10_000 and edits(plain(items[i]), plain(t)) <= budget[i])}
    want |= {(d, 2) for d, t in enumerate(texts) if f" {plain(items[2])} " in f" {plain(t)} "}
    assert got == want
    for r in rows(decontamination.contaminated_regions(docs, bench)):
        part = plain(f"x{texts[r['doc_id']][r['start'] : r['end']]}x")[1:-1]  # with spaces at its ends
        assert edits(plain(items[r["item_id"]]), part) == r["edits"]
    kept = decontamination.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    monkeypatch.setattr(decontamination, "MOST_ITEM_CHARS", 150)  # the benchmark in blocks
    assert {(r["doc_id"], r["item_id"]) for r in rows(decontamination.contaminated_regions(docs, bench))} == want
    assert {r.doc_id for r in decontamination.remove_contaminated(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontamination.contaminated_regions(docs, bench.limit(0)).count() == 0
    assert decontamination.remove_contaminated(docs.limit(0), bench).count() == 0


def test_overlapping_regions_keep_the_fewest_edits(spark):
    rng = random.Random(3)
    item = "".join(rng.choice("abcdefghijklmno") for _ in range(75))
    known = decontamination.Benchmark([(1, item)])
    text = item[:-6] + item
    assert [(a, b, e) for _, _, a, b, e in known.find([text]) if e == 0] == [(len(item) - 6, len(text), 0)]
    assert decontamination.apart([(1, 5, 9, 0), (1, 0, 5, 1), (1, 8, 12, 1), (2, 0, 3, 4)]) == [(1, 0, 5, 1), (1, 5, 9, 0), (2, 0, 3, 4)]


def test_items_that_share_an_opening(monkeypatch):
    """Hits in many small runs give what one run gives."""
    rng = random.Random(4)
    opening = "what of the following is the answer "
    items = [(i, opening + words(rng, 14)) for i in range(60)]
    text = " ".join(opening for _ in range(40)) + items[7][1] + " and " + items[9][1][:-1]
    texts = [text, words(rng, 50), items[3][1]]
    whole = decontamination.Benchmark(items).find(texts)
    monkeypatch.setattr(decontamination, "HITS", 97)
    assert sorted(decontamination.Benchmark(items).find(texts)) == sorted(whole)
    assert {(t, i) for t, i, *_ in whole} >= {(0, 7), (0, 9), (2, 3)}


# --- 3 -----------------------------------------------------------------------------------------------------------
def shingles(t, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_components(ids, texts, n, num):
    sets = [shingles(t, n) for t in texts]
    up = list(range(len(ids)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            up[top(i)] = top(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return [(k, len(sets[i]), least.get(top(i))) for i, k in enumerate(ids)], [top(i) for i in range(len(ids))], sets


@pytest.mark.parametrize("n,num,routes,block,pairs", [(3, 90, 4, 20_000, 4), (5, 80, 0, 20_000, 4), (5, 80, 0, 20_000, 0), (3, 90, 1, 3, 4)])
def test_ngram_components(spark, monkeypatch, n, num, routes, block, pairs):
    """With fewer routes the exact second pass has to find the links, without listed pairs in whole buckets; with small buckets, pairs of blocks."""
    monkeypatch.setattr(ngram_join, "PAIRS", pairs)
    monkeypatch.setattr(ngram_join, "ROUTES", routes)
    monkeypatch.setattr(ngram_join, "MOST_IN_BUCKET", block)
    texts = mixed_texts(7)
    ids = [5, 5, None, *range(100, 97 + len(texts))]
    order = lambda x: tuple((v is None, v or 0) for v in x)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(ngram_join.ngram_components(corpus(spark, texts, ids), Scratch(spark), n, num))), key=order)
    assert got == sorted(brute_components(ids, texts, n, num)[0], key=order)


def test_keep_one_of_each(spark):
    texts = mixed_texts(8)
    docs = corpus(spark, texts)
    kept = ngram_join.keep_one(docs, Scratch(spark))
    _, top, sets = brute_components(list(range(len(texts))), texts, 5, 80)
    first = {}
    for i in range(len(texts)):
        first.setdefault(top[i] if sets[i] else ("empty", i), i)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    assert ngram_join.keep_one(docs.limit(0), Scratch(spark)).count() == 0


def test_trie_links_match_brute_force():
    rng = random.Random(11)
    for _ in range(40):
        sets = []
        for _ in range(rng.randint(1, 4)):
            base = set(rng.sample(range(400), rng.randint(1, 120)))
            for _ in range(rng.randint(1, 12)):
                s = set(base)
                for x in rng.sample(sorted(base), min(len(base), rng.randint(0, 12))):
                    s.discard(x)
                    s.add(rng.getrandbits(60) if rng.random() < 0.7 else rng.randrange(400))
                sets.append(s)
        num = rng.choice([80, 90])
        pairs = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])}
        got = ngram_join.link([np.array(sorted(s), dtype=np.uint64) for s in sets], np.arange(len(sets)), num)
        assert {(min(p), max(p)) for p in got} <= pairs

        def joined(edges, n=len(sets)):
            up = list(range(n))

            def top(i):
                while up[i] != i:
                    i = up[i]
                return i

            for a, b in edges:
                up[top(a)] = top(b)
            first = {}
            return [first.setdefault(top(i), i) for i in range(n)]

        assert joined(got) == joined(pairs)


# --- 4 -----------------------------------------------------------------------------------------------------------
def test_nearest_is_exact():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex.of(vectors, 60, 16)
    dense = np.zeros((500, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 500, 7):
        docs, cos = index.nearest(*vectors[i], 10, i)
        want = dense @ dense[i]
        want[i] = -1
        best = [k for k in np.lexsort((np.arange(500), -want)) if want[k] > 0][:10]
        assert np.allclose(cos, want[best], atol=3e-6) and np.allclose(want[docs], want[best], atol=3e-6)


def test_toxicity(spark):
    rng = random.Random(9)
    texts = [words(rng, 40, 3000) + (f" {rng.choice(['scum', 'vermin', 'filth'])}{rng.choice(['', 'ish'])}" if i % 4 == 0 else "") for i in range(600)]
    docs = corpus(spark, [*texts, None, "", "  "])
    labels = spark.createDataFrame([*[(i, int(i % 4 == 0)) for i in range(600)], (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, Scratch(spark), ~toxicity.held_out(), by_label=True)
    got = {r["doc_id"]: r for r in rows(toxicity.score(docs, model))}
    out = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[600]["score"] == got[601]["score"] == got[602]["score"] < 0.5
    kept = toxicity.remove_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert toxicity.fit(docs, labels.limit(0), Scratch(spark)) is None
    assert {r["score"] for r in rows(toxicity.score(docs, None))} == {0.0}


def test_curve_is_the_best_rising_one():
    rng = random.Random(23)
    for _ in range(30):
        x = [rng.randrange(12) / 10 for _ in range(40)]
        y = [float(rng.random() < v) for v in x]
        values = sorted(set(x))
        of = [[b for a, b in zip(x, y, strict=True) if a == v] for v in values]
        fit = [max(min(np.mean(sum(of[i : j + 1], [])) for j in range(k, len(values))) for i in range(k + 1)) for k in range(len(values))]  # the max-min formula
        pools = {}
        for v, f, group in zip(values, fit, of, strict=True):
            pools.setdefault(round(f, 9), []).append((v, len(group)))
        at, got = toxicity.monotone(np.array(x), np.array(y))
        want = [((p[0][0] + p[-1][0]) / 2, (f * n + 0.25) / (n + 0.5)) for f, p in pools.items() for n in [sum(c for _, c in p)]]
        assert np.allclose(at, [w[0] for w in want]) and np.allclose(got, [w[1] for w in want])


@pytest.mark.parametrize("by_label", [False, True])
def test_scores_match_brute_force(spark, by_label):
    """From raw texts to neighbours and scores; repeats, a label given twice, null texts, and words that no example has."""
    rng = random.Random(19)
    texts = [words(rng, rng.randrange(1, 25), 60) + (" Scum" if i % 9 == 0 and i % 4 else "") for i in range(150)]
    out = [i for i in range(150) if zlib.crc32(str(i).encode()) % 5 == 0]
    texts[out[0]] = texts[next(i for i in range(150) if i not in out)]
    texts += [None, "", "nowhere seen", "w1 " * 3000]
    docs = corpus(spark, texts)
    labels = spark.createDataFrame([*[(i, int(i % 9 == 0)) for i in range(150)], (0, 0), (2, 0), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, Scratch(spark), ~toxicity.held_out(), by_label=by_label)
    got = {r["doc_id"]: r for r in rows(toxicity.score(docs, model))}
    learned = [i for i in range(150) if i not in out]
    y = {i: int(i % 9 == 0) for i in learned}
    split = [Counter((t or "").lower().split()) for t in texts]
    df = Counter(w for c in split for w in c)
    n1, n0 = sum(y.values()), len(y) - sum(y.values())

    def chi(w):
        a, b = sum(w in split[i] and y[i] for i in learned), sum(w in split[i] and not y[i] for i in learned)
        table = [[a, n1 - a], [b, n0 - b]]
        total, score = n1 + n0, 0.0
        for r in (0, 1):
            for c in (0, 1):
                want = sum(table[r]) * (table[0][c] + table[1][c]) / total
                score += (table[r][c] - want) ** 2 / want if want else 0
        return score

    weight = {w: np.log(len(texts) / df[w]) * (max(1, chi(w) / 10.83) if by_label else 1) for w in {w for i in learned for w in split[i]}}
    vector = [{w: (1 + np.log(n)) * weight[w] for w, n in c.items() if w in weight} for c in split]
    norm = [np.sqrt(sum(x * x for x in v.values())) for v in vector]

    def nearest(i):
        cos = {j: sum(x * vector[j].get(w, 0) for w, x in vector[i].items()) / (norm[i] * norm[j] or 1) for j in learned if j != i}
        return sorted(((c, j) for j, c in cos.items() if c > 5e-7), reverse=True)[: toxicity.K]

    def vote(near):
        return sum(c * c * y[j] for c, j in near) / sum(c * c for c, _ in near)

    curve = toxicity.monotone(np.array([vote(nearest(i)) for i in learned]), np.array([y[i] for i in learned], dtype=float))
    for i in [*out, 150, 151, 152, 153]:
        want = nearest(i)
        assert np.allclose([n["cosine"] for n in got[i]["neighbours"]], [c for c, _ in want], atol=5e-6)
        assert {n["id"] for n in got[i]["neighbours"]} >= {j for c, j in want if c > want[-1][0] + 1e-5}
        if want:
            mine = vote([(n["cosine"], n["id"]) for n in got[i]["neighbours"]])
            assert abs(got[i]["score"] - np.clip(np.interp(mine, *curve), 0, 1)) < 2e-3
        else:
            assert got[i]["score"] == got[150]["score"] < 0.5
    assert got[out[0]]["neighbours"][0]["cosine"] == 1.0
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.remove_toxic(docs.limit(0), model).count() == 0


# --- 5, 9 --------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    rng = random.Random(6)
    letters = "ab'stmdrevlLS  \n\t\r é²½_1 23.,!\"…’\xa0\x1c\x85İΣ中😀<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(3000)]
    texts += ["", " ", "\n", "'s", " 's", "a's b'll", "x <|endoftext|> y", "don't'll've"]
    e = Encoder(tokenizers.path(name))
    assert e.fast
    want = e.whole(texts)
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        assert e.count(part).tolist() == [len(w) for w in want[k : k + 500]]
        assert all(np.array_equal(a, b) for a, b in zip(e.encode(part), want[k : k + 500], strict=True))


@pytest.mark.parametrize("most", [200_000, 25, 0])
def test_token_counts_and_their_cache(spark, monkeypatch, most):
    """By each way of finding what the cache lacks: known and shared digests sent out, missing ones, neither."""
    monkeypatch.setattr(token_counts, "MOST_BROADCAST", most)
    path = Scratch(spark).path("cache")
    tok = tokenizers.path("byte_bpe_50k.json")
    texts = mixed_texts(10) + ["very long " * 60_000]
    first = token_counts.count_tokens(corpus(spark, texts[:40]), path, tok, Scratch(spark))
    assert first.count() == 40
    known = spark.read.parquet(path)
    before = {bytes(r.content) for r in known.collect()}
    got = {r["doc_id"]: r for r in rows(token_counts.count_tokens(corpus(spark, texts), path, tok, Scratch(spark)))}
    library = Encoder(tok).library
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {i: r["n_bytes"] for i, r in got.items()} == {i: len((t or "").encode()) for i, t in enumerate(texts)}
    after = [bytes(r.content) for r in spark.read.parquet(path).collect()]  # each digest once: none is encoded again
    assert len(after) == len(set(after)) == len({t or "" for t in texts}) > len(before) and before < set(after)
    assert token_counts.count_tokens(corpus(spark, []), path, tok, Scratch(spark)).count() == 0
    assert token_counts.count_tokens(corpus(spark, texts[:3]), path, tok, Scratch(spark)).count() == 3
    assert spark.read.parquet(path).count() == len(after)


def test_shards_round_trip(spark, monkeypatch):
    tok = tokenizers.path("word_bpe_49k.json")
    texts = mixed_texts(12)
    ids = [None, -5, 3, 3, *range(10, 6 + len(texts))]
    folder = Scratch(spark).path("shards")
    files = sstable.write_shards(corpus(spark, texts, ids), folder, tok, 2, 3)
    got = sorted(rows(sstable.read_shards(files)), key=lambda r: r["start"])
    library = Encoder(tok).library
    want = {}
    for i, t in zip(ids, texts, strict=True):
        want.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    assert [r["doc_id"] for r in got] == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        assert r["ids_crc32"] in {zlib.crc32(np.array(w, "<u4").tobytes()) for w in want[r["doc_id"]] if len(w) == r["n_tokens"]}
    from pyarrow import fs

    found = {i: [] for i in want}
    for path in [r.path for r in files.collect()]:
        store, name = fs.FileSystem.from_uri(path)
        shard = sstable.Shard(store.open_input_file(name))
        assert shard.lookup(999_999) == []
        for i in want:
            found[i] += [x.tolist() for x in shard.lookup(i)]
    assert {i: sorted(v) for i, v in found.items()} == {i: sorted(v) for i, v in want.items()}
    assert rows(sstable.read_shards(sstable.write_shards(corpus(spark, []), folder + "-none", tok, 2, 2))) == []


# --- 6 -----------------------------------------------------------------------------------------------------------
def test_sharding(spark):
    texts = mixed_texts(13)
    docs = corpus(spark, texts * 3, [None, 1, 1, 1, *range(4, 3 * len(texts))])
    got = rows(sharding.assign_shards(docs, shards=7))
    n = Counter(r["shard"] for r in got)
    assert len(got) == 3 * len(texts) and set(n) == set(range(7)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n[s]))
    again = {r["doc_id"]: r["shard"] for r in rows(sharding.assign_shards(docs.repartition(3), shards=7)) if (r["doc_id"] or 0) > 3}
    assert again == {r["doc_id"]: r["shard"] for r in got if (r["doc_id"] or 0) > 3}
    assert sharding.assign_shards(docs.limit(0), shards=7).count() == 0


def test_sharding_moves_little(spark):
    docs = spark.range(6000).withColumnRenamed("id", "doc_id")
    one, two = ({r["doc_id"]: r["shard"] for r in rows(sharding.assign_shards(docs, tie=None, shards=k))} for k in (12, 13))
    assert sum(one[i] != two[i] for i in one) < 0.5 * len(one)  # dealt anew, 12 of 13 would move


def test_shards_are_those_of_a_walk_round_the_ring(spark):
    """Each key in its turn, from its own place clockwise to the first shard with room."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i % 450 if i % 60 else None, f"t{i % 7}") for i in range(500)], "doc_id long, text string")
    got = rows(sharding.assign_shards(docs, shards=5, virtual_nodes=8, epochs=3))
    points = sharding.ring(5, 8)
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    keyed = docs.withColumn("h", h).withColumn("tie", F.xxhash64(F.lit(7), "h", "text")).withColumn("epoch", F.pmod(F.xxhash64(F.lit(11), "h"), F.lit(3)))
    turns = []
    for r in rows(keyed):
        arc = next((k for k, (p, _) in enumerate(points) if p >= r["h"]), 0)
        turns.append((r["epoch"], arc, r["tie"] % 8, r["tie"], r["doc_id"] or -1, r["text"], r["doc_id"]))
    filled, want = Counter(), []
    for _, arc, *_, text, key in sorted(turns, key=lambda t: t[:6]):
        k = arc
        while filled[points[k % len(points)][1]] >= 100:
            k += 1
        shard = points[k % len(points)][1]
        want.append((key, text, shard, filled[shard]))
        filled[shard] += 1
    assert Counter(want) == Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in got)


def test_placing_is_the_ring_walk():
    owners = [0, 1, 2, 0, 1, 2]
    counts = {(0, 0): 10, (0, 3): 1, (1, 2): 4}
    pieces = sharding.place(counts, owners, 3)
    full = Counter()
    for _, _, lo, hi, s, slot in pieces:
        assert slot == full[s]
        full[s] += hi - lo
    assert full == {0: 5, 1: 5, 2: 5}
    assert pieces[0] == (0, 0, 0, 5, 0, 0) and pieces[1] == (0, 0, 5, 10, 1, 0)


# --- 7, 8 --------------------------------------------------------------------------------------------------------
def test_line_rules(spark):
    rng = random.Random(14)
    texts = []
    for i in range(80):
        own = [words(rng, 15, 10**6) for _ in range(4)]
        texts.append("\n".join(["Shared  Line of the host" if i < 60 else "other", *own, own[0], "# * $"]))
    texts += [None, "", "a b c " * 40, "\n".join(["shared line OF the host"] * 30)]
    docs = corpus(spark, texts).withColumn("source", pd_source(spark))
    got = {r["doc_id"]: r for r in rows(line_rules.line_verdicts(docs, Scratch(spark), limit=50))}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(wins)
        covered = {k + j for k, x in enumerate(wins) if n[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert got[0]["removed_words"] == 5 + 3 and got[83]["base_failed"] and not got[83]["kept"] and got[0]["kept"]
    clean = {r["doc_id"]: r["text"] for r in rows(line_rules.clean_lines(docs, Scratch(spark), limit=50))}
    assert set(clean) == {i for i, r in got.items() if r["kept"]} and "Shared" not in clean[0] and "other" in clean[70]
    assert line_rules.line_verdicts(docs.limit(0), Scratch(spark)).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_line_limits_are_of_distinct_documents_of_a_host(spark, monkeypatch, broadcast):
    """One document under two hosts, a document in many rows, nulls, and a line at the limit exactly."""
    if not broadcast:
        monkeypatch.setattr(line_rules, "MOST_BROADCAST", 0)
    rng = random.Random(31)
    body = "\n".join(words(rng, 30, 10**6) for _ in range(3))
    made = [(i, f"at the limit\n{body} {i}", "a") for i in range(4)] + [(i, f"over it now\n{body} {i}", "a") for i in range(10, 15)]
    made += [(50, f"over it now\n{body}", "a"), (50, f"over it now\n{body}", "b"), (50, f"over it now\n{body}", "b")]
    made += [(60, f"many rows\n{body} {k}", "a") for k in range(9)]
    made += [(None, f"without a key\n{body} {k}", None) for k in range(5)] + [(70, None, "a"), (71, "over it now", None), (72, "over it now " + "\n" + "x " * 100_000, "a")]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string").withColumn("row", pd_source(spark))
    holders = {}
    for k, (i, t, host) in enumerate(made):
        for line in {" ".join(x.split()).lower() for x in (t or "").split("\n") if x.split()}:
            holders.setdefault((host, line), set()).add((i, t) if i is None else i)
    want = Counter()
    for i, t, host in made:
        gone = sum(len(x.split()) for x in (t or "").split("\n") if x.split() and len(holders[host, " ".join(x.split()).lower()]) > 4)
        want[i, host, len((t or "").split()), gone] += 1
    got = Counter((r["key_"], r["host"], r["n_words"], r["removed_words"]) for r in rows(line_rules.line_verdicts(docs, Scratch(spark), limit=4).withColumnRenamed("doc_id", "key_")))
    assert got == Counter({(i, "\x00" if h is None else h, n, g): c for (i, h, n, g), c in want.items()})
    assert {h: g > 0 for i, h, _, g in got if i == 50} == {"a": True, "b": False}


def pd_source(spark):
    from pyspark.sql import functions as F

    return F.lit("host")


def test_quality(spark):
    rng = random.Random(15)
    texts = [words(rng, 60, 900) if i % 3 else " ".join(w + "###" for w in words(rng, 60, 900).split()) for i in range(300)]
    docs = corpus(spark, [*texts, None, ""])
    labels = spark.createDataFrame([*[(i, int(i % 3 > 0)) for i in range(0, 300, 2)], (1, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in rows(quality.score_quality(docs, labels, Scratch(spark)))}
    assert len(got) == 302 and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[i]["predicted"] == (i % 3 > 0) for i in range(1, 300, 2)]) > 0.95
    assert {r["score"] for r in rows(quality.score_quality(docs, labels.limit(0), Scratch(spark)))} == {0.5}


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    none = corpus(spark, [])
    assert rows(quality.score_quality(none, labels, Scratch(spark))) == []
    got = rows(quality.score_quality(corpus(spark, ["a b", None, "", "x " * 200_000, "a b"], [1, None, 2, 3, 1]).drop("n_chars"), labels, Scratch(spark)))
    assert len(got) == 5 and len({r["score"] for r in got if r["doc_id"] == 1}) <= 2


def features_table(spark, x, y, fold):
    return spark.createDataFrame([(a.astype(np.float32).tobytes(), int(b), int(c)) for a, b, c in zip(x, y, fold, strict=True)], "x binary, y int, fold int").repartition(3)


def minimised(d, t, w, ridge):
    """A plain minimum of the penalised loss, by gradient descent with a step from the curvature's bound."""
    beta = np.zeros(d.shape[1])
    rate = 1 / (0.25 * np.linalg.eigvalsh((d * w[:, None]).T @ d)[-1] + ridge)
    for _ in range(60_000):
        slope = d.T @ (w * (t - 1 / (1 + np.exp(-(d @ beta))))) - ridge * beta
        beta = beta + rate * slope
        if np.abs(slope).max() < 1e-9:
            break
    return beta


def test_newton_finds_the_minimum(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1, -2, 0.5, 0, 0, 1])))).astype(int)
    w = np.where(rng.random(300) < 0.3, 0.2, 1.0)
    table = features_table(spark, np.hstack((x, w[:, None])), y, np.zeros(300))

    def two(x, y, fold):
        return [(x[:, :6], y.astype(float), x[:, 6]), (x[:, :3], 1.0 - y, np.ones(len(x)))]

    one, other = quality._newton(table, [np.zeros(6), np.zeros(3)], two, 30)
    x = x.astype(np.float32).astype(float)
    assert np.allclose(one, minimised(x, y, w.astype(np.float32).astype(float), quality.RIDGE), atol=2e-3)
    assert np.allclose(other, minimised(x[:, :3], 1 - y, np.ones(300), quality.RIDGE), atol=2e-3)


def test_cotraining_matches_a_plain_table(spark, monkeypatch):
    """Rounds on one table in memory: every row's pseudo-label by the other view of the round before."""
    monkeypatch.setattr(quality, "STEPS", 40)
    rng = np.random.default_rng(12)
    n, k = 400, quality.TEXT + quality.META
    truth = rng.random(n) < 0.6
    x = rng.normal(size=(n, k)) * 0.5
    x[:, :4] += truth[:, None] * 1.2
    x[:, quality.TEXT : quality.TEXT + 4] += truth[:, None] * 1.2
    x = x.astype(np.float32)
    fold = rng.integers(0, 5, n)
    y = np.where((rng.random(n) < 0.5) & (fold > 0), truth, -1)
    got = quality.cotrain(features_table(spark, x, y, fold), 1)
    x = x.astype(float)
    z = np.clip((x - x.mean(0)) / x.std(0), -4, 4)
    one = np.ones((n, 1))
    views = [np.hstack((z[:, : quality.TEXT], z[:, : quality.TEXT] ** 2 - 1, one)), np.hstack((z[:, quality.TEXT :], one))]
    learn = (y >= 0) & (fold > 1)
    beta = [minimised(d, np.where(learn, y, 0.0), learn.astype(float), quality.RIDGE) for d in views]
    prior = np.log(((y == 1) & learn).sum() + 1) - np.log(((y == 0) & learn).sum() + 1)
    strong = np.log(0.95 / 0.05)
    taught = []
    for view in (0, 1):
        t, w = np.where(learn, y, 0.0), learn.astype(float)
        odds = views[1 - view] @ beta[1 - view]
        for i in range(n):
            if not learn[i] and (odds[i] > max(0, prior) + strong or odds[i] < min(0, prior) - strong):
                t[i], w[i] = float(odds[i] > 0), 0.2
        assert (w == 0.2).sum() > 5
        taught.append(minimised(views[view], t, w, quality.RIDGE))
    assert np.allclose(got.text, taught[0], atol=5e-3) and np.allclose(got.meta, taught[1], atol=5e-3)
    held = (y >= 0) & (fold == 1)
    odds = np.clip(np.stack((views[0] @ got.text, views[1] @ got.meta, np.ones(n)), axis=1), -12, 12)
    start = np.array([1.0, 1.0, 0.0])
    assert np.abs(odds.T @ (held * (np.where(held, y, 0) - 1 / (1 + np.exp(-(odds @ got.stack))))) - 0.1 * got.stack).max() < 0.05 and not np.allclose(got.stack, start)


# --- 10 ----------------------------------------------------------------------------------------------------------
def brute_budgets(totals, budget, weight, epochs):
    """Budgets of a tree's leaves {path: tokens}: at each node the level x is searched at which min(most, x * weight) adds up."""
    out = {}

    def down(at, leaves, amount):
        if len(at) == len(next(iter(leaves))):
            out[at] = amount
            return
        kids = {}
        for path, n in leaves.items():
            kids.setdefault(path[: len(at) + 1], {})[path] = n
        most = {k: epochs * sum(v.values()) for k, v in kids.items()}
        low, high = 0.0, 2 * sum(most.values()) / min(weight(k) for k in kids) + 1
        for _ in range(200):
            x = (low + high) / 2
            low, high = (x, high) if sum(min(most[k], x * weight(k)) for k in kids) < amount else (low, x)
        for k, v in kids.items():
            down(k, v, min(most[k], high * weight(k)))

    down((), totals, min(budget, epochs * sum(totals.values())))
    return out


def test_budgets_match_brute_force(spark):
    """Three levels of weights, shortages that stay among siblings or go up, nulls in a level."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    names = ["_l0", "_l1", "_l2"]
    for case in range(4):
        totals = {(rng.choice("ab"), rng.choice(["x", "y", None]), f"s{rng.randrange(5)}"): rng.choice([1, 7, 50, 4000]) for _ in range(14)}
        weights = {("a",): 3.0, ("x",): 0.5, ("s1",): 4.0, ("b", None): 2.5, ("a", "x", "s2"): 9.0}
        leaves = spark.createDataFrame([(*k, n) for k, n in totals.items()], "_l0 string, _l1 string, _l2 string, n long").withColumn("_leaf", mixing.path_key(names))
        budget = (0.1, 0.5, 0.9, 1.7)[case] * sum(totals.values())
        got = {(r["_l0"], r["_l1"], r["_l2"]): r["_budget"] for r in rows(mixing.leaf_budgets(leaves, names, budget, weights, 2))}
        want = brute_budgets(totals, budget, lambda p: weights.get(p, weights.get(p[-1:], 1.0)), 2)
        assert set(got) == set(want) and all(abs(got[p] - want[p]) <= 1 for p in want)


@pytest.mark.parametrize("broadcast", [True, False])
def test_mixing(spark, monkeypatch, broadcast):
    """Every leaf takes whole epochs and a prefix of its order as long as the budget allows."""
    from pyspark.sql import functions as F

    if not broadcast:
        monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    made = [(i % 390 if i % 50 else None, f"src{i % 7}" if i % 11 else None, ("en", "en", "de", None)[i % 4], (1 + i % 9) if i % 13 else None) for i in range(420)]
    made += [(5000, "src1", "en", 100_000)]
    docs = spark.createDataFrame(made, "doc_id long, source string, lang string, n long")
    levels = {"domain": mixing.domain_of_source(), "lang": F.col("lang"), "source": F.col("source")}
    weights = {("en",): 5.0, ("d1",): 2.0, ("src3",): 3.0}
    got = rows(mixing.mix(docs, F.col("n"), levels, Scratch(spark), weights, 0.7, 2))
    leaf = lambda r: (mixing_leaf(r[1]), r[2], r[1])
    totals = Counter()
    for r in made:
        totals[leaf(r)] += r[3] or 1
    want = brute_budgets(dict(totals), 0.7 * sum(totals.values()), lambda p: weights.get(p, weights.get(p[-1:], 1.0)), 2)
    have = {}
    for r in got:
        have.setdefault((r["_l0"], r["_l1"], r["_l2"]), Counter())[r["doc_id"], r["_tokens"]] += r["_copies"]
    for p, budget in want.items():
        mine = [(r[0], r[3] or 1) for r in made if leaf(r) == p]
        epochs, rest = divmod(int(budget + 1e-5), totals[p])
        keys = spark.createDataFrame([(str(json_path(p)), i) for i in {m[0] for m in mine}], "leaf string, doc_id long")
        order = {r.doc_id: r.h for r in keys.select("doc_id", F.xxhash64(F.lit(mixing.SEED), F.lit(epochs).cast("long"), "leaf", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("h")).collect()}
        expected = Counter({m: c * epochs for m, c in Counter(mine).items()})
        for m in sorted(mine, key=lambda m: (order[m[0]], m[1])):
            rest -= m[1]
            if rest < 0:
                break
            expected[m] += 1
        assert have.get(p, Counter()) == Counter({m: c for m, c in expected.items() if c})
    assert mixing.mix(docs.limit(0), F.col("n"), levels, Scratch(spark)).count() == 0


def json_path(p):
    import json

    return json.dumps({f"_l{i}": x for i, x in enumerate(p)}, separators=(",", ":"))


def mixing_leaf(source):
    m = re.search(r"(\d{1,9})$", source or "")
    return f"d{(int(m[1]) if m else 0) % 4}"


# --- pipeline ----------------------------------------------------------------------------------------------------
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = mixed_texts(16)
    bench = words(random.Random(99), 14, 10**6)
    texts += [words(random.Random(i), 60, 5000) + f" filth{i % 3} " for i in range(40)] + [words(random.Random(77), 30, 5000) + " " + bench]
    corpus(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    n = len(texts)
    spark.createDataFrame(pd.DataFrame({"doc_id": range(n), "quality": 1, "toxic": [int("filth" in (t or "")) for t in texts]})).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = rows(corpus_pipeline.run(spark, str(tmp_path)))
    ids = [r["doc_id"] for r in out]
    assert len(set(ids)) == len(ids) and n - 1 not in ids and not [i for i in ids if "filth" in (texts[i] or "")]
    _, top, sets = brute_components(list(range(n)), texts, 5, 80)
    assert len({top[i] for i in ids if sets[i]}) == len([i for i in ids if sets[i]])
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - (min(sizes.values()) if len(sizes) == 24 else 0) <= 1


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null and repeated keys, repeated rows, null and empty texts, columns that operators use inside; then no documents at all."""
    import corpus_pipeline

    texts = mixed_texts(18)[:14]
    made = [(None if i % 5 == 0 else i % 4, t, None if i % 3 else "en", None if i % 4 else "src1") for i, t in enumerate([*texts, *texts[:9]])]
    for name, some in (("odd", made), ("empty", [])):
        folder = str(tmp_path / name)
        docs = spark.createDataFrame([(*r, 1, "r", "k", 2, "s") for r in some], "doc_id long, text string, lang string, source string, n_chars long, row string, key string, size int, shard string")
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(None, "x"), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        kept = docs
        for stage, f in corpus_pipeline.STAGES[:-1]:
            kept = Scratch(spark).save(f(spark, kept, folder), stage)
            assert kept.columns == docs.columns
        out = rows(corpus_pipeline.run(spark, folder))
        assert {"shard", "slot"} <= set(out[0]) if some else out == []
        _, top, sets = brute_components(list(range(len(some))), [r[1] for r in some], 5, 80)
        groups = len({top[i] if sets[i] else ("none", i) for i in range(len(some))})
        assert 0.5 * groups <= len(out) <= groups
