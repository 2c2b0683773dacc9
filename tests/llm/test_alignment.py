"""Alignment of two tokenizers against plain loops over the libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from spanveil.llm import alignment
from spanveil.llm.common import Scratch

tokenizers = pytest.importorskip("public_tokenizers")
BYTES, PIECES = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    one.encode_special_tokens = True
    signs = alignment.byte_level()
    docs = []
    for t in texts:
        groups = []
        if t:
            a = [(i, bytes(signs[c] for c in one.id_to_token(i))) for i in one.encode(" " + t, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i in two.encode(t) for p in [two.id_to_piece(i)]]
            if b"".join(x for _, x in a) == (" " + t).encode() == b"".join(x for _, x in b):
                ends = []
                for side in (a, b):
                    n, e = 0, []
                    for _, x in side:
                        n += len(x)
                        e.append(n)
                    ends.append(e)
                i = j = 0
                for stop in sorted(set(ends[0]) & set(ends[1])):
                    k, m = ends[0].index(stop) + 1, ends[1].index(stop) + 1
                    groups.append(([x for x, _ in a[i:k]], [x for x, _ in b[j:m]]))
                    i, j = k, m
        docs.append(groups)
    count = Counter(p for g in docs for p in {(x, y) for a, b in g for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for g in docs:
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


def texts():
    rng = random.Random(8)
    parts = [" ", "  ", "a", "the", "ing", "é", "梦", "\U0001f600", "\n", "\t", "1", "23", ".", "<|endoftext|>", "<s>", "<0x41>", "\x00", "ü", "́", "執行", "при", "'s", "Thlyouble", "ststonti"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(250)]
    return [None, "", " ", "▁", "a▁b", "the same", "the same", "x" * 3000, " " * 700, "word " * 3000, "ab" * 900 + " " * 50, *some, *some[:20]]


@pytest.mark.parametrize("most,run", [(2_000_000, 1 << 20), (0, 300)])
def test_equal_to_plain_loops(spark, monkeypatch, most, run):
    monkeypatch.setattr(alignment, "MOST_PAIRS", most)
    monkeypatch.setattr(alignment, "RUN_BYTES", run)
    t = texts()
    docs = spark.createDataFrame([(k, x, "clash", 5, True) for k, x in enumerate(t)], "doc_id long, text string, pairs string, n_a int, _partial boolean").repartition(3)
    got, pairs = alignment.align_tokens(docs, Scratch(spark), BYTES, PIECES)
    assert got.columns == ["doc_id", *alignment.COUNTS, "groups_sha256", "n_best", "count_sum"]
    rows = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()}
    want = brute(t)
    assert rows == dict(enumerate(want))
    assert pairs.count() > 100


def test_query_repeated_rows_null_keys_and_nothing(spark, tmp_path):
    t = ["the same words", "the same words", None, "x"]
    spark.createDataFrame(list(zip([7, 7, None, None], t, strict=True)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = alignment.op11_token_alignment(spark, str(tmp_path))
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(brute(t))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert alignment.op11_token_alignment(spark, f"{tmp_path}/none").count() == 0
