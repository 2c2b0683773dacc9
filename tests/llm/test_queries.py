"""Each registered query of the first ten, once, over a small folder of tables: its columns and its rows against brute force."""

import random
import zlib
from collections import Counter

import duckdb
import pytest

from spanveil.llm import queries
from spanveil.llm.tokens import Encoder
from tests.llm.test_operators import brute_components, brute_cut, mixed_texts, rows, words

tokenizers = pytest.importorskip("public_tokenizers")
ITEM = words(random.Random(31), 40, 10**6)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(33)
    texts = [*mixed_texts(32), words(rng, 50, 900) + " " + ITEM.upper() + " " + words(rng, 9, 900)]
    texts += [words(rng, 60, 900) + (f" filth scum{i % 3}" if i % 4 == 0 else "") for i in range(160)]
    made = [(1000 - 3 * i, t, ("en", "de", None)[i % 3], f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(i % 2 == 0), int("filth" in (r[1] or ""))) for i, r in enumerate(made)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, ITEM), (8, words(rng, 30, 10**6))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r[1] for r in made}, made


def run(spark, name, folder, columns):
    got = queries.QUERIES[name](spark, folder)
    assert got.columns[: len(columns.split())] == columns.split()
    return rows(got)


def test_op1(spark, tables):
    folder, texts, _ = tables
    got = run(spark, "op1_suffix_dedup", folder, "doc_id n_bytes n_removed n_spans kept_sha256")
    assert {r["doc_id"]: tuple(r.values())[1:5] for r in got} == dict(zip(texts, brute_cut(list(texts.values())), strict=True)) and len(got) == len(texts)


def test_op2(spark, tables):
    folder, texts, _ = tables
    (hit,) = run(spark, "op2_decontamination", folder, "doc_id item_id")
    assert hit["item_id"] == 7 and ITEM.upper() in texts[hit["doc_id"]] and hit["edits"] == 0


def test_op3(spark, tables):
    folder, texts, _ = tables
    got = run(spark, "op3_ngram_join", folder, "doc_id n_shingles component_id")
    ids = sorted(texts)
    _, top, sets = brute_components(ids, [texts[i] for i in ids], 3, 90)
    least = {}
    for i, t in zip(ids, top, strict=True):
        least.setdefault(t, i)
    want = {i: (len(s), least[t] if s else i) for i, t, s in zip(ids, top, sets, strict=True)}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(ids)


def test_op4(spark, tables):
    folder, texts, _ = tables
    got = run(spark, "op4_toxicity", folder, "doc_id held_out score predicted")
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts} and len(got) == len(texts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == int("filth" in (texts[r["doc_id"]] or "")) for r in out) >= 0.95 * len(out)


def test_op5(spark, tables):
    folder, texts, _ = tables
    library, at, want = Encoder(tokenizers.path("word_bpe_49k.json")).library, 0, []
    for i in sorted(texts):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        at += len(ids)
    got = run(spark, "op5_token_sstable", folder, "doc_id start n_tokens ids_crc32")
    assert sorted(tuple(r.values())[:4] for r in got) == want


def test_op6(spark, tables):
    folder, texts, _ = tables
    got = run(spark, "op6_sharding", folder, "doc_id size text_crc32 law shard slot grown_shard")
    body = {i: (t or "").encode() for i, t in texts.items()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got} == {i: (len(b) + 8, zlib.crc32(b), "rows", None) for i, b in body.items()}
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1 and len(got) == len(texts)
    assert {(r["shard"], r["slot"]) for r in got} == {(s, k) for s, n in counts.items() for k in range(n)}


@pytest.mark.parametrize("name", ["op7_line_rules"])
def test_op7(spark, tables, name):
    folder, _, _ = tables
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = run(spark, name, folder, "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept")
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(want.fetchall())


def test_op8(spark, tables):
    folder, texts, _ = tables
    got = rows(queries.QUERIES["op8_quality"](spark, folder))
    assert sorted(r["doc_id"] for r in got) == sorted(texts)


def test_op9(spark, tables):
    folder, texts, _ = tables
    library = Encoder(tokenizers.path("byte_bpe_50k.json")).library
    n = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    got = run(spark, "op9_token_counts", folder, "doc_id n_bytes n_tokens over_limit")
    assert sorted(map(lambda r: tuple(r.values()), got)) == sorted((i, len((t or "").encode()), n[i], n[i] > 512) for i, t in texts.items())


def test_op10(spark, tables):
    """Rows of the table with their own tokens, each taken once at least."""
    folder, texts, made = tables
    library = Encoder(tokenizers.path("byte_bpe_50k.json")).library
    got = run(spark, "op10_mixing", folder, "doc_id domain lang source n_tokens copies")
    own = {r[0]: r[2:4] for r in made}
    assert got and len({r["doc_id"] for r in got}) == len(got)
    for r in got:
        assert (r["lang"], r["source"]) == own[r["doc_id"]] and r["copies"] >= 1
        assert r["n_tokens"] == max(1, len(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids))  # as one token at least
