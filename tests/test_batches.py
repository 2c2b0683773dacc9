"""Python functions over parts of Arrow batches: what a worker holds doesn't follow the batch."""

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from spanveil.functions.batches import AT_ONCE, by_parts, parts
from spanveil.functions.folding import PIECE, find_all_folded, fold, fold_batch, fold_text, scrap, scraps
from spanveil.operators import detect as D
from spanveil.operators import propagate as P


def test_parts_are_small_and_whole():
    rng = random.Random(1)
    texts = [None if rng.random() < 0.1 else "ü" * rng.randrange(3000) for _ in range(3000)] + ["x" * (3 * AT_ONCE), ""]
    lists = [None if rng.random() < 0.1 else ["w" * rng.randrange(9) for _ in range(rng.randrange(50))] for _ in texts]
    made = list(parts([pa.array(texts), pa.array(lists)]))
    assert [t for p in made for t in p[0].to_pylist()] == texts and [t for p in made for t in p[1].to_pylist()] == lists
    assert all(len(p[0]) == 1 or sum(c.nbytes for c in p) <= AT_ONCE for p in made) and len(made) > 8
    assert len(list(parts([pa.array([], pa.string())]))) == 1


def test_folding_holds_a_piece_at_a_time():
    rng = random.Random(2)
    alphabet = "aÄß —ﬁﷺ́\ud800é"
    texts = ["".join(rng.choices(alphabet, k=n)) for n in (0, PIECE - 1, 1, 0, PIECE, 3 * PIECE + 7, 0, 5, 0)]
    assert fold_batch(texts) == [fold(t)[0] for t in texts] and fold_batch([]) == [] and fold_batch([""]) == [""]
    texts = ["x" * 2_000] * 2_000
    tracemalloc.start()
    fold_batch(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6  # 4 MB of text; over 150 MB when it was folded as one


def test_a_batch_of_long_rows_comes_in_parts(spark):
    """Repeats, places and folds see parts of a batch, with the results of a row alone."""
    sizes = by_parts(lambda texts: [len(texts)] * len(texts), "int")
    text = "Anna Muster wohnt in Bern. Muster-Haus, Frau Muster, BERN, Bern. "
    df = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(text), (F.col("id") % 40).cast("int")).alias("text"))
    assert max(r.n for r in df.select(sizes("text").alias("n")).collect()) < 2000
    found = D.rule_spans(F.col("text"), {"person": "Anna Muster", "ort": "Bern"})
    for everywhere in (False, True):
        out = P.propagate(df.withColumn("spans", found), everywhere).select("doc_id", "spans").collect()
        of = {}
        for r in out:
            assert of.setdefault(r.doc_id % 40, r.spans) == r.spans
        assert len(out) == 3000 and len(of[39]) > len(of[1]) > len(of[0]) == 0


def test_nulls_and_an_empty_table(spark):
    df = spark.createDataFrame([(None, None), ("Ü", ["Ü", "ab"]), ("", [])], "t string, ts array<string>")
    for rows in (df, df.where("false")):
        got = rows.select(fold_text("t"), scrap("t"), scraps("ts"), find_all_folded("ts", "t")).collect()
        assert [tuple(r) for r in got] == ([(None, None, None, []), ("u", True, [True, False], [[(0, 1)], []]), ("", True, [], [])] if rows is df else [])


def test_a_batch_looks_at_each_word_once(spark):
    lists = [None, [], ["Bern", "a", "und"], ["ab", "und", "a"], None, ["x"]] * 50
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, ts array<string>").coalesce(1).where("i > 2")
    alone = {w: f for w, f in df.select(F.explode_outer("ts").alias("w")).distinct().where("w is not null").select("w", scrap("w")).collect()}
    got = {i: f for i, f in df.select("i", scraps("ts")).collect()}
    assert got == {i: None if t is None else [alone[w] for w in t] for i, t in enumerate(lists) if i > 2} and alone["und"] and not alone["Bern"]
