"""Words read over drawn ones page by page, against the joins of layout.py."""

import random

from pyspark.sql import functions as F

from spanveil.functions import geometry as G
from spanveil.operators import layout, pages
from spanveil.plans.queries import QUERIES


def some(rng, page, most):
    left, top = rng.choice([-200.0, 0.0, 100.0, 128.0, 300.0]), rng.randrange(0, 300, 10) * 1.0
    return (page, left, top, left + rng.randrange(most), top + rng.randrange(most))


def test_without_joins(spark, monkeypatch):
    monkeypatch.setattr(pages, "ROWS", 7)
    monkeypatch.setattr(pages, "AT_ONCE", 3)
    rng = random.Random(8)
    words = [(None, 1, 900, some(rng, 1, 40), True, False), (3, None, 901, some(rng, 1, 40), False, True), (3, 1, 902, None, False, True), (3, 1, 903, some(rng, 1, 40), True, None)]
    for doc in range(10):
        for page in range(1, 4):
            words += [(doc, page, k, some(rng, page, 40), rng.random() < 0.6, rng.random() < 0.4) for k in range(rng.choice([0, 3, 40]))]
    w = spark.createDataFrame(words, f"doc_id long, page_no int, word_idx int, box {G.BOX}, drawn boolean, read boolean")
    old, new = layout.drop_read_over_drawn(w), pages.without_read_over_drawn(w)
    assert sorted(map(repr, old.collect())) == sorted(map(repr, new.collect())) and new.count() > 100
    assert old.schema.simpleString() == new.schema.simpleString()
    assert pages.without_read_over_drawn(w.where("false")).count() == 0


def test_the_query_scans_texts_and_shuffles_words_once(spark):
    plan = QUERIES["ocr_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan and plan.count("RepartitionByExpression") == 1
