"""Text units and mentions' boxes made in a document's row, against the joins and groups of layout.py."""

import random

import pytest
from pyspark.sql import functions as F

from spanveil import api
from spanveil.functions import geometry as G
from spanveil.operators import layout, marks, pages
from spanveil.operators.detect import CallableDetector, RuleDetector, explode_spans
from spanveil.operators.redact import redact
from spanveil.plans import queries as Q

WORD = f"doc_id long, page_no int, word_idx int, text string, box {G.BOX}, drawn boolean, read boolean"
TEXTS = ["a", "B-", "c-\r", "d- ", "é-", "1-", "-", "x@y.ch", "x@y-", "z.ch", " ", " ", "ß", "é-", "𝒳𝒴-", "7", "ende"]


def some(rng, page, most):
    left, top = rng.choice([-200.0, 0.0, 100.0, 128.0, 300.0]), rng.randrange(0, 300, 10) * 1.0
    return (page, left, top, left + rng.randrange(most), top + rng.randrange(most))


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(16)
    words, lines, regions = [(None, 1, 900, "a", some(rng, 1, 40), True, False), (3, None, 901, "a", some(rng, 1, 40), True, False), (3, 1, 902, "a", None, True, None), (50, 1, 0, " ", some(rng, 1, 9), True, False)], [], []
    for doc in range(14):
        for page in range(1, 4):
            words += [(doc, page, k, rng.choice(TEXTS), some(rng, page, 40), rng.random() < 0.6, rng.random() < 0.4) for k in range(rng.choice([0, 3, 40]))]
            lines += [(doc, page, k, some(rng, page, 300)) for k in range(rng.randrange(6))]
            regions += [(doc, 3 * page + k, some(rng, page, 400)) for k in range(rng.randrange(3))]
    # Two words of one number, in one line.
    words += [(3, 1, 950, t, (1, 2000.0, 0.0, 2010.0, 10.0), True, False) for t in ("zwei", "eins")]
    lines += [(3, 1, 9, (1, 1990.0, 0.0, 2100.0, 10.0))]
    rng.shuffle(words)
    make = spark.createDataFrame
    return make(words, WORD), make(lines, f"doc_id long, page_no int, line_idx int, box {G.BOX}"), make(regions, f"doc_id long, region_idx int, box {G.BOX}")


def as_rows(frame):
    return sorted(map(repr, frame.collect()))


def test_units_in_a_documents_row(spark, frames, monkeypatch):
    monkeypatch.setattr(pages, "ROWS", 7)
    old = layout.text_units(pages.placed(*frames))
    joined = layout.join_units(old)
    new = pages.units(pages.together(*frames), boxes=True)
    each = new.select("doc_id", F.posexplode("units").alias("unit_idx", "u"))
    slim = F.transform("words", lambda w: F.struct(w["box"].alias("box"), w["start"].alias("start"), w["end"].alias("end"))).alias("words")
    assert as_rows(each.select("doc_id", "unit_idx", "u.text", "u.page_no", "u.words")) == as_rows(old.select("doc_id", "unit_idx", "text", "box.page_no", slim)) and each.count() > 200
    assert as_rows(new.select("doc_id", "text", F.transform("units", lambda u: u["start"]).alias("starts"))) == as_rows(joined)
    assert all(r.text[u.start : u.end] == u.text for r in new.collect() for u in r.units)
    assert any(w.text == "B-" for r in old.collect() for w in r.words) and any(w.text == "B" for r in old.collect() for w in r.words)
    assert pages.units(pages.together(*(f.where("false") for f in frames))).count() == 0
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_mentions_cut_in_the_row(spark):
    rng = random.Random(14)
    rows = []
    for _ in range(40):
        units, at = [], 0
        for _ in range(rng.randrange(30)):
            n = rng.choice((1, 5, 80, 256))
            units.append((at, at + n))
            at += n + rng.choice((0, 2))
        begins = [rng.randrange(at + 1) for _ in range(rng.randrange(20))]
        rows.append((units, [(b, b + rng.choice((0, 1, 20, 3000))) for b in begins]))
    kind = "array<struct<start:int,end:int>>"
    got = spark.createDataFrame(rows, f"units {kind}, m {kind}").select("units", "m", layout.cut_mentions(F.col("m"), F.col("units")).alias("p")).collect()
    for r in got:
        want = [(n, u, max(s, a) - a, min(e, b) - a) for n, (s, e) in enumerate(r.m, 1) for u, (a, b) in enumerate(r.units) if a < e and s < b]
        assert sorted(map(tuple, r.p)) == sorted(want)
    assert any(r.p for r in got)


def joined_marks(frames, pictures, detector, types):
    """mark_documents by joins of units, mentions and words."""
    units = layout.text_units(pages.placed(*frames))
    joined = layout.join_units(units)
    mentions = layout.mention_numbers(explode_spans(redact(detector.detect(joined.select("doc_id", "text"), types, 0.8), [], True, True)))
    starts = joined.select("doc_id", F.posexplode("starts").alias("unit_idx", "u_start"))
    placed = units.join(starts, ["doc_id", "unit_idx"]).withColumn("u_end", F.col("u_start") + F.length("text"))
    pieces = layout.split_mentions(mentions.select("doc_id", "mention_no", "start", "end"), placed.select("doc_id", "unit_idx", "u_start", "u_end"))
    boxes = pieces.join(units.select("doc_id", "unit_idx", "words"), ["doc_id", "unit_idx"]).withColumn("boxes", layout.bars(layout.touched_boxes(F.col("words"), F.col("start"), F.col("end"))))
    each = boxes.select("doc_id", "mention_no", "unit_idx", F.posexplode("boxes").alias("i", "box")).join(mentions.select("doc_id", "mention_no", F.col("mention_id").alias("id"), "label", "confidence", "text"), ["doc_id", "mention_no"])
    spots = each.withColumn("ord", (F.col("mention_no") * 1_000_000 + F.col("unit_idx") * 1000 + F.col("i")).cast("int")).drop("mention_no", "unit_idx", "i")
    drawn = layout.picture_marks(pictures).withColumn("ord", F.lit(0))
    return marks.annotations(marks.merge_marks(drawn.unionByName(spots))).drop("ord")


MODEL = CallableDetector(lambda texts, types, threshold: [[("person", at, at + 3, 0.9) for at in range(0, len(t) - 3, 11)] for t in texts])


@pytest.mark.parametrize("detector,types", [(RuleDetector(), ["e-mail-adresse"]), (MODEL, ["person"])])
def test_marks_made_in_the_row(spark, frames, detector, types):
    pictures = spark.createDataFrame([(1, (1, 0.0, 500.0, 40.0, 512.0), {"signature": 0.5})], f"doc_id long, box {G.BOX}, classes map<string,double>")
    new = api.mark_documents(*frames, pictures, detector, types).drop("ord")
    assert as_rows(new) == as_rows(joined_marks(frames, pictures, detector, types)) and new.count() > 10


def test_rows_of_the_queries_pages(spark, tmp_path):
    """The rows that documents' texts make in place are those of the words, lines and regions made one by one."""
    texts = ["", " ", "\n\n", None, " a  b ", "a\n \n\tb   c\n" + "x " * 40 + "\n" + "y", "\n".join(f"w{i} über- {i}" + " v" * (i % 23) for i in range(75)), "k-\r\nl", "\n" * 31 + "z"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    words = Q.page_words(spark, str(tmp_path))
    old = pages.together(words, Q.lines_of(words), Q.regions_of(words))
    new = Q.page_rows(spark, str(tmp_path))
    used = old.select("doc_id", "page_no").distinct()  # a page without words has no regions there, and nothing for them to hold
    assert as_rows(new.select(*old.columns).join(used, ["doc_id", "page_no"]).select(*old.columns)) == as_rows(old) and old.count() > 500
    assert old.schema.simpleString() == new.select(*old.columns).schema.simpleString()
    assert as_rows(pages.units(new, True)) == as_rows(pages.units(old, True))


@pytest.mark.parametrize("name", ["unit_text", "mention_split", "mark_boxes"])
def test_words_are_not_shuffled(spark, name, monkeypatch):
    """Texts are, once, up to the rows that are given out, or the marks that are stored."""
    made = []
    monkeypatch.setattr(api, "stored", lambda df: made.append(df) or df)
    made.append(Q.QUERIES[name](spark, "/root/testdata/sf0.001"))
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and not any(x in plan for x in ("Join", "Aggregate", "Window", "Sort", "Union"))
