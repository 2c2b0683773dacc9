"""Files, pages, layout, marks, tasks, reports and streams."""

import random

import pytest
from pyspark.sql import functions as F

from spanveil.api import anonymize_documents
from spanveil.functions import geometry as G
from spanveil.functions import text as T
from spanveil.operators import layout, marks, report
from spanveil.operators import tasks as Q
from spanveil.operators.detect import RuleDetector
from spanveil.sources import files as S


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_pages_and_names(spark):
    df = one(spark, md="a<!-- docling-page -->b<!-- docling-page -->c", esc="a\\_b\\c")
    r = df.select(T.page_text(F.col("md")).alias("t"), T.page_offsets(F.col("md")).alias("o"), T.unescape_markdown(F.col("esc")).alias("e"), T.page_of(T.page_offsets(F.col("md")), F.lit(1)).alias("p"), T.page_offsets(F.lit(None).cast("string")).alias("n")).first()
    assert (r.t, r.o, r.e, r.p, r.n) == ("abc", [0, 1, 2], "a_b\\c", 2, [0])
    names = {"doc.pdf": "application/pdf", "doc.DOCX": T.MIME_BY_SUFFIX[".docx"], "doc.md": "text/markdown", "doc.txt": "text/plain", "doc.xyz": "invalid", "x/.pdf": "invalid", "none": "invalid"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.mime_type(F.col("n")).alias("m")).collect()
    assert {r.n: r.m for r in got} == names
    marked = spark.createDataFrame([("bericht.pdf",), ("x",), ("a/b.c.pdf",)], "n string").select(T.marked_name(F.col("n"))).collect()
    assert [r[0] for r in marked] == ["bericht.markiert.pdf", "x.markiert.pdf", "b.c.markiert.pdf"]
    keys = spark.createDataFrame([("h" * 200, "p"), ("", "peer"), (None, None)], "h string, p string").select(T.client_key(F.col("h"), F.col("p"))).collect()
    assert [r[0] for r in keys] == ["h" * 128, "peer", "anonymous"]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("x\\_y<!-- docling-page -->z")
    (tmp_path / "b.html").write_text("<p>Hi &amp; bye</p><script>no</script>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.xyz").write_bytes(b"?")
    files = S.admission(S.read_files(spark, str(tmp_path)), 1000)
    errors = {r.path[-5:]: r.error for r in files.collect()}
    assert [v for k, v in errors.items() if k.endswith("xyz")] == ["invalid_mime_type"]
    big = S.admission(one(spark, length=11, mime="application/pdf"), 10).first()
    assert big.error == "file_too_large" and S.admission(one(spark, length=10, mime="application/pdf"), 10).first().error is None

    def converter(content, mime):
        if mime == "application/pdf":
            return "from pdf"
        raise ValueError("cannot")

    got = {r.path[-4:]: r for r in S.convert(files, converter).collect()}
    assert got["a.md"].text == "x_yz" and got["a.md"].page_offsets == [0, 3] and got["html"].text == "Hi & bye" and got[".pdf"].text == "from pdf" and got[".xyz"].convert_error == "cannot"
    assert {r.convert_error for r in S.convert(files.where("mime = 'application/pdf'")).collect()} == {"no converter"}


def test_refused_files_keep_their_rows(spark, tmp_path):
    (tmp_path / "a.md").write_text("to a@b.ch")
    (tmp_path / "d.xyz").write_bytes(b"?")
    got = {r.doc_id[-5:]: r for r in anonymize_documents(spark, str(tmp_path), entity_types=["e-mail-adresse"]).collect()}
    assert len(got) == 2 and got["/a.md"].redacted_text == "to [e-mail-adresse:1]" and got["/a.md"].error is None
    refused = got["d.xyz"]
    assert (refused.error, refused.text, refused.redacted_text, refused.spans) == ("invalid_mime_type", None, None, None)


def test_service_calls(spark):
    df = spark.createDataFrame([("a",), ("bad",)], "v string")
    got = {r.v: r for r in S.call_service(df, lambda v: v, lambda t: "failure" if t == "bad" else "success", lambda t: t.upper(), "v", interval=0.01).collect()}
    assert got["a"].result == "A" and got["bad"].service_error == "failure" and got["bad"].result is None


def test_polls_that_raise_are_tried_again(spark):
    asked = []

    def poll(task):
        asked.append(task)
        if len(asked) < 3:
            raise OSError("no answer")
        return "running" if len(asked) < 5 else "finished"

    assert S.followed("t", poll, 0.001, 10.0) == "finished" and len(asked) == 5
    assert S.followed("t", lambda t: "running", 0.001, 0.02) == "timeout" and S.followed("t", lambda t: "skipped", 1.0, 1.0) == "skipped"


def box(t, l, b=None, r=None, page=1):
    return {"page_no": page, "l": float(l), "t": float(t), "r": float(r if r is not None else l + 40), "b": float(b if b is not None else t + 12)}


def words(spark, lines, hidden=False):
    """Lines of words, 20 points apart."""
    rows = [(1, 1, k * 100 + i, w, box(k * 20, i * 50), 0) for k, line in enumerate(lines) for i, w in enumerate(line)]
    df = spark.createDataFrame(rows, f"doc_id long, page_no int, word_idx int, text string, box {G.BOX}, region_idx int")
    return df.withColumn("line_idx", (F.col("word_idx") / 100).cast("int")).withColumn("hidden", F.lit(hidden))


@pytest.mark.parametrize(
    "lines,text,pieces",
    [
        ([["Runa", "von"], ["Abegglen"]], "Runa von Abegglen", ["Runa", "von", "Abegglen"]),
        ([["im", "Früh-"], ["ling", "1999"]], "im Frühling 1999", ["im", "Früh", "ling", "1999"]),
        ([["je", "45.-"], ["[brutto]"]], "je 45.- [brutto]", ["je", "45.-", "[brutto]"]),
    ],
)
def test_units(spark, lines, text, pieces):
    r = layout.text_units(words(spark, lines)).first()
    assert r.text == text and [r.text[w.start : w.end] for w in r.words] == pieces


def test_regions_lines_and_reading(spark):
    rows = [(1, 1, 0, "unten", box(60, 10), True, False), (1, 1, 1, "oben", box(20, 10), True, False), (1, 1, 2, "Name", box(22, 200), True, False), (1, 1, 3, "oben", box(21, 12), False, True), (1, 1, 4, "Schild", box(300, 300), False, True), (1, 1, 5, " ", box(0, 0), True, False)]
    w = spark.createDataFrame(rows, f"doc_id long, page_no int, word_idx int, text string, box {G.BOX}, drawn boolean, read boolean")
    regions = spark.createDataFrame([(1, 0, box(0, 0, 200, 400)), (1, 1, box(10, 190, 50, 300)), (1, 2, box(10, 190, 50, 300))], f"doc_id long, region_idx int, box {G.BOX}")
    lines = spark.createDataFrame([], f"doc_id long, page_no int, line_idx int, box {G.BOX}")
    kept = layout.drop_read_over_drawn(w)
    assert {r.word_idx for r in kept.collect()} == {0, 1, 2, 4, 5}
    lined = layout.words_to_lines(kept, lines)
    assert {r.word_idx: r.line_idx for r in lined.collect()} == {0: -1, 1: -2, 2: -3, 4: -5}
    placed = layout.words_to_regions(lined, regions)
    assert {r.word_idx: r.region_idx for r in placed.collect()} == {0: 0, 1: 0, 2: 1, 4: None}
    units = layout.text_units(placed.withColumn("hidden", F.lit(False)))
    assert [r.text for r in units.orderBy("unit_idx").collect()] == ["oben unten", "Name", "Schild"]
    joined = layout.join_units(units).first()
    assert joined.text == "oben unten\n\nName\n\nSchild" and joined.starts == [0, 12, 18]
    pages = spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, pages int")
    assert {tuple(r) for r in layout.incomplete_pages(pages, w).collect()} == {(1, 2), (2, 0)}


def test_layout_of_a_converter(spark):
    import json

    from spanveil.sources import layout as source

    low = {"l": 10.0, "t": 90.0, "r": 50.0, "b": 70.0, "coord_origin": "BOTTOMLEFT"}
    high = {"l": 1.0, "t": 2.0, "r": 3.0, "b": 4.0, "coord_origin": "TOPLEFT"}
    seen = [{"kind": "classification", "predicted_classes": [{"class_name": "signature", "confidence": 0.3}, {"class_name": "logo", "confidence": 0.6}]}]
    document = {"pages": {"1": {"page_no": 1, "size": {"width": 80, "height": 100}}}, "texts": [{"prov": [{"page_no": 1, "bbox": low}]}, {"prov": []}], "tables": [{"prov": [{"page_no": 1, "bbox": high}], "data": {"table_cells": [{"bbox": low}, {"bbox": None}]}}], "pictures": [{"prov": [{"page_no": 1, "bbox": high}, {"page_no": 2, "bbox": high}], "annotations": seen}]}

    def rect(x, y, w, h, origin):
        return {"r_x0": x, "r_y0": y, "r_x1": x + w, "r_y1": y, "r_x2": x + w, "r_y2": y + h, "r_x3": x, "r_y3": y + h, "coord_origin": origin}

    cells = [{"rect": rect(10, 80, 20, 10, "BOTTOMLEFT"), "text": "Vogt", "from_ocr": False, "rendering_mode": 0}, {"rect": rect(1, 1, 1, 1, "TOPLEFT"), "text": " \u00a0", "from_ocr": False}, {"rect": rect(5, 6, 7, 8, "TOPLEFT"), "text": "Amt", "from_ocr": True}, {"rect": rect(5, 6, 7, 8, "TOPLEFT"), "text": "unseen", "rendering_mode": 3}]
    pages = {"1": {"dimension": {"rect": rect(0, 0, 80, 100, "BOTTOMLEFT")}, "textline_cells": [{"rect": rect(0, 75, 80, 20, "BOTTOMLEFT")}], "word_cells": cells}}
    df = spark.createDataFrame([(1, json.dumps(document), json.dumps(pages)), (2, None, None), (3, "{", "[]")], "doc_id long, document string, pages string")
    known = source.parsed(df)
    assert [(r.doc_id, r.region_idx, tuple(r.box)) for r in source.regions(known).orderBy("region_idx").collect()] == [(1, 0, (1, 10.0, 10.0, 50.0, 30.0)), (1, 1, (1, 1.0, 2.0, 3.0, 4.0)), (1, 2, (1, 10.0, 10.0, 50.0, 30.0)), (1, 3, (1, 1.0, 2.0, 3.0, 4.0))]
    pictures = source.pictures(known)
    assert [(tuple(r.box), r.classes) for r in pictures.collect()] == [((1, 1.0, 2.0, 3.0, 4.0), {"signature": 0.3, "logo": 0.6})] and layout.picture_marks(pictures).first().confidence == 0.3
    found, lines = source.cells(df)
    assert {(r.word_idx, r.text, tuple(r.box), r.drawn, r.read) for r in found.collect()} == {(0, "Vogt", (1, 10.0, 10.0, 30.0, 20.0), True, False), (2, "Amt", (1, 5.0, 6.0, 12.0, 14.0), True, True), (3, "unseen", (1, 5.0, 6.0, 12.0, 14.0), False, False)}
    assert [tuple(r.box) for r in lines.collect()] == [(1, 0.0, 5.0, 80.0, 25.0)]


def test_reading_order_of_trees(spark):
    """Trees of any shape against a plain walk: groups, nesting, references to nothing, to themselves and back."""
    import json
    import random

    from spanveil.sources import layout as source

    rng = random.Random(4)
    ref = lambda k, i: {"$ref": f"#/{k}/{i}"}
    cases, want = [], {}
    for n in range(40):
        names = [(k, i) for k in ("texts", "tables", "pictures", "groups") for i in range(rng.randrange(4))]
        left = names[:]
        rng.shuffle(left)
        children = {x: [] for x in names}
        roots, placed = [], []
        for x in left:
            over = rng.choice([None, *placed]) if placed else None
            (roots if over is None else children[over]).append(x)
            placed.append(x)
        if n % 5 == 0 and placed:
            children[placed[-1]].append(placed[0])  # back to where it came from
            roots.append(("texts", 77))
        captions = {x: rng.sample(children[x], rng.randrange(len(children[x]) + 1)) for x in names if x[0] == "pictures"}
        prov = [{"page_no": 1, "bbox": {"l": 1.0, "t": 2.0, "r": 3.0, "b": 4.0, "coord_origin": "TOPLEFT"}}]
        d = {"pages": {"1": {"page_no": 1, "size": {"width": 8, "height": 9}}}, "body": {"children": [ref(*x) for x in roots]}}
        for k in ("texts", "tables", "pictures", "groups"):
            d[k] = [{"children": [ref(*c) for c in children[x]], "captions": [ref(*c) for c in captions.get(x, [])], "prov": prov} for x in names if x[0] == k]
        seen = []

        def walk(x, children=children, captions=captions, seen=seen):
            if x in children and x not in seen:
                seen.append(x)
                for c in children[x]:
                    if x[0] != "pictures" or c in captions[x]:
                        walk(c)

        for x in roots:
            walk(x)
        cases.append((n, json.dumps(d)))
        want[n] = [f"#/{k}/{i}" for k, i in seen]
    known = source.parsed(spark.createDataFrame([*cases, (99, None), (98, '{"texts":[{"prov":[]},{"prov":[]}],"groups":[{}]}')], "doc_id long, document string"))
    got = {}
    for r in source.reading_order(known).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append(r.ref)
    assert got == {n: w for n, w in want.items() if w} | {98: ["#/texts/0", "#/texts/1"]}
    sizes = {r.doc_id: r.n for r in source.regions(known).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert sizes == {n: k for n, w in want.items() if (k := sum(not r.startswith("#/groups") for r in w))}


def test_classes_of_pictures_in_both_forms(spark):
    import json

    from spanveil.sources import layout as source

    prov = [{"page_no": 1, "bbox": {"l": 1.0, "t": 2.0, "r": 3.0, "b": 4.0, "coord_origin": "TOPLEFT"}}]
    seen = {"classification": {"predictions": [{"class_name": "signature", "confidence": 0.7}, {"class_name": "logo", "confidence": None}]}}
    old = [{"kind": "classification", "predicted_classes": [{"class_name": "signature", "confidence": 0.9}]}]
    d = {"pages": {"1": {"page_no": 1, "size": {"width": 8, "height": 9}}}, "pictures": [{"prov": prov, "meta": seen}, {"prov": prov, "annotations": old}, {"prov": prov}]}
    got = source.pictures(source.parsed(spark.createDataFrame([(1, json.dumps(d))], "doc_id long, document string")))
    assert sorted((r.classes for r in got.collect()), key=str) == [{"signature": 0.7, "logo": 0.0}, {"signature": 0.9}, {}]


def test_lines_of_drawn_and_of_read_words(spark):
    """A line that holds both kinds makes two lines, the drawn one first; a line's place is its first word, wherever that one goes."""
    rows = [(1, 1, 0, "Anna", box(0, 0), True, False), (1, 1, 1, "Vogt", box(0, 40), True, False), (1, 1, 2, "Stempel", box(0, 80), True, True), (1, 1, 3, "Basel", box(0, 120), True, False)]
    rows += [(1, 1, 4, "drin", box(200, 0), True, False), (1, 1, 5, "zuerst", box(100, 0), True, False), (1, 1, 6, "danach", box(200, 300), True, False), (1, 1, 7, "unsichtbar", box(100, 300), False, False)]
    rows += [(1, 2, 8, "gelesen", box(0, 0, page=2), True, True), (1, 2, 9, "gezeichnet", box(50, 0, page=2), True, False)]
    w = spark.createDataFrame(rows, f"doc_id long, page_no int, word_idx int, text string, box {G.BOX}, drawn boolean, read boolean")
    lines = spark.createDataFrame([(1, 1, 0, box(0, 0, 20, 600)), (1, 1, 1, box(200, 0, 220, 600))], f"doc_id long, page_no int, line_idx int, box {G.BOX}")
    regions = spark.createDataFrame([(1, 0, box(195, 0, 225, 100))], f"doc_id long, region_idx int, box {G.BOX}")
    lined = layout.drop_read_over_drawn(layout.words_to_lines(w, lines)).withColumn("hidden", ~(F.col("drawn") | F.col("read")))
    units = layout.text_units(layout.words_to_regions(lined, regions))
    assert [r.text for r in units.orderBy("unit_idx").collect()] == ["drin", "Anna Vogt Basel", "danach", "zuerst", "Stempel", "gezeichnet", "gelesen", "unsichtbar"]


def test_boxes(spark):
    r = layout.text_units(words(spark, [["Runa", "Zumbrunn"]])).withColumn("b", layout.bars(layout.touched_boxes(F.col("words"), F.lit(0), F.lit(13)))).first()
    by = 1 + 0.15 * 12
    assert len(r.b) == 1 and r.b[0].l == pytest.approx(-by) and r.b[0].r == pytest.approx(90 + by)
    lists = [[box(0, 0), box(100, 400), box(2, 300)], [box(0, 0), box(100, 200), box(2, 300)], [], [box(0, 0), box(0, 0, page=2)], None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], f"i int, x array<{G.BOX}>").select("i", layout.bars(F.col("x")).alias("b")).collect()
    assert {r.i: len(r.b) for r in got} == {0: 2, 1: 1, 2: 0, 3: 2, 4: 0}  # in list 1 the bar that two make covers the third from left to right
    pieces = layout.split_mentions(spark.createDataFrame([(1, 1, 3, 15)], "doc_id long, mention_no int, start int, end int"), spark.createDataFrame([(1, 0, 0, 10), (1, 1, 12, 20)], "doc_id long, unit_idx int, u_start int, u_end int"))
    assert {tuple(p)[2:] for p in pieces.collect()} == {(0, 3, 10), (1, 0, 3)}
    pics = spark.createDataFrame([(1, box(0, 0), {"signature": 0.31, "logo": 0.6}), (1, box(9, 9), {"signature": 0.05}), (1, box(1, 1), {"logo": 1.0})], f"doc_id long, box {G.BOX}, classes map<string,double>")
    assert [(m.label, m.confidence) for m in layout.picture_marks(pics).collect()] == [("signature", 0.31)]


def test_bars_and_marks_match_plain_python(spark):
    """Random boxes; overlaps decide the same in a search for any pair that overlaps, once order plays no part."""
    rng = random.Random(8)
    lists = [[box(rng.randrange(60), rng.randrange(60), page=rng.choice((1, 1, 2))) for _ in range(rng.randrange(7))] for _ in range(60)]
    got = {r.i: r.b for r in spark.createDataFrame(list(enumerate(lists)), f"i int, x array<{G.BOX}>").select("i", layout.bars(F.col("x")).alias("b")).collect()}

    def joins(a, b):
        return a["page_no"] == b["page_no"] and any(min(a[h], b[h]) - max(a[w], b[w]) > min(a[h] - a[w], b[h] - b[w]) / 2 for w, h in ("tb", "lr"))

    for i, boxes in enumerate(lists):
        assert not any(joins(a, b) for k, a in enumerate(got[i]) for b in got[i][:k])  # nothing is left to join
        for b in boxes:  # and every box is in a bar of its page
            assert any(g.page_no == b["page_no"] and g.l <= b["l"] and g.t <= b["t"] and g.r >= b["r"] and g.b >= b["b"] for g in got[i])
        assert sorted({b["page_no"] for b in boxes}) == sorted({g.page_no for g in got[i]})


def test_rotation(spark):
    b = spark.createDataFrame([(box(100, 50, 112, 160), r) for r in (0, 90, 180, 270)], f"b {G.BOX}, r int")
    got = {r.r: r.u for r in b.select("r", G.user_rect(F.col("b"), F.col("r"), F.lit(40.0), F.lit(60.0), F.lit(560.0), F.lit(800.0)).alias("u")).collect()}
    assert got == {0: [90.0, 748.0, 200.0, 760.0], 90: [140.0, 110.0, 152.0, 220.0], 180: [440.0, 160.0, 550.0, 172.0], 270: [488.0, 700.0, 500.0, 810.0]}


def test_marks(spark):
    rows = [(1, 1, "d1", box(100, 100, 107, 180), "person", 0.7, "a"), (1, 2, "d1", box(96, 99, 111, 182), "person", 0.73, "b"), (1, 3, "d2", box(96, 99, 111, 182), "person", 0.5, "c"), (1, 4, "", box(0, 0, 10, 10), "signature", 0.4, ""), (1, 5, "", box(1, 1, 10, 10), "signature", 0.6, ""), (1, 6, "", box(1, 100, 10, 110), "signature", 0.2, "")]
    df = spark.createDataFrame(rows, marks.MARK)
    got = {(r.id, r.ord): r for r in marks.merge_marks(df).collect()}
    assert set(got) == {("d1", 1), ("d2", 3), ("", 4), ("", 6)}
    assert tuple(got["d1", 1].box) == (1, 99.0, 96.0, 182.0, 111.0) and got["d1", 1].confidence == 0.73 and got["d1", 1].text == "a" and got["", 4].confidence == 0.6
    assert {r.id: len(r.boxes) for r in marks.annotations(df).collect()}["d1"] == 2
    text = one(spark, l="person", c=0.93, t="Runa  Abegglen", e="", x="y" * 200)
    said = text.select(marks.comment(F.col("l"), F.col("c"), F.col("t")), marks.comment(F.lit("signature"), F.lit(0.41), F.col("e")), F.length(marks.comment(F.col("l"), F.col("c"), F.col("x")))).first()
    assert tuple(said) == ("person, Konfidenz 0.93: «Runa Abegglen»", "signature, Konfidenz 0.41", len("person, Konfidenz 0.93: «»") + 120)
    js = spark.createDataFrame([('[{"page":1,"left":1,"top":2,"right":3,"bottom":4}]',), ("[[1,1,2,3,4]]",), ('[{"page":0,"left":1,"top":2,"right":3,"bottom":4}]',)], "j string").select(marks.boxes_from_json(F.col("j")).alias("b")).collect()
    assert tuple(js[0].b[0]) == tuple(js[1].b[0]) == (1, 1.0, 2.0, 3.0, 4.0) and js[2].b is None
    far = marks.past_the_end(spark.createDataFrame([(1, 1, "a", box(0, 0, page=9), "p", 1.0, ""), (1, 2, "a", box(0, 0, page=3), "p", 1.0, "")], marks.MARK), spark.createDataFrame([(1, 1)], "doc_id long, pages int"))
    assert [r.page_no for r in far.collect()] == [3]
    names = marks.reviewed(spark.createDataFrame([(1, 1, "d1", [box(0, 0), box(50, 0)]), (1, 2, "", [box(0, 0)])], f"doc_id long, ord int, id string, boxes array<{G.BOX}>")).collect()
    assert sorted(r.name for r in names if r.id) == ["d1", "d1:1"] and all(len(r.name) == 36 for r in names if not r.id)


def test_unnamed_marks_match_plain_python(spark):
    """In order, each mark goes into the first one before it that covers six tenths of it, or is covered so."""
    rng = random.Random(9)
    made = [(rng.randrange(3), i, "", box(rng.randrange(6), rng.randrange(12), rng.randrange(8, 14), rng.randrange(20, 34), rng.choice((1, 1, 2))), rng.choice("xy"), rng.random(), f"t{i}") for i in range(60)]

    def part(a, b):
        w, h = (max(0.0, min(a[hi], b[hi]) - max(a[lo], b[lo])) for lo, hi in ("lr", "tb"))
        return w * h / ((a["r"] - a["l"]) * (a["b"] - a["t"])) if a["page_no"] == b["page_no"] else 0.0

    want = []
    for d, i, _, b, label, c, t in made:
        twin = next((m for m in want if m["key"] == (d, label) and max(part(m["box"], b), part(b, m["box"])) >= 0.6), None)
        if twin is None:
            want.append({"key": (d, label), "ord": i, "box": dict(b), "c": c, "t": t})
        else:
            for k, f in (("l", min), ("t", min), ("r", max), ("b", max)):
                twin["box"][k] = f(twin["box"][k], b[k])
            twin["c"] = max(twin["c"], c)
    got = marks.merge_unnamed(spark.createDataFrame(made, marks.MARK)).collect()
    assert sorted(((r.doc_id, r.label), r.ord, tuple(r.box), r.confidence, r.text) for r in got) == sorted((m["key"], m["ord"], tuple(m["box"][k] for k in ("page_no", "l", "t", "r", "b")), m["c"], m["t"]) for m in want)
    assert len(got) < len(made)


def test_annotating_documents(spark):
    from spanveil.api import annotate_documents

    reviewed = spark.createDataFrame([(1, 1, "d1", "person", 0.9, "Vogt", [box(10, 20), box(40, 20)], ""), (1, 2, "", "signature", 0.3, "", [box(5, 5)], "x"), (2, 1, "d1", "ort", 0.8, "Uster", [box(1, 1, page=4)], "")], f"doc_id long, ord int, id string, label string, confidence double, text string, boxes array<{G.BOX}>, overlay string")
    pages = spark.createDataFrame([(d, 1, 0, 0.0, 0.0, 200.0, 100.0) for d in (1, 2)], "doc_id long, page_no int, rotation int, left double, bottom double, width double, height double")
    records, refused = annotate_documents(reviewed, pages, F.lit("2031-05-03 10:00:00").cast("timestamp"))
    got = sorted(records.collect(), key=lambda r: (r.subj, r.rect))
    assert [(r.doc_id, r.page_no, r.subj, r.rect, r.created) for r in got] == [(1, 1, "Schwärzung: person", [20.0, 48.0, 60.0, 60.0], "D:20310503100000Z"), (1, 1, "Schwärzung: person", [20.0, 78.0, 60.0, 90.0], "D:20310503100000Z"), (1, 1, "Schwärzung: signature", [5.0, 83.0, 45.0, 95.0], "D:20310503100000Z")]
    assert sorted(r.nm for r in got if r.subj.endswith("person")) == ["d1", "d1:1"] and [(r.doc_id, r.page_no) for r in refused.collect()] == [(2, 4)]


def test_queues(spark):
    t = spark.createDataFrame([("l", "busy", 1), ("l", "busy", 2), ("l", "busy", 3), ("l", "late", 4)], "lane string, client string, seq int")
    order = [r.client for r in Q.fair_order(t).orderBy("queue_position").collect()]
    assert order == ["busy", "late", "busy", "busy"]
    assert [r.admitted for r in Q.admitted(t, F.lit(2)).orderBy("seq").collect()] == [True, True, False, False]
    e = spark.createDataFrame([("a", "pending", 0.0, 40.0), ("b", "pending", 0.0, 80.0), ("c", "running", 0.0, 0.0), ("d", "finished", 50.0, 0.0)], "task_id string, status string, updated_at double, polled_at double")
    assert [r.task_id for r in Q.abandoned(e, F.lit(100.0), 30.0).collect()] == ["a"]
    assert [r.task_id for r in Q.expired(e, F.lit(100.0), 30.0).collect()] == ["d"]
    reads = Q.collected(spark.createDataFrame([("r", 1), ("r", 2)], "resource_id string, ts int")).orderBy("ts").collect()
    assert [r.found for r in reads] == [True, False]


def test_reports(spark):
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double").agg(report.nearest_rank(F.col("v"), 0.5).alias("m")).first()
    assert v.m == 3.0  # rank 1.5 goes to 2
    assert spark.createDataFrame([], "v double").agg(report.nearest_rank(F.col("v"), 0.5).alias("m")).first().m == 0.0
    rng = random.Random(3)
    many = {k: [rng.choice((rng.random(), 0.5, None)) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 801), ("d", 4000))}
    table = spark.createDataFrame([(k, x) for k, xs in many.items() for x in xs] + [("e", None)], "k string, x double")
    for fraction in (0.0, 0.3, 0.5, 0.95, 1.0):
        got = {r.k: r.value for r in report.nearest_ranks(table, ["k"], F.col("x"), fraction, 20).collect()}
        want = {k: sorted(x for x in xs if x is not None) for k, xs in many.items()}
        assert got == {k: v[round(fraction * (len(v) - 1))] for k, v in want.items() if v}
    polls = spark.createDataFrame([(1, 0.0, "pending"), (1, 3.0, "running"), (1, 7.0, "finished")], "task_id int, ts double, status string")
    r = report.attribute_polls(polls).first()
    assert (r.queue_s, r.work_s, r.polls) == (3.0, 4.0, 3)


def test_whole_layout(spark):
    from spanveil.api import mark_documents

    rows = [(1, 1, 0, "an", box(0, 0), True, False), (1, 1, 1, "a@b.ch", box(0, 50), True, False), (1, 1, 2, "und", box(0, 100), True, False)]
    w = spark.createDataFrame(rows, f"doc_id long, page_no int, word_idx int, text string, box {G.BOX}, drawn boolean, read boolean")
    lines = spark.createDataFrame([(1, 1, 0, box(0, 0, 12, 200))], f"doc_id long, page_no int, line_idx int, box {G.BOX}")
    regions = spark.createDataFrame([], f"doc_id long, region_idx int, box {G.BOX}")
    pics = spark.createDataFrame([(1, box(500, 0), {"signature": 0.5})], f"doc_id long, box {G.BOX}, classes map<string,double>")
    got = {r.label: r for r in mark_documents(w, lines, regions, pics, RuleDetector(), ["e-mail-adresse"]).collect()}
    assert got["e-mail-adresse"].id == "d1" and got["e-mail-adresse"].boxes[0].l == pytest.approx(50 - 2.8) and got["signature"].id.startswith("picture:1:")


def test_streams(spark, tmp_path):
    from spanveil.streaming import tasks as X

    spark.createDataFrame([(1, "a@b.ch x"), (2, None)], "doc_id long, text string").write.json(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").json(str(tmp_path / "in"))
    X.redact_stream(docs).select("doc_id", "redacted_text").writeStream.format("memory").queryName("redacted").trigger(availableNow=True).start().awaitTermination(60)
    assert {(r.doc_id, r.redacted_text) for r in spark.table("redacted").collect()} == {(1, "[e-mail-adresse:1] x"), (2, "")}
    spark.createDataFrame([("t", "2024-01-01 00:00:00"), ("t", "2024-01-01 00:00:50"), ("t", "2024-01-01 00:03:00")], "task_id string, ts string").write.json(str(tmp_path / "polls"))
    polls = spark.readStream.schema("task_id string, ts timestamp").json(str(tmp_path / "polls"))
    X.polling_sessions(polls).writeStream.format("memory").queryName("spells").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.polls for r in spark.table("spells").collect()) == [1, 2]


def test_task_machine(spark, tmp_path):
    """Moves, moves that aren't allowed, abandonment, expiry; the last batch only moves the watermark."""
    from spanveil.streaming import tasks as X

    made = [("a", 0, "submit", None), ("a", 5, "start", None), ("a", 5, "submit", None), ("a", 9, "finish", "r1"), ("a", 10, "fail", "late")]
    made += [("b", 0, "submit", None), ("b", 50, "poll", None), ("c", 1, "submit", None), ("c", 2, "cancel", None), ("d", 1, "submit", None), ("d", 3, "start", None), ("d", 4, "fail", "broken"), ("e", 3, "start", None)]
    batches = [made, [("z", 300, "submit", None)], [("z", 310, "start", None), ("z", 9000, "poll", None)], [("z", 9001, "poll", None)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([(t, f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}", e, x) for t, s, e, x in rows], "task_id string, ts string, event string, detail string").coalesce(1).write.mode("append").json(str(tmp_path / "events" / f"b={k}"))
    events = spark.readStream.option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).schema("task_id string, ts timestamp, event string, detail string").json(str(tmp_path / "events"))
    X.task_machine(events).writeStream.format("memory").queryName("moves").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    zero = 1704067200
    got = {(r.task_id, r.status): (r.updated_at - zero, r.error or r.resource_id) for r in spark.table("moves").collect()}
    assert got.pop(("z", "pending")) == (300, None) and got.pop(("z", "running")) == (310, None)
    want = {("a", "pending"): (0, None), ("a", "running"): (5, None), ("a", "finished"): (9, "r1"), ("b", "pending"): (0, None), ("b", "failed"): (110, "abandoned by the caller"), ("c", "pending"): (1, None), ("c", "failed"): (2, "cancelled"), ("d", "pending"): (1, None), ("d", "running"): (3, None), ("d", "failed"): (4, "broken")}
    assert {k: v for k, v in got.items() if k[1] != "expired"} == want
    assert {k[0]: v[0] for k, v in got.items() if k[1] == "expired"} == {"a": 3609, "b": 3710, "c": 3602, "d": 3604}


def test_regions_are_made_in_the_documents_row(spark):
    """No join: a frame made of JSON is much larger than its file tells, and would be broadcast through the driver."""
    from spanveil.sources import layout as source

    known = source.parsed(spark.createDataFrame([(1, "{}")], "doc_id long, document string"))
    for made in (source.regions(known), source.pictures(known), source.reading_order(known)):
        assert "Join" not in made._jdf.queryExecution().toString() and made.collect() == []


def test_pages_placed_at_once(spark, monkeypatch):
    """Equal to lines, drawn words and regions joined one after the other, also where pages come in parts; words are shuffled once."""
    import random

    from spanveil.operators import pages

    monkeypatch.setattr(pages, "ROWS", 7)
    monkeypatch.setattr(pages, "AT_ONCE", 3)
    rng = random.Random(6)
    words, lines, regions = [], [], []

    def some(page, most):
        left, top = rng.choice([-200.0, 0.0, 100.0, 128.0, 300.0]), rng.randrange(0, 300, 10) * 1.0
        return (page, left, top, left + rng.randrange(most), top + rng.randrange(most))

    for doc in range(12):
        for page in range(1, 4):
            words += [(doc, page, k, rng.choice(["a", "B-", " ", " ", "ß"]), some(page, 40), rng.random() < 0.6, rng.random() < 0.4) for k in range(rng.choice([0, 3, 40]))]
            lines += [(doc, page, k, some(page, 300)) for k in range(rng.randrange(6))]
            regions += [(doc, 3 * page + k, some(page, 400)) for k in range(rng.randrange(3))]
    w = spark.createDataFrame(words, f"doc_id long, page_no int, word_idx int, text string, box {G.BOX}, drawn boolean, read boolean")
    n = spark.createDataFrame(lines, f"doc_id long, page_no int, line_idx int, box {G.BOX}")
    r = spark.createDataFrame(regions, f"doc_id long, region_idx int, box {G.BOX}")
    old = layout.words_to_regions(layout.drop_read_over_drawn(layout.words_to_lines(w, n)).withColumn("hidden", ~(F.col("drawn") | F.col("read"))), r)
    new = pages.placed(w, n, r)
    assert sorted(map(repr, old.select(*new.columns).collect())) == sorted(map(repr, new.collect())) and new.count() > 100
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan
    assert new.where("false").unionByName(pages.placed(w.where("false"), n, r)).count() == 0
