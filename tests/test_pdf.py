"""PDF files: pages, appended marks, and what is refused."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanveil.operators import marks
from spanveil.plans.tables import pdf_of
from spanveil.sources import pdf
from spanveil.sources.pdf import Name, Pdf, Ref, Unreadable, parse, write


@pytest.mark.parametrize("value", [{"A": [1, -2, None, True, False, Name("a b#/"), Ref(3, 0)], "B": {"C": b"\x00\xff()"}}, [], {}, b""])
def test_values_are_written_and_read(value):
    assert parse(write(value), 0)[0] == value


def test_values_as_other_writers_put_them():
    data = rb"<< /K#41 (a\(b\)(c)\053\n\\) % note" + b"\n/N [1 0 R 2 .5 -3. +4 <4 1 4>] /S/T>>"
    got = parse(data, 0)[0]
    assert got["KA"] == b"a(b)(c)+\n\\" and got["N"] == [Ref(1, 0), 2, pytest.approx(0.5), -3, 4, b"A@"] and got["S"] == "T"
    assert pdf.text_of(parse(write("Zürich"), 0)[0]) == "Zürich" and pdf.text_of(b"ab") == "ab" and pdf.text_of(3) is None
    assert [write(x) for x in (1e-7, 20.0, -3)] == [b"0.0000001", b"20.0", b"-3"]
    with pytest.raises(Unreadable):
        write([float("nan")])
    for broken in (b"(a", b"<zz>", b"[1", b"<</A", b"[" * 200, b"", b"x"):
        with pytest.raises(Unreadable):
            parse(broken, 0)


def test_numbers_in_lists_and_what_is_none():
    from decimal import Decimal

    for data, value in ((b"[1 -2 +3 .5 4. 7]", [1, -2, 3, Decimal("0.5"), Decimal(4), 7]), (b"[1 2 0 R]", [1, Ref(2, 0)]), (b"[1  2%x\n3 ]", [1, 2, 3]), (b"[1 [2 3] 4]", [1, [2, 3], 4]), (b"[ 1]", [1]), (b"12 0 obj", 12), (b"12 0 R", Ref(12, 0)), (b"1.5]", Decimal("1.5")), (b"null/", None), (b"/#41b", "Ab"), (b"/ ", "")):
        assert parse(data, 0)[0] == value
    for broken in (b"[1 2-3]", b"[1 .]", b"[1.2.3]", b"truer", b"1a", b"+", b"12 0 Rx 3x"):
        with pytest.raises(Unreadable):
            parse(broken, 0) if broken != b"12 0 Rx 3x" else parse(b"[12 0 Rx]", 0)
    assert [write(x) for x in (0.1, 1e22, -2.5, 123456789.125, 1e-5)] == [b"0.1", b"10000000000000000000000", b"-2.5", b"123456789.125", b"0.00001"]


def test_the_tree_of_pages_is_walked_once(spark):
    p = Pdf(pdf_of(1, "x" * 9000))
    assert p.pages() is p.pages() and len(p.pages()) == 3
    files = spark.createDataFrame([(i, bytearray(pdf_of(i, "x" * 100)) if i % 5 else bytearray(b"no")) for i in range(200)], "doc_id long, content binary").coalesce(1)
    got = pdf.pdf_pages(files).collect()
    assert [r.doc_id for r in got] == list(range(200)) and [r.error is None for r in got] == [i % 5 > 0 for i in range(200)]


@pytest.mark.parametrize("doc_id", range(4))
def test_marks_are_appended_and_the_file_stays(doc_id):
    data = pdf_of(doc_id, "x" * 6500)
    once = Pdf(data).with_annotations([(2, {"Subtype": Name("Redact"), "NM": "a"}), (1, {"NM": "b"})])
    twice = Pdf(once).with_annotations([(2, {"NM": "ü"})])
    assert once.startswith(data) and twice.startswith(once) and Pdf(data).with_annotations([]) == data
    p = Pdf(twice)
    names = [[pdf.text_of(p.get(p.get(a).get("NM"))) for a in p.get(page.get("Annots")) or []] for _, page, _ in p.pages()]
    assert names == [[*([None] if doc_id == 0 else []), "b"], ["a", "ü"], []]
    with pytest.raises(Unreadable):
        Pdf(data).with_annotations([(4, {})])


def test_lists_of_annotations_that_stand_alone_and_inherited_shapes():
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Kids[3 0 R]/Rotate 90/MediaBox[0 0 9 9]>>", b"<</Kids[4 0 R 5 0 R]/CropBox[10 20 5 2]>>", b"<</Annots 6 0 R>>", b"<</Annots 6 0 R/Rotate 0>>", b"[<</NM(x)>>]"]
    out, at = bytearray(b"junk\n%PDF-1.4\n"), []
    for n, body in enumerate(objects, 1):
        at.append(len(out) - 5)
        out += b"%d 0 obj" % n + body + b"endobj\n"
    start = len(out) - 5
    out += b"xref\n0 1\n0000000000 65535 f \n1 6\n" + b"".join(b"%010d 00000 n \n" % a for a in at) + b"trailer<</Root 1 0 R/Size 7>>\nstartxref %d\n%%%%EOF" % start
    p = Pdf(bytes(out))
    assert [p.shape(full) for _, _, full in p.pages()] == [{"rotation": r, "left": 5.0, "bottom": 2.0, "width": 5.0, "height": 18.0} for r in (90, 0)]
    q = Pdf(p.with_annotations([(1, {"NM": "a"}), (2, {"NM": "b"})]))
    assert [len(q.get(page["Annots"])) for _, page, _ in q.pages()] == [3, 3]
    locked = bytes(out).replace(b"/Size 7", b"/Size 7/Encrypt 1 0 R")
    with pytest.raises(Unreadable, match="encrypted"):
        Pdf(locked)


def test_files_as_rows(spark):
    good = pdf_of(1, "a" * 3001)
    loop = pdf_of(2, "a").replace(b"/Kids [4 0 R]", b"/Kids [2 0 R]")
    files = spark.createDataFrame([(1, good), (2, loop), (3, b""), (4, None), (5, good[: len(good) // 2]), (6, good), (7, good)], "doc_id long, content binary")
    pages = pdf.pdf_pages(files).collect()
    assert sorted((r.doc_id, r.page_no, r.width, r.height, r.error is None) for r in pages if r.page_no) == [(d, n, 595.0, 842.0, True) for d in (1, 6, 7) for n in (1, 2)]
    assert {r.doc_id for r in pages if r.error} == {2, 3, 4, 5}
    rows = [(1, 1, "d1", {"page_no": 2, "l": 10.0, "t": 20.0, "r": 30.0, "b": 40.0}, "person", 0.9, "Zoë"), (7, 1, "d1", {"page_no": 3, "l": 1.0, "t": 2.0, "r": 3.0, "b": 4.0}, "ort", 0.9, "x"), (5, 1, "d1", {"page_no": 1, "l": 1.0, "t": 2.0, "r": 3.0, "b": 4.0}, "ort", 0.9, "x")]
    placed = spark.createDataFrame(rows, marks.MARK).withColumns({"rotation": F.lit(0), "left": F.lit(0.0), "bottom": F.lit(0.0), "width": F.lit(595.0), "height": F.lit(842.0), "at": F.lit("2024-01-01").cast("timestamp_ntz"), "name": F.col("id"), "overlay": F.lit("statt")})
    made = pdf.write_marks(files, marks.records(placed))
    out = {r.doc_id: r for r in made.collect()}
    assert out[1].n_marks == 1 and bytes(out[6].content) == good and out[6].n_marks == 0 and out[7].error == "a mark on page 3 of 2" and out[5].error and out[7].content is None
    assert b"OverlayText" in bytes(out[1].content)
    (a,) = [r for r in pdf.pdf_annotations(made.where("error is null")).collect()]
    assert (a.doc_id, a.page_no, a.subtype, a.rect, a.name, a.contents) == (1, 2, "Redact", [10.0, 802.0, 30.0, 822.0], "d1", "person, Konfidenz 0.90: «Zoë»")
    assert pdf.pdf_pages(files.limit(0)).count() == 0


def test_reviewed_marks_of_files(spark):
    from spanveil.api import annotate_files
    from spanveil.functions.geometry import BOX

    files = spark.createDataFrame([(d, pdf_of(d, "a" * 3001)) for d in (1, 2, 3)], "doc_id long, content binary")
    spot = lambda page: {"page_no": page, "l": 1.0, "t": 2.0, "r": 3.0, "b": 4.0}
    reviewed = spark.createDataFrame([(1, 1, "d1", "ort", 0.9, "x", [spot(1), spot(2)], ""), (2, 1, "d1", "ort", 0.9, "x", [spot(5)], "")], f"doc_id long, ord int, id string, label string, confidence double, text string, boxes array<{BOX}>, overlay string")
    made = annotate_files(files, reviewed)
    assert {r.doc_id: (r.n_marks, r.error) for r in made.collect()} == {1: (2, None), 2: (None, "a mark on page 5 past the last one"), 3: (0, None)}
    assert sorted((r.page_no, r.name) for r in pdf.pdf_annotations(made.where("doc_id = 1")).collect()) == [(1, "d1"), (2, "d1:1")]
