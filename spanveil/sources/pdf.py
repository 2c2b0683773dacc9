"""PDF files as rows: their pages, marks appended to them, and annotations read back.

A file is changed by an update at its end (new objects, their places, a trailer that names the places before),
so its own bytes stay as they are. Read are tables and streams of places, compressed objects, and older versions
behind newer ones. A file that is damaged, encrypted or without pages becomes a row with an error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from functools import lru_cache
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.batches import give_back, parts

#: Bytes that a stream of places or objects may unpack to, and how deep arrays and dictionaries may nest.
MOST_UNPACKED, MOST_DEEP = 1 << 28, 100
LETTER = [0, 0, 612, 792]

_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
# What a value begins with, or all of it, behind blanks and comments; numbers end where a word ends.
_TOKEN = re.compile(
    rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*+(?:(?P<dict><<)|\[(?P<numbers>(?:[+-]?(?:\d+\.?\d*|\.\d+)(?: |(?=\])))++)\]|(?P<list>\[)|(?P<text>\()|(?P<hex><)|/(?P<name>[^\0\t\n\f\r ()<>\[\]{}/%]*)|(?:(?P<first>\d+)[\0\t\n\f\r ]+(?P<second>\d+)[\0\t\n\f\r ]+R|(?P<fixed>true|false|null)"
    rb"|(?P<whole>[+-]?\d+)|(?P<broken>[+-]?(?:\d+\.\d*|\.\d+)))(?![^\0\t\n\f\r ()<>\[\]{}/%])|)"
)
_HEX, _BLANK, _STREAM = re.compile(rb"#([0-9A-Fa-f]{2})"), re.compile(rb"\s"), re.compile(rb"[\0\t\n\f\r ]*stream(\r\n|\n|\r)")
_ODD = re.compile(rb"[^!$&'*-.0-;=?-Z\\^-z|~]")
_OBJ = re.compile(rb"[\0\t\n\f\r ]*(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj")
_RUN = re.compile(rb"[\0\t\n\f\r ]*(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+(?=\d{10} )")
_PLACE = re.compile(rb"[\0\t\n\f\r ]*(\d{10}) (\d{5}) ([nf])")
# What a backslash and a letter stand for in a string.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Unreadable(ValueError):
    """The file can't be read completely."""


class Ref(NamedTuple):
    number: int
    generation: int


class Name(str):
    pass


class Stream(NamedTuple):
    head: dict
    raw: bytes


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    depth, out, i = 1, bytearray(), at + 1
    while depth:
        c = data[i : i + 1]
        if not c:
            raise Unreadable("a string without its end")
        i += 1
        if c == b"\\":
            digits = re.compile(rb"[0-7]{1,3}").match(data, i)
            if digits:
                out.append(int(digits[0], 8) & 255)
                i = digits.end()
            elif data[i : i + 2] == b"\r\n":
                i += 2
            else:
                c = data[i : i + 1]
                out += b"" if c in (b"\n", b"\r") else _ESCAPES.get(c, c)
                i += 1
            continue
        depth += (c == b"(") - (c == b")")
        out += c if depth else b""
    return bytes(out), i


@lru_cache(4096)
def _name(word: bytes) -> Name:
    return Name(_HEX.sub(lambda m: bytes([int(m[1], 16)]), word).decode("latin-1"))


def parse(data: bytes, at: int, deep: int = 0) -> tuple[Any, int]:
    """The value at a place and the place after it."""
    if deep > MOST_DEEP:
        raise Unreadable("values nested too deep")
    token = _TOKEN.match(data, at)
    kind, end = token.lastgroup, token.end()
    if kind == "whole":
        return int(token[kind]), end
    if kind == "broken":
        return Decimal(token[kind].decode("ascii")), end
    if kind == "name":
        return _name(token[kind]), end
    if kind == "numbers":
        return [Decimal(x) if "." in x else int(x) for x in token[kind].decode("ascii").split()], end
    if kind == "dict":
        items, at = _until(data, end, b">>", deep)
        return dict(zip(items[::2], items[1::2], strict=False)), at
    if kind == "list":
        return _until(data, end, b"]", deep)
    if kind == "text":
        return _string(data, end - 1)
    if kind == "hex":
        at, end = end, data.find(b">", end)
        digits = _BLANK.sub(b"", data[at:end]) if end > 0 else b"?"
        try:
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii")), end + 1
        except ValueError as e:
            raise Unreadable("a broken string") from e
    if kind == "second":
        return Ref(int(token["first"]), int(token["second"])), end
    if kind == "fixed":
        return {b"true": True, b"false": False, b"null": None}[token[kind]], end
    raise Unreadable(f"no value at byte {end}")


def _until(data: bytes, at: int, end: bytes, deep: int) -> tuple[list, int]:
    out = []
    while True:
        at = _SKIP.match(data, at).end()
        if data.startswith(end, at):
            return out, at + len(end)
        value, at = parse(data, at, deep + 1)
        out.append(value)


@lru_cache(4096)
def _named(name: str) -> bytes:
    return b"/" + _ODD.sub(lambda m: b"#%02X" % m[0][0], name.encode("latin-1"))


def write(value: Any) -> bytes:
    kind = type(value)
    if kind is int:
        return b"%d" % value
    if kind is float:
        digits = repr(value)
        return _decimal(Decimal(digits)) if "e" in digits or "n" in digits else digits.encode("ascii")
    if kind is Name:
        return _named(value)
    if isinstance(value, dict):
        return b"<<" + b" ".join([_named(k) + b" " + write(v) for k, v in value.items()]) + b">>"
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, (list, tuple)):
        return b"[" + b" ".join(map(write, value)) + b"]"
    if isinstance(value, bytes):
        return b"<" + value.hex().encode("ascii") + b">"
    if isinstance(value, str):
        return write(value.encode("ascii") if value.isascii() else b"\xfe\xff" + value.encode("utf-16-be"))
    if value is None or isinstance(value, bool):
        return {None: b"null", True: b"true", False: b"false"}[value]
    return _decimal(value)


def _decimal(number: Decimal) -> bytes:
    if not number.is_finite():
        raise Unreadable("a number that a file can't hold")
    return format(number, "f").encode("ascii")


def text_of(value: Any) -> str | None:
    if not isinstance(value, bytes):
        return None
    for mark, code in ((b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if value.startswith(mark):
            return value[len(mark) :].decode(code, "replace")
    return value.decode("latin-1")


def unpacked(s: Stream) -> bytes:
    """A stream's bytes; streams of places and objects are plain or deflated, with rows stored as differences or not."""
    kinds, params = s.head.get("Filter"), s.head.get("DecodeParms")
    kind = kinds[0] if isinstance(kinds, list) and len(kinds) == 1 else kinds
    params = params[0] if isinstance(params, list) and params else params
    if kind is None or kind == []:
        return s.raw
    if kind != "FlateDecode":
        raise Unreadable(f"a stream packed as {kind}")
    unpack = zlib.decompressobj()
    try:
        out = unpack.decompress(s.raw, MOST_UNPACKED)
    except zlib.error as e:
        raise Unreadable("a broken stream") from e
    if unpack.unconsumed_tail:
        raise Unreadable("a stream that unpacks to too much")
    params = params if isinstance(params, dict) else {}
    if params.get("Predictor", 1) < 10:
        return out
    width, before, rows = params.get("Columns", 1), bytes(params.get("Columns", 1)), bytearray()
    for i in range(0, len(out), width + 1):
        kind, row = out[i], bytearray(out[i + 1 : i + 1 + width])
        if kind == 1:
            for j in range(1, len(row)):
                row[j] = row[j] + row[j - 1] & 255
        elif kind == 2:
            row = bytearray(a + b & 255 for a, b in zip(row, before))
        elif kind:
            raise Unreadable("rows of a stream stored in a way that isn't known")
        rows, before = rows + row, bytes(row)
    return bytes(rows)


class Pdf:
    """A file's objects by number; the newest version of each counts."""

    def __init__(self, data: bytes) -> None:
        self.data, self.base = data, data[:1024].find(b"%PDF-")
        end = re.search(rb"startxref\s+(\d+)", data[data.rfind(b"startxref") :]) if b"startxref" in data else None
        if self.base < 0 or not end:
            raise Unreadable("not a PDF")
        self.last, self.trailer, self.as_stream = int(end[1]), {}, False
        self.places: dict[int, tuple | None] = {}
        self.packed: dict[int, tuple[list[int], bytes, int]] = {}
        self._pages: list[tuple[Ref, dict, dict]] = []
        at, seen = [self.last], set()
        while at:
            place = at.pop()
            if place in seen or not isinstance(place, int):
                continue
            trailer = self._section(place + self.base)
            self.as_stream = self.as_stream if seen else "Type" in trailer
            seen.add(place)
            self.trailer = trailer | self.trailer
            at += [trailer[k] for k in ("Prev", "XRefStm") if k in trailer]
        if "Encrypt" in self.trailer:
            raise Unreadable("the PDF is encrypted")

    def _section(self, at: int) -> dict:
        at = _SKIP.match(self.data, at).end()
        if not self.data.startswith(b"xref", at):
            s = self._object(at)[1]
            if not isinstance(s, Stream) or s.head.get("Type") != "XRef":
                raise Unreadable("no table of places where one should be")
            rows, (w1, w2, w3) = unpacked(s), s.head["W"]
            index, i = s.head.get("Index") or [0, s.head["Size"]], 0
            for first, count in zip(index[::2], index[1::2], strict=True):
                for n in range(first, first + count):
                    row = rows[i : i + w1 + w2 + w3]
                    i += w1 + w2 + w3
                    if len(row) < w1 + w2 + w3:
                        break
                    kind = int.from_bytes(row[:w1]) if w1 else 1
                    a, b = int.from_bytes(row[w1 : w1 + w2]), int.from_bytes(row[w1 + w2 :])
                    self.places.setdefault(n, {1: ("at", a, b), 2: ("in", a, b)}.get(kind))
            return s.head
        at += 4
        while run := _RUN.match(self.data, at):
            at = run.end()
            for n in range(int(run[1]), int(run[1]) + int(run[2])):
                place = _PLACE.match(self.data, at)
                if not place:
                    raise Unreadable("a broken table of places")
                at = place.end()
                self.places.setdefault(n, ("at", int(place[1]), int(place[2])) if place[3] == b"n" else None)
        at = self.data.find(b"trailer", at)
        trailer = parse(self.data, at + 7)[0] if at >= 0 else None
        if not isinstance(trailer, dict):
            raise Unreadable("no trailer")
        return {k: v for k, v in trailer.items() if k != "Type"}

    def _object(self, at: int) -> tuple[int, Any]:
        head = _OBJ.match(self.data, at)
        if not head:
            raise Unreadable(f"no object at byte {at}")
        value, at = parse(self.data, head.end())
        begin = _STREAM.match(self.data, at)
        if isinstance(value, dict) and begin:
            n = self.get(value.get("Length"))
            if not isinstance(n, int) or n < 0 or begin.end() + n > len(self.data):
                raise Unreadable("a stream without its length")
            value = Stream(value, self.data[begin.end() : begin.end() + n])
        return int(head[1]), value

    def get(self, value: Any) -> Any:
        """The value itself, or what it refers to; null for objects that aren't there."""
        for _ in range(MOST_DEEP):
            if not isinstance(value, Ref):
                return value
            place = self.places.get(value.number)
            if place is None:
                return None
            if place[0] == "at":
                number, value_ = self._object(place[1] + self.base)
                if number != value.number:
                    raise Unreadable(f"object {value.number} isn't at its place")
                value = value_
            else:
                value = self._packed(*place[1:])
        raise Unreadable("references go round")

    def _packed(self, holder: int, i: int) -> Any:
        if holder not in self.packed:
            place = self.places.get(holder)
            s = self._object(place[1] + self.base)[1] if place and place[0] == "at" else None
            if not isinstance(s, Stream) or not isinstance(s.head.get("First"), int):
                raise Unreadable("no stream of objects where one should be")
            body = unpacked(s)
            self.packed[holder] = [int(x) for x in body[: s.head["First"]].split()], body, s.head["First"]
        numbers, body, first = self.packed[holder]
        if 2 * i + 1 >= len(numbers):
            raise Unreadable("an object that its stream doesn't hold")
        return parse(body, first + numbers[2 * i + 1])[0]

    def pages(self) -> list[tuple[Ref, dict, dict]]:
        """Each page in order: its reference, its dictionary, and that with what it takes over from above."""
        if self._pages:
            return self._pages
        root = self.get(self.trailer.get("Root"))
        todo, seen, out = [(root.get("Pages") if isinstance(root, dict) else None, {})], set(), []
        while todo:
            ref, above = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or not isinstance(ref, Ref) or ref in seen:
                raise Unreadable("a broken tree of pages")
            seen.add(ref)
            full = above | node
            if "Kids" in node:
                kids = self.get(node["Kids"])
                if not isinstance(kids, list):
                    raise Unreadable("a broken tree of pages")
                todo += [(k, {x: full[x] for x in ("Rotate", "CropBox", "MediaBox") if x in full}) for k in reversed(kids)]
            else:
                out.append((ref, node, full))
        if not out:
            raise Unreadable("the PDF has no pages")
        self._pages = out
        return out

    def shape(self, page: dict) -> dict:
        """Rotation, and the crop box as stored."""
        box = next((b for b in (self.get(page.get(k)) for k in ("CropBox", "MediaBox")) if isinstance(b, list) and len(b) == 4), LETTER)
        x0, y0, x1, y1 = (float(self.get(v)) for v in box)
        return {"rotation": int(self.get(page.get("Rotate")) or 0), "left": min(x0, x1), "bottom": min(y0, y1), "width": abs(x1 - x0), "height": abs(y1 - y0)}

    def with_annotations(self, marks: list[tuple[int, dict]]) -> bytes:
        """The file with an annotation on a page for each of marks (page number, dictionary)."""
        if not marks:
            return self.data
        pages, changed = self.pages(), {}
        number = max([self.trailer.get("Size", 0), *(n + 1 for n in self.places)])
        for page_no, fields in marks:
            if not 1 <= page_no <= len(pages):
                raise Unreadable(f"a mark on page {page_no} of {len(pages)}")
            ref, page, _ = pages[page_no - 1]
            mark, number = Ref(number, 0), number + 1
            changed[mark] = fields
            page = changed.setdefault(ref, dict(page))
            held = page.get("Annots")
            if isinstance(held, Ref) and isinstance(changed.get(held, self.get(held)), list):
                changed.setdefault(held, list(self.get(held))).append(mark)
            else:
                page["Annots"] = [*(held if isinstance(held, list) else []), mark]
        out, at = bytearray(self.data + b"\n"), {}
        for ref, value in changed.items():
            place = self.places.get(ref.number)
            generation = place[2] if place and place[0] == "at" else 0
            at[ref.number] = (len(out) - self.base, generation)
            out += b"%d %d obj\n" % (ref.number, generation) + write(value) + b"\nendobj\n"
        start = len(out) - self.base
        trailer = {k: v for k, v in self.trailer.items() if k in ("Root", "Info", "ID")} | {"Prev": self.last}
        if self.as_stream:
            at[number] = (start, 0)
            rows = b"".join(b"\1" + p.to_bytes(8) + g.to_bytes(2) for _, (p, g) in sorted(at.items()))
            index = [x for n in sorted(at) for x in (n, 1)]
            head = {"Type": Name("XRef"), "Size": number + 1, "W": [1, 8, 2], "Index": index, "Length": len(rows)} | trailer
            out += b"%d 0 obj\n" % number + write(head) + b"\nstream\n" + rows + b"\nendstream\nendobj\n"
        else:
            out += b"xref\n" + b"".join(b"%d 1\n%010d %05d n \n" % (n, *p) for n, p in sorted(at.items()))
            out += b"trailer\n" + write({"Size": number} | trailer) + b"\n"
        return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def _fields(r: dict) -> dict:
    """An annotation's dictionary for a record of operators/marks.py."""
    out = {"Type": Name(r["type"].strip("/")), "Subtype": Name(r["subtype"].strip("/")), "Rect": r["rect"], "QuadPoints": r["quad_points"], "C": r["c"], "IC": r["ic"], "F": r["f"]}
    out |= {"T": r["t"], "Subj": r["subj"], "Contents": r["contents"], "NM": r["nm"], "CreationDate": r["created"], "M": r["created"]}
    return out | ({"OverlayText": r["overlay_text"]} if r["overlay_text"] else {})


def _each(rows: DataFrame, schema: str, make: Callable[[dict], list[dict]]) -> DataFrame:
    """rows(doc_id, content, ...) through make, few files at a time; a file that can't be read gives a row with its error."""
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, {schema}, error string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def of(row: dict) -> list[dict]:
        try:
            out = make(row)
        except (Unreadable, KeyError, TypeError, ValueError, ArithmeticError, AttributeError, IndexError) as e:
            out = [{"error": str(e) if isinstance(e, Unreadable) else f"the PDF is broken: {e!r}"}]
        return [{"doc_id": row["doc_id"]} | o for o in out]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in parts(batch.columns):
                made = [o for row in pa.RecordBatch.from_arrays(columns, batch.schema.names).to_pylist() for o in of(row)]
                yield pa.RecordBatch.from_pylist(made, schema=arrow)
        give_back()

    return rows.mapInArrow(run, schema)


def pdf_pages(files: DataFrame) -> DataFrame:
    """files(doc_id, content): a row for each page with its shape (page_no, rotation, left, bottom, width, height), or one with an error."""

    def make(row: dict) -> list[dict]:
        pdf = Pdf(row["content"] or b"")
        return [{"page_no": n} | pdf.shape(full) for n, (_, _, full) in enumerate(pdf.pages(), 1)]

    return _each(files.select("doc_id", "content"), "page_no int, rotation int, left double, bottom double, width double, height double", make)


def write_marks(files: DataFrame, records: DataFrame) -> DataFrame:
    """files(doc_id, content) with the annotation records of ``marks.records`` appended: doc_id, content, n_marks, error.

    A document's marks come in the order of pages, then names. Without marks a file stays as it is.
    """
    fields = [c for c in records.columns if c != "doc_id"]
    order = ["page_no", "nm", *(c for c in fields if c not in ("page_no", "nm"))]
    of_doc = records.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("marks"))

    def make(row: dict) -> list[dict]:
        marks = [(m["page_no"], _fields(m)) for m in row["marks"] or []]
        pdf = Pdf(row["content"] or b"")
        pdf.pages()
        return [{"content": pdf.with_annotations(marks), "n_marks": len(marks)}]

    return _each(files.select("doc_id", "content").join(of_doc, "doc_id", "left"), "content binary, n_marks int", make)


def pdf_annotations(files: DataFrame) -> DataFrame:
    """files(doc_id, content): a row for each annotation, in the order of pages (page_no, subtype, rect, name, contents), or one with an error."""

    def make(row: dict) -> list[dict]:
        pdf, out = Pdf(row["content"] or b""), []
        for n, (_, page, _) in enumerate(pdf.pages(), 1):
            for ref in pdf.get(page.get("Annots")) or []:
                a = pdf.get(ref)
                rect = [float(pdf.get(x)) for x in pdf.get(a.get("Rect")) or []]
                out.append({"page_no": n, "subtype": pdf.get(a.get("Subtype")), "rect": rect, "name": text_of(pdf.get(a.get("NM"))), "contents": text_of(pdf.get(a.get("Contents")))})
        return out

    return _each(files.select("doc_id", "content"), "page_no int, subtype string, rect array<double>, name string, contents string", make)
