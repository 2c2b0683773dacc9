"""A converter's JSON as tables: regions, pictures, page sizes, words and text lines.

The JSON is that of the public docling document format: ``texts``, ``tables`` and ``pictures`` with places
(``prov``) on pages and ``children`` by reference, and for each page its cells as rectangles of four corners. Boxes may count
from the bottom left; here all count from the top left.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

BBOX = "struct<l:double,t:double,r:double,b:double,coord_origin:string>"
PROV = f"array<struct<page_no:int,bbox:{BBOX}>>"
CLASSES = "array<struct<class_name:string,confidence:double>>"
REFS = "array<struct<`$ref`:string>>"
ITEM = f"prov:{PROV},children:{REFS}"
#: A picture's classes, in the form of today and in an older one.
SEEN = f"annotations:array<struct<kind:string,predicted_classes:{CLASSES}>>,meta:struct<classification:struct<predictions:{CLASSES}>>"
DOCUMENT = f"""struct<pages:map<string,struct<page_no:int,size:struct<width:double,height:double>>>, body:struct<children:{REFS}>, groups:array<struct<children:{REFS}>>,
 texts:array<struct<{ITEM}>>, tables:array<struct<{ITEM},data:struct<table_cells:array<struct<bbox:{BBOX}>>>>>,
 pictures:array<struct<{ITEM},captions:{REFS},{SEEN}>>, key_value_items:array<struct<{ITEM}>>, form_items:array<struct<{ITEM}>>>"""
#: The lists that hold a document's items, in the order that counts where a document has no tree.
KINDS = ("texts", "tables", "pictures", "key_value_items", "form_items")
RECT = "struct<r_x0:double,r_y0:double,r_x1:double,r_y1:double,r_x2:double,r_y2:double,r_x3:double,r_y3:double,coord_origin:string>"
CELL = f"struct<rect:{RECT},text:string,from_ocr:boolean,rendering_mode:int>"
PAGES = f"map<string,struct<dimension:struct<rect:{RECT}>,textline_cells:array<struct<rect:{RECT}>>,word_cells:array<{CELL}>>>"
#: The rendering mode of text that is not drawn.
INVISIBLE = 3


def parsed(docs: DataFrame, document: str = "document") -> DataFrame:
    """docs(doc_id, document) with the document read as ``d``; null where it is no JSON of that form."""
    return docs.select("doc_id", F.from_json(document, DOCUMENT).alias("d"))


def page_sizes(parsed_: DataFrame) -> DataFrame:
    """(doc_id, page_no, width, height), in points."""
    return parsed_.select("doc_id", F.explode("d.pages").alias("no", "p")).select("doc_id", F.col("no").cast("int").alias("page_no"), "p.size.width", "p.size.height")


def _placed(places: Column) -> Column:
    """Of places(page_no, bbox) of a document: the boxes from the top left, on pages that the document has."""
    sizes = F.transform(F.map_entries("d.pages"), lambda e: F.struct(e["key"].cast("int").alias("page_no"), e["value"]["size"]["height"].alias("height")))

    def boxes(p: Column) -> Column:
        x, up = p["bbox"], F.coalesce(p["bbox"]["coord_origin"] == "BOTTOMLEFT", F.lit(False))
        own = F.filter(sizes, lambda s: s["page_no"] == p["page_no"])
        return F.transform(own, lambda s: G.top_left(p["page_no"], x["l"], x["t"], x["r"], x["b"], s["height"], up))

    return F.flatten(F.transform(places, boxes))


def _refs(children: Column) -> Column:
    return F.transform(F.coalesce(children, F.array().cast(REFS)), lambda c: c["$ref"])


def _walked(roots: pa.Array, names: pa.Array, children: pa.Array) -> pa.Array:
    """For each document the places in ``names`` of what its tree reaches, parents before children, in order; a reference counts once."""
    rows = []
    for root, own, lists in zip(roots, names, children, strict=True):
        if not root.is_valid:
            rows.append(None)
            continue
        own, lists = own.as_py() or [], lists.as_py() or []
        at, seen, out = {ref: i for i, ref in enumerate(own)}, set(), []
        open_ = root.as_py()[::-1]
        while open_:
            i = at.get(open_.pop())
            if i is not None and i not in seen:  # a reference to nothing, or one met before, leads nowhere
                seen.add(i)
                out.append(i)
                open_ += lists[i][::-1]
        rows.append(out)
    return pa.array(rows, pa.list_(pa.int32()))


NODE = f"struct<ref:string,children:array<string>,item:boolean,places:array<struct<page_no:int,bbox:{BBOX}>>>"


def _nodes(kind: str) -> Column:
    """A list's nodes with their places: those of an item, then the cells of a table, on its first page."""

    def node(x: Column, i: Column) -> Column:
        places = F.array().cast(PROV) if kind == "groups" else F.coalesce(x["prov"], F.array().cast(PROV))
        if kind == "tables":
            first = F.get(x["prov"], F.lit(0))["page_no"]
            cells = F.transform(F.filter(x["data"]["table_cells"], lambda c: c["bbox"].isNotNull()), lambda c: F.struct(first.alias("page_no"), c["bbox"].alias("bbox")))
            places = F.concat(places, F.coalesce(F.when(F.size(x["prov"]) > 0, cells).cast(PROV), F.array().cast(PROV)))
        return F.struct(F.concat(F.lit(f"#/{kind}/"), i.cast("string")).alias("ref"), _below(kind, x).alias("children"), F.lit(kind != "groups").alias("item"), places.alias("places"))

    return F.transform(F.coalesce(f"d.{kind}", F.array()), node).cast(f"array<{NODE}>")


def _read(parsed_: DataFrame) -> DataFrame:
    """parsed_ with ``n``, a document's nodes, and ``walk``, the places in it of those that its tree reaches, in reading order.

    The tree starts at the body and goes through groups and items to their children by JSON references,
    parents first. Inside a picture only its captions count. A document without a body has its lists' order.
    All of it is in the document's own row: nothing is shuffled or broadcast.
    """
    each = parsed_.where("d is not null").withColumn("n", F.concat(*(_nodes(k) for k in ("groups", *KINDS))))
    root = F.when(F.col("d.body").isNotNull(), _refs(F.col("d.body.children")))
    walk = F.arrow_udf(_walked, "array<int>").asNondeterministic()(root, F.transform("n", lambda x: x["ref"]), F.transform("n", lambda x: x["children"]))
    listed = F.filter(F.transform("n", lambda x, i: F.when(x["item"], i)), lambda i: i.isNotNull())
    return each.withColumn("_w", walk).withColumn("walk", F.coalesce("_w", listed)).drop("_w")


def reading_order(parsed_: DataFrame) -> DataFrame:
    """(doc_id, ref, place) of all items that the document's tree reaches, all content layers, in reading order (see _read)."""
    return _read(parsed_).select("doc_id", F.posexplode(F.transform("walk", lambda i: F.get("n", i)["ref"])).alias("place", "ref"))


def _below(kind: str, item: Column) -> Column:
    below = _refs(item["children"])
    return F.array_intersect(below, _refs(item["captions"])) if kind == "pictures" else below


def regions(parsed_: DataFrame) -> DataFrame:
    """(doc_id, region_idx, box): each place of each item, then each cell of a table on its first page, in reading order.

    Units of text follow these numbers. Items that the document's tree doesn't reach are no regions.
    """
    places = F.flatten(F.transform("walk", lambda i: F.get("n", i)["places"]))
    return _read(parsed_).select("doc_id", F.posexplode(_placed(places)).alias("region_idx", "box"))


def pictures(parsed_: DataFrame) -> DataFrame:
    """(doc_id, box, classes): each place of each picture, with what the classifier takes it for."""
    reached = F.array_distinct(F.transform("walk", lambda i: F.get("n", i)["ref"]))
    mine = F.filter(F.transform("d.pictures", lambda x, i: F.struct(F.concat(F.lit("#/pictures/"), i.cast("string")).alias("ref"), x.alias("x"))), lambda p: F.array_contains(reached, p["ref"]))
    items = _read(parsed_).select("doc_id", "d", F.explode(mine).alias("p")).select("doc_id", "d", "p.x")
    older = F.flatten(F.transform(F.filter(F.coalesce("x.annotations", F.array()), lambda a: a["predicted_classes"].isNotNull()), lambda a: a["predicted_classes"]))
    pairs = F.coalesce("x.meta.classification.predictions", older)
    classes = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda c: c["class_name"])), lambda n: F.struct(n, F.array_max(F.transform(F.filter(pairs, lambda c: c["class_name"] == n), lambda c: F.coalesce(c["confidence"], F.lit(0.0)))))))
    return items.select("doc_id", F.explode(_placed(F.col("x.prov"))).alias("box"), classes.alias("classes"))


def _around(rect: Column, page: Column, height: Column) -> Column:
    """The box around a rectangle's corners."""
    xs, ys = ([rect[f"r_{c}{i}"] for i in range(4)] for c in "xy")
    up = F.coalesce(rect["coord_origin"] == "BOTTOMLEFT", F.lit(False))
    return G.top_left(page, F.least(*xs), F.when(up, F.greatest(*ys)).otherwise(F.least(*ys)), F.greatest(*xs), F.when(up, F.least(*ys)).otherwise(F.greatest(*ys)), height, up)


def cells(docs: DataFrame, pages: str = "pages") -> tuple[DataFrame, DataFrame]:
    """Of docs(doc_id, pages): words (doc_id, page_no, word_idx, text, box, drawn, read) and text lines (doc_id, page_no, line_idx, box).

    Blank words are left out; a page's height is that of its own rectangle.
    """
    each = docs.select("doc_id", F.explode(F.from_json(pages, PAGES)).alias("no", "p")).withColumn("page_no", F.col("no").cast("int"))
    rect = F.col("p.dimension.rect")
    ys = [rect[f"r_y{i}"] for i in range(4)]
    each = each.withColumn("height", F.greatest(*ys) - F.least(*ys))
    words = each.select("doc_id", "page_no", "height", F.posexplode("p.word_cells").alias("word_idx", "c")).where(F.trim(F.regexp_replace("c.text", r"(?U)\s+", " ")) != "")
    words = words.select("doc_id", "page_no", "word_idx", "c.text", _around(F.col("c.rect"), F.col("page_no"), F.col("height")).alias("box"), (~F.col("c.rendering_mode").eqNullSafe(F.lit(INVISIBLE))).alias("drawn"), F.coalesce("c.from_ocr", F.lit(False)).alias("read"))
    lines = each.select("doc_id", "page_no", "height", F.posexplode("p.textline_cells").alias("line_idx", "c"))
    return words, lines.select("doc_id", "page_no", "line_idx", _around(F.col("c.rect"), F.col("page_no"), F.col("height")).alias("box"))
