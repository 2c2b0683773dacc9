"""Words of pages to text units, and places in texts back to boxes.

Theta joins run inside (doc_id, page_no): an equi-join on these and a condition on boxes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.arrays import gathered_fully, running_sums
from ..functions.batches import by_parts

PAGE = ["doc_id", "page_no"]
UNIT_GAP = "\n\n"
#: Characters of a stretch of text in which mentions and units meet.
STRETCH = 256
PICTURE_CLASSES, PICTURE_CONFIDENCE = ("signature",), 0.2


def incomplete_pages(page_counts: DataFrame, words: DataFrame) -> DataFrame:
    """Pages of 1..pages without a word, and page 0 for a document without pages."""
    every = page_counts.select("doc_id", F.explode(F.when(F.col("pages") > 0, F.sequence(F.lit(1), F.col("pages"))).otherwise(F.array(F.lit(0)))).alias("page_no"))
    return every.join(words.select(*PAGE).distinct(), PAGE, "left_anti")


def inside(box: str, point_of: str) -> Column:
    return G.contains(F.col(box), *G.centre(F.col(point_of)))


#: Points to a side of the grid's cells.
CELL = 128.0


def _cell(v: Column) -> Column:
    return F.floor(v / CELL)


def with_cells(rows: DataFrame, box: str) -> DataFrame:
    """Rows of boxes, one for each grid cell they touch: a point is then met through its one cell."""
    for axis, lo, hi in (("_cx", "l", "r"), ("_cy", "t", "b")):
        rows = rows.withColumn(axis, F.explode(F.sequence(_cell(F.col(f"{box}.{lo}")), _cell(F.greatest(f"{box}.{lo}", f"{box}.{hi}")))))
    return rows


def at_centre(rows: DataFrame, box: str) -> DataFrame:
    x, y = G.centre(F.col(box))
    return rows.withColumn("_cx", _cell(x)).withColumn("_cy", _cell(y))


NEAR = [*PAGE, "_cx", "_cy"]
LINE = [*PAGE, "line_idx"]


def words_to_lines(words: DataFrame, lines: DataFrame) -> DataFrame:
    """words with ``line_idx``, the first line that holds the word's centre, else a line of its own, -1 - word_idx; and ``line_first``,
    the first word of that line. Blank words go. A line's first word may be one that is passed over later, so all words come here."""
    near = with_cells(lines.select(*PAGE, "line_idx", F.col("box").alias("_line")), "_line")
    full = words.where(F.trim(F.regexp_replace("text", r"(?U)\s", "")) != "")
    joined = at_centre(full, "box").join(near, NEAR, "left").withColumn("_hit", F.when(inside("_line", "box"), F.col("line_idx")))
    keys = [c for c in words.columns if c not in ("text", "box", "drawn", "read")]
    best = joined.groupBy(*keys).agg(F.min("_hit").alias("_hit"), F.first("text").alias("text"), F.first("box").alias("box"), F.first("drawn").alias("drawn"), F.first("read").alias("read"))
    return best.withColumn("line_idx", F.coalesce("_hit", -1 - F.col("word_idx"))).withColumn("line_first", F.min("word_idx").over(Window.partitionBy(*LINE))).drop("_hit")


def drop_read_over_drawn(words: DataFrame) -> DataFrame:
    """words without those read from pixels whose centre lies in a drawn word's box."""
    drawn = with_cells(words.where("drawn and not read").select(*PAGE, F.col("box").alias("_drawn")), "_drawn")
    read = at_centre(words.where("read"), "box").join(drawn, NEAR)
    over = read.where(inside("_drawn", "box")).select("doc_id", "page_no", "word_idx").distinct()
    return words.where("not read").unionByName(words.where("read").join(over, ["doc_id", "page_no", "word_idx"], "left_anti"))


def words_to_regions(words: DataFrame, regions: DataFrame) -> DataFrame:
    """words with ``region_idx``: the smallest region on the page that holds the centre, the first of equal ones; null outside all."""
    near = with_cells(regions.select("doc_id", F.col("box.page_no").alias("page_no"), "region_idx", F.col("box").alias("_region")), "_region")
    hits = at_centre(words, "box").join(near, NEAR).where(inside("_region", "box"))
    best = hits.groupBy("doc_id", "page_no", "word_idx").agg(F.min_by("region_idx", F.struct(G.area(F.col("_region")), "region_idx")).alias("region_idx"))
    return words.join(best, ["doc_id", "page_no", "word_idx"], "left")


def text_units(words: DataFrame) -> DataFrame:
    """Units of words(doc_id, page_no, word_idx, text, box, line_idx, line_first, read, region_idx, hidden): one for each region, then
    one for each line outside regions; shown words before hidden ones.

    A row: doc_id, unit_idx, text, box, words (text, box, start, end in the unit's text).
    A line's words are joined by spaces; a word broken by a hyphen at a line's end is written whole. Words
    drawn and words read from pixels make lines of their own, also where they stand in one line. Outside regions
    a page's drawn lines come before those that are read, each in the order of the line's first word of any kind.
    Without ``line_first`` the line's words that are given decide, without ``read`` all are drawn.
    """
    if "line_first" not in words.columns:
        words = words.withColumn("line_first", F.min("word_idx").over(Window.partitionBy(*LINE)))
    if "read" not in words.columns:
        words = words.withColumn("read", F.lit(False))
    word = F.struct("word_idx", "text", "box")
    # Dealt by document once: runs, units and their numbers are then made without another shuffle of the words.
    run = words.repartition("doc_id").groupBy("doc_id", "page_no", "hidden", "read", "region_idx", "line_idx", "line_first").agg(F.array_sort(F.collect_list(word)).alias("w"), F.min("box.t").alias("top"), F.min("box.l").alias("left"))
    # In a region lines go from the top; outside, each line is a unit.
    loose = F.col("region_idx").isNull()
    unit = F.struct(F.when(loose, F.col("page_no")).otherwise(0).cast("int").alias("page"), (loose & F.col("read")).alias("read"), F.when(loose, F.col("line_first")).otherwise(F.col("region_idx")).cast("long").alias("place"))
    grouped = run.withColumn("loose", loose).withColumn("u", unit).groupBy("doc_id", "hidden", "loose", "u").agg(F.array_sort(F.collect_list(F.struct("top", "left", "read", "line_first", "w"))).alias("lines"))
    flat = F.flatten(F.transform("lines", lambda ln: F.transform(ln["w"], lambda x, i: F.struct(x["text"].alias("text"), x["box"].alias("box"), (i == F.size(ln["w"]) - 1).alias("ends")))))
    out = grouped.withColumn("f", flat)
    following = lambda i: F.when(i + 1 < F.size("f"), F.element_at("f", F.least(i + 2, F.size("f")))["text"]).otherwise("")
    broken = F.transform("f", lambda x, i: x["ends"] & x["text"].rlike(r"\p{L}-$") & following(i).rlike(r"^\p{L}"))
    out = out.withColumn("broken", broken)
    piece = F.transform(F.arrays_zip("f", "broken"), lambda z, i: F.struct(F.when((i == 0) | F.element_at("broken", F.greatest(i, F.lit(1))), "").otherwise(" ").alias("gap"), F.when(z["broken"], F.substring(z["f"]["text"], F.lit(1), F.length(z["f"]["text"]) - 1)).otherwise(z["f"]["text"]).alias("text"), z["f"]["box"].alias("box")))
    out = out.withColumn("p", piece)
    # Where each piece begins with its gap, by running sums.
    out = out.withColumn("at", running_sums(F.transform("p", lambda x: F.length(x["gap"]) + F.length(x["text"]))))

    def span(x: Column, i: Column) -> Column:
        begin = F.get("at", i) + F.length(x["gap"])
        return F.struct(x["text"].alias("text"), x["box"].alias("box"), begin.cast("int").alias("start"), (begin + F.length(x["text"])).cast("int").alias("end"))

    spans = F.transform("p", span)
    boxes = F.transform("p", lambda x: x["box"])
    whole = F.aggregate(F.slice(boxes, 2, F.size(boxes)), F.element_at(boxes, 1).cast(G.BOX), lambda a, b: G.union(a, b))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("hidden", "loose", "u")) - 1
    return out.select("doc_id", number.alias("unit_idx"), F.array_join(F.transform("p", lambda x: F.concat(x["gap"], x["text"])), "").alias("text"), whole.alias("box"), spans.alias("words"))


def join_units(units: DataFrame) -> DataFrame:
    """(doc_id, text, starts): units' texts with blank lines between, the gap left out while the text is empty."""
    ordered = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit_idx", "text"))).alias("u"))
    texts = F.transform("u", lambda x: x["text"])
    # The gap goes before each text after the first that isn't empty.
    first = F.array_position(F.transform(texts, lambda t: t != ""), F.lit(True))
    ordered = ordered.withColumn("gaps", F.transform("u", lambda x, i: F.when((first > 0) & (i + 1 > first), F.lit(UNIT_GAP)).otherwise("")))
    ordered = ordered.withColumn("at", running_sums(F.transform("u", lambda x, i: F.length(x["text"]) + F.length(F.get("gaps", i)))))
    starts = F.transform("at", lambda a, i: (a + F.length(F.get("gaps", i))).cast("int"))
    return ordered.select("doc_id", F.array_join(F.transform("u", lambda x, i: F.concat(F.get("gaps", i), x["text"])), "").alias("text"), starts.alias("starts"))


def split_mentions(mentions: DataFrame, units: DataFrame) -> DataFrame:
    """Pieces of mentions(doc_id, mention_no, start, end) in units(doc_id, unit_idx, u_start, u_end): start and end in the unit.

    Both sides are dealt to stretches of the text; a pair comes from the first stretch that it shares, so the join is on
    equal stretches and its work follows the pieces. An empty unit or mention lies in the stretch of its place.
    """

    def dealt(rows: DataFrame, low: str, high: str, first: str) -> DataFrame:
        at = lambda c: F.floor(c / STRETCH)
        return rows.withColumn(first, at(F.col(low))).withColumn("_stretch", F.explode(F.sequence(first, F.greatest(F.col(first), at(F.col(high) - 1)))))

    pairs = dealt(mentions, "start", "end", "_m").join(dealt(units, "u_start", "u_end", "_u").hint("merge"), ["doc_id", "_stretch"])
    joined = pairs.where(F.col("_stretch") == F.greatest("_m", "_u")).where("u_start < end and start < u_end")
    return joined.select("doc_id", "mention_no", "unit_idx", (F.greatest("start", "u_start") - F.col("u_start")).alias("start"), (F.least("end", "u_end") - F.col("u_start")).alias("end"))


def cut_mentions(mentions: Column, units: Column) -> Column:
    """split_mentions() in a document's row: pieces (mention_no, unit_idx, start, end) of mentions in reading order.

    Units have start and end in the text; they come in order, hold a character at least and don't overlap.
    """

    def run(*columns: list) -> list[list[dict] | None]:
        rows = []
        for starts, ends, u_starts, u_ends in zip(*columns, strict=True):
            if starts is None or u_starts is None:
                rows.append(None)
                continue
            met = ((n, u, a, b) for n, (a, b) in enumerate(zip(starts, ends, strict=True), 1) for u in range(bisect_right(u_ends, a), bisect_left(u_starts, b)))
            rows.append([{"mention_no": n, "unit_idx": u, "start": max(a - u_starts[u], 0), "end": min(b, u_ends[u]) - u_starts[u]} for n, u, a, b in met])
        return rows

    each = (F.transform(rows, end) for rows in (mentions, units) for end in (lambda x: x["start"], lambda x: x["end"]))
    return by_parts(run, "array<struct<mention_no:int,unit_idx:int,start:int,end:int>>")(*each)


def touched_boxes(words: Column, start: Column, end: Column) -> Column:
    """Padded boxes of the words that a piece touches."""
    return F.transform(F.filter(words, lambda w: (w["start"] < end) & (start < w["end"])), lambda w: G.padded(w["box"]))


def bars(boxes: Column) -> Column:
    """The boxes of one piece run together into bars.

    Two boxes of a page make one if they overlap by more than half of the smaller one, up and
    down or left and right; over again until no two do.
    """

    def share(a: Column, b: Column, low: str, high: str) -> Column:
        return F.least(a[high], b[high]) - F.greatest(a[low], b[low]) > F.least(a[high] - a[low], b[high] - b[low]) / 2

    def alike(a: Column, b: Column) -> Column:
        return F.coalesce((a["page_no"] == b["page_no"]) & (share(a, b, "t", "b") | share(a, b, "l", "r")), F.lit(False))

    return gathered_fully(boxes, f"array<{G.BOX}>", alike, G.union)


def picture_marks(pictures: DataFrame) -> DataFrame:
    """Marks on pictures(doc_id, box, classes) that are signatures."""
    out = None
    for name in PICTURE_CLASSES:
        score = F.coalesce(F.element_at("classes", name), F.lit(0.0))
        part = pictures.where(score >= PICTURE_CONFIDENCE).select("doc_id", "box", F.lit(name).alias("label"), score.alias("confidence"), F.lit("").alias("text"), F.lit("").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def in_reading_order(spans: Column) -> Column:
    """A document's spans as mention_numbers() counts them."""
    whole = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["label_ord"].alias("b"), s["ord"].alias("c"), s.alias("s"))))
    return F.transform(whole, lambda x: x["s"])


def mention_numbers(spans: DataFrame) -> DataFrame:
    """Mentions in reading order: d1, d2, ... by start, then by label and place in its list."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "label_ord", "ord"))
    return spans.withColumn("mention_no", n).withColumn("mention_id", F.concat(F.lit("d"), n.cast("string")))
