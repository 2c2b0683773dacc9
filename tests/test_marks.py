"""Marks of one document in any number, and mentions cut by units, against plain Python."""

from __future__ import annotations

import random
import time

from spanveil.operators import layout, marks


def united(boxes):
    """Each box into the first one before it that covers six tenths of it, or is covered so."""

    def part(a, b):
        w, h = max(0.0, min(a[3], b[3]) - max(a[1], b[1])), max(0.0, min(a[4], b[4]) - max(a[2], b[2]))
        size = max(0.0, a[3] - a[1]) * max(0.0, a[4] - a[2])
        return w * h / size if size and a[0] == b[0] else 0.0

    out = []
    for n, b in enumerate(boxes):
        twin = next((m for m in out if max(part(m[1], b), part(b, m[1])) >= 0.6), None)
        if twin is None:
            out.append([n, b])
        else:
            a = twin[1]
            twin[1] = (a[0], min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]))
    return sorted(map(tuple, out))


def merged(spark, boxes):
    rows = [(1, n, "", dict(zip(("page_no", "l", "t", "r", "b"), b)), "x", 0.5, "t") for n, b in enumerate(boxes)]
    got = marks.merge_unnamed(spark.createDataFrame(rows, marks.MARK)).collect()
    return sorted((r.ord, tuple(r.box)) for r in got)


def test_boxes_of_all_sizes(spark):
    rng = random.Random(11)
    boxes = []
    for _ in range(700):
        w, h = (rng.choice((0.0, 0.5, 3.0, 12.0, 12.0, 40.0, 300.0)) * rng.uniform(0.5, 1.5) for _ in "wh")
        x, y = rng.uniform(-100, 500), rng.uniform(-100, 700)
        boxes.append((rng.choice((1, 2)), x, y, x + w, y + h))
    boxes += [(1, 50.0, 50.0, 40.0, 60.0), boxes[3], boxes[3], (2, 0.0, 0.0, 0.0, 0.0)]
    want = united(boxes)
    assert merged(spark, boxes) == want and len(want) < len(boxes)


def test_marks_that_are_not_wholly_known_stand_alone(spark):
    odd = [(None, 0.0, 0.0, 10.0, 10.0), (1, None, 0.0, 10.0, 10.0), (1, 0.0, 0.0, float("inf"), 10.0), (1, float("nan"), 0.0, 10.0, 10.0)]
    good = [(1, 0.0, 0.0, 10.0, 10.0), (1, 1.0, 0.0, 10.0, 10.0)]
    assert sorted(n for n, _ in merged(spark, odd + good)) == [0, 1, 2, 3, 4]
    assert merged(spark, []) == []


def test_a_hundred_thousand_marks_of_one_document_and_label(spark):
    rng = random.Random(12)
    places = [(x * 10.0, y * 5.0) for x in range(250) for y in range(200)]
    boxes = [(1, x, y, x + 9.0, y + 4.5) for x, y in places for _ in "ab"]
    rng.shuffle(boxes)
    began = time.monotonic()
    got = merged(spark, boxes)
    assert sorted(b for _, b in got) == sorted(set(boxes)) and len(got) == len(places)
    assert time.monotonic() - began < 60


def test_mentions_cut_by_units(spark):
    rng = random.Random(13)
    units, mentions = [], []
    for d in range(4):
        at = 0
        for u in range(120):
            n = rng.choice((0, 1, 5, 80, 256, 255, 900 if d else 3))
            units.append((d, u, at, at + n))
            at += n + rng.choice((0, 2))
        for m in range(80):
            begin = rng.randrange(at)
            mentions.append((d, m, begin, begin + rng.choice((0, 1, 20, 256, 3000))))
    want = sorted((d, m, u, max(s, us) - us, min(e, ue) - us) for d, m, s, e in mentions for d2, u, us, ue in units if d == d2 and us < e and s < ue)
    got = layout.split_mentions(spark.createDataFrame(mentions, "doc_id long, mention_no int, start int, end int"), spark.createDataFrame(units, "doc_id long, unit_idx int, u_start int, u_end int"))
    assert sorted(map(tuple, got.collect())) == want and want
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()
