"""Ranks and live admission by many tasks, against plain loops; counts over all groupings."""

import random
from collections import Counter, defaultdict


from spanveil.operators import report
from spanveil.operators import tasks as Q


def test_ranks_of_groups_of_any_size(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), i, rng.randrange(5)) for i in range(3000)]
    rng.shuffle(rows)
    got = Q.ranked(spark.createDataFrame(rows, "g string, seq long, _x int").repartition(7), ["g"], ["seq"], "n")
    assert got.columns == ["g", "seq", "_x", "n"]
    want, seen = {}, Counter()
    for g, i, _ in sorted(rows, key=lambda r: r[1]):
        seen[g] += 1
        want[i] = seen[g]
    assert {r.seq: r.n for r in got.collect()} == want
    assert Q.ranked(spark.createDataFrame([], "g string, seq long"), ["g"], ["seq"], "n").count() == 0


def test_fair_order_of_a_hot_client(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["convert", "redact"]), rng.choice(["hot"] * 8 + ["a", "b", "c", None]), i) for i in range(1500)]
    got = {r.seq: r.queue_position for r in Q.fair_order(spark.createDataFrame(rows, "lane string, client string, seq long").repartition(5)).collect()}
    want = {}
    for lane in ("convert", "redact"):
        waiting = defaultdict(list)
        for x, client, i in rows:
            if x == lane:
                waiting[client].append(i)
        order, turn = list(waiting.values()), 0
        place = 0
        while any(len(w) > turn for w in order):
            for w in order:
                if len(w) > turn:
                    place += 1
                    want[w[turn]] = place
            turn += 1
    assert got == want


def plain(events, bounds):
    now, out = Counter(), {}
    for lane, seq, change in sorted(events, key=lambda e: (e[1], e[2])):
        x = now[lane]
        out[seq, lane, change] = (x, x < bounds[lane] if change > 0 else None)
        now[lane] = min(max(x + change, 0), bounds[lane])
    return out


def test_live_admission(spark):
    """Backlogs that fill and empty over many ranges, lanes without events in some of them, a null lane."""
    bounds = {"convert": 3, "redact": 40, None: 1, "zero": 0}
    for seed in range(3):
        rng = random.Random(seed)
        events = []
        for i in range(2500):
            lane = rng.choice(["convert", "convert", "redact", "redact", None] if i < 1800 else ["redact", "zero"])
            up = 0.75 if (i // 300) % 2 == 0 else 0.3
            events.append((lane, i, 1 if rng.random() < up else -1))
        frame = spark.createDataFrame([(*e, bounds[e[0]], "extra") for e in events], "lane string, seq long, change int, bound int, other string").repartition(6)
        rows = Q.admitted_live(frame).collect()
        assert {(r.seq, r.lane, r.change): (r.waiting, r.admitted) for r in rows} == plain(events, bounds) and rows[0].other == "extra"
    assert Q.admitted_live(frame.limit(0)).count() == 0


def test_live_admission_over_the_events(spark):
    from __spark_entry__ import queries

    d = "/root/testdata/sf0.001"
    got = {(r.seq, r.lane): (r.waiting, r.admitted) for r in queries()["queue_admission_live"](spark, d).collect()}
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type").collect()
    events = [("convert" if r.user_id % 2 == 0 else "redact", r.event_id, 1 if r.event_type in ("view", "click") else -1) for r in rows]
    want = plain(events, {"convert": 16, "redact": 256})
    assert got == {(s, lane): v for (s, lane, _), v in want.items()}


def test_cube(spark):
    rows = [(1, "ort", "de", None, 2), (1, "plz", "de", None, 1), (2, "ort", None, "s", 3), (2, "ort", None, "s", 4), (3, "ort", "de", "s", 1)]
    got = {(r.label, r.lang, r.source, r.grouping_id): (r.n, r.n_docs) for r in report.entity_cube(spark.createDataFrame(rows, "doc_id long, label string, lang string, source string, k long")).collect()}
    want = {}
    for bits in range(8):
        for i, *names, k in rows:
            key = (*(None if bits & b else x for x, b in zip(names, (4, 2, 1), strict=True)), bits)
            n, ids = want.get(key, (0, set()))
            want[key] = (n + k, ids | {i})
    assert got == {k: (n, len(ids)) for k, (n, ids) in want.items()}
