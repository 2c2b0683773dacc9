"""Span operators: golden cases, and folds against plain Python on random spans."""

import random
import re
import subprocess
import sys
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanveil.api import anonymize_text, load_blacklist, load_entity_types
from spanveil.functions.catalog import REPEATING_LABELS, extended, filled
from spanveil.functions.folding import find, fold, fold_batch, is_scrap, stopwords
from spanveil.operators import detect as D
from spanveil.operators import redact, spans
from spanveil.operators.propagate import accept, find_exact, needles, propagate
from spanveil.plans.queries import QUERIES

FIELDS = ("label", "label_ord", "ord", "id", "text", "start", "end", "confidence")


def doc(spark, text, found):
    """found: label -> list of (start, end) or (start, end, id)."""
    rows = [(label, k, i, s[2] if len(s) > 2 else i + 1, text[s[0] : s[1]], s[0], s[1], 0.9 - i / 100) for k, (label, ss) in enumerate(found.items()) for i, s in enumerate(ss)]
    return spark.createDataFrame([(1, text, rows)], f"doc_id long, text string, spans {D.SPANS}")


def out(df):
    return [tuple(s) for s in df.select("spans").first()[0]]


def carried(spark, text, found, everywhere=False):
    return {(s[0], s[3], s[4], s[5]) for s in out(propagate(doc(spark, text, found), everywhere))}


def at(text, *parts):
    """Where each part begins and ends; a part named twice is looked for after the one before."""
    out, upto = [], 0
    for p in parts:
        a = text.index(p, upto)
        out.append((a, a + len(p)))
        upto = a + len(p)
    return out


def test_repeats(spark):
    t = "Gestern sprach Lena Vogt vor. Frau Vogt brachte ihren Hund mit."
    assert carried(spark, t, {"person": at(t, "Lena Vogt")}) == {("person", 1, "Lena Vogt", 15), ("person", 2, "Vogt", 35)}
    t = "Olten oder Olten"
    assert len(carried(spark, t, {"ort": at(t, "Olten"), "organisation": [(11, 16)]})) == 2  # what is taken stays
    t = "Frist 3. Mai 2031, verlegt vom 3. Mai 2031."
    assert carried(spark, t, {"datum": at(t, "3. Mai 2031")}) == {("datum", 1, "3. Mai 2031", 6)}  # dates aren't carried
    t = "Das Amt in Uster. Der Verein Uster-West klagt."
    assert len(carried(spark, t, {"ort": at(t, "Uster")})) == 1  # nor into compounds
    t = "Kern GmbH mahnt, Kern GmbH zahlt."
    assert {x[1] for x in carried(spark, t, {"organisation": [(0, 9, 7)]}, True)} == {7, 8}  # numbers go on after the label's last
    t = "Erbin ist Runa Abegglen, es zeichnet Runa Abegglen"
    for everywhere in (False, True):  # whole names go before surnames
        assert [x[2] for x in sorted(carried(spark, t, {"person": at(t, "Runa Abegglen")}, everywhere))] == ["Runa Abegglen"] * 2


def test_repeats_everywhere_in_broken_text(spark):
    t = "Seit 7. Juli 1999 in Affoltern-Weiher, am 7.\nJuli 1999 von AffolternWeiher weg."
    got = {x[2] for x in carried(spark, t, {"datum": at(t, "7. Juli 1999"), "ort": at(t, "Affoltern-Weiher")}, True)}
    assert got == {"7. Juli 1999", "7.\nJuli 1999", "Affoltern-Weiher", "AffolternWeiher"}


def test_needles_with_odd_characters(spark):
    t = "x a.b\\E(c) y a.b\\E(c) z aXb\\E(c) 😀é"
    assert len(carried(spark, t, {"ort": [(2, 10)]})) == 2
    found = doc(spark, "Lena Vogt L", {"person": [(0, 9), (10, 11)]}).select(needles(F.col("spans")).alias("n")).first().n
    assert [n.needle for n in found] == ["Lena Vogt", "Vogt"]


def test_repeats_match_plain_python(spark):
    """Many overlapping detections and needles: the sorted intervals decide as a search of all that is taken does."""
    rng = random.Random(4)
    for _ in range(300):
        pairs = [[(a, a + rng.randrange(1, 8)) for a in (rng.randrange(40) for _ in range(rng.randrange(12)))] for _ in range(2)]
        taken, want = list(pairs[0]), []
        for c in pairs[1]:
            if not any(c[0] < t[1] and t[0] < c[1] for t in taken):
                taken.append(c)
                want.append(c)
        assert accept(*pairs) == want
    assert find_exact("aa", "aaa aa, aa_ 'aa aa-aa (aa)") == [(4, 6), (23, 25)]
    assert find_exact("Bär", "Bär😀Bär éBär Bär٣") == [(0, 3), (4, 7)]


def test_all_detections_are_carried(spark, tmp_path):
    """The third place of a document and those after it are detections too."""
    text = "Grossstadt Oberwinterthur Unterwaldner. ja Unterwaldner, ja Niederhasli"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.label, r.mention, r.span_start) for r in QUERIES["propagate_exact"](spark, str(tmp_path)).collect()}
    assert {m for label, m, _ in got if label == "ort"} == {"Grossstadt", "Oberwinterthur", "Unterwaldner", "Niederhasli"}
    assert {r.needle for r in QUERIES["propagate_candidates"](spark, str(tmp_path)).collect()} >= {"Unterwaldner", "Niederhasli"}
    assert {r.mention for r in QUERIES["propagate_everywhere"](spark, str(tmp_path)).collect()} >= {"Unterwaldner", "Niederhasli"}


def test_malformed_blacklist_scraps(spark):
    t = "8610 7 061 B von (k) ZKX NG"
    df = doc(spark, t, {"plz": at(t, "8610", "7", "061"), "person": at(t, "B")})
    assert [x[4] for x in out(df.withColumn("spans", spans.drop_malformed(F.col("spans"))))] == ["8610", "B"]
    named = "Ida mit Zeta Werk aus Uster"
    df = doc(spark, named, {"person": at(named, "Ida", "Zeta Werk"), "ort": at(named, "Uster")})
    assert [x[4] for x in out(df.withColumn("spans", spans.drop_blacklisted(F.col("spans"), ["zeta"])))] == ["Ida", "Uster"]
    assert len(out(df.withColumn("spans", spans.drop_blacklisted(F.col("spans"), [])))) == 3
    assert out(df.withColumn("spans", spans.drop_blacklisted(F.col("spans"), [""]))) == []
    df = doc(spark, t, {"person": at(t, "von", "(k)", "ZKX", "NG")})
    assert [x[4] for x in out(spans.drop_scraps(df))] == ["ZKX", "NG"]
    kept = df.select(spans.entities_map(F.col("spans"), ["person", "ort"]).alias("m")).first().m
    assert len(kept["person"]) == 4 and kept["ort"] == []


def test_scraps_of_whole_texts(spark, tmp_path):
    text = "Verwaltung in\n Liestal für\tKantone [d] GKZ, e"
    spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " die Zürich ")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.pos, r.text) for r in QUERIES["scrap_filter"](spark, str(tmp_path)).collect())
    assert [x[0::2] for x in got] == [(1, "Verwaltung"), (1, "Liestal"), (1, "Kantone"), (1, "GKZ,"), (4, "Zürich")]
    assert [text.split()[x[1]] for x in got if x[0] == 1] == [x[2] for x in got if x[0] == 1]


def test_redaction(spark):
    def text(t, found, **kw):
        return redact.redact(doc(spark, t, found), **kw).first().redacted_text

    assert text("Nach Olten zog Vogt um.", {"person": [(15, 19)], "ort": [(5, 10)]}) == "Nach [ort:1] zog [person:1] um."
    assert text("Am Weiher 9, 8610 Uster!", {"adresse": [(0, 23)], "plz": [(13, 17)]}) == "[adresse:1]!"
    assert text("😀é Vogt.", {"person": [(3, 7)]}) == "😀é [person:1]."
    assert text("abcdefghijklm", {"datum": [(0, 5), (3, 10), (7, 12)]}) == "[datum:1]fg[datum:3]m"
    assert text("abcdefghijklm", {"datum": [(0, 5), (3, 10), (7, 12)]}, unite=True) == "[datum:1]m"
    assert text("Anna Berg. Frau Berg kam.", {"person": [(0, 9)]}, blacklist=["anna"]) == "Anna Berg. Frau [person:2] kam."
    assert text("", {"person": []}) == ""
    for labels in (("ort", "person"), ("person", "ort")):
        assert text("Olten", {labels[0]: [(0, 5)], labels[1]: [(0, 5)]}) == f"[{labels[0]}:1]"


def greedy(found):
    """The greedy choice in plain Python."""
    kept, cursor = [], 0
    for s in sorted(found, key=lambda s: (s[5], -s[6], s[1], s[2])):
        if s[5] >= cursor:
            kept.append(s)
            cursor = s[6]
    return kept


def test_choice_matches_plain_python(spark):
    rng = random.Random(1)
    docs = []
    for d in range(150):
        text = "".join(rng.choice("abc é😀") for _ in range(40))
        rows = []
        for k in range(3):
            for i in range(rng.randrange(5)):
                a = rng.randrange(38)
                b = rng.randrange(a + 1, 40)
                rows.append((f"l{k}", k, i, i + 1, text[a:b], a, b, 0.9))
        docs.append((d, text, rows))
    df = spark.createDataFrame(docs, f"doc_id long, text string, spans {D.SPANS}")
    got = df.select("doc_id", redact.resolved(F.col("spans")).alias("k"), redact.splice(F.col("text"), redact.resolved(F.col("spans"))).alias("t"))
    for r in got.collect():
        want = greedy(docs[r.doc_id][2])
        assert [tuple(s) for s in r.k] == want
        text, at = "", 0
        for s in want:
            text += docs[r.doc_id][1][at : s[5]] + f"[{s[0]}:{s[3]}]"
            at = s[6]
        assert r.t == text + docs[r.doc_id][1][at:]


@pytest.mark.parametrize(
    "needle,text,found",
    [
        ("Runa Abegglen", "bei Runa\tAbegglen, R una Abeg glen, Runa-Abegglen", ["Runa\tAbegglen", "R una Abeg glen"]),
        ("Hof-Acker", "Hof Acker; HofAcker; Hof–\nAcker; hofacker; Hofackers", ["Hof Acker", "HofAcker", "Hof–\nAcker", "hofacker"]),
        ("7.31", "Ziffer 7.3.1 oder 17.31, Preis 7.31", ["7.31"]),
        ("88-12", "8812 88-12 88–12 88--12 88 12", ["8812", "88-12", "88–12"]),
        ("Muesli", "Müesli MÜSLI Müsli mu\u0308esli", ["Müesli", "mu\u0308esli"]),
        ("gross", "Groß, GROSS, große", ["Groß", "GROSS"]),
        ("Affinitaet", "Aﬃnitaet", ["Aﬃnitaet"]),
        ("Uster", "Uster-West, West-Uster, Usters, 'Uster, Uster’s", ["Uster"]),
        ("ZKX", "Plan_ZKX_neu.txt ZKX2", ["ZKX"]),
        ("-", "a-b", []),
        ("", "x", []),
        ("x", "", []),
    ],
)
def test_loose_matching(needle, text, found):
    assert [text[a:b] for a, b in find(needle, text)] == found


def slow_places(needle, text):
    """Loose matching by trying each place and walking both texts sign by sign."""
    blank = lambda c: c.isspace() or c == "-"
    want, _ = fold(needle)
    body, origin = fold(text)
    words = [w for w in want.split() if w.strip("-")]
    atoms = [(c, k == 0 and i > 0, gap, last.isalpha() and c.isalpha()) for i, w in enumerate(words) for k, (last, gap, c) in enumerate(split_word(w))]
    out, at = [], 0
    while at < len(body) and atoms:
        end = walk(atoms, body, at)
        held = lambda c: c.isalnum() or c in "'-"
        if end is None or blank(body[at]) or (at and held(body[at - 1])) or (end < len(body) and held(body[end])):
            at += 1
        else:
            out.append((origin[at], origin[end - 1] + 1))
            at = end
    return out


def split_word(w):
    last, gap = "", False
    for c in w:
        if c == "-":
            gap = True
        else:
            yield last, gap, c
            last, gap = c, False


def walk(atoms, body, at):
    for n, (c, new_word, hyphens, letters) in enumerate(atoms):
        start = at
        while n and at < len(body) and (body[at].isspace() or body[at] == "-"):
            at += 1
        gap = body[start:at]
        ok = gap.isspace() if new_word else True if letters else gap in ("", "-") if hyphens else not gap
        if n and not ok or at >= len(body) or body[at] != c:
            return None
        at += 1
    return at


def test_loose_matching_is_the_slow_one():
    rng = random.Random(6)
    letters = "abAé ß-–ﬀ.'_\n1"
    for _ in range(6000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(22)))
        a = rng.randrange(len(t) + 1)
        n = t[a : a + rng.randrange(1, 7)] if rng.random() < 0.7 else "".join(rng.choice(letters) for _ in range(3))
        assert find(n, t) == slow_places(n, t), (n, t)


def test_folding():
    assert fold("Größe–2²")[0] == "grosse-22" and fold("ﬃ")[1] == [0, 0, 0]
    texts = ["", "É\u0301", "a\u00adb", "", "x"]
    assert fold_batch(texts) == [fold(t)[0] for t in texts] == ["", "e", "a-b", "", "x"]


def test_scraps(spark):
    assert all(map(is_scrap, ["von", "x y  z", "(k)", "sur,", "with the", "«della»"]))
    assert not any(map(is_scrap, ["ZKX", "8610", "NG", "Von", "post@amt.example", "www.amt.example", "von ."]))
    assert {"fur", "dans", "della", "the"} <= stopwords()


def test_scraps_match_plain_python(spark):
    """Word by word: two letters or digits in a row somewhere, and not function words in small letters alone."""
    rng = random.Random(15)
    small = stopwords()
    parts = ["von", "Von", "è", "die,", "a", "b2", "2b", "-", "«la»", "é", "Ort", "x_y", "'d", "ß", "and"]
    lists = [["".join(rng.choice(parts) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(1, 4))) for _ in range(5)] for _ in range(60)]
    df = spark.createDataFrame([(i, [("l", 0, k, k + 1, t, 0, 1, 1.0) for k, t in enumerate(ts)]) for i, ts in enumerate(lists)], f"doc_id long, spans {D.SPANS}")

    def scrap(t):
        low = fold(t)[0]
        if not any(a.isalnum() and b.isalnum() for a, b in zip(low, low[1:], strict=False)):
            return True
        return t.islower() and all(w.strip(".,;:!?()[]{}<>«»\"'") in small for w in low.split())

    got = {r.doc_id: [x.text for x in r.spans] for r in spans.drop_scraps(df).collect()}
    assert got == {i: [t for t in ts if not scrap(t)] for i, ts in enumerate(lists)}
    assert 40 < sum(map(len, got.values())) < 260


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(alphabet="aéßﬀ -\n.1B", max_size=30))
def test_a_text_finds_itself(text):
    if any(c.isalnum() for c in text) and text.strip() == text and not text.startswith(("-", ".")) and not text.endswith("-"):
        assert (0, len(text)) in find(text, text) or text.count("-")


def plain_pipeline(text, everywhere=False, allowed=("example.org",)):
    """Rules, numbers, repeats, the never-redact list, the choice and the placeholders, on one text in plain Python."""
    found = []
    for k, (label, rule) in enumerate(D.RULES.items()):
        for i, m in enumerate(re.finditer(rule, text)):
            found.append([label, k, i, i + 1, m.group(), m.start(), m.end(), 1.0])
    found = [x for x in found if not (x[0] == "plz" and not re.fullmatch("[1-9][0-9]{3}", x[4].strip()))]
    wanted = []
    for x in found:
        if (everywhere or x[0] in REPEATING_LABELS) and len(x[4].strip()) > 2:
            wanted.append((x[0], -len(x[4].strip()), x[4].strip()))
    taken = [(x[5], x[6]) for x in found]
    for label, _, n in sorted(set(wanted)):
        places = slow_places(n, text) if everywhere else [(m.start(), m.end()) for m in re.finditer(re.escape(n), text) if not re.match(r"[\w'-]", text[m.start() - 1 : m.start()]) and not re.match(r"[\w'-]", text[m.end() : m.end() + 1])]
        for a, b in places:
            if all(b <= c or d <= a for c, d in taken):
                taken.append((a, b))
                own = [x for x in found if x[0] == label]
                found.append([label, own[0][1], max(x[2] for x in own) + 1, max(x[3] for x in own) + 1, text[a:b], a, b, 1.0])
    found = [x for x in found if not any(w.lower() in x[4].lower() for w in allowed)]
    out, at = "", 0
    for x in sorted(found, key=lambda x: (x[5], -x[6], x[1], x[2])):
        if x[5] >= at:
            out += text[at : x[5]] + f"[{x[0]}:{x[3]}]"
            at = x[6]
    return out + text[at:], sorted((x[0], x[3], x[5], x[6]) for x in found)


def test_the_pipeline_matches_plain_python(spark):
    rng = random.Random(12)
    pieces = ["ruf 044 555 66 77 an", "044-555-1234", "(044) 555-1234", "a.b@c-d.ch", "x@example.org", "A.B@C-D.CH", "10.2.33.4", "756.1111.2222.33", "CHE-101.202.303", "CH93 0076 2011 6238 5295 7", "ZH 4711", "ZH4711", "https://uster.example/a?b=4711", "1.2.2031", "CHF 1'200.50", "Fr. 45.-", "8610 Uster", "00:1a:2B:3c:4D:5e", "4711", "é😀", "\n", "Straße", "(a.b@c-d.ch)", "xa.b@c-d.ch"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", ", ", "", ". "]) for _ in range(rng.randrange(12))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for everywhere in (False, True):
        got = redact.redact(D.RuleDetector().detect(docs, list(D.RULES)), ["example.org"], everywhere).collect()
        for r in got:
            text, spans_ = plain_pipeline(texts[r.doc_id], everywhere)
            assert sorted((x.label, x.id, x.start, x.end) for x in r.spans) == spans_ and r.redacted_text == text, (everywhere, texts[r.doc_id])


def test_rules(spark):
    t = "CH93 0076 2011 6238 5295 7, 756.1234.5678.97, 00:1A:2b:3c:4D:5e, BS 12345, CHE-123.456.789, https://a.ch/x, 01.02.2024, CHF 1'200.50, 4051"
    df = D.RuleDetector().detect(spark.createDataFrame([(1, t)], "doc_id long, text string"), list(D.RULES))
    labels = {s[0]: s[4] for s in out(df) if s[0] != "plz"}
    assert labels["iban"] == "CH93 0076 2011 6238 5295 7" and labels["ahv-nummer"] == "756.1234.5678.97" and labels["mac-adresse"] == "00:1A:2b:3c:4D:5e"
    assert labels["kfz-kennzeichen"] == "BS 12345" and labels["uid-nummer"] == "CHE-123.456.789" and labels["url"].startswith("https://a.ch/x")
    assert labels["datum"] == "01.02.2024" and labels["geldbetrag"] == "CHF 1'200.50"


def test_detectors(spark):
    docs = spark.createDataFrame([(1, "Frau Zgraggen"), (2, None)], "doc_id long, text string")
    model = D.CallableDetector(lambda texts, types, threshold: [[("person", 5, 13, 0.9), ("person", 0, 4, 0.1), ("ort", 0, 1, 0.9)] if t else [] for t in texts])
    got = {r.doc_id: r.spans for r in model.detect(docs, ["person"], 0.8).collect()}
    assert [tuple(s)[3:7] for s in got[1]] == [(1, "Zgraggen", 5, 13)] and got[2] == []
    service = D.ServiceDetector(lambda texts, types, threshold: [len(t) for t in texts], lambda task: "success", lambda task: [[("ort", 0, n, 0.9)] if n else [] for n in task])
    assert {r.doc_id: [x.text for x in r.spans] for r in service.detect(docs, ["ort"], 0.8).collect()} == {1: ["Frau Zgraggen"], 2: []}
    ready = spark.createDataFrame([(1, "person", 0, "Zgraggen", 5, 13, 0.9), (1, "person", 1, "Frau", 0, 4, 0.85), (1, "person", 2, "x", 0, 4, 0.2)], "doc_id long, label string, pos int, text string, start int, end int, confidence double")
    got = {r.doc_id: [(s.id, s.text) for s in r.spans] for r in D.TableDetector(ready).detect(docs, ["ort", "person"]).collect()}
    assert got == {1: [(1, "Zgraggen"), (2, "Frau")], 2: []}


def test_entry_loads_without_a_session():
    """In a process of its own: nothing makes a Column while modules are imported."""
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 50; print('loaded')"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("loaded"), done.stderr[-2000:]


def test_facade(spark):
    text, found = anonymize_text(spark, "a@b.ch, 1.2.3.4", entity_types=["e-mail-adresse", "ip-adresse"])
    assert text == "[e-mail-adresse:1], [ip-adresse:1]" and [f["label"] for f in found] == ["e-mail-adresse", "ip-adresse"]
    assert list(load_entity_types("legal")) == ["person", "ort", "plz", "organisation", "datum", "telefonnummer"]
    assert load_blacklist("legal") == ["court", "plaintiff", "defendant", "judge"] and len(load_entity_types("full")) == 27
    assert load_entity_types("default", verbose=True)["ort"] == {"name": "Ort", "description": load_entity_types()["ort"]}
    assert filled([], []) == (["person", "ort"], ["acme", "widget"]) and extended(["a"], "b", "a") == ["a", "b"]


def test_many_matches_in_one_text(spark):
    """Work that grows with the matches, not with their square; and arrays around the size of a block."""
    import time

    from spanveil.functions.arrays import BLOCK, running_sums, scan
    from spanveil.functions.text import page_offsets, page_text

    sizes = [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK, 1000]
    rows = [(list(range(n)),) for n in sizes] + [(None,)]
    got = spark.createDataFrame(rows, "a array<bigint>").select("a", running_sums(F.col("a")).alias("s"), scan(F.col("a"), "array<bigint>", F.lit(0).cast("bigint"), lambda at, x: (x, F.when(x > at, F.array(x - at)).otherwise(F.array().cast("array<bigint>")))).alias("d")).collect()
    for r in got:
        assert r.s == (None if r.a is None else [sum(r.a[:i]) for i in range(len(r.a))])
        assert r.d == (None if r.a is None else [1] * max(0, len(r.a) - 1))
    n = 32_000
    text = "é ab12 " * n
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    began = time.time()
    found = docs.where("doc_id = 1").select(D.occurrences(F.col("text"), "[a-z]+[0-9]+").alias("f")).first().f
    assert time.time() - began < 10 and len(found) == n and all(text[x.start : x.end] == "ab12" for x in (found[0], found[77], found[-1]))
    pages = spark.createDataFrame([("x<!-- docling-page -->" * 500,)], "t string").select(page_offsets(F.col("t")).alias("o")).first().o
    assert pages == [min(i, 500) for i in range(501)]


def test_many_needles_in_one_pass():
    """The automaton finds what one search for each needle finds: overlaps, needles in needles, needles that touch words."""
    from spanveil.functions import folding, machine
    from spanveil.operators import propagate

    rng = random.Random(9)
    for _ in range(300):
        needles = list({"".join(rng.choice("aab- ü") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(20))})
        text = "".join(rng.choice("aab- ü_") for _ in range(rng.randrange(80)))
        assert propagate.find_all_exact(needles, text) == [propagate.find_exact(n, text) for n in needles]
        got = folding.find_all(needles, text)
        assert got == [[{"start": a, "end": b} for a, b in folding.find(n, text)] for n in needles]
    assert machine.Machine([]).starts("x") == {} and not machine.Machine([""]).any("x")


def test_long_blacklists(spark):
    """10^5 listed words, in one automaton for each worker, let through what a search for each does."""
    from spanveil.operators import spans as S

    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(100_000)] + ["Straße", "İx"]
    texts = [words[5].upper(), "x" + words[77] + "y", "none", "", None, "STRASSE", "STRAẞE", "an der straße", words[9][:6]]
    docs = spark.createDataFrame([(1, [("ort", 0, i, i + 1, t, 0, 1, 1.0) for i, t in enumerate(texts)]), (2, []), (3, None)], f"doc_id long, spans {D.SPANS}")
    got = {r.doc_id: r.s and [x.text for x in r.s] for r in docs.select("doc_id", S.drop_blacklisted(F.col("spans"), words).alias("s")).collect()}
    low = [w.lower() for w in words]
    assert got == {1: [t for t in texts if t is None or not any(w in t.lower() for w in low)], 2: [], 3: None}
    with pytest.raises(ValueError):
        S.MOST_WORDS, kept = 10, S.MOST_WORDS
        try:
            S.drop_blacklisted(F.col("spans"), words)
        finally:
            S.MOST_WORDS = kept
