"""Behaviour tables and properties of the operators."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushlake.functions import checksums, dates, geometry, taxonomy
from hushlake.functions import text as tx
from hushlake.operators import answers, entities, fields, sanitize, spatial, synthesis, vault
from hushlake.sources import html
from hushlake.streaming import limits


def scan(spark, rows, **more):
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(rows)], "doc_id int, text string, context string")
    out = {i: [] for i in range(len(rows))}
    for r in entities.scan_entities(df, context="context", **more).collect():
        out[r.doc_id].append((r.type, r.value))
    return [out[i] for i in range(len(rows))]


CASES = [
    ("write to ananya.iyer@example.com", None, ["EMAIL"]),
    ("call 9812345678 or +91 9812345678", None, ["PHONE", "PHONE"]),
    ("uid 223456789018 and 2234 5678 9018", None, ["AADHAAR", "AADHAAR"]),
    ("uid 223456789012", None, []),
    ("card 4111 1111 1111 1111", None, ["CARD"]),
    ("card 4111111111111112", None, []),
    ("pan ABCPI1234K not ABCXI1234K", None, ["PAN"]),
    ("HDFC0001234", None, ["IFSC"]),
    ("ananya@okhdfcbank", None, ["UPI"]),
    ("@mention someone@somewhere", None, []),
    ("pay to someone@somewhere", None, ["UPI"]),
    ("M1234567", None, []),
    ("M1234567", "passport number", ["PASSPORT"]),
    ("400050", "PIN", ["PINCODE"]),
    ("400050", None, []),
    ("14/03/2001", "born", ["DOB"]),
    ("482913", "Enter OTP", ["OTP"]),
    ("431", "CVV", ["CVV"]),
    ("order 12345678, v1.2.3, 2024, $ 1,299.00", None, []),
    ("", None, []),
    (None, None, []),
    ("1 4785380592391139", None, []),
    ("épan ABCPI1234K", None, ["PAN"]),
]


def test_entities(spark):
    got = scan(spark, [(t, c) for t, c, _ in CASES])
    assert [[k for k, _ in g] for g in got] == [e for _, _, e in CASES]


def test_strict_has_no_context_rules(spark):
    assert scan(spark, [("someone@somewhere pay to", None), ("M1234567 passport", None)], strict=True) == [[], []]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab@.-+ 0123456789é😀\n⟦⟧EMAIL_", max_size=60), min_size=1, max_size=20))
def test_spans_hold(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    last = {}
    for r in entities.scan_entities(df).orderBy("doc_id", "start").collect():
        assert texts[r.doc_id][r.start : r.end] == r.value
        assert r.start >= last.get(r.doc_id, 0)
        last[r.doc_id] = r.end
    clean = {r.doc_id: r.clean for r in sanitize.sanitize(df).collect()}
    again = sanitize.sanitize(spark.createDataFrame(list(clean.items()), "doc_id int, text string"))
    assert {r.doc_id: r.clean for r in again.collect()} == clean


def test_checksums(spark):
    people = synthesis.people(spark.range(1, 200), "id")
    bad = people.where(
        ~checksums.verhoeff_valid(F.col("aadhaar")) | ~checksums.luhn_valid(F.col("card")) | ~checksums.pan_valid(F.col("pan"))
    )
    assert bad.count() == 0
    one = people.limit(1).collect()[0].aadhaar
    typos = [one[:i] + str((int(one[i]) + 1) % 10) + one[i + 1 :] for i in range(12)]
    assert spark.createDataFrame([(t,) for t in typos], "v string").where(checksums.verhoeff_valid(F.col("v"))).count() == 0
    decoys = synthesis.decoys(spark.range(1, 200), "id")
    assert decoys.where("decoy is null").count() == 0
    assert decoys.where(checksums.verhoeff_valid(F.col("decoy")) | checksums.luhn_valid(F.col("decoy"))).count() == 0


@pytest.mark.parametrize(
    "label, kind",
    [("Aadhaar", "AADHAAR"), ("aadhaar_no", "AADHAAR"), ("shipping panel", None), ("विद्यालय का नाम", None), ("आवेदक का नाम", "NAME"),
     ("ईमेल पता", "EMAIL"), ("a/c no", "ACCOUNT"), ("Account name", None), ("pin", "GENERIC")],
)
def test_fields(spark, label, kind):
    row = (1, "input", "text", label, "", "", "", "", "", None, True)
    names = "field_id int, tag string, type string, label string, aria_label string, placeholder string, name string, id string, title string, autocomplete string, editable boolean"
    assert fields.classify_fields(spark.createDataFrame([row], names)).collect()[0].kind == kind


def test_dates(spark):
    said = ["14/03/2001", "31/02/2001", "3 Sept 2024", "March 3, 2024", "2024-02-29", "soon", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select(dates.iso_date(F.col("s")).alias("d")).collect()
    assert [r.d for r in rows] == ["2001-03-14", "31/02/2001", "2024-09-03", "2024-03-03", "2024-02-29", "soon", None]


def test_labels_and_masks(spark):
    df = spark.createDataFrame([("State of domicile *", "ananya@x.org"), ("Please enter your state of domicile (as per x)", "1234"), ("Father's name", "1234567")], "a string, b string")
    rows = df.select(tx.normal_label(F.col("a")), tx.masked(F.col("b")), tx.slug(F.col("a"), F.lit(3))).collect()
    assert [tuple(r) for r in rows] == [
        ("domicile state", "a•••••@x.org", "STATE_DOMICILE"),
        ("domicile state", "••••", "STATE_DOMICILE"),
        ("father name", "1••••67", "FATHER_NAME"),
    ]


def test_tokens(spark):
    hits = spark.createDataFrame(
        [(1, 0, "EMAIL", "A@b.c"), (1, 9, "PHONE", "981-234"), (2, 0, "EMAIL", "a@b.c"), (3, 0, "EMAIL", "z@b.c"), (4, 0, "CARD", "981234")],
        "doc_id long, start int, type string, value string",
    )
    tokens = {r.norm: r.token for r in vault.tokenize(hits).collect()}
    assert tokens == {"a@bc": "⟦EMAIL_1⟧", "981234": "⟦PHONE_1⟧", "z@bc": "⟦EMAIL_2⟧"}
    assert re.match(taxonomy.TOKEN, "⟦EMAIL_1⟧")


def test_fusion_never_uncovers(spark):
    b = lambda x, y, w, h: {"x": float(x), "y": float(y), "w": float(w), "h": float(h)}
    rows = [(1, 1, "EMAIL", b(10, 10, 100, 20), "dom", 0.9), (1, 2, "GENERIC", b(12, 11, 90, 18), "vision", 0.5), (1, 3, "PHONE", b(300, 300, 50, 20), "dom", 0.9), (1, 4, "PHONE", b(0, 0, 1, 1), "dom", 0.9)]
    found = spark.createDataFrame(rows, "page_id int, id long, type string, box struct<x:double,y:double,w:double,h:double>, source string, confidence double")
    kept = spatial.fuse(found, 1280.0, 800.0).collect()
    assert sorted(r.type for r in kept) == ["EMAIL", "PHONE", "PHONE"]
    assert all(r.box.w >= 4 for r in kept)


def test_geometry(spark):
    a, b = (geometry.box(*[F.lit(v) for v in x]) for x in ((0, 0, 10, 10), (5, 5, 10, 10)))
    r = spark.range(1).select(geometry.iou(a, b), geometry.containment(a, b), geometry.common_area(a, b), geometry.padded(a, 3.0, F.lit(12.0), F.lit(12.0)).w).first()
    assert r[0] == pytest.approx(25 / 175) and r[1] == 0.25 and r[2] == 25 and r[3] == 12


def test_search(spark):
    tasks = ["search for red shoes", "find the login button", "look up cats and dogs", "Find \"quiet cafes\".", "buy milk"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tasks)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(answers.search_query(F.col("t"))).collect()] == ["red shoes", None, None, "quiet cafes", None]


def test_answers(spark):
    page = "Application portal\nApplication status: Approved\nApplication number 12\nStatus page"
    df = spark.createDataFrame([(1, page)], "doc_id int, text string")
    best = answers.answer_lines(df, "What is the status of my application?").first()
    assert best.line == "Application status: Approved"


def test_html(spark):
    page = "<html><body><p>Hello <b>you</b><script>var x='</p>'</script><p>a<br>b</div><dl><dt>Name<dd>Ann</dl><input name=e autocomplete=email>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    blocks = html.text_blocks(df).orderBy("page_id", "ord").collect()
    assert [(r.tag, r.text) for r in blocks] == [("p", "Hello you"), ("p", "a b"), ("dt", "Name"), ("dd", "Ann")]
    assert [(r.tag, r.autocomplete) for r in html.controls(df).collect()] == [("input", "email")]


def test_bucket_stream_equals_fold(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = limits.bucket_stream(stream, rate=0.001, burst=5.0).writeStream.outputMode("update").format("memory").queryName("bucket").start()
    q.processAllAvailable()
    q.stop()
    got = {r.user_id: (r.seen, r.denied) for r in spark.table("bucket").collect()}
    times = F.transform(F.array_sort(F.collect_list(F.struct(F.col("ts").cast("timestamp").cast("double").alias("t"), "event_id"))), lambda x: x.t)
    folded = events.groupBy("user_id").agg(limits.bucket_fold(times, 0.001, 5.0).alias("ok")).collect()
    assert got == {r.user_id: (len(r.ok), r.ok.count(False)) for r in folded}
