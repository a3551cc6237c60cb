"""Nulls, repeated keys, gaps and sizes that an earlier version lost rows on."""

from hushlake.operators import evaluation, sanitize, vault
from hushlake.sources import html


def test_resolve_keeps_every_row(spark):
    rows = [(1, "a ⟦X_1⟧ b"), (1, "other ⟦Y_1⟧"), (2, None), (None, "⟦X_1⟧"), (3, "no token"), (3, "no token")]
    entries = spark.createDataFrame([("⟦X_1⟧", "v"), ("⟦X_1⟧", "w")], "token string, value string")
    got = vault.resolve(spark.createDataFrame(rows, "k long, text string"), "text", entries, "k").collect()
    want = [(1, "a v b", False), (1, "other ⟦Y_1⟧", True), (2, None, False), (None, "v", False), (3, "no token", False), (3, "no token", False)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_tokenize_keeps_values_of_null_ids(spark):
    rows = [(None, 0, "EMAIL", "a@b.cc"), (1, 0, "EMAIL", "c@d.ee"), (2, 0, "EMAIL", "A@B.cc")]
    got = vault.tokenize(spark.createDataFrame(rows, "doc_id long, start int, type string, value string"))
    assert {r.norm for r in got.collect()} == {"a@bcc", "c@dee"}
    assert {r.token for r in got.collect()} == {"⟦EMAIL_1⟧", "⟦EMAIL_2⟧"}


def test_known_values_beyond_one_automaton(spark):
    values = spark.range(100_000).selectExpr("concat('value', id) AS value")
    texts = spark.createDataFrame([(1, "see VALUE99999 and value12"), (2, None), (3, "nothing")], "doc_id long, text string")
    want = {(1, "value99999"), (1, "value9999"), (1, "value999"), (1, "value99"), (1, "value9"), (1, "value12"), (1, "value1")}
    for at_once in (1_000_000, 30_000):
        got = vault.known_values(texts, values, at_once=at_once).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_audit_reads_whole_strings(spark):
    late = "x " * 15_000 + "a@mail.example.com"
    payload = spark.createDataFrame([(1, [("task", late)])], "payload_id long, strings array<struct<path:string,value:string>>")
    assert sanitize.audit(payload).count() == 1
    assert sanitize.audit(payload, most=20_000).count() == 0


def test_pages_without_id_or_html(spark):
    pages = spark.createDataFrame([(None, "<p>one"), (9007199254740993, "<a href=x>two"), (3, None)], "page_id long, html string")
    assert {tuple(r) for r in html.text_blocks(pages).select("page_id", "text").collect()} == {(None, "one"), (9007199254740993, "two")}
    assert [r.page_id for r in html.controls(pages).collect()] == [9007199254740993]
    many = spark.createDataFrame([(1, "<input>" * 500)], "page_id long, html string")
    assert html.controls(many).count() == 500 and html.controls(many, most=160).count() == 160


def test_changes_over_gaps(spark):
    ids = [1, 2, 5, 9, 70, 71, 300, 5000, 123456]
    rows = [(i, [float(k), 0.0]) for k, i in enumerate(ids)] + [(None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    for block in (4096, 8):
        got = {r.vec_id: r.before for r in evaluation.with_previous(df.where("vec_id is not null"), "vec_id", "v", block).collect()}
        assert got == {i: ([float(k - 1), 0.0] if k else None) for k, i in enumerate(ids)}
    assert sorted(r.vec_id for r in evaluation.changed(df, "vec_id", "v", 0.4).where("changed").collect()) == ids[1:]


def test_long_runs_before_an_address(spark):
    """Would take minutes where every letter of a run starts a search."""
    from hushlake.operators import entities

    df = spark.createDataFrame([(1, "a" * 300_000 + " b@c.dd " + "e" * 300_000)], "doc_id long, text string")
    assert [r.value for r in entities.scan_entities(df, only=["EMAIL"]).collect()] == ["b@c.dd"]
