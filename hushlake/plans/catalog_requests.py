"""Queries of requests, local decisions, vision and scores, with their SQL.

What a case must give stands in the SQL by key, as literals that do not come from
the code under test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.functions import geometry as g
from hushlake.operators import choices, evaluation, fields, planning, requests, spatial, synthesis, vision
from hushlake.sources.tables import table

from .catalog import _INSIDE, _boxes, _boxes_sql, _cells_sql, query


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"))


def _pick(*values) -> Column:
    """The value at the key, around and around."""
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col("id") % len(values)).cast("int"))


def _case(*values, of: str = "c_custkey") -> str:
    shown = ["NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values]
    return f"(CASE {of} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(shown)) + " END)"


# --- local decisions -----------------------------------------------------------------


@query(f"SELECT c_custkey AS id, {_case('down', None, 'up', 'up', None)} AS way FROM customer")
def bare_scroll(spark: SparkSession, d: str) -> DataFrame:
    task = _pick("please scroll down a bit", "scroll down and fill the form", "move back up", "Page higher, please!", "what is up")
    return _keyed(spark, d).select("id", choices.bare_scroll(task).alias("way"))


@query(f"SELECT c_custkey AS id, {_case(2, 2, 0, 1, None)}::INTEGER AS at FROM customer")
def option_match(spark: SparkSession, d: str) -> DataFrame:
    options = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(t).alias("text")) for v, t in (("1", "State of Goa"), ("2", "Goa "), ("goa", "Elsewhere"))])
    return _keyed(spark, d).select("id", choices.chosen_option(options, _pick("GOA", " goa ", "state of", "2", "nowhere")).alias("at"))


@query(f"""
SELECT c_custkey AS id, {_case('an email address', 'a UPI ID', 'an OTP', 'a qr code', 'an Aadhaar number')} AS noun FROM customer
""")
def friendly_types(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d).select("id", choices.with_article(choices.friendly_type(_pick("EMAIL", "UPI", "OTP", "QR_CODE", "AADHAAR"))).alias("noun"))


@query("""
SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'type ⟦EMAIL_1⟧ into element ' || c_custkey WHEN 1 THEN 'click element ' || c_custkey
  WHEN 2 THEN 'scroll down' WHEN 3 THEN 'go back' WHEN 4 THEN 'wait 800 ms' ELSE 'ask the user' END AS said FROM customer
""")
def describe_action(spark: SparkSession, d: str) -> DataFrame:
    text = lambda v=None: F.lit(v).cast("string")
    action = F.struct(
        _pick("type", "click", "scroll", "navigate", "wait", "ask_user").alias("action"), F.col("id").alias("element_id"), text("⟦EMAIL_1⟧").alias("text"),
        text().alias("option"), text().alias("direction"), text().alias("key"), text("back").alias("url"), F.lit(None).cast("int").alias("ms"),
    )
    return _keyed(spark, d).select("id", choices.described_action(action).alias("said"))


@query("""
SELECT c_custkey AS id, 'N' || c_nationkey || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS "unique"
FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS n FROM customer)
""")
def unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("slug"))
    return choices.unique_slugs(c, "c_mktsegment", order="id").select("id", "unique")


@query("""
WITH f AS (SELECT c_custkey % 40 AS owner, c_custkey AS ord, CASE c_custkey % 3 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'CARD' ELSE 'PHONE' END AS type, c_name FROM customer),
u AS (SELECT owner, type AS key, min((ord, c_name)) AS x FROM f WHERE type <> 'CARD' AND NOT (type = 'EMAIL' AND owner % 2 = 0) GROUP BY ALL)
SELECT owner, key, CASE key WHEN 'EMAIL' THEN 'Email' ELSE 'Mobile number' END AS label, x[2] AS value FROM u
""")
def document_suggestions(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "customer").withColumn("id", F.col("c_custkey")).select(
        (F.col("id") % 40).alias("owner"), F.col("id").alias("ord"), _pick("EMAIL", "CARD", "PHONE").alias("type"), F.concat(F.lit(" "), "c_name").alias("value")
    )
    held = found.where("owner % 2 = 0").select("owner", F.lit("EMAIL").alias("key"))
    return choices.document_suggestions(found, held).select("owner", "key", "label", "value")


@query("""
SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 2 THEN NULL ELSE 'new' || c_custkey % 10 END AS answer FROM customer
""")
def recall_by_label(spark: SparkSession, d: str) -> DataFrame:
    owner = (F.col("id") % 10).alias("owner")
    asked = _keyed(spark, d).select("id", owner, _pick("Father's name *", "Please enter your NAME (father)", "Mother's name").alias("label"))
    asked = asked.withColumn("label", F.when(F.col("id") % 3 == 1, "name of the father").otherwise(F.col("label")))
    told = spark.range(10).select(F.col("id").alias("owner"), F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("old").alias("w")), F.struct(F.lit(2).alias("at"), F.lit("new").alias("w")))).alias("m"))
    memos = told.select("owner", F.lit("Father name").alias("label"), F.col("m.at").alias("at"), F.concat("m.w", F.col("owner").cast("string")).alias("value"))
    return choices.recalled(asked, memos).select("id", "answer")


@query(f"""
SELECT c_custkey AS id, {_case('scroll', None, 'search', 'declared', 'memory', None, 'memory')} AS rule,
  {_case('scroll', None, 'type', 'type', 'type', None, 'select')} AS action, {_case(None, None, 'red shoes', '⟦PROFILE.EMAIL⟧', 'Suresh', None, None)} AS text FROM customer
""")
def plan_on_device(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of the device's own planner, and two pages that need more."""
    text = lambda v=None: F.lit(v).cast("string")
    flag = lambda v: F.lit(v).cast("boolean")

    def element(n, role, label=None, kind=None, value=None, options=None, group=None, sensitive=None, reason=None):
        return F.struct(
            F.lit(n).alias("id"), text(role).alias("role"), text(kind).alias("type"), text(label).alias("label"), text().alias("placeholder"),
            text(value).alias("value"), (F.array(*map(F.lit, options)) if options else F.lit(None).cast("array<string>")).alias("options"),
            text(group).alias("group"), flag(False).alias("checked"), flag(False).alias("disabled"), text(sensitive).alias("sensitive"), text(reason).alias("reason"),
        )

    search = F.array(element(1, "searchbox", "Find"))
    mail = F.array(element(1, "textbox", "Mail", sensitive="EMAIL", reason="kw:email"), element(2, "textbox", "Mail", sensitive="EMAIL", reason="autocomplete=email"))
    father = F.array(element(1, "textbox", "Password", "password"), element(3, "textbox", "Father's name"))
    group = F.array(element(4, "radio", "OBC", group="cat"), element(5, "radio", "General", group="cat"), element(6, "combobox", "Category", options=["Select one", "General"]))
    group = F.transform(group, lambda e: F.when(e.id < 6, e.withField("label", F.concat(e.label, F.lit("")))).otherwise(e.withField("value", F.lit("Select one"))))
    pages = [search, search, search, mail, father, mail, group]
    empty = F.array().cast("array<int>")
    tried = F.when(F.col("id") % 7 == 5, F.array(F.lit(2))).otherwise(empty)
    recall = F.create_map(F.lit("father name"), F.lit("Suresh"), F.lit("category"), F.lit(" general "))
    staged = _keyed(spark, d).select(
        "id", _pick("scroll down please", "what is this?", "search for red shoes", "fill it", "fill it", "fill it", "fill it").alias("task"),
        F.get(F.array(*pages), (F.col("id") % 7).cast("int")).alias("elements"), F.array(F.lit("EMAIL")).alias("profile_keys"),
        tried.alias("attempted"), F.lit(False).alias("scrolled"), F.lit(False).alias("searched"), recall.alias("recall"),
    )
    return choices.plan_local(staged).select("id", "local.rule", "local.action", "local.text")


@query(f"SELECT c_custkey AS id, {_case('link', 'button', 'combobox', 'searchbox', 'textbox', 'switch', 'textbox', 'nav')} AS role FROM customer")
def control_roles(spark: SparkSession, d: str) -> DataFrame:
    role = fields.role_of(
        _pick("A", "input", "select", "INPUT", "input", "div", "div", "NAV"), _pick(None, "submit", None, "search", None, None, None, None),
        _pick("", "", "", "", "", "Switch", None, None), F.col("id") % 8 == 6,
    )
    return _keyed(spark, d).select("id", role.alias("role"))


# --- requests ---------------------------------------------------------------------------


@query(f"""
SELECT page_id, source, type, count(*) AS n FROM (
  SELECT page_id, 'dom-field' AS source, CASE WHEN id % 2 = 0 THEN 'EMAIL' ELSE 'PASSWORD' END AS type FROM {_boxes_sql(0)} WHERE id % 3 <> 0
  UNION ALL SELECT page_id, 'dom-text', 'PHONE' FROM {_boxes_sql(0)}, range(2)
  UNION ALL SELECT page_id, 'dom-image', 'GENERIC' FROM {_boxes_sql(0)} WHERE id % 5 = 0) GROUP BY ALL
""")
def all_detections(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d, 0)
    controls = b.select(
        "page_id", "id", "box", F.when(F.col("id") % 2 == 0, "EMAIL").otherwise("PASSWORD").alias("sensitive"),
        F.when(F.col("id") % 3 != 0, "x").otherwise("").alias("value"), F.lit("⟦EMAIL_1⟧").alias("token"), F.lit("kw").alias("reason"),
    )
    text = b.select("page_id", F.col("id").alias("ord"), F.lit("PHONE").alias("type"), F.lit("⟦PHONE_1⟧").alias("token"), F.lit(0.9).alias("confidence"), F.array("box", "box").alias("rects"))
    frames = b.where("id % 5 = 0").select("page_id", F.col("id").alias("ord"), "box")
    return requests.detected(controls, text, frames).groupBy("page_id", "source", "type").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, round(least(1.0, sum(w * h) / (400.0 * 300.0)), 6) AS share FROM {_boxes_sql(0)} WHERE id % 4 = 0 GROUP BY page_id")
def hidden_share(spark: SparkSession, d: str) -> DataFrame:
    pages = _boxes(spark, d, 0).where("id % 4 = 0").groupBy("page_id").agg(F.collect_list("box").alias("boxes"))
    return pages.select("page_id", F.round(requests.redacted_share(F.col("boxes"), F.lit(400.0), F.lit(300.0)), 6).alias("share"))


@query("""
SELECT c_custkey AS id, 'Label #' AS label, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '⟦EMAIL_1⟧' WHEN 2 THEN 'Customer##########'[:8] || '#' || regexp_replace(substr(c_name, 10), '[0-9]', '#', 'g') END AS value,
  CASE c_custkey % 4 WHEN 3 THEN false ELSE true END AS filled FROM customer
""")
def wire_elements(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    element = F.struct(
        k.alias("id"), F.lit("textbox").alias("role"), g.box(k, k, k, k).alias("box"), F.lit("  Label \n 1 ").alias("label"), F.lit("").alias("text"),
        F.lit(None).cast("string").alias("placeholder"), F.lit("text").alias("type"), F.lit(False).alias("disabled"), F.lit(False).alias("required"),
        F.lit(None).cast("boolean").alias("checked"), F.when(k % 4 == 0, "PASSWORD").when(k % 4 != 2, "EMAIL").alias("sensitive"),
        F.when(k % 4 != 3, F.regexp_replace("c_name", "#", "7")).alias("value"), F.lit("⟦EMAIL_1⟧").alias("token"),
    )
    wire = requests.wire_element(element, lambda c: F.regexp_replace(c, "[0-9]", "#"))
    return table(spark, d, "customer").select(wire.alias("w")).select("w.id", "w.label", "w.value", "w.filled")


@query(f"""
SELECT c_custkey AS id, {_case('short enough', 'cut at a word…', 'aaaaaaaaaaaaaaaaaaa…', 'never inside…')} AS text FROM customer
""")
def cut_at_word(spark: SparkSession, d: str) -> DataFrame:
    text = _pick("short enough", "cut at a word  boundary", "a" * 30, "never inside ⟦EMAIL_1⟧ of it")
    return _keyed(spark, d).select("id", requests.cut_at_word(text, 20).alias("text"))


@query(f"""
SELECT c_custkey AS id, {_case("Name: X|⟦CARD_1⟧|end", "Name: X|hidden|end", "Name: X|…")} AS text FROM customer
""")
def screen_text(spark: SparkSession, d: str) -> DataFrame:
    """Label and value on one line, a block below pixels withheld, a repeated line
    once, a budget that ends the text."""
    at = lambda y: g.box(F.lit(0.0), F.lit(float(y)), F.lit(100.0), F.lit(10.0))
    block = lambda text, y, label=None: F.struct(F.lit(text).alias("text"), F.lit(label).cast("string").alias("label"), at(y).alias("box"))
    blocks = F.array(block("Name", 0), block(" X ", 20, "Name"), block("hidden", 40), block("end", 60), block("end", 80))
    pixel = F.struct(F.lit("CARD").alias("type"), F.lit("vision").alias("source"), at(41).alias("box"), F.lit("⟦CARD_1⟧").alias("token"))
    face = F.struct(F.lit("FACE").alias("type"), F.lit("vision").alias("source"), at(41).alias("box"), F.lit("⟦FACE_1⟧").alias("token"))
    pages = _keyed(spark, d).select("id", F.array(F.when(F.col("id") % 3 == 0, pixel).otherwise(face)).alias("found"))
    whole = requests.screen_text(blocks, F.col("found"), lambda c: c)
    tight = requests.screen_text(blocks, F.col("found"), lambda c: c, most=12)
    text = F.when(F.col("id") % 3 == 2, tight).otherwise(whole)
    return pages.select("id", F.replace(text, F.lit("\n"), F.lit("|")).alias("text"))


@query("""
SELECT user_id, count(*) FILTER (WHERE value >= 30) AS requests, coalesce(sum(strlen(props)) FILTER (WHERE value >= 30), 0)::BIGINT AS bytes,
  count(*) FILTER (WHERE value < 30) AS local_steps FROM events GROUP BY user_id
""")
def run_ledger(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "events").select("user_id", F.when(F.col("value") < 30, "local").otherwise("vlm").alias("planner"), F.col("props").alias("payload"))
    return requests.ledger(steps, ("user_id",))


@query("""
SELECT CASE WHEN value < 10 THEN 'rejected' ELSE 'step' END AS event, CASE WHEN value >= 10 THEN event_type END AS action,
  CASE WHEN value < 10 THEN 1 ELSE 0 END::BIGINT AS kept, count(*) AS n FROM events GROUP BY ALL
""")
def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    found = F.array(F.struct(F.lit("EMAIL").alias("type"), F.lit("task").alias("path"), F.lit("a@b.cc").alias("value")))
    steps = table(spark, d, "events").select(
        F.col("ts").alias("at"), F.col("user_id").alias("session"), F.col("event_type").alias("action"),
        F.when(F.col("value") < 10, found).otherwise(F.slice(found, 1, 0)).alias("incidents"),
    )
    return requests.audit_row(steps).groupBy("event", "action", F.size("incidents").cast("long").alias("kept")).agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey AS id, {_case(True, True, True, False)} AS image, 2::INTEGER AS fields, ['EMAIL', 'PHONE'] AS hidden, ['Go'] AS first_buttons FROM customer")
def request_described(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    element = lambda n, role, label: F.struct(n.alias("id"), F.lit(role).alias("role"), F.lit(label).alias("label"), F.lit("").alias("text"))
    elements = F.array(element(F.when(k % 4 == 1, 1000).otherwise(1), "textbox", "a"), element(F.lit(2), "searchbox", "b"), element(F.lit(3), "button", "Go"))
    gone = lambda kind: F.struct(F.lit(kind).alias("type"), F.when(k % 4 == 2, "ocr").otherwise("vision").alias("source"))
    request = F.struct(F.when(k % 4 != 0, "text").alias("visible_text"), elements.alias("elements"), F.array(gone("PHONE"), gone("EMAIL"), gone("PHONE")).alias("redactions"))
    rows = _keyed(spark, d).select("id", request.alias("r"))
    said = requests.described(F.col("r.elements"), F.col("r.redactions"))
    return rows.select("id", requests.needs_image(F.col("r")).alias("image"), said.alias("s")).select("id", "image", "s.fields", "s.hidden", "s.first_buttons")


# --- vision -------------------------------------------------------------------------------

_X = "(greatest(least(f.x + f.w, d.x + d.w) - greatest(f.x, d.x), 0) * greatest(least(f.y + f.h, d.y + d.h) - greatest(f.y, d.y), 0))"
_CENTRE = "({a}.x + {a}.w / 2 BETWEEN {b}.x - 4 AND {b}.x + {b}.w + 4 AND {a}.y + {a}.h / 2 BETWEEN {b}.y - 4 AND {b}.y + {b}.h + 4)"


@query(f"""
SELECT f.page_id, f.id FROM {_boxes_sql(40)} f WHERE NOT EXISTS (SELECT 1 FROM {_boxes_sql(0)} d WHERE d.page_id = f.page_id
  AND ({_CENTRE.format(a="f", b="d")} OR {_CENTRE.format(a="d", b="f")} OR {_X} / (f.w * f.h + d.w * d.h - {_X}) > 0.3))
""")
def undeclared_controls(spark: SparkSession, d: str) -> DataFrame:
    return vision.undeclared(_boxes(spark, d, 40), _boxes(spark, d, 0)).select("page_id", "id")


@query(f"""
SELECT page_id, id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY (id % 7 = 0) DESC, w * h DESC, id) AS rank
  FROM {_boxes_sql(0)} WHERE w >= 80 AND h >= 40) WHERE rank <= 3
""")
def reading_targets(spark: SparkSession, d: str) -> DataFrame:
    images = _boxes(spark, d, 0).withColumn("hint", F.when(F.col("id") % 7 == 0, "document-like"))
    return vision.reading_targets(images).select("page_id", "id", "rank")


@query("""
SELECT c_custkey AS id, CASE WHEN abs((1000 + c_custkey % 100) / 1000.0 - 1.05) / 1.05 > 0.03 THEN round((1000 + c_custkey % 100) / 1000.0, 3) ELSE 1.05 END AS dpr FROM customer
""")
def measured_dpr(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    return _keyed(spark, d).select("id", vision.effective_dpr((1000 + k % 100).cast("double"), F.lit(1000.0), F.lit(1.05)).alias("dpr"))


@query("""
WITH a AS (SELECT vec_id, a, embedding, list_transform(range(4), lambda c: embedding[(4 + c) * 8 + a + 1]::DOUBLE) AS s FROM embeddings, range(8) r(a))
SELECT vec_id, a AS id, (list_position(s, list_max(s)) - 1)::INTEGER AS class, list_max(s) AS score,
  embedding[a + 1]::DOUBLE / 2 - embedding[16 + a + 1]::DOUBLE / 2 / 2 AS x FROM a WHERE list_max(s) >= 0.1
""")
def decode_boxes(spark: SparkSession, d: str) -> DataFrame:
    boxes = vision.decoded(F.col("embedding"), 4, 2.0, 0.1)
    return table(spark, d, "embeddings").select("vec_id", F.explode(boxes).alias("b")).select("vec_id", "b.id", "b.class", "b.score", F.col("b.box.x").alias("x"))


# --- scores --------------------------------------------------------------------------------


@query(f"""
WITH m AS (SELECT t.page_id, t.id, max(CASE WHEN d.id IS NULL THEN 0 ELSE 1 END) AS hit, max(CASE WHEN d.id % 3 = t.id % 2 THEN 1 ELSE 0 END) AS typed
  FROM {_boxes_sql(0)} t LEFT JOIN {_boxes_sql(20)} d ON t.page_id = d.page_id AND {_INSIDE} GROUP BY ALL)
SELECT page_id, count(*) AS truths, sum(hit)::BIGINT AS covered, sum(typed)::BIGINT AS typed, round(avg(hit), 3) AS coverage, round(avg(typed), 3) AS recall FROM m GROUP BY page_id
""")
def typed_coverage(spark: SparkSession, d: str) -> DataFrame:
    hits = spatial.matched(_boxes(spark, d, 0), _boxes(spark, d, 20)).select(
        F.col("t.page_id").alias("page_id"), F.col("t.id").alias("truth"), (F.col("t.id") % 2).alias("truth_type"), (F.col("d.id") % 3).alias("found_type")
    )
    return evaluation.coverage(hits, ("page_id",))


@query(f"""
SELECT page_id, round(count(t.page_id) FILTER (WHERE d.m = 1) / nullif(count(t.t), 0), 6) AS recall, round(count(t.t) FILTER (WHERE d.m = 1) / nullif(count(d.m), 0), 6) AS precision,
  round(count(d.m) / 4000, 6) AS hidden
FROM (SELECT *, 1 AS t FROM {_cells_sql(0)}) t FULL JOIN (SELECT *, 1 AS m FROM {_cells_sql(20)}) d USING (page_id, cx, cy) GROUP BY page_id
""")
def mask_scores(spark: SparkSession, d: str) -> DataFrame:
    def grid(shift: int) -> DataFrame:
        return _boxes(spark, d, shift).select("page_id", F.explode(spatial.cells(F.col("box"), 16)).alias("c")).select("page_id", "c.*").distinct()

    return evaluation.mask_scores(grid(0), grid(20), ("page_id",), 4000)


@query("SELECT event_type, median(value) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.timings(table(spark, d, "events"), "value", ("event_type",))


@query("""
SELECT user_id, count(*) FILTER (WHERE value >= 50) AS model_steps, round(median(event_id) FILTER (WHERE value >= 50) / 1000, 1) AS median_s,
  max(event_id % 777) FILTER (WHERE value >= 50) AS most_tokens, count(*) FILTER (WHERE value >= 50 AND event_id % 2 = 0) AS with_image FROM events GROUP BY user_id
""")
def model_steps(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "events").select(
        "user_id", F.when(F.col("value") >= 50, "vlm").otherwise("rules").alias("planner"), F.col("event_id").alias("inference_ms"),
        (F.col("event_id") % 777).alias("prompt_tokens"), (F.col("event_id") % 2 == 0).alias("image_sent"),
    )
    return evaluation.model_steps(steps, ("user_id",))


@query("""
SELECT d.doc_id, b.text AS value FROM documents d JOIN (SELECT DISTINCT text FROM benchmark) b
  ON contains(regexp_replace(lower(d.text), '[^\\p{L}\\p{N}]', '', 'g'), regexp_replace(lower(b.text), '[^\\p{L}\\p{N}]', '', 'g'))
""")
def leaked_values(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "benchmark").select(F.col("text").alias("value")).distinct()
    return evaluation.leaks(table(spark, d, "documents"), values)


@query(f"SELECT c_custkey AS id, {_case('pii_text', 'payment_card', None, 'button', 'password_field', 'logo')} AS class FROM customer")
def detector_classes(spark: SparkSession, d: str) -> DataFrame:
    kind, value = _pick("pii", "pii", "pii", "ui", "ui", "canvas"), _pick("email", "CVV", "FACE", "Button", "password", "logo")
    return _keyed(spark, d).select("id", synthesis.detector_class(kind, value).alias("class"))


@query(f"SELECT c_custkey AS id, {_case(True, False, False)} AS yes, {_case(True, False, False)} AS sends FROM customer")
def consent_and_enter(spark: SparkSession, d: str) -> DataFrame:
    asked = _pick("I declare that this is true", "Press submit on the declaration?", "Allow it?")
    sends = choices.enter_submits(_pick("textbox", "searchbox", "textbox"), F.lit("text"), _pick("Name", "Name", "Search here"), F.lit(None).cast("string"))
    return _keyed(spark, d).select("id", choices.consents(asked).alias("yes"), sends.alias("sends"))


@query(f"""
WITH t AS (SELECT page_id, sum(hit)::BIGINT AS tp, sum(1 - hit)::BIGINT AS fn FROM (SELECT t.page_id, t.id,
    max(CASE WHEN d.id IS NULL THEN 0 ELSE 1 END) AS hit FROM {_boxes_sql(0)} t LEFT JOIN {_boxes_sql(40)} d ON t.page_id = d.page_id AND {_INSIDE} GROUP BY ALL) GROUP BY page_id),
  f AS (SELECT page_id, count(*) AS fp FROM {_boxes_sql(40)} d WHERE NOT EXISTS (SELECT 1 FROM {_boxes_sql(0)} t WHERE t.page_id = d.page_id AND {_INSIDE}) GROUP BY page_id),
  c AS (SELECT page_id, coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp, coalesce(fn, 0)::BIGINT AS fn FROM t FULL JOIN f USING (page_id))
SELECT page_id, tp, fp, fn, round(tp / nullif(tp + fp, 0), 3) AS precision, round(tp / nullif(tp + fn, 0), 3) AS recall,
  CASE WHEN tp > 0 THEN round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 3) END AS f1 FROM c
""")
def harness_score(spark: SparkSession, d: str) -> DataFrame:
    truth, found = _boxes(spark, d, 0), _boxes(spark, d, 40)
    each = spatial.matched(truth, found).groupBy(F.col("t.page_id").alias("page_id"), F.col("t.id").alias("id")).agg((F.count("d.id") > 0).alias("covered"))
    return evaluation.harness_scores(each, spatial.unmatched(found, truth), ("page_id",))


@query(f"""
SELECT c_custkey AS id, {_case('order', 'amount', 'count', 'invalid_card', 'invalid_aadhaar', 'year')} AS kind, true AS formed,
  CASE c_custkey % 6 WHEN 1 THEN '₹' || format('{{:,}}', (c_custkey::BIGINT * 7368787 % 899999999999) % 999900 + 100)
    WHEN 2 THEN ((c_custkey::BIGINT * 7368787 % 899999999999) % 99000 + 1000)::VARCHAR WHEN 5 THEN ((c_custkey::BIGINT * 7368787 % 899999999999) % 41 + 1990)::VARCHAR END AS number
FROM customer
""")
def mixed_decoys(spark: SparkSession, d: str) -> DataFrame:
    """Six kinds of decoy; those that could pass a check are shown by their form alone."""
    made = synthesis.mixed_decoys(_keyed(spark, d), "id")
    form = _pick("[0-9]{10,12}", "₹[0-9,]+", "[0-9]{4,6}", "4[0-9]{3}( [0-9]{4}){3}", "[0-9]{4}( [0-9]{4}){2}", "(19|20)[0-9]{2}")
    return made.select("id", "kind", F.regexp_like("decoy", F.concat(F.lit("^"), form, F.lit("$"))).alias("formed"), F.when(F.col("kind").isin("amount", "count", "year"), F.col("decoy")).alias("number"))


@query("""
SELECT c_custkey AS id, CASE WHEN k IN (3, 4) THEN 11 WHEN k = 2 THEN 3 ELSE 10 END::INTEGER AS rule, CASE k WHEN 2 THEN 'type' WHEN 3 THEN 'type' WHEN 4 THEN 'select' ELSE 'done' END AS action,
  CASE k WHEN 2 THEN '⟦PROFILE.EMAIL⟧' WHEN 3 THEN 'green' WHEN 4 THEN 'green' ELSE 'filled' END AS text FROM (SELECT *, c_custkey % 6 AS k FROM customer)
""")
def fill_from_task(spark: SparkSession, d: str) -> DataFrame:
    """What the task states goes before the profile, but not into a field that holds
    something (0), was answered (1), is about something else (2) or a choice made (5)."""
    k = F.col("id") % 6

    def element(id_: int, role: str, label: Column, **more) -> Column:
        s = lambda n: more.get(n, F.lit(None)).cast("string").alias(n)
        b = lambda n: more.get(n, F.lit(None)).cast("boolean").alias(n)
        return F.struct(
            F.lit(id_).alias("id"), F.lit(role).alias("role"), label.alias("label"), s("text"), s("placeholder"), s("value"),
            s("sensitive"), s("group"), b("required"), b("disabled"), b("checked"), b("filled"),
        )

    box = element(1, "textbox", F.when(k == 2, "colours of_it").otherwise("Your colour"), value=F.when(k == 0, "red"))
    mail = element(2, "textbox", F.lit("Email"), sensitive=F.lit("EMAIL"), filled=(k != 2) & (k != 3), value=F.when((k != 2) & (k != 3), "x"))
    choice = element(3, "radio", F.lit("Green"), group=F.lit("colour_wanted"), checked=k == 5)
    done = F.struct(F.lit("type").alias("action"), F.lit(1).alias("element_id"), F.lit(True).alias("ok"))
    rows = _keyed(spark, d).select(
        F.col("id").alias("request_id"), F.lit("My colour is green, fill the form").alias("task"), F.array(F.lit("EMAIL")).alias("profile_keys"), F.lit(False).alias("more_below"),
        F.when(k >= 4, F.array(choice)).otherwise(F.array(box, mail)).alias("elements"), F.filter(F.array(done), lambda _: k == 1).alias("history"),
    )
    return planning.plan(rows).select(F.col("request_id").alias("id"), "rule", "action", "text")


@query(f"""
SELECT c_custkey AS id, {_case(100, 800, 700, 5000)} AS wait, c_custkey % 14 < 12 AS taken, 'header, form' AS spine FROM customer
""")
def waits_and_budget(spark: SparkSession, d: str) -> DataFrame:
    made = synthesis.sections(F.array(F.lit("header"), F.lit("form")), F.array(F.lit("extra"), F.lit("more")), F.col("id"))
    rows = _keyed(spark, d)
    return rows.select("id", requests.waited(_pick(5, None, 700, 60000)).alias("wait"), requests.within_budget(F.col("id") % 14).alias("taken"), F.array_join(F.slice(made, 1, 2), ", ").alias("spine"))


@query("SELECT event_id, ts AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_steps(spark: SparkSession, d: str) -> DataFrame:
    return requests.recent(table(spark, d, "events").select("event_id", F.col("ts").alias("at")))


@query(f"""
SELECT c_custkey AS id, {_case('EARLIER IN THIS CONVERSATION (oldest first):' + chr(10) + '- user: hello' + chr(10) + '  you: hi' + chr(10) + chr(10), '', '')} || 'TASK: ' || {_case('fill it', 'What is due?', 'fill it')} || '

STEP: ' || (c_custkey % 3) || '

PAGE: https://a.example/form' || {_case(' — ' + 'A form', '', '')} || '

' || {_case('NOTE: no screenshot this step. The page was judged too sensitive, or redaction covered too much of it to be worth sending. Work from the element list and their bounding boxes alone.' + chr(10) + chr(10), 'NOTE: no screenshot this step — the element list and the screen text below describe everything on the page. Refer to elements by id.' + chr(10) + chr(10), '')} || 'PROFILE KEYS AVAILABLE: ' || {_case('EMAIL, PHONE', '(none)', '(none)')} || '

REDACTIONS ON THIS SCREEN:
[]

ELEMENTS:
[{{"id":1,"role":"checkbox"}}]

' || {_case('', 'SCREEN TEXT (reading order; personal data already replaced by tokens):' + chr(10) + 'Due: 5' + chr(10) + chr(10), '')} || {_case('', '', 'The page continues below what is on screen; scroll down to see more of it.' + chr(10) + chr(10))} || {_case('', 'THIS TASK IS A QUESTION. Do not click, type or scroll. Reply now with {"action": "done", "summary": "<the answer, in the words of the SCREEN TEXT>"}. If the answer is behind a token, the token is the answer.' + chr(10) + chr(10), '')} || 'Respond with exactly one JSON action object.' AS text FROM customer
""")
def model_prompt(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id") % 3
    none = F.array().cast("array<struct<token:string,type:string>>")
    turn = F.array(F.struct(F.lit("hello").alias("task"), F.lit("hi").alias("summary")))
    r = F.struct(
        _pick("fill it", "What is due?", "fill it").alias("task"), k.alias("step"), F.lit("https://a.example").alias("origin"), F.lit("/form").alias("path"),
        _pick("A form", None, "").alias("title"), _pick(1, 2, 2).alias("level"), (k == 2).alias("attached"),
        F.when(k == 0, F.array(F.lit("EMAIL"), F.lit("PHONE"))).otherwise(F.array().cast("array<string>")).alias("profile_keys"), none.alias("redactions"),
        F.array(F.struct(F.lit(1).alias("id"), F.lit("checkbox").alias("role"), F.lit("on").alias("value"), F.lit(True).alias("filled"))).alias("elements"),
        F.when(k == 1, "Due: 5").alias("visible_text"), (k == 2).alias("more_below"), F.array().cast("array<struct<action:string>>").alias("history"),
        F.when(k == 0, turn).alias("conversation"),
    )
    return _keyed(spark, d).withColumn("r", r).select("id", requests.prompt(F.col("r")).alias("text"))
