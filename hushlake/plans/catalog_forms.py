"""More queries: gates, offers, scanned cards, model answers, labels, bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.functions import geometry
from hushlake.operators import gates, offers, spatial
from hushlake.sources import documents
from hushlake.sources.tables import table
from hushlake.streaming import offers as timed

from .catalog import query


@query("""
SELECT c_custkey AS action_id, k = 5 AS ok, [ 'other-site', 'other-kind', 'replaces-value', 'made-up', 'retyped', NULL][(k + 1)::INTEGER] AS gate,
  ['EMAIL', 'EMAIL', 'EMAIL', 'EMAIL', 'GENERIC', NULL][(k + 1)::INTEGER] AS value_type FROM (SELECT *, c_custkey % 6 AS k FROM customer)
""")
def value_gate(spark: SparkSession, d: str) -> DataFrame:
    """Six kinds of action, five of which a gate must stop."""
    k = F.col("c_custkey") % 6
    actions = table(spark, d, "customer").select(
        F.col("c_custkey").alias("action_id"),
        F.when(k <= 1, "⟦EMAIL_1⟧").when(k == 2, "plain words").when(k == 3, "made@up.example.com").when(k == 4, "second").otherwise("⟦EMAIL_1⟧ and more").alias("text"),
        F.when(k == 0, "https://b.example").otherwise("https://a.example").alias("page_origin"),
        F.when((k == 2) | (k == 5), "EMAIL").when(k == 1, "PHONE").alias("field_type"),
        F.when(k == 2, "⟦EMAIL_1⟧").alias("field_value"),
        F.lit("Contact").alias("field_label"),
        F.when(k == 4, "first").alias("typed"),
    )
    known = spark.createDataFrame([("⟦EMAIL_1⟧", "EMAIL", "https://a.example")], "token string, type string, origin string")
    return gates.gate(actions, known)


@query("""
SELECT page_id, CASE WHEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) = 'https://ththnd.example.net' THEN 'allow' ELSE 'confirm' END AS verdict FROM pages
""")
def navigation_gate(spark: SparkSession, d: str) -> DataFrame:
    verdict = gates.navigation(F.col("url"), F.lit("https://ththnd.example.net"))
    return table(spark, d, "pages").select("page_id", verdict.alias("verdict"))


@query("""
SELECT c_custkey AS form_id, 'city town' AS key, c_name || '-2' AS value FROM customer WHERE c_custkey % 4 <> 0
""")
def offer_new_answers(spark: SparkSession, d: str) -> DataFrame:
    """Readings of a form: the last per label, secrets left out, known ones too."""
    c, none = table(spark, d, "customer"), F.lit(None).cast("string")

    def reading(ord_: int, kind: str, sensitive, value, label: str) -> DataFrame:
        return c.select(
            F.col("c_custkey").alias("form_id"), F.lit(ord_).alias("ord"), F.lit("textbox").alias("role"), F.lit(kind).alias("input_type"),
            F.lit(sensitive).cast("string").alias("sensitive"), value.alias("value"), F.lit(label).alias("label"), none.alias("placeholder"), none.alias("group"),
        )

    name = F.col("c_name")
    rows = reading(1, "text", None, name, "Your town (city)").unionByName(reading(2, "text", None, F.concat(name, F.lit("-2")), "Town, city"))
    rows = rows.unionByName(reading(3, "password", "PASSWORD", name, "Secret")).unionByName(reading(4, "text", "OTP", name, "Code"))
    rows = rows.withColumn("label", F.when(F.col("ord") <= 2, "City or town of the").otherwise(F.col("label"))).withColumn("label", F.regexp_replace("label", " or ", " "))
    items = offers.learnable(rows)
    known = c.where("c_custkey % 4 = 0").select(F.lit("city town").alias("key"), F.concat("c_name", F.lit("-2")).alias("value"))
    return offers.new_to_vault(items, known).select("form_id", "key", "value")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'email' WHEN p_partkey % 3 = 1 THEN 'email and city' ELSE 'a, b, c and 2 more' END AS said FROM part
""")
def describe_offer(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    names = F.when(k == 0, arr("email", "email")).when(k == 1, arr("email", "city")).otherwise(arr(*"abcde"))
    return table(spark, d, "part").select("p_partkey", offers.described(names).alias("said"))


@query("""
SELECT s_suppkey AS scan_id, i AS line_no, CASE WHEN i = 0 THEN 'DOB ' || s_suppkey ELSE s_name || ' end' END AS text,
  CASE WHEN i = 1 THEN 'DOB ' || s_suppkey END AS before, CASE WHEN i = 0 THEN 30.0 ELSE 90.0 END AS right_edge
FROM supplier, (SELECT unnest([0, 1]) AS i)
""")
def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two recognised lines per scan, with the box around the first four characters."""
    s = table(spark, d, "supplier")
    word = '{{"text":%s,"bbox":{{"x0":%d,"y0":0,"x1":%d,"y1":10}}}}'
    first = ",".join((word % ('"DOB"', 0, 30) + "|" + word % ('"{k}"', 40, 60)).replace("{{", "{").replace("}}", "}").split("|"))
    second = ",".join((word % ('"{n}"', 0, 90) + "|" + word % ('"end"', 95, 120)).replace("{{", "{").replace("}}", "}").split("|"))
    tree = '{"blocks":[{"paragraphs":[{"lines":[{"confidence":90,"words":[' + first + ']},{"words":[' + second + ',{"text":""}]}]}]},{}]}'
    filled = F.replace(F.replace(F.lit(tree), F.lit("{k}"), F.col("s_suppkey").cast("string")), F.lit("{n}"), F.col("s_name"))
    lines = documents.ocr_lines(s.select(F.col("s_suppkey").alias("scan_id"), filled.alias("tree")))
    box = documents.box_of_span(F.col("words"), F.lit(0), F.lit(3))
    return lines.select("scan_id", "line_no", "text", "before", box.x1.alias("right_edge"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE '{"action": "click", "element_id": ' || p_partkey || '}' END AS action FROM part
""")
def json_lenient_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit('{"element_id": '), k, F.lit(', "action": "click"}'))
    answer = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("<think>{no}</think>"), body))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("I {will} do "), body, F.lit(" now")))
        .otherwise(F.lit("no object <think>{\"a\":1}"))
    )
    return table(spark, d, "part").select("p_partkey", documents.model_action(answer).alias("action"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS value FROM customer")
def vault_seal_open(spark: SparkSession, d: str) -> DataFrame:
    """Sealed and opened again; every fifth blob is spoiled on the way."""
    key = F.encode(F.lit("0123456789abcdef0123456789abcdef"), "UTF-8")
    blob = documents.sealed(F.col("c_name"), key)
    kept = table(spark, d, "customer").select("c_custkey", blob.alias("b"))
    spoiled = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("AAAA"), F.substr("b", F.lit(5)))).otherwise(F.col("b"))
    return kept.select("c_custkey", documents.opened(spoiled, key).alias("value"))


@query("""
SELECT id, line FROM (SELECT id, CASE WHEN h >= 25 AND cx <= 1 AND cy <= 1 THEN format('{} {:.6f} {:.6f} {:.6f} {:.6f}', id % 9, cx, cy, w / 1000.0, h / 500.0) END AS line
  FROM (SELECT s_suppkey AS id, ((s_suppkey * 37) % 800 + (60 + s_suppkey % 40) / 2.0) / 1000.0 AS cx, ((s_suppkey * 53) % 600 + (20 + s_suppkey % 30) / 2.0) / 500.0 AS cy,
    (60 + s_suppkey % 40)::DOUBLE AS w, (20 + s_suppkey % 30)::DOUBLE AS h FROM supplier))
""")
def yolo_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    h = 20 + k % 30
    b = geometry.box((k * 37) % 800, (k * 53) % 600, F.lit(60) + k % 40, F.when(h >= 25, h).otherwise(2))
    b = F.when(h >= 25, b).otherwise(geometry.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)))
    return table(spark, d, "supplier").select(k.alias("id"), documents.yolo_line(k % 9, b, F.lit(1000.0), F.lit(500.0)).alias("line"))


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 4 <> 0")
def dismiss_read_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Vague boxes over plain text go; over a number, a picture or a value they stay."""
    k = F.col("s_suppkey")
    box = geometry.box(F.lit(0), F.lit(0), F.lit(100), F.lit(20))
    vague = table(spark, d, "supplier").select(k.alias("page_id"), k.alias("id"), F.lit("vision").alias("source"), box.alias("box"))
    k = F.col("page_id")
    text = vague.select("page_id", F.lit("text").alias("kind"), F.when(k % 4 == 1, "call 1234 5678 90").otherwise("plain words").alias("text"), "box")
    more = vague.where("page_id % 4 in (2, 3)").select("page_id", F.when(k % 4 == 2, "picture").otherwise("personal").alias("kind"), F.lit("").alias("text"), "box")
    return spatial.vague_boxes_left(vague, text.unionByName(more)).select("id")


@query("""
SELECT event_id FROM events QUALIFY coalesce(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch(ts) > 600, true)
""")
def debounced_events(spark: SparkSession, d: str) -> DataFrame:
    return timed.debounced(table(spark, d, "events"), 600.0).select("event_id")


@query("""
WITH l AS (SELECT user_id, max(ts) AS ts, max_by(event_type, (ts, event_id)) AS a FROM events GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events)
SELECT user_id FROM l, m WHERE a = 'view' AND ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 5 DAY
""")
def offer_ttl(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("action", F.when(F.col("event_type") == "view", "offer").otherwise("dismissed"))
    return timed.live_offers(events, "2024-01-15 00:00:00", 5 * 86400).select("user_id")


@query("""
WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN ts::TIMESTAMP - lag(ts::TIMESTAMP) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k
""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return timed.sessions(table(spark, d, "events"))
