"""All queries of the library by name, with the SQL that each must equal.

Relations that the tables lack (people, forms, boxes, tasks) are made from
keys by arithmetic, the same in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushlake.functions import checksums, dates, geometry, text as tx
from hushlake.operators import answers, entities, evaluation, fields, planning, sanitize, spatial, synthesis, vault
from hushlake.sources import html
from hushlake.sources.tables import table
from hushlake.streaming import limits

FLAGSHIP = "entity_counts_by_lang"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- entities ---------------------------------------------------------------

EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"
#: Luhn over a string of digits d, in SQL.
LUHN = (
    "(list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 0 THEN "
    "(2 * d[len(d) + 1 - i]::INTEGER) % 10 + (2 * d[len(d) + 1 - i]::INTEGER) // 10 ELSE d[len(d) + 1 - i]::INTEGER END)) % 10 = 0)"
)


def _cards(source: str, key: str, column: str) -> str:
    """Card numbers without look-around: separators doubled, so that the one
    that ends a match is still there to begin the next."""
    return f"""
      SELECT {key}, d FROM (
        SELECT {key}, regexp_replace(unnest(regexp_extract_all(
          regexp_replace({column}, '([^0-9])', '\\1\\1', 'gs'),
          '(?:^|[^0-9])([0-9](?:(?:  |--)?[0-9]){{12,18}})(?:[^0-9]|$)', 1)), '[^0-9]', '', 'g') AS d FROM {source}
      ) WHERE len(d) BETWEEN 13 AND 19 AND {LUHN}"""


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS value FROM documents")
def email_scan(spark: SparkSession, d: str) -> DataFrame:
    return entities.scan_entities(table(spark, d, "documents"), only=["EMAIL"]).select("doc_id", "value")


@query(f"SELECT doc_id, d AS digits FROM ({_cards('documents', 'doc_id', 'text')})")
def card_luhn_scan(spark: SparkSession, d: str) -> DataFrame:
    hits = entities.scan_entities(table(spark, d, "documents"), only=["CARD"])
    return hits.select("doc_id", checksums.only_digits(F.col("value")).alias("digits"))


@query(f"""
WITH hits AS (
  SELECT doc_id, 'EMAIL' AS type FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) FROM documents)
  UNION ALL SELECT doc_id, 'CARD' FROM ({_cards('documents', 'doc_id', 'text')}))
SELECT lang, type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM hits JOIN documents USING (doc_id) GROUP BY lang, type
""")
def entity_counts_by_lang(spark: SparkSession, d: str) -> DataFrame:
    hits = entities.scan_entities(table(spark, d, "documents"), only=["EMAIL", "CARD"], keep=("doc_id", "lang"))
    return hits.groupBy("lang", "type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"SELECT page_id, unnest(regexp_extract_all(html, '{EMAIL}')) AS value FROM pages")
def pages_email_scan(spark: SparkSession, d: str) -> DataFrame:
    hits = entities.scan_entities(table(spark, d, "pages"), "html", only=["EMAIL"], keep=("page_id",))
    return hits.select("page_id", "value")


@query(f"""
SELECT doc_id, d AS digits FROM ({_cards('documents', 'doc_id', 'text')})
""")
def guard_only_strict(spark: SparkSession, d: str) -> DataFrame:
    """The server's profile, restricted to cards before any regex runs."""
    hits = entities.scan_entities(table(spark, d, "documents"), only=["CARD"], strict=True)
    return hits.select("doc_id", checksums.only_digits(F.col("value")).alias("digits"))


#: Texts with context words by key, in both languages of the engine.
def _coded(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    code = F.lpad(((k * 43) % 900000 + 100000).cast("string"), 6, "0")
    lead = F.when(k % 4 == 0, "Your OTP is ").when(k % 4 == 1, "Order number ").when(k % 4 == 2, "PIN code ").otherwise("सत्यापन कोड ")
    return table(spark, d, "customer").select(k.alias("id"), F.concat(lead, code, F.lit(" for "), "c_name").alias("text"))


_CODED = """
  SELECT c_custkey AS id, (c_custkey * 43) % 900000 + 100000 AS code,
    (CASE c_custkey % 4 WHEN 0 THEN 'Your OTP is ' WHEN 1 THEN 'Order number ' WHEN 2 THEN 'PIN code ' ELSE 'सत्यापन कोड ' END)
      || lpad(((c_custkey * 43) % 900000 + 100000)::VARCHAR, 6, '0') || ' for ' || c_name AS text
  FROM customer"""


@query(f"""
SELECT id, regexp_extract(text, '[0-9]+') AS value,
  CASE WHEN contains(lower(text), 'otp') OR contains(text, 'सत्यापन कोड') THEN 'OTP' ELSE 'PINCODE' END AS type
FROM ({_CODED}) WHERE contains(lower(text), 'otp') OR contains(text, 'सत्यापन कोड') OR contains(lower(text), 'pin code')
""")
def context_window_rule(spark: SparkSession, d: str) -> DataFrame:
    hits = entities.scan_entities(_coded(spark, d), only=["OTP", "PINCODE"], keep=("id",))
    return hits.where(F.length("value") == 6).select("id", "value", "type")


def _people_sql(columns: str) -> str:
    table_ = "[" + ", ".join(map(str, checksums.PRODUCT)) + "]"
    powers = "[" + ", ".join(map(str, checksums.POWERS)) + "]"
    inverse = "[" + ", ".join(map(str, checksums.INVERSE)) + "]"
    return f"""
    WITH stems AS (
      SELECT c_custkey, ((c_custkey * 7919) % 79999999999 + 20000000000)::VARCHAR AS stem,
        '4' || lpad(((c_custkey * 104729) % 99999999999999)::VARCHAR, 14, '0') AS card
      FROM customer),
    folded AS (
      SELECT *, list_reduce(list_prepend(0, list_transform(range(1, 12), lambda i:
          {powers}[((i % 8) * 10 + stem[12 - i]::INTEGER + 1)::INTEGER])),
          lambda a, b: {table_}[(a * 10 + b + 1)::INTEGER]) AS v,
        list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN
          (2 * card[16 - i]::INTEGER) % 10 + (2 * card[16 - i]::INTEGER) // 10 ELSE card[16 - i]::INTEGER END)) AS l
      FROM stems)
    SELECT c_custkey, stem || {inverse}[(v + 1)::INTEGER]::VARCHAR AS aadhaar, card || ((10 - l % 10) % 10)::VARCHAR AS card FROM folded"""


def _people(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.people(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query(f"SELECT c_custkey, aadhaar FROM ({_people_sql('')})")
def verhoeff_generate(spark: SparkSession, d: str) -> DataFrame:
    return _people(spark, d).select("c_custkey", "aadhaar")


@query(f"SELECT c_custkey, card FROM ({_people_sql('')})")
def luhn_generate(spark: SparkSession, d: str) -> DataFrame:
    return _people(spark, d).select("c_custkey", "card")


@query(f"SELECT c_custkey, true AS good, (aadhaar[12]::INTEGER + 1) % 10 = aadhaar[12]::INTEGER AS spoiled FROM ({_people_sql('')})")
def verhoeff_check(spark: SparkSession, d: str) -> DataFrame:
    """Every made number holds; with its last digit raised by one it fails."""
    p = _people(spark, d)
    spoiled = F.concat(F.left("aadhaar", F.lit(11)), ((F.right("aadhaar", F.lit(1)).cast("int") + 1) % 10).cast("string"))
    return p.select("c_custkey", checksums.verhoeff_valid(F.col("aadhaar")).alias("good"), checksums.verhoeff_valid(spoiled).alias("spoiled"))


@query("""
SELECT p_partkey, regexp_matches(v, '^[A-Z]{3}[PCHFATBLJG][A-Z][0-9]{4}[A-Z]$') AS valid FROM (
  SELECT p_partkey, 'ABC' || chr((65 + p_partkey % 26)::INTEGER) || 'I' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') || 'K' AS v FROM part)
""")
def pan_structure(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    v = F.concat(F.lit("abc"), F.char(97 + k % 26), F.lit("I"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("k"))
    return table(spark, d, "part").select("p_partkey", checksums.pan_valid(v).alias("valid"))


@query(f"""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'CARD' ELSE 'ACCOUNT' END AS type FROM ({_people_sql('')})
""")
def overlap_resolution(spark: SparkSession, d: str) -> DataFrame:
    """A valid card beside the word account is a card; a spoiled one is an account."""
    p = _people(spark, d)
    spoiled = F.concat(F.left("card", F.lit(15)), ((F.right("card", F.lit(1)).cast("int") + 1) % 10).cast("string"))
    said = F.concat(F.lit("account "), F.when(F.col("c_custkey") % 3 == 0, F.col("card")).otherwise(spoiled))
    texts = p.select("c_custkey", said.alias("text"))
    return entities.scan_entities(texts, only=["CARD", "ACCOUNT"], keep=("c_custkey",)).select("c_custkey", "type")


@query(f"""
SELECT id, CASE WHEN lower(provider) IN ({_list(entities.HANDLES)[1:-1]}) OR contains(lower(text), 'upi') THEN 'UPI' END AS type FROM (
  SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'okaxis' ELSE 'somewhere' END AS provider,
    CASE WHEN s_suppkey % 2 = 0 THEN 'upi id ' ELSE 'find me ' END || 'shop' || s_suppkey || '@' || provider AS text FROM supplier)
WHERE type IS NOT NULL
""")
def upi_handle_or_context(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    said = F.concat(
        F.when(k % 2 == 0, "upi id ").otherwise("find me "), F.lit("shop"), k.cast("string"), F.lit("@"),
        F.when(k % 3 == 0, "okaxis").otherwise("somewhere"),
    )
    texts = table(spark, d, "supplier").select(k.alias("id"), said.alias("text"))
    return entities.scan_entities(texts, only=["UPI"], keep=("id",)).select("id", "type")


# --- scalar text -------------------------------------------------------------

_WS = "[\\s\\x{A0}\\x{FEFF}\\p{Z}\\x0b]+"


@query(f"SELECT doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS clean FROM documents")
def collapse_ws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.squeezed(F.col("text")).alias("clean"))


@query(f"""
SELECT doc_id, CASE WHEN length(c) > 120 THEN left(c, 119) || '…' ELSE c END AS label
FROM (SELECT doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS c FROM documents)
""")
def clamp_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.clamp_label(F.col("text")).alias("label"))


@query("""
SELECT c_custkey, left(m, 1) || repeat('•', least(strpos(m, '@') - 2, 6)) || substr(m, strpos(m, '@')) AS mail,
  left(c_phone, 1) || repeat('•', least(length(c_phone) - 3, 8)) || right(c_phone, 2) AS phone
FROM (SELECT c_custkey, c_name AS c_phone, 'user' || c_custkey || '@mail.example.com' AS m FROM customer)
""")
def mask_value(spark: SparkSession, d: str) -> DataFrame:
    mail = F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@mail.example.com"))
    return table(spark, d, "customer").select("c_custkey", tx.masked(mail).alias("mail"), tx.masked(F.col("c_name")).alias("phone"))


@query("SELECT c_custkey, regexp_replace(lower(c_name || ' (x).'), '[\\s().-]', '', 'g') AS norm FROM customer")
def normalize_compare(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", tx.compared(F.concat("c_name", F.lit(" (x)."))).alias("norm"))


@query(f"""
SELECT p_partkey, array_to_string(list_sort(list_filter(
  regexp_split_to_array(regexp_replace(lower('Please enter your ' || p_name || ' (optional) *'), '\\([^)]*\\)', ' ', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'),
  lambda w: w <> '' AND NOT list_contains({_list(tx.NOISE)}, w))), ' ') AS label FROM part
""")
def normalize_label(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Please enter your "), "p_name", F.lit(" (optional) *"))
    return table(spark, d, "part").select("p_partkey", tx.normal_label(said).alias("label"))


@query("""
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) AS origin,
  CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/'
    ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS path FROM pages
""")
def url_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.safe_url(F.col("url")).alias("u")).select("page_id", "u.origin", "u.path")


@query("SELECT o_orderkey, strftime(o_orderdate::DATE, '%Y-%m-%d') AS iso FROM orders")
def to_iso_date(spark: SparkSession, d: str) -> DataFrame:
    """Order dates in four spellings, read back."""
    at, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    said = (
        F.when(k % 4 == 0, F.date_format(at, "dd/MM/yyyy"))
        .when(k % 4 == 1, F.date_format(at, "d MMMM yyyy"))
        .when(k % 4 == 2, F.date_format(at, "MMM d, yyyy"))
        .otherwise(F.date_format(at, "yyyy-MM-dd"))
    )
    return table(spark, d, "orders").select("o_orderkey", dates.iso_date(said).alias("iso"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE > DATE '1996-06-30'")
def future_date_filter(spark: SparkSession, d: str) -> DataFrame:
    said = F.date_format(F.col("o_orderdate").cast("date"), "dd.MM.yyyy")
    return table(spark, d, "orders").where(dates.is_future(said, F.lit("1996-06-30").cast("date"))).select("o_orderkey")


# --- fields, questions, tasks -----------------------------------------------

#: (label, what it asks for)
LABELS = (
    ("Aadhaar number", "AADHAAR"), ("panNumber", "PAN"), ("date_of_birth", "DOB"), ("Mobile no", "PHONE"),
    ("E-mail address", "EMAIL"), ("BANK_ACC_NO", "ACCOUNT"), ("पिता का नाम", "NAME"), ("कंपनी का नाम", None),
    ("Company name", None), ("Father's name", "NAME"), ("Shipping panel", None), ("जन्म तिथि", "DOB"),
    ("One-time password", "PASSWORD"), ("Zip code", "PINCODE"), ("Street", "ADDRESS"), ("Order quantity", None),
)


@query(f"""
SELECT c_custkey AS field_id, {_list(n or '' for _, n in LABELS)}[(c_custkey % {len(LABELS)} + 1)::INTEGER] AS kind FROM customer
""")
def classify_field(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    label = F.get(F.array(*[F.lit(x) for x, _ in LABELS]), (k % len(LABELS)).cast("int"))
    none = F.lit("")
    form = table(spark, d, "customer").select(
        k.alias("field_id"), F.lit("INPUT").alias("tag"), F.lit("text").alias("type"), label.alias("label"),
        *[none.alias(c) for c in ("aria_label", "placeholder", "name", "id", "title", "autocomplete")], F.lit(True).alias("editable"),
    )
    return fields.classify_fields(form).select("field_id", F.coalesce("kind", none).alias("kind"))


@query("""
SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(p_name || ' dateOfBirth_' || p_partkey, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[_.-]+', ' ', 'g')) AS context FROM part
""")
def field_context(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit("")
    named = F.concat(F.lit("dateOfBirth_"), F.col("p_partkey").cast("string"))
    c = fields.field_context(F.col("p_name"), none, none, named, none, none)
    return table(spark, d, "part").select("p_partkey", c.alias("context"))


@query("""
SELECT p_partkey, ['avatar-like', 'document-like', 'signature-like', 'code-like', ''][(p_partkey % 5 + 1)::INTEGER] AS hint FROM part
""")
def image_hint(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("p_partkey") % 5).cast("int")
    alt = F.get(F.array(*[F.lit(x) for x in ("User photo", "My passport", "sign here", "QR", "company logo")]), k)
    hint = fields.image_hint(alt, F.lit("img"), F.concat(F.lit("/a/"), F.col("p_partkey").cast("string"), F.lit(".png?avatar=1")))
    return table(spark, d, "part").select("p_partkey", F.coalesce(hint, F.lit("")).alias("hint"))


_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


@query(f"""
SELECT page_id, CASE WHEN regexp_matches({_HOST}, '{answers.SENSITIVE_HOST}') OR page_id % 10 > 4 THEN 1 ELSE 2 END::INTEGER AS level FROM pages
""")
def decide_disclosure(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, d, "pages").select("page_id", answers.disclosure(host, (F.col("page_id") % 10) / 10).alias("level"))


@query(f"""
SELECT conv_id, turn, len(list_filter({_list(answers.IRREVERSIBLE)}, lambda w: contains(lower(text), w))) > 0 AS hit FROM conversations
""")
def irreversible_hint(spark: SparkSession, d: str) -> DataFrame:
    hit = answers.looks_irreversible(F.col("text"), F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", hit.alias("hit"))


@query(f"""
SELECT conv_id, turn, ends_with(t, '?') OR regexp_matches(t, '{answers.QUESTION.replace("(?=[", "(?:[").replace("'", "''")}')
  OR len(list_filter({_list(answers.READ_ONLY)}, lambda w: contains(t, w))) > 0 AS question
FROM (SELECT conv_id, turn, lower(trim(text)) AS t FROM conversations)
""")
def question_detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", answers.is_question(F.col("text")).alias("question"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'shoes size ' || p_partkey ELSE NULL END AS query FROM part
""")
def search_query_extract(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    task = (
        F.when(k % 4 == 0, F.concat(F.lit("Please search for \""), name, F.lit("\".")))
        .when(k % 4 == 1, F.concat(F.lit("find shoes size "), k.cast("string")))
        .when(k % 4 == 2, F.lit("find the login button"))
        .otherwise(F.concat(F.lit("search for "), name, F.lit(" and buy it")))
    )
    return table(spark, d, "part").select("p_partkey", answers.search_query(task).alias("query"))


@query("""
SELECT c_custkey, 'group' || (c_custkey % 5) AS category, '⟦PROFILE.PHONE⟧' AS phone FROM customer
""")
def task_facts_extract(spark: SparkSession, d: str) -> DataFrame:
    task = F.concat(F.lit("My category is group"), (F.col("c_custkey") % 5).cast("string"), F.lit(", and my phone number is ⟦PROFILE.PHONE⟧. Fill the form"))
    facts = answers.task_facts(task)
    return table(spark, d, "customer").select(
        "c_custkey", F.try_element_at(facts, F.lit("category")).alias("category"), F.try_element_at(facts, F.lit("phone number")).alias("phone")
    )


_REQUEST = """elements array<struct<id:int,role:string,label:string,text:string,placeholder:string,value:string,sensitive:string,
  group:string,required:boolean,disabled:boolean,checked:boolean,filled:boolean>>"""


@query("""
SELECT c_custkey AS request_id,
  CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 6 WHEN 5 THEN 7 WHEN 6 THEN 8 WHEN 7 THEN 9 ELSE 10 END::INTEGER AS rule,
  CASE k WHEN 0 THEN 'done' WHEN 1 THEN 'search' WHEN 2 THEN 'type' WHEN 5 THEN 'click' WHEN 6 THEN 'scroll' WHEN 8 THEN 'done' ELSE 'ask_user' END AS action
FROM (SELECT c_custkey, c_custkey % 9 AS k FROM customer)
""")
def first_match_plan(spark: SparkSession, d: str) -> DataFrame:
    """Nine kinds of request, each with one rule that must fit first."""
    k = F.col("c_custkey") % 9

    def element(id_: int, role: str, label: str, when, **more) -> F.Column:
        s = lambda n: F.lit(more.get(n)).cast("string").alias(n)
        b = lambda n: F.lit(more.get(n)).cast("boolean").alias(n)
        e = F.struct(
            F.lit(id_).alias("id"), F.lit(role).alias("role"), F.lit(label).alias("label"), s("text"), s("placeholder"), s("value"),
            s("sensitive"), s("group"), b("required"), b("disabled"), b("checked"), b("filled"),
        )
        return F.when(when, e)

    items = F.array_compact(
        F.array(
            element(1, "textbox", "Email", k == 2, sensitive="EMAIL"),
            element(2, "textbox", "Father's email", k == 3, sensitive="EMAIL", required=True),
            element(3, "checkbox", "I agree", k == 4, required=True),
            element(4, "button", "Next ›", k == 5),
            element(5, "button", "Submit", (k == 7) | (k == 8)),
        )
    )
    task = F.when(k == 0, "What is on this page?").when(k == 1, "search for shoes").when(k == 8, "fill it, stop before submit").otherwise("fill the form")
    history = F.array().cast("array<struct<action:string,element_id:int,ok:boolean>>")
    requests = table(spark, d, "customer").select(
        F.col("c_custkey").alias("request_id"), task.alias("task"), F.array(F.lit("EMAIL")).alias("profile_keys"),
        (k == 6).alias("more_below"), items.alias("elements"), history.alias("history"),
    )
    return planning.plan(requests).select("request_id", "rule", "action")


# --- tokens, sanitizing, audit ------------------------------------------------


@query(f"""
WITH m AS (SELECT doc_id, unnest(v) AS value, unnest(range(len(v))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{EMAIL}') AS v FROM documents)),
f AS (SELECT regexp_replace(lower(value), '[\\s().-]', '', 'g') AS norm, min((doc_id, i)) AS place FROM m GROUP BY 1)
SELECT norm, '⟦EMAIL_' || row_number() OVER (ORDER BY place) || '⟧' AS token FROM f
""")
def tokenize_first_seen(spark: SparkSession, d: str) -> DataFrame:
    hits = entities.scan_entities(table(spark, d, "documents"), only=["EMAIL"])
    return vault.tokenize(hits).select("norm", "token")


@query("""
SELECT c_custkey, 'Mail ' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '⟦EMAIL_' || c_custkey || '⟧' END || ' or ' || c_name || '.' AS resolved,
  c_custkey % 2 = 1 AS has_unresolved FROM customer
""")
def resolve_tokens(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey").cast("string")
    mail, name = (F.concat(F.lit(f"⟦{t}_"), k, F.lit("⟧")) for t in ("EMAIL", "NAME"))
    texts = c.select("c_custkey", F.concat(F.lit("Mail "), mail, F.lit(" or "), name, F.lit(".")).alias("text"))
    mails = c.where("c_custkey % 2 = 0").select(mail.alias("token"), F.col("c_name").alias("value"))
    return vault.resolve(texts, "text", mails.unionByName(c.select(name.alias("token"), F.col("c_name").alias("value"))), "c_custkey")


@query("""
SELECT d.doc_id, b.text AS value FROM documents d JOIN (SELECT DISTINCT text FROM benchmark WHERE length(text) >= 4) b
  ON contains(lower(d.text), lower(b.text))
""")
def known_value_match(spark: SparkSession, d: str) -> DataFrame:
    return vault.known_values(table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("text").alias("value")))


@query(f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '⟦EMAIL⟧', 'g') AS clean FROM documents")
def sanitize_email(spark: SparkSession, d: str) -> DataFrame:
    return sanitize.sanitize(table(spark, d, "documents"), only=["EMAIL"]).select("doc_id", "clean")


@query("""
SELECT kind, type, path, count(*) AS n FROM (
  SELECT 'pattern' AS kind, 'EMAIL' AS type, 'elements[0].value' AS path FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 'vault', 'NAME', 'task' FROM customer WHERE c_custkey % 3 = 0) GROUP BY ALL
""")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    """Payloads with a leaked address, a known name in another spelling, and tokens."""
    k = F.col("c_custkey")
    mail = F.concat(F.lit("user"), k.cast("string"), F.lit("@mail.example.com"))
    item = lambda path, value: F.struct(F.lit(path).alias("path"), value.alias("value"))
    strings = F.array(
        item("elements[0].value", F.when(k % 2 == 0, mail).otherwise(F.lit("⟦EMAIL_1⟧"))),
        item("task", F.when(k % 3 == 0, F.lit("ask ANANYA-IYER now")).otherwise(F.lit("ask someone"))),
        item("screen.image_jpeg_b64", mail),
    )
    payload = table(spark, d, "customer").select(k.alias("payload_id"), strings.alias("strings"))
    secrets = spark.createDataFrame([("Ananya Iyer", "NAME"), ("abc", "NAME")], "value string, type string")
    found = sanitize.audit(payload, secrets=secrets)
    return found.groupBy("kind", "type", "path").agg(F.count("*").alias("n"))


# --- boxes ---------------------------------------------------------------------


def _boxes(spark: SparkSession, d: str, shift: int) -> DataFrame:
    k = F.col("s_suppkey")
    b = geometry.box((k * 37) % 800 + (k % 4) * shift, (k * 53) % 600, F.lit(60) + k % 40, F.lit(20) + k % 30)
    return table(spark, d, "supplier").select((k % 10).alias("page_id"), k.alias("id"), b.alias("box"))


def _boxes_sql(shift: int) -> str:
    return f"""(SELECT s_suppkey % 10 AS page_id, s_suppkey AS id, ((s_suppkey * 37) % 800 + (s_suppkey % 4) * {shift})::DOUBLE AS x,
      ((s_suppkey * 53) % 600)::DOUBLE AS y, (60 + s_suppkey % 40)::DOUBLE AS w, (20 + s_suppkey % 30)::DOUBLE AS h FROM supplier)"""


_COMMON = "greatest(least(t.x + t.w, d.x + d.w) - greatest(t.x, d.x), 0) * greatest(least(t.y + t.h, d.y + d.h) - greatest(t.y, d.y), 0)"
_INSIDE = f"({_COMMON}) / least(t.w * t.h, d.w * d.h) >= 0.5"


@query(f"""
SELECT t.id, round(({_COMMON}) / (t.w * t.h + d.w * d.h - ({_COMMON})), 6) AS iou, round(({_COMMON}) / least(t.w * t.h, d.w * d.h), 6) AS containment
FROM {_boxes_sql(0)} t JOIN {_boxes_sql(20)} d ON t.id = d.id
""")
def iou_containment(spark: SparkSession, d: str) -> DataFrame:
    t, f = _boxes(spark, d, 0).alias("t"), _boxes(spark, d, 20).alias("d")
    a, b = F.col("t.box"), F.col("d.box")
    return t.join(f, F.col("t.id") == F.col("d.id")).select(
        F.col("t.id").alias("id"), F.round(geometry.iou(a, b), 6).alias("iou"), F.round(geometry.containment(a, b), 6).alias("containment")
    )


@query(f"SELECT t.page_id, t.id AS truth, d.id AS found FROM {_boxes_sql(0)} t LEFT JOIN {_boxes_sql(20)} d ON t.page_id = d.page_id AND {_INSIDE}")
def truth_detection_left_join(spark: SparkSession, d: str) -> DataFrame:
    m = spatial.matched(_boxes(spark, d, 0), _boxes(spark, d, 20))
    return m.select("t.page_id", F.col("t.id").alias("truth"), F.col("d.id").alias("found"))


@query(f"SELECT page_id, id FROM {_boxes_sql(40)} d WHERE NOT EXISTS (SELECT 1 FROM {_boxes_sql(0)} t WHERE t.page_id = d.page_id AND {_INSIDE})")
def false_positive_anti(spark: SparkSession, d: str) -> DataFrame:
    return spatial.unmatched(_boxes(spark, d, 40), _boxes(spark, d, 0)).select("page_id", "id")


@query(f"""
WITH tp AS (SELECT page_id, sum(hit) AS tp, sum(1 - hit) AS fn FROM (
    SELECT t.page_id, t.id, max(CASE WHEN d.id IS NULL THEN 0 ELSE 1 END) AS hit FROM {_boxes_sql(0)} t
    LEFT JOIN {_boxes_sql(40)} d ON t.page_id = d.page_id AND {_INSIDE} GROUP BY ALL) GROUP BY ALL),
fp AS (SELECT page_id, count(*) AS fp FROM {_boxes_sql(40)} d WHERE NOT EXISTS (
    SELECT 1 FROM {_boxes_sql(0)} t WHERE t.page_id = d.page_id AND {_INSIDE}) GROUP BY ALL),
c AS (SELECT coalesce(page_id::VARCHAR, 'all') AS page, sum(tp)::BIGINT AS tp, sum(coalesce(fp, 0))::BIGINT AS fp, sum(fn)::BIGINT AS fn
  FROM tp LEFT JOIN fp USING (page_id) GROUP BY ROLLUP (page_id))
SELECT page, tp, fp, fn, round(tp / nullif(tp + fp, 0), 3) AS precision, round(tp / nullif(tp + fn, 0), 3) AS recall,
  round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 3) AS f1 FROM c
""")
def precision_recall_rollup(spark: SparkSession, d: str) -> DataFrame:
    truth, found = _boxes(spark, d, 0), _boxes(spark, d, 40)
    hits = spatial.matched(truth, found).groupBy(F.col("t.page_id").alias("page_id"), F.col("t.id").alias("id")).agg(F.max(F.col("d.id").isNotNull().cast("long")).alias("hit"))
    tp = hits.groupBy("page_id").agg(F.sum("hit").alias("tp"), F.sum(1 - F.col("hit")).alias("fn"))
    fp = spatial.unmatched(found, truth).groupBy("page_id").agg(F.count("*").alias("fp"))
    counts = (
        tp.join(fp, "page_id", "left")
        .rollup("page_id")
        .agg(F.sum("tp").alias("tp"), F.sum(F.coalesce("fp", F.lit(0))).alias("fp"), F.sum("fn").alias("fn"))
        .withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.lit("all")))
    )
    return evaluation.scored(counts, ("page",))


def _cells_sql(shift: int) -> str:
    return f"""(SELECT DISTINCT page_id, cx, unnest(range(floor(y / 16)::BIGINT, greatest(ceil((y + h) / 16)::BIGINT, floor(y / 16)::BIGINT + 1))) AS cy FROM (
      SELECT *, unnest(range(floor(x / 16)::BIGINT, greatest(ceil((x + w) / 16)::BIGINT, floor(x / 16)::BIGINT + 1))) AS cx FROM {_boxes_sql(shift)}))"""


@query(f"""
SELECT page_id, count(*) AS cells, count(d.cx) AS covered, round(count(d.cx) / count(*), 6) AS recall
FROM {_cells_sql(0)} t LEFT JOIN {_cells_sql(20)} d USING (page_id, cx, cy) GROUP BY page_id
""")
def mask_grid_recall(spark: SparkSession, d: str) -> DataFrame:
    def grid(shift: int) -> DataFrame:
        return _boxes(spark, d, shift).select("page_id", F.explode(spatial.cells(F.col("box"), 16)).alias("c")).select("page_id", "c.*").distinct()

    seen = grid(20).withColumn("hit", F.lit(1))
    return grid(0).join(seen, ["page_id", "cx", "cy"], "left").groupBy("page_id").agg(
        F.count("*").alias("cells"), F.count("hit").alias("covered"), F.round(F.count("hit") / F.count("*"), 6).alias("recall")
    )


@query(f"""
SELECT t.id, round(avg(CASE WHEN px >= d.x AND px <= d.x + d.w AND py >= d.y AND py <= d.y + d.h THEN 1.0 ELSE 0.0 END), 6) AS share
FROM (SELECT *, x + (i + 0.5) * w / 16 AS px, y + (j + 0.5) * h / 16 AS py FROM {_boxes_sql(0)}, range(16) a(i), range(16) b(j)) t
JOIN {_boxes_sql(20)} d ON t.id = d.id GROUP BY t.id
""")
def coverage_share(spark: SparkSession, d: str) -> DataFrame:
    t, f = _boxes(spark, d, 0).alias("t"), _boxes(spark, d, 20).alias("d")
    share = spatial.covered_share(F.col("t.box"), F.array(F.col("d.box")))
    return t.join(f, F.col("t.id") == F.col("d.id")).select(F.col("t.id").alias("id"), F.round(share, 6).alias("share"))


@query()
def fuse_boxes(spark: SparkSession, d: str) -> DataFrame:
    found = _boxes(spark, d, 0).unionByName(_boxes(spark, d, 10).withColumn("id", F.col("id") + 100000))
    kinds = found.withColumn("type", F.when(F.col("id") % 2 == 0, "EMAIL").otherwise("GENERIC")).withColumn(
        "source", F.when(F.col("id") >= 100000, "vision").otherwise("dom")
    )
    return spatial.fuse(kinds.withColumn("confidence", F.lit(0.9)), 1280.0, 800.0)


@query()
def nms(spark: SparkSession, d: str) -> DataFrame:
    items = _boxes(spark, d, 0).groupBy("page_id").agg(F.collect_list(F.struct("id", ((F.col("id") * 7919) % 1000 / 1000).alias("score"), "box")).alias("items"))
    return items.select("page_id", F.explode(spatial.suppressed(F.col("items"), 0.3)).alias("k")).select("page_id", "k.id", "k.score")


# --- history, windows, evaluation ------------------------------------------------


@query("""
SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type
""")
def percentile_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.nearest_rank(table(spark, d, "events"), "value", (0.5, 0.9, 0.99), ("event_type",))


@query("""
SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE value < 10) AS failures FROM events GROUP BY ALL HAVING count(*) FILTER (WHERE value < 10) >= 2
""")
def repeat_failure_count(spark: SparkSession, d: str) -> DataFrame:
    failed = F.count(F.when(F.col("value") < 10, 1))
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), failed.alias("failures")).where("failures >= 2")


@query("""
WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c)
SELECT user_id, any_value(event_type) AS value, count(*) AS length, min(event_id) AS first_event FROM r GROUP BY user_id, run HAVING count(*) >= 3
""")
def failure_streak(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changed = F.when(F.lag("event_type").over(w) == F.col("event_type"), 0).otherwise(1)
    runs = events.withColumn("c", changed).withColumn("run", F.sum("c").over(w))
    return runs.groupBy("user_id", "run").agg(
        F.first("event_type").alias("value"), F.count("*").alias("length"), F.min("event_id").alias("first_event")
    ).where("length >= 3").drop("run")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8")
def last_k_history(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k <= 8").select("user_id", "event_id")


@query("""
SELECT event_id, last_value(CASE WHEN value >= 50 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_typed FROM events
""")
def last_typed(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(F.col("value") >= 50, F.col("value"))
    return table(spark, d, "events").select("event_id", F.last(good, ignorenulls=True).over(w).alias("last_typed"))


@query("""
WITH g AS (SELECT vec_id, embedding, lag(embedding) OVER (ORDER BY vec_id) AS before FROM embeddings)
SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: abs(embedding[i]::DOUBLE - before[i]::DOUBLE))) / 64 > 0.5 AS changed FROM g WHERE before IS NOT NULL
""")
def change_detect(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.changed(table(spark, d, "embeddings"), "vec_id", "embedding", 0.5)


@query("""
SELECT coalesce(event_type, 'all') AS kind, count(*) AS n, round(avg(CASE WHEN value >= 20 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate,
  bool_and(value >= 0) AS all_safe, max(value) AS peak, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type)
""")
def task_summary_rollup(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "events").rollup("event_type")
        .agg(
            F.count("*").alias("n"), F.round(F.avg((F.col("value") >= 20).cast("double")), 6).alias("pass_rate"),
            F.bool_and(F.col("value") >= 0).alias("all_safe"), F.max("value").alias("peak"), F.countDistinct("user_id").alias("users"),
        )
        .select(F.coalesce("event_type", F.lit("all")).alias("kind"), "n", "pass_rate", "all_safe", "peak", "users")
    )


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, CASE WHEN c_nationkey % 10 = 0 THEN 'test' WHEN c_nationkey % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM customer
""")
def recipe_split(spark: SparkSession, d: str) -> DataFrame:
    """Whole groups go to one split."""
    g = F.col("c_nationkey") % 10
    return table(spark, d, "customer").select("c_custkey", F.when(g == 0, "test").when(g == 1, "val").otherwise("train").alias("split"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    return limits.windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("""
WITH t AS (SELECT user_id, list({'t': epoch(ts::TIMESTAMP), 'tokens': 4.0::DOUBLE, 'denied': 0::BIGINT} ORDER BY ts, event_id) AS l FROM events GROUP BY user_id),
f AS (SELECT user_id, len(l) AS seen, list_reduce(l, lambda a, x: {
    't': x.t,
    'tokens': CASE WHEN least(5.0, a.tokens + (x.t - a.t) * 0.001) >= 1 THEN least(5.0, a.tokens + (x.t - a.t) * 0.001) - 1 ELSE least(5.0, a.tokens + (x.t - a.t) * 0.001) END,
    'denied': a.denied + CASE WHEN least(5.0, a.tokens + (x.t - a.t) * 0.001) >= 1 THEN 0 ELSE 1 END}) AS r FROM t)
SELECT user_id, seen, r.denied AS denied FROM f
""")
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    times = F.transform(F.array_sort(F.collect_list(F.struct(F.col("ts").cast("timestamp").cast("double").alias("t"), "event_id"))), lambda x: x.t)
    events = table(spark, d, "events").groupBy("user_id").agg(times.alias("t"))
    ok = events.select("user_id", limits.bucket_fold(F.col("t"), rate=0.001, burst=5.0).alias("ok"))
    return ok.select("user_id", F.size("ok").cast("long").alias("seen"), F.size(F.filter("ok", lambda x: ~x)).cast("long").alias("denied"))


@query()
def html_text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return html.text_blocks(table(spark, d, "pages"))


@query()
def html_controls(spark: SparkSession, d: str) -> DataFrame:
    return html.controls(table(spark, d, "pages"))


@query()
def df_weighted_answer(spark: SparkSession, d: str) -> DataFrame:
    return answers.answer_lines(table(spark, d, "documents"), "What is the token of the account?")


# --- the relational ground --------------------------------------------------------


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem").where("l_shipdate <= '1998-09-02'").groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.count("*").alias("n"))
    )


@query("""
SELECT n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    l, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    joined = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("n_name").agg(
        F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue")
    )


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")
