"""Questions, searches and stated facts in tasks; answers from text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlake.functions.text import EDGE, without_tokens

#: Fixed values.
READ_ONLY = (
    "describe", "what is on", "what's on", "summarise", "summarize", "summary", "read this", "read the page",
    "tell me about", "explain this page", "what does this page",
)
QUESTION = (
    "(?i)^\\s*(?:what|which|when|where|who|how much|how many|is|are|does|did|has|have|can you tell|tell me"
    "|check (?:if|whether|my|the status|status|what)|क्या)(?=[\\s'’?,.!]|$)"
)
SEARCH = "(?i)^\\s*(?:please\\s+)?(?:search|look\\s+up|look\\s+for|find)\\s+(?:for\\s+|about\\s+)?(.+?)\\s*[.!]?\\s*$"
CONTROL = (
    f"(?i){EDGE}(?:button|link|field|box|menu|tab|option|form|section|icon|checkbox|dropdown|page|login|log[\\s-]?in"
    f"|sign[\\s-]?in|sign[\\s-]?up|submit){EDGE}"
)
IRREVERSIBLE = (
    "submit", "pay", "send", "delete", "remove", "confirm", "buy", "order", "transfer", "withdraw", "place order",
    "sign up", "register", "apply", "checkout", "जमा", "सबमिट", "भुगतान", "भेजें", "हटाएं", "हटाएँ", "पुष्टि", "पंजीकरण",
    "आवेदन करें", "खरीदें", "ऑर्डर", "स्थानांतरण", "निकासी",
)
STOPWORDS = (
    "what which when where who whom whose how much many is are was were be been does did do has have had can could will "
    "would should you tell me check the a an of my mine our your this that these those on in at for to it its and or there "
    "page screen please show about current currently now i am give any from with by as क्या है हैं मेरा मेरी मेरे का की के में को"
).split()
SENSITIVE_HOST = "(?i)(?:bank|banking|netbanking|upi|paytm|phonepe|kyc|aadhaar|uidai|incometax|nsdl|passport|gov\\.in|nic\\.in)"
MAX_AREA = 0.4


def _contains_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def is_question(task: Column) -> Column:
    low = F.lower(F.trim(task))
    return low.endswith("?") | low.rlike(QUESTION) | _contains_any(low, READ_ONLY)


def looks_irreversible(text: Column, label: Column) -> Column:
    return _contains_any(F.lower(F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(label, F.lit("")))), IRREVERSIBLE)


def search_query(task: Column) -> Column:
    """What a task asks to search for, or null."""
    query = F.trim(F.regexp_replace(F.trim(F.regexp_extract(task, SEARCH, 1)), "^[\"'“”‘’]+|[\"'“”‘’]+$", ""))
    joined = query.rlike(f"(?i){EDGE}(?:and|then){EDGE}|,")
    control = task.rlike(f"(?i)^\\s*(?:find|look\\s+for){EDGE}") & query.rlike(CONTROL)
    return F.when((query != "") & ~joined & ~control, query)


def disclosure(host: Column, covered: Column) -> Column:
    """1: structure only; 2: with picture."""
    return F.when(host.rlike(SENSITIVE_HOST) | (covered > MAX_AREA), 1).otherwise(2)


FACT = f"(?i){EDGE}my\\s+([a-z][a-z ]{{1,30}}?)\\s+is\\s+((?:⟦[^⟧]*⟧|[^,;.⟦])+?)\\s*(?=,|;|\\.|{EDGE}and{EDGE}|$)"


def task_facts(task: Column) -> Column:
    """Map of what "my x is y" states; of a repeated x the last counts."""
    subjects = F.transform(F.regexp_extract_all(task, F.lit(FACT), F.lit(1)), lambda s: F.lower(F.trim(s)))
    values = F.transform(F.regexp_extract_all(task, F.lit(FACT), F.lit(2)), lambda v: F.trim(v))
    pairs = F.zip_with(subjects, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    latest = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o.k == p.k))
    return F.map_from_entries(latest)


def words(text: Column) -> Column:
    """Distinct content words, with the lightest stemming."""
    each = F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_\\u0900-\\u097F]+"), F.lit(0))
    stems = F.transform(each, lambda w: F.when((F.length(w) > 4) & w.endswith("s"), F.left(w, F.length(w) - 1)).otherwise(w))
    return F.array_distinct(F.filter(stems, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS)))


def answer_lines(texts: DataFrame, question: str, keep: str = "doc_id", text: str = "text") -> DataFrame:
    """(keep, line_no, line, score): per text the line that answers best.

    Rare words of the question count for more: a word's weight is one over the
    number of lines of this text that have it.  Ties go to the word that comes
    first in the question, then to the first line."""
    spark = texts.sparkSession
    asked = spark.range(1).select(words(F.lit(question)).alias("w")).first().w
    if not asked:
        return texts.select(keep, F.lit(0).alias("line_no"), F.lit("").alias("line"), F.lit(0.0).alias("score")).where("false")
    wanted = F.array(*[F.lit(w) for w in asked])
    lines = (
        texts.select(keep, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))
        .withColumn("line", F.trim("line"))
        .where((F.col("line") != "") & (F.col("line") != "…"))
        .withColumn("hit", F.array_intersect(wanted, words(without_tokens(F.col("line")))))
        .where(F.size("hit") > 0)
    )
    each = lines.select(keep, "line_no", "line", F.explode("hit").alias("word"))
    df = F.count("*").over(Window.partitionBy(keep, "word"))
    first = F.array_position(wanted, F.col("word")) - 1
    scored = (
        each.withColumn("df", df)
        .groupBy(keep, "line_no")
        .agg(F.first("line").alias("line"), (F.sum(1 / F.col("df")) + 0.01 * (len(asked) - F.min(first))).alias("score"))
    )
    best = scored.groupBy(keep).agg(F.max_by(F.struct("line_no", "line", "score"), F.struct(F.round("score", 9), -F.col("line_no"))).alias("b"))
    return best.select(keep, "b.line_no", "b.line", F.round("b.score", 6).alias("score"))
