"""Secrets by pattern and by sliding-window entropy (native expressions only).

Three base kinds are found by pattern: assignments of long values to telling
names, access keys, long hexadecimal runs.  Beyond them every long token is a
candidate.  A window slides over its characters; the Shannon entropy inside
the window follows from incremental counts: a character that enters or leaves
changes one count, and the sum of c * log2(c) by the difference of that count
alone.  The greatest window entropy is held against a threshold of the
token's character class.  An allow list (words, links, numbers, identifiers,
placeholders) suppresses what is known to be harmless.

Defined results for odd input: a null or empty text has no spans; repeated
rows have equal spans; texts of any length are searched whole, tokens of any
length are swept once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import counted_kind, joined_spans, let, ranked, regex_spans, running, table, text_or_empty

ASSIGN = (
    "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+"
)
ASSIGN_VALUE = "^(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
#: What every assignment holds, as a quicker test.
ASSIGN_HINT = "[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]{12}"
ACCESS = "AKIA[A-Z0-9]{14,}+"
HEX = "[0-9a-f]{16,}+"
BASE = ("assign", "access", "hex")
MIN_VALUE = 12

#: Candidates: maximal runs of at least so many token characters.
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Class of a token, its pattern, and the bits that a window must reach.  A
#: window of 20 characters has at most log2(20) = 4.32 bits.
THRESHOLDS = (
    ("digits", "^[0-9]+$", 99.0),
    ("hex", "^[0-9A-Fa-f]+$", 3.0),
    # the long words of sf0.1 reach 3.58
    ("lower", "^[a-z]+$", 3.65),
    ("upper", "^[A-Z]+$", 3.65),
    ("letters", "^[A-Za-z]+$", 3.7),
    ("alnum", "^[A-Za-z0-9]+$", 3.7),
    ("mixed", "^", 3.9),
)
#: Fixed patterns of harmless tokens, and of what stands before one.
ALLOWED = (
    "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # identifiers
    "(?i)example|placeholder|changeme|dummy|xxxx|1234567",
    "^[a-z]*+(?:[A-Z][a-z]++)++$",  # capitalised words
    # words of less than 20 letters joined by signs, no digit
    "^(?=[A-Za-z]*+[-_/=+])(?![A-Za-z+/_=-]*?[A-Za-z]{20})(?:(?:[A-Z]++(?![a-z])|[a-z]*+(?:[A-Z][a-z]++)*+)(?:[-_/=+]++|$))++$",
    "^[0-9+/_=-]+$",  # dates, numbers, rules
)
#: In links only host and path are harmless.
ALLOWED_BEFORE = "(?:://(?:[^\\x20\\x09-\\x0D?#]*[^\\x20\\x09-\\x0D?#:])?|www\\.[^\\x20\\x09-\\x0D?#]*|@[A-Za-z0-9.-]*|sha(?:1|256|384|512)-)$"


def _c_log_c(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


#: Characters of tokens.  Their counts in a window are below 32, so that twelve
#: of them fit a number.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
BITS, LANES = 5, 12
WORDS = -(-len(SYMBOLS) // LANES)


def window_entropy(token: Column, width: int = WINDOW) -> Column:
    """Greatest Shannon entropy (bits) of ``width`` neighbouring characters.

    The state of the sweep is the count of every character in the window, packed
    into a few numbers, the sum of c*log2(c) over them, and the least such sum so
    far.  A character that enters or leaves changes one count.  Less sum is more
    entropy.  ``width`` is below 32.
    """
    places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)

    def shifted(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % LANES) * BITS)

    def count(acc: Column, place: Column) -> Column:
        word = F.lit(0).cast("bigint")
        for k in range(WORDS):
            word = F.when((place / LANES).cast("int") == k, acc[f"w{k}"]).otherwise(word)
        return F.call_function("shiftright", word, (place % LANES) * BITS).bitwiseAND(F.lit((1 << BITS) - 1))

    def changed(acc: Column, place: Column, by: int) -> Column:
        n = count(acc, place)
        there = lambda k: (place / LANES).cast("int") == k
        words = [F.when(there(k), acc[f"w{k}"] + by * shifted(place)).otherwise(acc[f"w{k}"]).alias(f"w{k}") for k in range(WORDS)]
        total = (acc.total - _c_log_c(n) + _c_log_c(n + by)).alias("total")
        return F.struct(*words, total, acc.least.alias("least"))

    def step(acc: Column, x: Column) -> Column:
        left = let(acc, lambda a: F.when(x.out >= 0, changed(a, x.out, -1)).otherwise(a))
        grown = let(left, lambda a: changed(a, x["in"], 1))
        least = lambda a: F.when(x.full, F.least(a.least, a.total)).otherwise(a.least)
        return let(grown, lambda a: F.struct(*[a[f"w{k}"].alias(f"w{k}") for k in range(WORDS)], a.total.alias("total"), least(a).alias("least")))

    none = float(1 << 20)
    start = F.struct(*[F.lit(0).cast("bigint").alias(f"w{k}") for k in range(WORDS)], F.lit(0.0).alias("total"), F.lit(none).alias("least"))
    moves = let(
        places,
        lambda p: F.transform(
            p,
            lambda c, i: F.struct(
                c.alias("in"), F.when(i >= width, F.get(p, i - width)).otherwise(F.lit(-1)).alias("out"), (i >= width - 1).alias("full")
            ),
        ),
    )
    swept = F.aggregate(moves, start, step, lambda acc: acc.least)
    return F.when(F.length(token) >= width, F.log2(F.lit(float(width))) - swept / width).otherwise(F.lit(0.0))


def suspicious(s: Column) -> Column:
    """Whether a candidate's entropy passes the threshold of its class."""
    bar = F.lit(99.0)
    for _, pattern, bits in reversed(THRESHOLDS):
        bar = F.when(s.value.rlike(pattern), bits).otherwise(bar)
    harmless = s.before.rlike(ALLOWED_BEFORE)
    for pattern in ALLOWED:
        harmless = harmless | s.value.rlike(pattern)
    return F.when(harmless | (bar > 90), F.lit(False)).otherwise(window_entropy(s.value) >= bar)


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": F.filter(
            regex_spans(text, ASSIGN, text.rlike(ASSIGN_HINT)),
            lambda s: F.length(F.regexp_replace(s.value, ASSIGN_VALUE, "")) >= MIN_VALUE,
        ),
        "access": regex_spans(text, ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": regex_spans(text, HEX),
    }


def with_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` and a struct ``out``: counts and spans of the base kinds, and
    all spans with those of kind ``entropy`` that overlap none of the others."""
    t = text_or_empty(text)
    found = base_spans(t)
    base = F.array_sort(F.concat(*[ranked(found[k], i, k) for i, k in enumerate(BASE)]))
    more = ranked(F.filter(regex_spans(t, TOKEN), suspicious), len(BASE), "entropy")
    staged = docs.drop(out).withColumn("__s_base", base).withColumn("__s_more", more)
    b, m = F.col("__s_base"), F.col("__s_more")
    far = 1 << 30

    def free(both: Column) -> Column:
        known = lambda s: s["rank"] < len(BASE)
        ends = running(F.transform(both, lambda s: F.when(known(s), s.end).otherwise(0)), lambda a, x: F.greatest(a, x), 0)
        starts = F.reverse(
            running(
                F.reverse(F.transform(both, lambda s: F.when(known(s), s.start).otherwise(far))),
                lambda a, x: F.least(a, x),
                far,
            )
        )
        marked = F.zip_with(
            both, F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s"))), lambda x, k: F.struct(x.alias("x"), k.alias("k"))
        )
        return F.transform(
            F.filter(marked, lambda y: known(y.x) | ((y.k.e <= y.x.start) & (y.k.s >= y.x.end))), lambda y: y.x
        )

    both = F.col("__s_all")
    return (
        staged.withColumn("__s_all", F.array_sort(F.concat(b, m)))
        .withColumn(
            out,
            F.struct(
                *[counted_kind(b, k).alias(f"n_{k}") for k in BASE],
                b.alias("base"),
                F.when(F.size(m) > 0, free(both)).otherwise(both).alias("spans"),
            ),
        )
        .drop("__s_base", "__s_more", "__s_all")
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        *[f"secrets.n_{k}" for k in BASE],
        F.sha2(joined_spans(F.col("secrets.base")), 256).alias("base_sha256"),
        joined_spans(F.col("secrets.spans")).alias("spans"),
    )
