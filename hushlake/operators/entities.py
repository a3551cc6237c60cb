"""Typed entities in text: pattern, check, context; overlaps by rank.

A rule is data; the plan of a scan is built from the rules that are asked for,
so what is not asked for costs nothing.  Every rule reads the text once with a
JVM regular expression behind a cheap test, and only its matches are checked.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions import checksums
from hushlake.functions.arrays import let, numbered_hits, placed
from hushlake.functions.taxonomy import priority
from hushlake.functions.text import EDGE

#: Characters of text around a match in which a context word counts.
AROUND = 48
#: Payment handles that need no context.
HANDLES = (
    "okhdfcbank", "okicici", "oksbi", "okaxis", "ybl", "ibl", "axl", "apl", "paytm", "upi", "sbi", "hdfcbank",
    "icici", "axisbank", "kotak", "pnb", "barodampay", "fbl", "idfcbank", "yesg", "abfspay", "airtel", "freecharge",
    "jio", "jupiteraxis", "naviaxis", "superyes", "timecosmos", "waaxis", "wasbi", "waicici", "rmhdfc", "indus",
    "cnrb", "uco", "unionbank",
)
PAY_WORDS = ("upi", "vpa", "virtual payment", "pay to", "payment address")
BIRTH_WORDS = ("dob", "date of birth", "birth", "born", "birthday", "जन्म")


@dataclass(frozen=True)
class Rule:
    type: str
    name: str
    pattern: str
    confidence: float
    check: str | None = None
    context: tuple[str, ...] = field(default=())
    #: A substring that every match has; texts without it are not searched.
    needs: str | None = None


#: Patterns, confidences and context words.
RULES = (
    # a match starts where a run starts or the match before it ended: linear in the text
    Rule("EMAIL", "email", "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", 0.97, needs="@"),
    Rule("AADHAAR", "aadhaar-verhoeff", "(?<![0-9])[2-9][0-9]{3}[\\s-]?[0-9]{4}[\\s-]?[0-9]{4}(?![0-9])", 0.99, "verhoeff"),
    Rule("CARD", "card-luhn", "(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", 0.98, "luhn"),
    Rule("PAN", "pan-structure", f"{EDGE}[A-Z]{{5}}[0-9]{{4}}[A-Z]{EDGE}", 0.98, "pan"),
    Rule("IFSC", "ifsc", f"{EDGE}[A-Z]{{4}}0[A-Z0-9]{{6}}{EDGE}", 0.95),
    Rule("UPI", "upi-vpa", f"{EDGE}[A-Za-z0-9._-]{{2,60}}@[A-Za-z]{{2,20}}{EDGE}", 0.92, "handle", needs="@"),
    Rule("PHONE", "phone-in", "(?<![0-9-])(?:\\+?91[\\s-]?)?[6-9][0-9]{9}(?![0-9-])", 0.94),
    Rule("ACCOUNT", "account-context", "(?<![0-9-])[0-9]{9,18}(?![0-9-])", 0.90,
         context=("account number", "account no", "a/c", "bank account", "acct", "account", "खाता")),
    Rule("PASSPORT", "passport-in", f"{EDGE}[A-PR-WY][0-9]{{7}}{EDGE}", 0.90, context=("passport", "पासपोर्ट")),
    Rule("DOB", "dob-dmy", "(?<![0-9])(?:0?[1-9]|[12][0-9]|3[01])[/.-](?:0?[1-9]|1[0-2])[/.-](?:19|20)[0-9]{2}(?![0-9])", 0.90,
         context=BIRTH_WORDS),
    Rule("DOB", "dob-iso", "(?<![0-9])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9])", 0.90,
         context=BIRTH_WORDS),
    Rule("CVV", "cvv-context", "(?<![0-9])[0-9]{3,4}(?![0-9])", 0.88,
         context=("cvv", "cvc", "csc", "security code", "card code", "सीवीवी")),
    Rule("OTP", "otp-context", "(?<![0-9])[0-9]{4,8}(?![0-9])", 0.85,
         context=("otp", "one-time", "one time", "verification code", "auth code", "passcode", "ओटीपी", "सत्यापन कोड")),
    Rule("PINCODE", "pincode-context", "(?<![0-9])[1-9][0-9]{5}(?![0-9])", 0.85,
         context=("pin code", "pincode", "pin", "postal", "zip", "पिन", "डाक")),
)
#: The server's own check has no context rules and knows handles only.
STRICT_TYPES = ("EMAIL", "AADHAAR", "CARD", "PAN", "IFSC", "UPI", "PHONE")

MATCH = "array<struct<type:string,value:string,start:int,end:int,confidence:double,rule:string>>"


def _any_word(text: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def _accepted(rules: list[Rule], k: Column, span: Column, text: Column, extra: Column | None, strict: bool) -> Column:
    """Whether a match holds by the check and the context of its rule."""
    value = span.value
    first = F.greatest(span.start - AROUND, F.lit(0))
    near = F.substring(text, first + 1, span.end - first + AROUND)
    window = F.lower(near if extra is None else F.concat_ws(" ", near, extra))
    known = F.lower(F.substring_index(value, "@", -1)).isin(*HANDLES)

    def holds(rule: Rule) -> Column:
        if rule.check == "verhoeff":
            return checksums.verhoeff_valid(value)
        if rule.check == "luhn":
            return checksums.luhn_valid(value, 13, 19)
        if rule.check == "pan":
            return checksums.pan_valid(value)
        if rule.check == "handle":
            return known if strict else known | _any_word(window, PAY_WORDS)
        return _any_word(window, rule.context) if rule.context else F.lit(True)

    verdict = F.lit(False)
    for number, rule in enumerate(rules):
        verdict = F.when(k == number, holds(rule)).otherwise(verdict)
    return verdict


def candidates(text: Column, context: Column | None = None, only: Iterable[str] | None = None, strict: bool = False) -> Column:
    """All matches of all rules that are asked for, overlaps and all.

    The rules that hit form one array, whose matches are placed and checked by
    one expression that knows its rule by number; the plan stays small."""
    wanted = set(only) if only is not None else None
    rules = [
        r for r in RULES if (wanted is None or r.type in wanted) and (not strict or r.type in STRICT_TYPES)
    ]
    if not rules:
        return F.array().cast(MATCH)
    need = lambda r: F.contains(text, F.lit(r.needs)) if r.needs else None
    found = F.array_compact(F.array(*[numbered_hits(k, text, r.pattern, need(r)) for k, r in enumerate(rules)]))

    def of_rule(x: Column) -> Column:
        pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), x.k)
        kept = F.filter(placed(x), lambda s: _accepted(rules, x.k, s, text, context, strict))
        return F.transform(
            kept,
            lambda s: F.struct(
                pick(r.type for r in rules).alias("type"),
                s.value.alias("value"),
                s.start.alias("start"),
                s.end.alias("end"),
                pick(r.confidence for r in rules).alias("confidence"),
                pick(r.name for r in rules).alias("rule"),
            ),
        )

    return F.flatten(F.transform(found, of_rule))


def without_overlaps(matches: Column) -> Column:
    """Greedy: higher rank, then longer, then leftmost; given back by start."""
    ranked = F.array_sort(
        F.transform(
            matches,
            lambda m: F.struct((-priority(m.type)).alias("r"), (m.start - m.end).alias("l"), m.start.alias("s"), m.alias("m")),
        )
    )

    def keep(acc: Column, x: Column) -> Column:
        taken = F.exists(acc, lambda k: (x.m.start < k.end) & (k.start < x.m.end))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(x.m)))

    chosen = F.aggregate(ranked, F.array().cast(MATCH), keep)
    by_start = F.array_sort(F.transform(chosen, lambda m: F.struct(m.start.alias("s"), m.end.alias("e"), m.alias("m"))))
    return F.when(F.size(matches) < 2, matches).otherwise(F.transform(by_start, lambda x: x.m))


def entities(text: Column, context: Column | None = None, only: Iterable[str] | None = None, strict: bool = False) -> Column:
    safe = F.coalesce(text, F.lit(""))
    return let(candidates(safe, context, only, strict), without_overlaps)


def scan_entities(
    df: DataFrame,
    text: str = "text",
    context: str | None = None,
    only: Iterable[str] | None = None,
    strict: bool = False,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """A row for each entity: ``keep`` and type, value, start, end, confidence, rule."""
    extra = F.coalesce(F.col(context), F.lit("")) if context else None
    staged = df.select(*keep, entities(F.col(text), extra, only, strict).alias("__m"))
    return staged.select(*keep, F.explode("__m").alias("__x")).select(*keep, "__x.*")


def classified(text: Column, context: Column | None = None) -> Column:
    """The entity that is the whole text, or else the first one in it."""
    return let(
        entities(text, context),
        lambda ms: F.coalesce(
            F.get(F.filter(ms, lambda m: (m.start == 0) & (m.end == F.length(text))), 0), F.get(ms, 0)
        ),
    )
