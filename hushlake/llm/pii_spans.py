"""Personal data by candidate gradient boosting (native expressions only).

Four base kinds are found by pattern and check: e-mail and IP addresses, card
and telephone numbers.  Beyond them, generators of high recall propose spans
that may overlap: national telephone numbers, social security numbers, bank
accounts, long numbers, dates, card numbers in longer runs of digits.  Each candidate has features of its format and
its context; boosted trees score it, and a threshold per kind, calibrated for
precision on held-out candidates, selects.  Of overlapping candidates the best
stays; one that overlaps a base span goes.  The trees are fitted here, on
made-up candidates whose labels follow from what was put around them, and run
as CASE expressions, so a text never leaves the JVM.

Defined results for odd input: a null or empty text has no spans; repeated
rows have equal spans; texts of any length are searched whole, in time that is
linear in the length (patterns start only where a run starts and never
backtrack over one); an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosted_trees import BoostedTrees, calibrated
from .common import counted_kind, joined_spans, let, ranked, regex_spans, running, table, text_or_empty

LOCAL = "A-Za-z0-9._%+-"
#: Equal to the plain leftmost search: a match starts where a run of its first
#: class starts, or where the match before it ended.
EMAIL = f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
#: A whole run of digits with single spaces or hyphens that has 14 to 19 digits.
CARD = "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){13,18}+(?![\\x20-]?[0-9])"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

GENERATORS = {
    "natphone": "(?<![0-9+(.-])\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}[\\x20.-][0-9]{4}(?![0-9-])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "account": "(?<![A-Za-z0-9.,-])[0-9]{8,19}(?![A-Za-z0-9-]|[.,][0-9])",
    "birthdate": "(?<![0-9/.-])(?:[0-9]{1,2}[/.-][0-9]{1,2}[/.-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9/-])",
    # one card's groups, or one group, in a run that the base rule takes as a whole
    "cardnumber": "(?<![0-9])(?<![A-Za-z0-9][.,])(?:[0-9]{4}([\\x20-])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}(?:\\1[0-9]{1,3})?|[0-9]{4}[\\x20-][0-9]{6}[\\x20-][0-9]{4,5}|[0-9]{13,19})(?![0-9]|[.,][0-9])",
}
KINDS = tuple(GENERATORS)
#: A candidate has 8 to 44 characters and those of one generator do not
#: overlap, so no more than these neighbours by start can overlap one.
NEIGHBOURS = 48

#: A word against must stand in so many characters before the candidate.
NEAR = 16
#: Context words (fixed values) that speak for a kind, and words against all.
SUPPORT = {
    "natphone": ("phone", "call", "tel", "mobile", "fax", "cell", "contact", "telefon", "móvil", "téléphone"),
    "ssn": ("ssn", "social security", "tax id", "social"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
    "account": ("account", "acct", "a/c", "card", "karte", "carte", "tarjeta", "passport", "konto", "license", "licence", "member"),
    "birthdate": ("born", "birth", "dob", "geboren", "né le", "née le", "nacid", "birthday"),
    "cardnumber": ("card", "karte", "carte", "tarjeta", "visa", "credit", "payment"),
}
AGAINST = ("order", "invoice", "version", "ticket", "serial", "part no", "sku", "isbn", "build", "issue", "ref", "page", "model", "total")
FEATURES = ("kind", "digits", "separators", "luhn", "support", "against", "sign", "check", "distinct")
PRECISION = 0.95


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return bool(digits) and total % 10 == 0


def _mod97(value: str) -> int:
    s = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def features(kind: str, value: str, before: str) -> list[float]:
    """Of a made-up candidate; :func:`feature_columns` is the same in Spark."""
    digits = "".join(c for c in value if c in "0123456789")
    low = before.lower()
    return [
        KINDS.index(kind),
        len(digits),
        sum(c in " .-/()" for c in value),
        float(_luhn(digits)),
        float(any(w in low for w in SUPPORT[kind])),
        float(any(w in low[-NEAR:] for w in AGAINST)),
        float(before[-1:] in tuple("$€£#=")),
        float(kind == "iban" and _mod97(value) == 1),
        len(set(digits)),
    ]


def _luhn_column(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def feature_columns(kind: str, s: Column) -> list[Column]:
    digits = F.regexp_replace(s.value, "[^0-9]", "")
    low = F.lower(s.before)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")

    def any_of(words, where: Column) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(where, F.lit(w))
        return flag(hit)

    if kind == "iban":
        plain = F.replace(s.value, F.lit(" "), F.lit(""))
        turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
        rest = F.aggregate(
            F.split(turned, ""),
            F.lit(0),
            lambda acc, c: F.when(c == "", acc)
            .when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97)
            .otherwise((acc * 100 + F.ascii(c) - 55) % 97),
        )
        check = flag(rest == 1)
    else:
        check = F.lit(0.0)
    return [
        F.lit(float(KINDS.index(kind))),
        F.length(digits).cast("double"),
        F.length(F.regexp_replace(s.value, "[^\\x20./()-]", "")).cast("double"),
        flag(_luhn_column(digits)),
        any_of(SUPPORT[kind], low),
        any_of(AGAINST, F.right(low, F.lit(NEAR))),
        flag(s.before.rlike("[$€£#=]$")),
        check,
        F.size(F.array_remove(F.array_distinct(F.split(digits, "")), "")).cast("double"),
    ]


def made_up(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates with labels: what stands before one says what it is."""
    rng = np.random.default_rng(seed)
    digit = lambda k: "".join(rng.choice(list("0123456789"), k))
    filler = ("the of and to ", "le de la et ", "der die das und ", "el de la que ")

    def iban(real: bool) -> str:
        body = "".join(rng.choice(list("0123456789"), 16))
        if not real:
            return "DE" + digit(2) + body
        for k in range(2, 99):
            if _mod97(v := f"DE{k:02d}{body}") == 1:
                return v
        return "DE00" + body

    def number() -> str:
        return digit(int(rng.integers(8, 20)))

    def card(real: bool) -> str:
        few = list("0123456789") if rng.random() < 0.7 else list(digit(2))
        v = "".join(rng.choice(few, int(rng.integers(12, 19))))
        ends = [v + c for c in "0123456789" if _luhn(v + c) == real]
        v = str(rng.choice(ends))
        if len(v) == 16 and rng.random() < 0.5:
            return str(rng.choice(["-", " "])).join(v[k : k + 4] for k in range(0, 16, 4))
        return v

    x, y = [], []
    for _ in range(n):
        kind = KINDS[int(rng.integers(len(KINDS)))]
        place = rng.choice(["support", "against", "neither"])
        before = str(rng.choice(filler))
        if place == "support":
            before += str(rng.choice(SUPPORT[kind])) + ": "
        elif place == "against":
            before += str(rng.choice(AGAINST)) + " " + str(rng.choice(["", "#", "= "]))
        if rng.random() < 0.1:
            before += str(rng.choice(["$", "#", "="]))
        plain = place == "neither" and before[-1:] not in "$#="
        if kind == "natphone":
            a, b, c = digit(3), digit(3), digit(4)
            sep = str(rng.choice(["-", ".", " "]))
            bracket = rng.random() < 0.5
            value = f"({a}) {b}-{c}" if bracket else f"{a}{sep}{b}{sep}{c}"
            label = place == "support" or (plain and (bracket or sep == "-"))
        elif kind == "ssn":
            value = f"{digit(3)}-{digit(2)}-{digit(4)}" if rng.random() < 0.9 else "000-00-0000"
            label = len(set(value)) > 3 and (place == "support" or plain)
        elif kind == "iban":
            real = rng.random() < 0.6
            value = iban(real)
            label = real and place != "against"
        elif kind == "account":
            value = number()
            label = place == "support"
        elif kind == "cardnumber":
            value = card(rng.random() < 0.5)
            label = _luhn("".join(c for c in value if c in "0123456789")) and place != "against"
        else:
            value = f"{int(rng.integers(1, 29)):02d}/{int(rng.integers(1, 13)):02d}/{int(rng.integers(1930, 2024))}"
            label = place == "support"
        x.append(features(kind, value, before))
        y.append(label)
    return np.array(x, dtype=float), np.array(y, dtype=float)


@lru_cache(maxsize=1)
def model() -> tuple[BoostedTrees, dict[str, float]]:
    """Trees fitted on one made-up set, thresholds calibrated on another."""
    trees = BoostedTrees().fit(*made_up(3000, seed=1))
    x, y = made_up(3000, seed=2)
    scores = trees.scores(x)
    of_kind = {k: x[:, 0] == i for i, k in enumerate(KINDS)}
    return trees, {k: calibrated(scores[m], y[m], PRECISION) for k, m in of_kind.items()}


def base_spans(text: Column) -> dict[str, Column]:
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    some_digit = text.rlike("[0-9]{2}|[0-9][.\\x20-][0-9]")
    return {
        "email": regex_spans(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(
            regex_spans(text, IP, some_digit),
            lambda s: F.forall(
                F.split(s.value, "\\."),
                lambda p: let(F.ltrim(p, F.lit("0")), lambda z: (F.length(z) < 3) | ((F.length(z) == 3) & (z <= "255"))),
            ),
        ),
        "card": F.filter(
            regex_spans(text, CARD, some_digit), lambda s: F.coalesce(_luhn_column(digits(s.value)), F.lit(False))
        ),
        "phone": F.filter(
            regex_spans(text, PHONE, F.contains(text, F.lit("+"))),
            lambda s: F.length(digits(s.value)).between(10, 15),
        ),
    }


def candidates(text: Column) -> Column:
    """Proposed spans above their thresholds: (start, rank, end, kind, score)."""
    trees, thresholds = model()

    def of(k: int, kind: str, pattern: str) -> Column:
        scored = F.transform(
            regex_spans(text, pattern, text.rlike("[0-9]{2}")),
            lambda s: F.struct(
                s.start.alias("start"),
                F.lit(len(BASE) + k).alias("rank"),
                s.end.alias("end"),
                F.lit(kind).alias("kind"),
                trees.expression(feature_columns(kind, s)).alias("score"),
            ),
        )
        return F.filter(scored, lambda s: s.score >= thresholds[kind])

    found = [of(k, kind, pattern) for k, (kind, pattern) in enumerate(GENERATORS.items())]
    return F.array_sort(F.flatten(F.array(*found)))


def settled(proposed: Column, base: Column) -> Column:
    """Proposed spans that overlap no base span and no better proposed one.

    Both arrays are sorted by start.  One sweep over both, forward for the
    furthest end so far and backward for the nearest start, finds overlaps."""

    def against_each_other(all_: Column) -> Column:
        return F.filter(
            all_,
            lambda c, i: ~F.exists(
                F.slice(all_, F.greatest(i - NEIGHBOURS, F.lit(0)) + 1, 2 * NEIGHBOURS + 1),
                lambda o: (o.start < c.end)
                & (o.end > c.start)
                & ((o.score > c.score) | ((o.score == c.score) & (F.struct(o.start, o["rank"]) < F.struct(c.start, c["rank"])))),
            ),
        )

    def against_base(both: Column) -> Column:
        far = 1 << 30
        ends = running(
            F.transform(both, lambda s: F.when(s.base, s.end).otherwise(0)), lambda a, x: F.greatest(a, x), 0
        )
        starts = F.reverse(
            running(
                F.reverse(F.transform(both, lambda s: F.when(s.base, s.start).otherwise(far))),
                lambda a, x: F.least(a, x),
                far,
            )
        )
        marks = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s")))
        marked = F.zip_with(both, marks, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
        free = F.filter(marked, lambda x: ~x.b.base & (x.m.e <= x.b.start) & (x.m.s >= x.b.end))
        return F.transform(free, lambda x: x.b)

    merged = F.array_sort(
        F.concat(
            F.transform(proposed, lambda s: _flat(s, False, s.score)),
            F.transform(base, lambda s: _flat(s, True, F.lit(0.0))),
        )
    )
    return F.when(F.size(proposed) > 0, let(let(merged, against_base), against_each_other)).otherwise(
        F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,base:boolean,score:double>>")
    )


def _flat(s: Column, base: bool, score: Column) -> Column:
    return F.struct(
        s.start.alias("start"),
        s["rank"].alias("rank"),
        s.end.alias("end"),
        s.kind.alias("kind"),
        F.lit(base).alias("base"),
        score.alias("score"),
    )


def _bare(spans: Column) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s.start.alias("start"), s["rank"].alias("rank"), s.end.alias("end"), s.kind.alias("kind"))
    )


def with_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` and a struct ``out``: counts of the base kinds, the base spans
    and all spans, both sorted by start and kind."""
    t = text_or_empty(text)
    found = base_spans(t)
    base = F.array_sort(F.concat(*[ranked(found[k], i, k) for i, k in enumerate(BASE)]))
    staged = docs.drop(out).withColumn("__p_base", base).withColumn("__p_more", candidates(t))
    more = settled(F.col("__p_more"), F.col("__p_base"))
    b = F.col("__p_base")
    return staged.withColumn(
        out,
        F.struct(
            *[counted_kind(b, k).alias(f"n_{k}") for k in BASE],
            b.alias("base"),
            F.array_sort(F.concat(b, _bare(more))).alias("spans"),
        ),
    ).drop("__p_base", "__p_more")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle
    brackets; of overlapping spans the first names the stretch they cover."""
    tagged = with_spans(docs, text, "__pii")

    def cut(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: s.end), lambda a, x: F.greatest(a, x), 0)
        return let(
            ends,
            lambda e: F.filter(
                F.transform(
                    spans,
                    lambda s, i: F.struct(
                        s.start.alias("start"),
                        F.when(i > 0, F.get(e, i - 1)).otherwise(0).alias("free"),
                        s.kind.alias("kind"),
                        (i == 0).alias("first"),
                    ),
                ),
                lambda s: s.first | (s.free <= s.start),
            ),
        )

    t = F.col(text)
    pieces = lambda heads: F.transform(
        heads,
        lambda s: F.concat(F.substring(t, s.free + 1, s.start - s.free), F.lit("<"), F.upper(s.kind), F.lit(">")),
    )
    last = F.array_max(F.transform(F.col("__pii.spans"), lambda s: s.end))
    clean = F.concat(
        F.array_join(let(cut(F.col("__pii.spans")), pieces), ""), F.substring(t, last + 1, F.length(t))
    )
    return tagged.withColumn(text, F.when(F.size("__pii.spans") > 0, clean).otherwise(t)).select(*docs.columns)


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        *[f"pii.n_{k}" for k in BASE],
        F.sha2(joined_spans(F.col("pii.base")), 256).alias("base_sha256"),
        joined_spans(F.col("pii.spans")).alias("spans"),
    )
