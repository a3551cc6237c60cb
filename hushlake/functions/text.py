"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .taxonomy import TOKEN

#: White space as a browser has it.
BLANK = "[\\s\\x{A0}\\x{FEFF}\\p{Z}]"
#: A word edge between ASCII word characters and others.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
DOT = "•"
#: Words that dress a label up (fixed values).
NOISE = (
    "please", "kindly", "enter", "type", "select", "choose", "provide", "your", "the", "a", "an", "of", "here",
    "below", "optional", "required", "mandatory", "कृपया", "अपना", "अपनी", "अपने", "का", "की", "के", "दर्ज", "करें",
)


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def clamp_label(text: Column, most: int = 120) -> Column:
    clean = squeezed(text)
    return F.when(F.length(clean) > most, F.concat(F.left(clean, F.lit(most - 1)), F.lit("…"))).otherwise(clean)


def clamp_at_word(text: Column, most: int) -> Column:
    """Cut at the last space that is not before the middle, and not in a token."""
    head = F.left(text, F.lit(most))
    space = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", head) > 0) & (space > most / 2), F.left(head, space)).otherwise(head)
    open_ = F.length(cut) - F.locate("⟦", F.reverse(cut))
    unfinished = F.regexp_extract(cut, "⟦[^⟧]*$", 0) != ""
    return F.when(F.length(text) <= most, text).when(unfinished, F.rtrim(F.left(cut, open_))).otherwise(cut)


def compared(text: Column) -> Column:
    """Lower case without white space, hyphens, brackets and dots."""
    return F.regexp_replace(F.lower(text), "[\\s().-]", "")


def masked(text: Column) -> Column:
    """Enough of a value to recognise it, not to read it."""

    def of(v: Column) -> Column:
        n, at = F.length(v), F.locate("@", v)
        mail = F.concat(F.left(v, F.lit(1)), F.repeat(F.lit(DOT), F.least(at - 2, F.lit(6))), F.substr(v, at))
        rest = F.concat(F.left(v, F.lit(1)), F.repeat(F.lit(DOT), F.least(n - 3, F.lit(8))), F.right(v, F.lit(2)))
        return F.when(at > 1, mail).when(n <= 4, F.repeat(F.lit(DOT), n)).otherwise(rest)

    return let(F.trim(text), of)


def normal_label(label: Column) -> Column:
    """The words of a label that say what it asks for, sorted."""
    plain = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "\\([^)]*\\)", " ")
    plain = F.regexp_replace(plain, f"['’]s{EDGE}", "")
    words = F.split(plain, "[^\\p{L}\\p{M}\\p{N}]+")
    return F.array_join(F.array_sort(F.filter(words, lambda w: (w != "") & ~w.isin(*NOISE))), " ")


def slug(label: Column, number: Column) -> Column:
    """FATHER_NAME for "Father's name"; ANSWER_n where nothing ASCII is left."""
    plain = F.regexp_replace(F.lower(label), "\\([^)]*\\)", " ")
    plain = F.regexp_replace(plain, f"['’]s{EDGE}", "")
    words = F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*NOISE))
    name = F.regexp_replace(F.left(F.upper(F.array_join(words, "_")), F.lit(40)), "_+$", "")
    return F.when(name.rlike("^[A-Z]"), name).otherwise(F.concat(F.lit("ANSWER_"), number.cast("string")))


def without_tokens(text: Column) -> Column:
    return F.regexp_replace(text, TOKEN, " ")


def safe_url(url: Column) -> Column:
    """Scheme, host and path; query and fragment may carry secrets."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1))
    plain = F.regexp_replace(host, F.when(scheme == "https", F.lit(":443$")).otherwise(F.lit(":80$")), "")
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    good = (scheme != "") & (host != "")
    return F.struct(
        F.when(good, F.concat(scheme, F.lit("://"), plain)).otherwise(F.lit("(unknown)")).alias("origin"),
        F.when(good & (path != ""), path).otherwise(F.lit("/")).alias("path"),
    )
