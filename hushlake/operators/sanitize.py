"""Text with personal data replaced by tokens, and the audit of payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions.arrays import let, regex_spans
from hushlake.functions.taxonomy import TOKEN, is_token
from hushlake.functions.text import compared

from .entities import entities

def spliced(text: Column, spans: Column) -> Column:
    """``text`` with each span (start, end, token; by start, disjoint) replaced."""
    ends = lambda s: F.concat(F.array(F.lit(0)), F.transform(s, lambda x: x.end))
    return let(
        spans,
        lambda s: F.concat(
            F.array_join(
                F.zip_with(
                    s,
                    F.slice(ends(s), 1, F.size(s)),
                    lambda x, free: F.concat(F.substring(text, free + 1, x.start - free), x.token),
                ),
                "",
            ),
            F.substring(text, F.element_at(ends(s), -1) + 1, F.length(text)),
        ),
    )


def blanked(text: Column) -> Column:
    """Tokens become spaces of equal length, so offsets stay and digits inside
    a token are not taken for a value."""
    spans = regex_spans(text, TOKEN, F.contains(text, F.lit("⟦")))
    spaces = F.transform(
        spans,
        lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.repeat(F.lit(" "), s.end - s.start).alias("token")),
    )
    return F.when(F.size(spans) > 0, spliced(text, spaces)).otherwise(text)


def sanitize(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), only=None) -> DataFrame:
    """``keep``, the text with every entity replaced by its type in token
    brackets, and the types that were replaced, in order."""
    source = F.coalesce(F.col(text), F.lit(""))
    seen = df.select(*keep, source.alias("__t")).withColumn("__b", blanked(F.col("__t")))
    staged = seen.select(*keep, "__t", entities(F.col("__b"), None, only).alias("__m"))
    marks = F.transform(
        "__m",
        lambda m: F.struct(m.start.alias("start"), m.end.alias("end"), F.concat(F.lit("⟦"), m.type, F.lit("⟧")).alias("token")),
    )
    clean = F.when(F.size("__m") > 0, spliced(F.col("__t"), marks)).otherwise(F.col("__t"))
    return staged.select(*keep, clean.alias("clean"), F.transform("__m", lambda m: m.type).alias("types"))


def audit(payload: DataFrame, strings: str = "strings", keep: str = "payload_id", secrets: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Incidents (kind, type, path, rule) of an array of (path, value).  Bare
    tokens and the image path are skipped; no incident carries a value.  Strings
    are read whole, or their first ``most`` characters."""
    each = payload.select(keep, F.explode(strings).alias("s")).select(keep, "s.path", F.col("s.value").alias("value"))
    kept = each.where((F.col("path") != "screen.image_jpeg_b64") & ~is_token(F.col("value")))
    cut = kept if most is None else kept.withColumn("value", F.left("value", F.lit(most)))
    plain = cut.select(keep, "path", blanked(F.col("value")).alias("b"))
    hits = plain.select(keep, "path", F.explode(entities(F.col("b"))).alias("m"))
    found = hits.select(keep, F.lit("pattern").alias("kind"), "m.type", "path", "m.rule")
    if secrets is None:
        return found
    needles = secrets.where(F.length("value") >= 4).select(compared(F.col("value")).alias("needle"), F.col("type"))
    # one incident per string: the first secret by type and needle
    known = (
        cut.select(keep, "path", compared(F.col("value")).alias("norm"))
        .join(needles, F.contains("norm", F.col("needle")))
        .groupBy(keep, "path")
        .agg(F.min(F.struct("type", "needle")).alias("x"))
    )
    return found.unionByName(known.select(keep, F.lit("vault").alias("kind"), "x.type", "path", F.lit("vault-value").alias("rule")))
