"""Gates before a value is typed: the first that fails gives the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions.taxonomy import is_token
from hushlake.functions.text import without_tokens

from .entities import entities
from .vault import token_keys


def gate(actions: DataFrame, vault: DataFrame, key: str = "action_id") -> DataFrame:
    """(key, ok, gate, value_type).  ``actions`` has text, page_origin,
    field_type, field_value, field_label and typed (what was typed there
    before, or null); ``vault`` has token, type and origin."""
    tokens = actions.select(key, "page_origin", "field_type", F.posexplode(token_keys(F.coalesce("text", F.lit("")))).alias("pos", "token"))
    known = tokens.join(vault.select("token", F.col("type").alias("value_type"), "origin"), "token")
    foreign = F.col("origin").isNotNull() & F.col("page_origin").isNotNull() & (F.col("origin") != F.col("page_origin"))
    other = ~F.col("field_type").eqNullSafe(F.col("value_type"))
    failed = known.select(
        key, "pos", "value_type", F.when(foreign, "other-site").when(other, "other-kind").alias("why")
    ).where("why is not null")
    first = failed.groupBy(key).agg(F.min(F.struct("pos", "why", "value_type")).alias("f"))
    text = F.coalesce(F.col("text"), F.lit(""))
    has_token = F.size(token_keys(text)) > 0
    replaced = is_token(F.coalesce("field_value", F.lit(""))) & (F.trim(text) != "") & ~has_token
    made_up = F.get(entities(F.col("__plain"), F.coalesce("field_label", F.lit(""))), 0)
    retyped = F.col("typed").isNotNull() & (F.trim(text) != "") & (F.trim(text) != F.trim("typed"))
    judged = (
        actions.withColumn("__plain", without_tokens(text))
        .withColumn("__made", made_up)
        .join(first, key, "left")
        .withColumn(
            "gate",
            F.when(F.col("f.why").isNotNull(), F.col("f.why"))
            .when(replaced, "replaces-value")
            .when(F.col("__made").isNotNull(), "made-up")
            .when(retyped, "retyped"),
        )
    )
    kind = F.when(F.col("f.why").isNotNull(), F.col("f.value_type")).when(F.col("gate") == "made-up", F.col("__made.type"))
    kind = F.when(F.col("gate").isin("replaces-value", "retyped"), F.coalesce("field_type", F.lit("GENERIC"))).otherwise(kind)
    return judged.select(key, F.col("gate").isNull().alias("ok"), "gate", kind.alias("value_type"))


def navigation(url: Column, origin: Column) -> Column:
    """allow, confirm (another site) or refuse (no web address, or a token in it)."""
    web = url.rlike("(?i)^https?://")
    same = F.lower(F.regexp_extract(url, "^([A-Za-z]+://[^/?#]+)", 1)) == F.lower(origin)
    return F.when(~web | (F.size(token_keys(url)) > 0), "refuse").when(same, "allow").otherwise("confirm")
