"""What could be remembered from a form: learnable readings, new to the vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions.taxonomy import NEVER_REMEMBERED
from hushlake.functions.text import normal_label

MAX_VALUE = 120
#: Inputs that never hold something worth filling again.
SKIPPED = ("password", "search", "hidden", "file", "submit", "button", "reset", "image", "range", "color")


def question_label(role: Column, label: Column, placeholder: Column, group: Column) -> Column:
    said = F.when(F.coalesce(label, F.lit("")) != "", label).otherwise(placeholder)
    return F.when(role == "radio", F.replace(group, F.lit("_"), F.lit(" "))).otherwise(said)


def learnable(readings: DataFrame, keep: tuple[str, ...] = ("form_id",)) -> DataFrame:
    """``keep``, key, label, value, type: the last reading of each label.
    ``readings`` has ord, role, input_type, sensitive, value, label, placeholder, group."""
    label = F.trim(question_label(F.col("role"), F.col("label"), F.col("placeholder"), F.col("group")))
    usable = (
        readings.withColumn("__label", label)
        .withColumn("key", normal_label(F.col("__label")))
        .withColumn("__value", F.trim("value"))
        .where((F.col("__value") != "") & (F.length("__value") <= MAX_VALUE))
        .where((F.col("role") != "searchbox") & ~F.lower(F.coalesce("input_type", F.lit(""))).isin(*SKIPPED))
        .where(F.col("sensitive").isNull() | ~F.col("sensitive").isin(*NEVER_REMEMBERED))
        .where((F.col("__label") != "") & (F.col("key") != ""))
    )
    last = usable.groupBy(*keep, "key").agg(
        F.max_by(F.struct(F.col("__label").alias("label"), F.col("__value").alias("value"), F.col("sensitive").alias("type")), "ord").alias("x")
    )
    return last.select(*keep, "key", "x.label", "x.value", "x.type")


def new_to_vault(items: DataFrame, memory: DataFrame) -> DataFrame:
    """Items whose label is not remembered with the same value."""
    return items.join(memory.select("key", "value"), ["key", "value"], "left_anti")


def described(names: Column, shown: int = 3) -> Column:
    """"a, b and c" or "a, b, c and k more"."""
    unique = F.array_distinct(names)
    n = F.size(unique)
    few = F.when(n <= 1, F.coalesce(F.get(unique, 0), F.lit(""))).otherwise(
        F.concat(F.array_join(F.slice(unique, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.coalesce(F.get(unique, n - 1), F.lit("")))
    )
    many = F.concat(F.array_join(F.slice(unique, 1, shown), ", "), F.lit(" and "), (n - shown).cast("string"), F.lit(" more"))
    return F.when(n <= shown, few).otherwise(many)
