"""Stable tokens for values: a dictionary with one shuffle by value.

Ordinals count the distinct values of a type in order of first appearance.
They come from per-block counts and running sums of blocks, not from one
window over a type, so no task holds a whole type.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlake.functions.text import compared

#: Distinct values of a type that one window numbers.
BLOCKS = 512
#: Values that one automaton holds.
AT_ONCE = 100_000


def tokenize(matches: DataFrame, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """(norm, type, value, token): one row per normalised value of ``matches``
    (type, value and the order columns).  A value keeps its first type."""
    at = F.struct(*order)
    firsts = (
        matches.withColumn("norm", compared(F.col("value")))
        .groupBy("norm")
        .agg(F.min(F.struct(at.alias("at"), "type", "value")).alias("f"))
        .select("norm", "f.at", "f.type", "f.value")
    )
    # blocks of the order are ranked, then numbered inside: two levels, no single window per type
    lead = F.col(f"at.{order[0]}")
    span = firsts.agg(F.min(lead).alias("lo"), F.max(lead).alias("hi"))
    placed = firsts.join(F.broadcast(span), F.lit(True)).withColumn(
        "block", F.coalesce(F.floor((lead - F.col("lo")) * F.lit(BLOCKS) / (F.col("hi") - F.col("lo") + 1)).cast("int"), F.lit(-1))
    )
    sizes = placed.groupBy("type", "block").agg(F.count("*").alias("n"))
    # at most BLOCKS rows per type
    before = Window.partitionBy("type").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("type", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("type", "block").orderBy("at", "norm")
    return (
        placed.withColumn("k", F.row_number().over(inside))
        .join(starts, ["type", "block"])
        .select("norm", "type", "value", F.concat(F.lit("⟦"), "type", F.lit("_"), (F.col("start") + F.col("k")).cast("string"), F.lit("⟧")).alias("token"))
    )


def token_keys(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("⟦[A-Z][A-Z0-9_.]*⟧"), F.lit(0))


def resolve(df: DataFrame, text: str, vault: DataFrame, key: str) -> DataFrame:
    """(key, resolved, has_unresolved): a row for each row of ``df``, the tokens of
    ``text`` replaced by their values; unknown tokens stay, a null text stays null.
    Of a token that the vault has twice the least value counts."""
    each = df.select(F.struct(F.col(key).alias("key"), F.col(text).alias("text")).alias("__row"))
    with_token = F.contains(F.col("__row.text"), F.lit("⟦"))
    pieces = F.split(F.col("__row.text"), "(?=⟦[A-Z][A-Z0-9_.]*⟧)|(?<=⟧)")
    parts = each.where(with_token).distinct().select("__row", F.posexplode(pieces).alias("pos", "piece"))
    known = vault.groupBy(F.col("token").alias("piece")).agg(F.min("value").alias("__v"))
    joined = parts.join(known, "piece", "left").withColumn("out", F.coalesce("__v", "piece"))
    whole = joined.groupBy(F.col("__row").alias("__of")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x.out), "").alias("__whole"),
        F.max((F.col("piece").rlike("^⟦[A-Z][A-Z0-9_.]*⟧$") & F.col("__v").isNull()).cast("int")).alias("__u"),
    )
    return each.join(whole, F.col("__row").eqNullSafe(F.col("__of")), "left").select(
        F.col("__row.key").alias(key),
        F.coalesce("__whole", F.col("__row.text")).alias("resolved"),
        F.coalesce(F.col("__u") == 1, F.lit(False)).alias("has_unresolved"),
    )


def known_values(texts: DataFrame, values: DataFrame, text: str = "text", keep: str = "doc_id", least: int = 4, at_once: int = AT_ONCE) -> DataFrame:
    """(keep, value): literal case-insensitive containment of a dictionary.

    A dictionary of any size is searched in as many passes as it has parts of about
    ``at_once`` values, each by an automaton that is broadcast and reads a text once."""
    wanted = values.where(F.length("value") >= least).select("value").distinct().select("value", F.lower("value").alias("low"))
    n = wanted.count()
    parts = max(1, -(-n // at_once))
    found = [_found_by_automaton(texts, wanted.where(F.pmod(F.xxhash64("value"), F.lit(parts)) == k), text, keep) for k in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _found_by_automaton(texts: DataFrame, wanted: DataFrame, text: str, keep: str) -> DataFrame:
    spelled: dict[str, list[str]] = {}
    for r in wanted.collect():  # about at_once rows
        spelled.setdefault(r.low, []).append(r.value)
    shared = texts.sparkSession.sparkContext.broadcast(spelled)

    @F.pandas_udf("array<string>")
    def hits(lows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for low, values in shared.value.items():
            automaton.add_word(low, values)
        automaton.make_automaton()
        for part in lows:
            yield pd.Series([sorted({v for _, vs in automaton.iter(t) for v in vs}) if t and shared.value else [] for t in part])

    return texts.select(keep, hits(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("__hits")).select(keep, F.explode("__hits").alias("value"))


def remembered(entries: DataFrame, key: str = "key", order: str = "at") -> DataFrame:
    """Upserts: the latest entry of each key; a null value forgets."""
    last = entries.groupBy(key).agg(F.max_by("value", order).alias("value"), F.max(order).alias(order))
    return last.where("value is not null")
