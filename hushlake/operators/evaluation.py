"""Scores of detections, leaks, steps and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vault import known_values

def ratio(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.round(F.when(whole > 0, part / whole), digits)


def scored(counts: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Precision, recall and F1 of tp, fp, fn; null where nothing is there."""
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return counts.select(
        *keep, "tp", "fp", "fn",
        F.round(p, 3).alias("precision"),
        F.round(r, 3).alias("recall"),
        F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), 3).alias("f1"),
    )


def nearest_rank(values: DataFrame, value: str, shares: tuple[float, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Percentiles that are values of the data, not between them."""
    aggs = [F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(100 * s)}") for s in shares]
    return values.groupBy(*keep).agg(*aggs)


def streaks(events: DataFrame, key: str, order: tuple[str, ...], same: str) -> DataFrame:
    """(key, value, length, start): longest run of equal neighbours per key."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.coalesce((F.lag(same).over(w) != F.col(same)).cast("int"), F.lit(1))
    runs = events.withColumn("__c", changed).withColumn("__run", F.sum("__c").over(w))
    return runs.groupBy(key, "__run").agg(F.first(same).alias("value"), F.count("*").alias("length"), F.min(F.struct(*order)).alias("start")).drop("__run")


#: Rows of a block of neighbours.
BLOCK = 4096


def with_previous(df: DataFrame, key: str, column: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``before``: ``column`` of the row with the next smaller integer
    ``key``, whatever the gaps.  Blocks of keys are windows of their own; only the
    last row of each block goes to the block after it."""
    placed = df.withColumn("__b", F.floor(F.col(key) / block))
    lasts = placed.groupBy("__b").agg(F.max_by(column, key).alias("__last"))
    order = Window.partitionBy(F.floor(F.col("__b") / block)).orderBy("__b")
    # the first block of a stretch of blocks looks back over one row for each stretch
    ahead = lasts.withColumn("__prev", F.lag("__last").over(order)).withColumn("__s", F.floor(F.col("__b") / block))
    tops = lasts.groupBy(F.floor(F.col("__b") / block).alias("__s")).agg(F.max_by("__last", "__b").alias("__top"))
    tops = tops.select("__s", F.lag("__top").over(Window.orderBy("__s")).alias("__top"))
    ahead = ahead.join(tops, "__s").select("__b", F.coalesce("__prev", "__top").alias("__prev"))
    inside = Window.partitionBy("__b").orderBy(key)
    rows = placed.join(ahead, "__b").withColumn("__n", F.row_number().over(inside))
    return rows.withColumn("before", F.when(F.col("__n") == 1, F.col("__prev")).otherwise(F.lag(column).over(inside))).drop("__b", "__n", "__prev")


def changed(df: DataFrame, key: str, column: str, least: float) -> DataFrame:
    """(key, changed): whether a vector differs from the one before it by more than
    ``least`` in the mean of absolute differences; the first has none before it."""
    rows = with_previous(df.where(F.col(key).isNotNull()).select(key, F.col(column).cast("array<double>").alias(column)), key, column)
    diff = F.aggregate(F.zip_with(column, "before", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x) / F.size(column)
    return rows.where("before is not null").select(key, (diff > least).alias("changed"))


def coverage(hits: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Of truth and detection matches (truth, truth_type, found_type or null): how many
    truths are covered by any box, and how many by one of their type.  A truth that
    is covered as something else is safe, and counts as missed all the same."""
    each = hits.groupBy(*keep, "truth").agg(
        F.max(F.col("found_type").isNotNull().cast("long")).alias("any"),
        F.max(F.coalesce((F.col("found_type") == F.col("truth_type")).cast("long"), F.lit(0))).alias("typed"),
    )
    return each.groupBy(*keep).agg(
        F.count("*").alias("truths"), F.sum("any").alias("covered"), F.sum("typed").alias("typed"),
        F.round(F.avg("any"), 3).alias("coverage"), F.round(F.avg("typed"), 3).alias("recall"),
    )


def harness_scores(truths: DataFrame, unmatched: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Scores that don't ask for the type: a truth (column covered) counts as found
    where any box covers it, ``unmatched`` are the boxes that cover none.  F1 is null
    where precision or recall is zero."""
    t = truths.groupBy(*keep).agg(F.sum(F.col("covered").cast("long")).alias("tp"), F.sum((~F.col("covered")).cast("long")).alias("fn"))
    both = t.join(unmatched.groupBy(*keep).agg(F.count("*").alias("fp")), list(keep), "full")
    counts = both.select(*keep, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])
    return scored(counts, keep).withColumn("f1", F.when(F.col("tp") > 0, F.col("f1")))


def mask_scores(truth: DataFrame, mask: DataFrame, keep: tuple[str, ...], cells: int) -> DataFrame:
    """Recall, precision and share of the screen of grid cells (distinct rows of
    ``keep`` and cx, cy) that hold truth and that are hidden."""
    on = [*keep, "cx", "cy"]
    both = truth.withColumn("t", F.lit(1)).join(mask.withColumn("m", F.lit(1)), on, "full")
    met = F.sum(F.when(F.col("t").isNotNull() & F.col("m").isNotNull(), 1).otherwise(0))
    return both.groupBy(*keep).agg(
        F.round(met / F.nullif(F.count("t"), F.lit(0)), 6).alias("recall"),
        F.round(met / F.nullif(F.count("m"), F.lit(0)), 6).alias("precision"),
        F.round(F.count("m") / cells, 6).alias("hidden"),
    )


def timings(rows: DataFrame, value: str, keep: tuple[str, ...]) -> DataFrame:
    """Median between values, least and most."""
    return rows.groupBy(*keep).agg(F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def model_steps(steps: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Of steps (planner, inference_ms, prompt_tokens, image_sent): those a model took."""
    model = F.col("planner") == "vlm"
    ms = F.when(model, F.col("inference_ms"))
    return steps.groupBy(*keep).agg(
        F.count(ms).alias("model_steps"), F.round(F.median(ms) / 1000, 1).alias("median_s"),
        F.max(F.when(model, F.col("prompt_tokens"))).alias("most_tokens"),
        F.sum(F.when(model & F.col("image_sent"), 1).otherwise(0)).alias("with_image"),
    )


def bare_text(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]", "")


def leaks(bodies: DataFrame, values: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """(keep, value): values that are legible in a body, whatever stands between
    their letters and digits."""
    plain = values.select(F.col("value").alias("__v"), bare_text(F.col("value")).alias("value")).where("value <> ''")
    found = known_values(bodies.select(keep, bare_text(F.col(text)).alias(text)), plain, text, keep, least=1)
    return found.withColumnRenamed("value", "__bare").join(plain.withColumnRenamed("value", "__bare"), "__bare").select(keep, F.col("__v").alias("value"))
