"""Document fingerprints by SimHash and permuted block tables (native only).

Every word of a text votes on the 64 bits of its hash, with a weight that
grows with its length: longer words say more.  Votes are added up in lanes of
16 bits, four to a number, so that one word costs sixteen additions; long
texts are added in blocks that no lane can overflow.

To find all fingerprints within a radius, the 64 bits are cut into six blocks.
Two fingerprints that differ in at most three bits agree in at least three
blocks, so in one of the twenty tables that are keyed by three of them.  Equal
fingerprints are one entry with a count, whatever their number.

The next document in falling order of id is found without a global sort:
documents fall into blocks by bounds of their ids, each block also receives
the first document of the block below, and a window within blocks does the
rest.  Whole texts are shuffled once; the number of blocks has a bound.

Defined results for odd input: a null or empty text has fingerprint zero; rows
of equal id follow each other by text, a null id comes last; a single document
is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty, words_of, written

LANES = 16
LANE_MASK = 0x0001000100010001
MAX_WEIGHT = 8
#: Words whose votes fit 15 bits, so that the top lane never reaches the sign.
BLOCK = (1 << 15) // MAX_WEIGHT - 1
RADIUS = 3
CUTS = (0, 11, 22, 33, 44, 54, 64)
AGREE = 3
#: Documents of a block of neighbours, bounds that a plan may hold, and blocks.
#: Whatever the input, no more than MAX_BLOCKS rows of 24 bytes tell which block
#: follows which (2 MB): they are sorted by one task and broadcast.
ROWS_PER_BLOCK = 2000
MAX_BOUNDS = 1024
MAX_BLOCKS = 1 << 16


def _lanes(words: Column) -> Column:
    """Struct of LANES numbers with the votes for bit one, and all weights."""
    zero = F.struct(*[F.lit(0).cast("bigint").alias(f"v{k}") for k in range(LANES)], F.lit(0).cast("bigint").alias("all"))
    votes = F.transform(
        words,
        lambda w: F.struct(F.xxhash64(w).alias("h"), F.least(F.length(w), F.lit(MAX_WEIGHT)).cast("bigint").alias("w")),
    )
    return F.aggregate(
        votes,
        zero,
        lambda acc, x: F.struct(
            *[
                (acc[f"v{k}"] + F.shiftrightunsigned(x.h, k).bitwiseAND(F.lit(LANE_MASK)) * x.w).alias(f"v{k}")
                for k in range(LANES)
            ],
            (acc["all"] + x.w).alias("all"),
        ),
    )


def simhash(words: Column) -> Column:
    """The fingerprint of an array of words as a signed 64-bit number."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(words) - 1) / BLOCK).cast("int")),
        lambda b: _lanes(F.slice(words, b * BLOCK + 1, BLOCK)),
    )

    def spread(x: Column) -> Column:
        return F.array(
            *[
                F.shiftrightunsigned(x[f"v{bit % LANES}"], (bit // LANES) * LANES).bitwiseAND(F.lit(0xFFFF))
                for bit in range(64)
            ],
            x["all"],
        )

    total = F.aggregate(
        blocks,
        F.array_repeat(F.lit(0).cast("bigint"), 65),
        lambda acc, x: F.zip_with(acc, spread(x), lambda a, b: a + b),
        # bit by bit; the last entry is the sum of all weights
        lambda acc: F.aggregate(
            F.transform(
                F.slice(acc, 1, 64),
                lambda v, i: F.when(2 * v > F.get(acc, 64), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(
                    F.lit(0).cast("bigint")
                ),
            ),
            F.lit(0).cast("bigint"),
            lambda a, b: a.bitwiseOR(b),
        ),
    )
    return F.when(F.size(words) > 0, total).otherwise(F.lit(0).cast("bigint"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, n_near): for each distinct fp of ``queries`` the number of rows of
    ``prints`` (column fp) whose fingerprint is within ``radius`` (at most 3)."""
    if not 0 <= radius <= len(CUTS) - 1 - AGREE:
        raise ValueError("these tables find no more than three differing bits")
    masks = []
    for chosen in combinations(range(len(CUTS) - 1), AGREE):
        mask = sum(((1 << CUTS[c + 1]) - (1 << CUTS[c])) for c in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)

    def keyed(df: DataFrame, names: dict[str, str]) -> DataFrame:
        tables = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key")
        return df.select(*[F.col(c).alias(n) for c, n in names.items()], tables)

    counts = prints.groupBy("fp").agg(F.count("*").alias("n"))
    asked = queries.select("fp").distinct()
    pairs = (
        keyed(asked, {"fp": "fp"})
        .join(keyed(counts, {"fp": "other", "n": "n"}).hint("shuffle_merge"), ["t", "key"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)
        .groupBy("fp", "other")
        .agg(F.first("n").alias("n"))
    )
    return pairs.groupBy("fp").agg(F.sum("n").alias("n_near"))


def with_next(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` and, as next_<column>, columns of the next document in falling
    order of id; the first follows the last."""
    n, low, high = docs.agg(F.count("*"), F.min(doc_id), F.max(doc_id)).first()
    blocks = min(MAX_BLOCKS, max(1, -(-n // ROWS_PER_BLOCK)))
    bounds = min(MAX_BOUNDS, blocks)
    cuts = docs.select(F.percentile_approx(doc_id, [k / bounds for k in range(1, bounds)] or [0.5], 10000)).first()[0] or []
    cuts = sorted(set(cuts))
    edges = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # a segment between two bounds is cut evenly where there are more blocks than bounds
    fine = -(-blocks // bounds)
    spot = F.size(F.filter(edges, lambda e: e < F.col(doc_id)))
    left = F.coalesce(F.get(edges, F.col("__x_seg") - 1), F.lit(low if low is not None else 0)).cast("double")
    right = F.coalesce(F.get(edges, F.col("__x_seg")), F.lit(high if high is not None else 0)).cast("double")
    share = F.when(right > left, (F.col(doc_id) - left) / (right - left)).otherwise(F.lit(0.0))
    part = F.least(F.floor(share * fine), F.lit(fine - 1))
    block = F.when(F.col(doc_id).isNull(), F.lit(-1)).otherwise(F.col("__x_seg") * fine + part).cast("bigint")
    placed = docs.withColumn("__x_seg", spot).withColumn("__x_block", block).drop("__x_seg")
    # one row per block: first document by id, and the block that precedes it in falling order
    firsts = placed.groupBy("__x_block").agg(F.max(doc_id).alias("__x_top"))
    order = Window.orderBy(F.desc("__x_block"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = firsts.select(
        F.col("__x_block").alias("__x_of"),
        F.col("__x_top"),
        F.coalesce(F.lag("__x_block").over(order), F.last("__x_block").over(everything)).alias("__x_to"),
    )
    # the first of a block is also a guest of the block before it
    hosts = F.array(
        F.struct(F.col("__x_block").alias("block"), F.lit(0).alias("guest")),
    )
    tops = written(tops, "block-tops")
    joined = placed.join(F.broadcast(tops), (F.col("__x_block") == F.col("__x_of")) & F.col(doc_id).eqNullSafe(F.col("__x_top")), "left")
    hosts = F.when(
        F.col("__x_of").isNotNull(), F.concat(hosts, F.array(F.struct(F.col("__x_to").alias("block"), F.lit(1).alias("guest"))))
    ).otherwise(hosts)
    dealt = joined.withColumn("__x_at", F.explode(hosts)).withColumns(
        {"__x_host": F.col("__x_at.block"), "__x_guest": F.col("__x_at.guest")}
    )
    near = Window.partitionBy("__x_host").orderBy("__x_guest", F.desc_nulls_last(doc_id), text)
    following = dealt.withColumns({f"next_{c}": F.lead(c).over(near) for c in columns})
    return following.where("__x_guest = 0").drop("__x_block", "__x_of", "__x_top", "__x_to", "__x_at", "__x_host", "__x_guest")


def op8_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    printed = docs.withColumn("__w", words_of(F.lower("text"))).withColumn("fp", simhash(F.col("__w"))).drop("__w")
    pairs = with_next(printed, ["text", "fp"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - floor(length(text) / 2))"), F.left("next_text", half))
    done = (
        pairs.withColumn("edited", edited)
        .withColumn("__w", words_of(F.lower("edited")))
        .withColumn("edited_fp", simhash(F.col("__w")))
    )
    rows = written(
        done.select(
            "doc_id",
            n.cast("bigint").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            "fp",
            "edited_fp",
            "next_fp",
        ),
        "edited-fingerprints",
    )
    near = within(rows.select("fp"), rows.where("doc_id % 20 = 0").select("fp"))
    # what is within the radius grows with the input, so it is not broadcast
    found = rows.join(near.hint("shuffle_merge"), "fp", "left")
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex16(F.col("fp")).alias("fingerprint"),
        hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        # documents within the radius, itself not counted; asked for ids divisible by 20
        F.when(F.col("doc_id") % 20 == 0, F.col("n_near") - 1).alias("n_near"),
    )
