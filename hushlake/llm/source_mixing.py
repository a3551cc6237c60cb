"""Mixing sources to target weights by Poisson replication.

Every source has a target share of the mixture.  A document of a source is
repeated a number of times that is Poisson distributed with the mean
``rate = total * share * all documents / documents of the source``: a uniform
number hashed from the seed and the document's id is put through the inverse
of the distribution.  So the counts need no state, come out the same on every
run and after every lost executor, and meet the target in the mean.  The
copies are then dealt and sorted by a hash of id and copy, which mixes all
sources over all output files.

Defined results for odd input: a null source is a source of its own; a null id
is hashed as the word "null"; repeated rows have the same count; texts are not
looked at; an empty table gives an empty result.  A column of the input named
like ``out`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, written

SEED = 17
#: Share of a source is its number of documents to this power, normed to 1.
TEMPER = 0.5
#: Rates beyond this are drawn as a sum of equal parts, so exp(-rate) is exact.
PART = 64.0
#: Up to so many sources the rates are broadcast (a name and a number each);
#: beyond, they are joined by a shuffle whose large partitions Spark splits.
MAX_BROADCAST_SOURCES = 20_000


def uniform(seed: int, *parts: Column) -> Column:
    """52 hash bits as a number in [0, 1)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def inverse_poisson(u: Column, rate: Column) -> Column:
    """Least k whose cumulated probability is above u; rate is at most PART."""
    steps = F.sequence(F.lit(0), F.floor(rate + 12 * F.sqrt(rate) + 20).cast("int"))
    folded = F.aggregate(
        steps,
        F.struct(F.exp(-rate).alias("p"), F.lit(0.0).alias("below"), F.lit(0).alias("k")),
        lambda acc, i: let(
            acc.below + acc.p,
            lambda c: F.struct(
                (acc.p * rate / (i + 1)).alias("p"),
                c.alias("below"),
                (acc.k + F.when(u >= c, 1).otherwise(0)).alias("k"),
            ),
        ),
    )
    return folded.k


def copies(seed: int, doc_id: Column, rate: Column) -> Column:
    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")
    draws = F.transform(
        F.sequence(F.lit(0), parts - 1), lambda j: inverse_poisson(uniform(seed, j, doc_id), rate / parts)
    )
    return F.aggregate(draws, F.lit(0), lambda a, k: a + k)


def rates(docs: DataFrame, source: str = "source", shares: dict | None = None, total: float = 1.0) -> DataFrame:
    """(source, rate): target repetitions.  ``shares`` names the target share of
    each source (others get none); by default shares are tempered counts."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if shares is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(TEMPER))
    else:
        weight = F.lit(0.0)
        for name, share in shares.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(share)).otherwise(weight)
    weighted = written(counts.withColumn("w", weight), "sources")
    sums = weighted.agg(F.sum("n").alias("docs"), F.sum("w").alias("weights"))  # one row
    rate = F.lit(total) * F.col("w") / F.col("weights") * F.col("docs") / F.col("n")
    return weighted.join(F.broadcast(sums), F.lit(True)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix(
    docs: DataFrame,
    source: str = "source",
    doc_id: str = "doc_id",
    shares: dict | None = None,
    total: float = 1.0,
    seed: int = SEED,
    out: str = "copy",
) -> DataFrame:
    """``docs`` repeated and shuffled, with the number of the copy in ``out``."""
    by_source = written(rates(docs, source, shares, total), "rates").select(F.col("source").alias("__m_source"), F.col("rate").alias("__m_rate"))
    if by_source.count() <= MAX_BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    drawn = docs.drop(out).join(by_source, F.col(source).eqNullSafe(F.col("__m_source")))
    drawn = drawn.withColumn("__m_n", copies(seed, F.col(doc_id), F.col("__m_rate")))
    # no filter on the count: it would be pushed down and drawn twice
    each = drawn.withColumn(out, F.explode(F.when(F.col("__m_n") > 0, F.sequence(F.lit(1), F.col("__m_n")))))
    order = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(out).cast("string")))
    return (
        each.withColumn("__m_order", order)
        .repartition(F.col("__m_order"))
        .sortWithinPartitions("__m_order")
        .drop("__m_source", "__m_rate", "__m_n", "__m_order")
    )


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "copy", "source", "lang", "n_chars", "text")


OP10_SQL = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sums AS (SELECT sum(n) AS docs, sum(pow(n::DOUBLE, {TEMPER})) AS weights FROM counts),
rated AS (
  SELECT source, 1.0::DOUBLE * pow(n::DOUBLE, {TEMPER}) / weights * docs / n AS rate FROM counts, sums
),
terms AS (
  SELECT source, i, sum(exp(i * ln(rate) - rate - lgamma(i + 1.0))) OVER (PARTITION BY source ORDER BY i) AS below
  FROM rated, (SELECT unnest(range(0, 200)) AS i)
),
cdf AS (SELECT source, list(below ORDER BY i) AS below FROM terms GROUP BY source),
drawn AS (
  SELECT d.*, c.below,
    ('0x' || substr(md5('{SEED}:0:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE
      / 4503599627370496.0 AS u
  FROM documents d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source
),
counted AS (SELECT *, len(list_filter(below, lambda b: u >= b)) AS k FROM drawn)
SELECT doc_id, unnest(range(1, k + 1))::INTEGER AS copy, source, lang, n_chars, text FROM counted WHERE k > 0
"""
