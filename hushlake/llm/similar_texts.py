"""Pairs of texts whose sets of 5-word shingles have a similarity of 0.8 or more.

The search is exact.  Shingles have one order over all texts, the rarer first.
Two sets with a Jaccard similarity of 0.8 share a shingle among the first
n - ceil(0.8 n) + 1 of each, so only those are exchanged, with their places:
the first shingle that two such sets share leaves enough after it in both.  Where
two meet, the parities of their hashes in bins, 64 bytes a text, bound from
below by how many they differ; the join lets nothing through that differs by
too many.  A pair that is left is held against its histograms of hashes, which
bound what it can share from above, and then against its whole sets.

A meeting's head is the text with the fewest rarer shingles before the one it is
about: in a group of near copies that is the text they were made from, or one
near it.  Every text is compared with the first of its heads, which links nearly
all of such a group; with its other heads, and then with other texts that it
meets, only where links found so far do not join the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, written
from .components import components

SHINGLE = 5
#: The least similarity is SHARED / OF.
SHARED, OF = 4, 5
#: Counters of how common shingles are: one for about so many bytes of text, and
#: no more than 2^COUNTER_BITS[1], 8 MB.  They set the order alone, so sharing one
#: costs time and loses nothing.
BYTES_PER_COUNTER = 384
COUNTER_BITS = (15, 20)
#: Texts that are counted at once.
COUNTED = 256
#: Texts that a Python worker takes at once.
TEXTS = 1000
#: Bins of a set's histogram, a byte each; a full one says nothing.
BINS = 512
FULL = 255


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the shingles; one of all words for a shorter text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)])) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), dtype=np.uint64, count=n))


def _counter(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def first_shingles(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Those of which two similar sets share one, in order."""
    n = len(hashes)
    if not n:
        return hashes
    order = np.lexsort((hashes, common[_counter(hashes, len(common).bit_length() - 1)]))
    return hashes[order[: n + (-SHARED * n // OF) + 1]]


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingle_set_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).view(np.int64) for t in texts])


def common_shingles(texts: DataFrame) -> np.ndarray:
    """How many texts' shingles fall to each counter."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(int(size // BYTES_PER_COUNTER).bit_length(), COUNTER_BITS[0]), COUNTER_BITS[1])

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << bits, np.int64)
        for frame in frames:
            for at in range(0, len(frame), COUNTED):
                some = np.concatenate([shingle_set(t) for t in frame["text"].iloc[at : at + COUNTED]])
                counts += np.bincount(_counter(some, bits), minlength=1 << bits)
        there = np.flatnonzero(counts)
        yield pd.DataFrame({"counter": there, "n": counts[there]})

    # a task hands out a row for each counter, so there are few tasks
    few = texts.select("text").coalesce(2 * spark.sparkContext.defaultParallelism)
    found = few.mapInPandas(counted, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(1 << bits, np.int64)
    common[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    return common


def histogram(hashes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """How many hashes a bin has, as bytes, and the parities, as numbers of 64 bits."""
    counts = np.bincount((hashes & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    return np.minimum(counts, FULL).astype(np.uint8).tobytes(), np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


@F.pandas_udf(T.BooleanType())
def can_be_alike(na: pd.Series, ha: pd.Series, nb: pd.Series, hb: pd.Series) -> pd.Series:
    """Whether sets of these sizes and histograms can share enough."""
    a, b = (np.frombuffer(b"".join(h), np.uint8).reshape(-1, BINS) for h in (ha, hb))
    shared = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    enough = (OF + SHARED) * shared >= SHARED * (na.to_numpy(np.int64) + nb.to_numpy(np.int64))
    return pd.Series(enough | (a == FULL).any(axis=1) | (b == FULL).any(axis=1))


def _verified(pairs: DataFrame, prefixes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of row hashes that are similar."""
    own = written(
        prefixes.select("row_hash", "n", "bins").join(pairs.select(F.explode(F.array("a", "b")).alias("row_hash")).distinct(), "row_hash", "left_semi").dropDuplicates(["row_hash"]),
        "histograms",
    )
    one = lambda x: own.select(F.col("row_hash").alias(x), F.col("n").alias("n" + x), F.col("bins").alias("h" + x))
    close = pairs.join(one("a"), "a").join(one("b"), "b").where(can_be_alike("na", "ha", "nb", "hb")).select("a", "b")
    close = written(close, "close")
    # written, so that its size is known and a small one spares the texts a shuffle
    wanted = written(close.select(F.explode(F.array("a", "b")).alias("row_hash")).distinct(), "wanted")
    forget(own)
    kept = texts.join(wanted, "row_hash", "left_semi").dropDuplicates(["row_hash"])
    sets = written(kept.select("row_hash", shingle_set_udf("text").alias("set")), "shingle-sets", rows=TEXTS)
    one = lambda x: sets.select(F.col("row_hash").alias(x), F.col("set").alias("s" + x))
    both = F.size(F.array_intersect("sa", "sb"))
    alike = OF * both >= SHARED * (F.size("sa") + F.size("sb") - both)
    done = written(close.join(one("a"), "a").join(one("b"), "b").where(alike).select("a", "b"), "similar")
    forget(close, wanted, sets)
    return done


def enough_left(na: Column, ia: Column, nb: Column, ib: Column) -> Column:
    """Whether sets of these sizes whose first common shingle has these places (from
    0) can share enough."""
    return (OF + SHARED) * F.least(na - ia, nb - ib) >= SHARED * (na + nb)


def few_differ(na: Column, oa: Column, nb: Column, ob: Column) -> Column:
    """Whether sets of these sizes and parities can differ by few enough; a shingle
    that only one of them has turns over one parity."""
    differ = sum((F.bit_count(oa[k].bitwiseXOR(ob[k])) for k in range(1, BINS // 64)), F.bit_count(oa[0].bitwiseXOR(ob[0])))
    return (OF + SHARED) * differ <= (OF - SHARED) * (na + nb)


def similar_links(docs: DataFrame, text: Column) -> DataFrame:
    """(a, b): row hashes of similar texts that join all such into the same
    components; a written table."""
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64(text).alias("row_hash"), text.alias("text"))
    shared = spark.sparkContext.broadcast(common_shingles(texts))

    @F.pandas_udf("struct<n:int,first:array<long>,bins:binary,odd:array<long>>")
    def firsts(texts: pd.Series) -> pd.DataFrame:
        n, first, bins, odd = np.zeros(len(texts), np.int32), [], [], []
        for k, t in enumerate(texts):
            s = shingle_set(t)
            n[k] = len(s)
            first.append(first_shingles(s, shared.value).view(np.int64))
            for to, it in zip((bins, odd), histogram(s)):
                to.append(it)
        return pd.DataFrame({"n": n, "first": first, "bins": bins, "odd": odd})

    prefixes = written(texts.withColumn("f", firsts("text")).select("row_hash", "f.n", "f.first", "f.bins", "f.odd"), "first-shingles", rows=TEXTS)
    rows = prefixes.select("row_hash", "n", "odd", F.posexplode("first").alias("place", "s"))
    met = rows.groupBy("s").agg(F.min_by("row_hash", "place").alias("head"), F.min("row_hash").alias("least"), F.max("row_hash").alias("last"))
    met = written(met.where("least <> last").select("s", "head"), "met")
    members = written(rows.join(met, "s").distinct(), "meetings")
    of_head = members.where("row_hash = head").select("s", *[F.col(c).alias(k + "h") for c, k in (("n", "n"), ("place", "p"), ("odd", "o"))])
    heads = members.where("row_hash <> head").join(of_head, "s").where(
        enough_left(F.col("n"), F.col("place"), F.col("nh"), F.col("ph")) & few_differ(F.col("n"), F.col("odd"), F.col("nh"), F.col("oh"))
    )
    heads = written(heads.groupBy(F.col("head").alias("a"), F.col("row_hash").alias("b")).agg(F.min("ph").alias("ph")), "heads")
    forget(met)
    foremost = written(heads.groupBy("b").agg(F.min_by("a", "ph").alias("a")).select("a", "b"), "foremost-heads")
    first = _verified(foremost, prefixes, texts)
    # texts that links found so far join have one label
    label = components(first)
    of = lambda x: label.select(F.col("node").alias(x), F.col("root").alias("l" + x))
    named = lambda x: F.coalesce("l" + x, x)
    apart = heads.join(foremost, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").where(named("a") != named("b"))
    apart = written(apart.select("a", "b"), "other-heads")
    linked = written(first.unionByName(_verified(apart, prefixes, texts)), "linked")
    forget(foremost, apart, first, label)
    label = components(linked)
    placed = written(
        members.select("s", "row_hash", "n", "place", "odd").join(of("row_hash"), "row_hash", "left").select("s", "row_hash", "n", "place", "odd", named("row_hash").alias("l")),
        "places",
    )
    forget(members)
    one = lambda x: placed.select("s", *[F.col(c).alias(k + x) for c, k in (("row_hash", ""), ("n", "n"), ("place", "p"), ("odd", "o"), ("l", "l"))])
    rest = one("a").join(one("b"), "s").where(
        (F.col("a") < F.col("b"))
        & (F.col("la") != F.col("lb"))
        & enough_left(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"))
        & few_differ(F.col("na"), F.col("oa"), F.col("nb"), F.col("ob"))
    )
    tried = heads.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(rest.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "others")
    forget(placed, heads, label)
    more = _verified(pairs, prefixes, texts)
    both = written(linked.unionByName(more), "similar-links")
    forget(pairs, linked, more, prefixes)
    return both
