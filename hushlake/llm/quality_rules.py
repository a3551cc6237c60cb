"""Quality rules by distribution divergence (native DataFrame expressions only).

Every document gets a character-class histogram and a histogram of its
language's most common words.  Both are compared with references of the
document's declared language by the Jensen-Shannon distance (base 2, so 0 to
1).  The references are gathered by grouped aggregation over all documents.
The bound of the word distance follows from the reference and the length of
the text, and lies below the distance of a text in another language.
Guards of minimum length keep short texts from being judged by a histogram
that they are too short to fill.

Defined results for odd input: a null or empty text has no words and fails the
base rule; a null language is compared with the pooled reference of all
documents; repeated rows are judged alike,
row by row; an empty table gives an empty result.  Columns of the input are
kept; one named like ``out`` is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table, text_or_empty, words_of, written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Words in a language's reference.
TOP_WORDS = 32
#: Parts of a vocabulary that are ranked by themselves first.
SHARDS = 16
#: Places that say whether a word can be one of these.
BINS = 1024
#: Repeated hashes up to which a text's windows are looked up one by one.
LOOKED_UP = 64
#: References of the commonest languages that are broadcast, of 2 KB each; those
#: of further languages are joined to their documents.
BROADCAST_LANGUAGES = 4096
#: Guards and thresholds of the two comparisons.
MIN_CHARS_FOR_CLASSES = 200
MAX_CLASS_DISTANCE = 0.30
MIN_WORDS_FOR_WORDS = 60
#: Bound of the word distance where the language is not known, or where a text
#: is too short to be expected to hold MIN_LISTED words of its reference.
MAX_WORD_DISTANCE = 0.55
MIN_LISTED = 12
#: Else the bound follows from the reference.  ``word_none`` is the distance of
#: a text without any listed word.  Of its square, a text of the language may
#: have OWN_SHARE, and what a sample of its length has by chance, but never
#: NONE_SHARE.
OWN_SHARE = 0.30
NONE_SHARE = 0.81

#: What a text is compared with.
REFERENCE = ("known", "class_share", "ids", "bins", "word_share", "word_none")

#: Patterns whose matched characters are counted; the rest is the last class.
N_CLASSES = 5


def rare_characters(text: Column) -> Column:
    """The text without lower-case letters and spaces; most of it goes at once."""
    return F.regexp_replace(F.regexp_replace(text, "[a-z\\x20\\x09-\\x0D]+", ""), "\\p{Ll}+", "")


def class_counts(n_chars: Column, dense: Column, rare: Column) -> list[Column]:
    """Characters by class: lower, upper, digit, other, space.  ``dense`` is the
    number of characters in words, ``rare`` what rare_characters() leaves."""
    upper = F.length(F.regexp_replace(rare, "[^\\p{Lu}]+", ""))
    digit = F.length(F.regexp_replace(rare, "[^0-9]+", ""))
    return [
        c.cast("double")
        for c in (dense - F.length(rare), upper, digit, F.length(rare) - upper - digit, n_chars - dense)
    ]


def repeated_words(words: Column, window_hashes: Column) -> Column:
    """Words that lie in a 5-word window found twice or more, the first included.

    Windows are compared by a 64-bit hash first; where no hash is found twice,
    no window is.  Else the windows of such hashes are compared as strings.
    """

    def neighbours_equal(pairs: Column) -> Column:
        n = F.size(pairs)
        return F.filter(
            pairs,
            lambda e, k: ((k > 0) & (F.get(pairs, k - 1).x == e.x)) | ((k + 1 < n) & (F.get(pairs, k + 1).x == e.x)),
        )

    def exact(ws: Column, hashes: Column) -> Column:
        twice = let(F.sort_array(hashes), lambda v: F.array_distinct(F.filter(v, lambda h, k: (k > 0) & (F.get(v, k - 1) == h))))
        places = F.transform(hashes, lambda h, i: F.struct(h.alias("x"), i.alias("i")))
        # a few repeated hashes are looked up one by one, many are found by a sort
        suspects = let(
            twice,
            lambda d: F.when(
                F.size(d) <= LOOKED_UP, F.filter(places, lambda e: F.array_contains(d, e.x))
            ).otherwise(let(F.array_sort(places), neighbours_equal)),
        )
        strings = F.array_sort(
            F.transform(
                suspects,
                lambda e: F.struct(F.array_join(F.slice(ws, e.i + 1, WINDOW), " ").alias("x"), e.i.alias("i")),
            )
        )
        starts = F.array_sort(F.transform(let(strings, neighbours_equal), lambda e: e.i))
        cover = F.aggregate(
            starts,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc.n + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        )
        return cover.n

    return F.when(
        (F.size(words) <= WINDOW) | (F.size(F.array_distinct(window_hashes)) == F.size(window_hashes)),
        F.lit(0).cast("bigint"),
    ).otherwise(let(F.struct(words.alias("w"), window_hashes.alias("h")), lambda x: exact(x.w, x.h)))


def word_ids(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hashes(ids: Column) -> Column:
    """A hash of each 5-word window, in order; none for a shorter text.  The ids
    are well mixed, so shifted copies of them need no more than exclusive or."""
    zipped = F.arrays_zip(
        *[F.slice(ids, k + 1, F.greatest(F.size(ids) - (WINDOW - 1), F.lit(0))) for k in range(WINDOW)]
    )

    def mixed(x: Column) -> Column:
        h = x["0"]
        for k in range(1, WINDOW):
            h = h.bitwiseXOR(F.shiftrightunsigned(x[str(k)], 3 * k))
        return h

    return F.transform(zipped, mixed)


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v)))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def shares(counts: Column) -> Column:
    """Shares of the total; all zero where there is nothing."""
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)
    return let(total, lambda t: F.transform(counts, lambda c: F.when(t > 0, c / t).otherwise(F.lit(0.0))))


def word_bar(n_words: Column, ref: Column) -> Column:
    """The greatest word distance that a text of ``n_words`` words may have.  The
    expected squared distance of a sample is the number of its free shares over
    8 n ln 2."""
    none = ref.word_none * ref.word_none
    chance = F.size(ref.ids) / (8 * math.log(2) * n_words)
    listed = n_words * (1 - F.get(ref.word_share, F.lit(TOP_WORDS)))
    own = F.sqrt(F.least(NONE_SHARE * none, OWN_SHARE * none + chance))
    return F.when(ref.known & (listed >= MIN_LISTED), F.least(own, F.lit(MAX_WORD_DISTANCE))).otherwise(F.lit(MAX_WORD_DISTANCE))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, docs, known, class_share, ids, bins, word_share, word_none) of every language,
    and of all documents together under a null ``lang``.

    Word counts are summed before the shuffle, and the rank limit is applied in
    every task before and after it, so no task sees a language's vocabulary.  The
    vocabulary is shuffled, but never written: its files would be as many as the
    tasks, and for each the local file system starts processes.
    """
    t = text_or_empty(text)
    n = N_CLASSES
    by_class = (
        docs.select(F.col(lang).alias("lang"), F.length(t).alias("n"), rare_characters(t).alias("rare"), words_of(t).alias("w"))
        .withColumn("dense", F.length(F.array_join("w", "")))
        .select("lang", F.size("w").alias("words"), F.array(*class_counts(F.col("n"), F.col("dense"), F.col("rare"))).alias("c"))
    )
    classes = written(
        by_class.groupBy("lang").agg(
            F.count("*").alias("docs"), F.sum("words").alias("total"), *[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(n)]
        ),
        "classes",
    )
    sums = ("docs", "total", *[f"c{i}" for i in range(n)])
    each = classes.where("lang is not null").select("lang", *sums)
    pooled = classes.agg(*[F.sum(c).alias(c) for c in sums]).select(F.lit(None).cast("string").alias("lang"), *sums)
    shared = each.unionByName(pooled).select(
        "lang", "docs", "total", shares(F.array(*[F.col(f"c{i}") for i in range(n)])).alias("class_share")
    )
    words = docs.select(F.col(lang).alias("lang"), F.explode(word_ids(words_of(t))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    # each word counts for its language, and for all documents under a null one
    none_such = F.lit(None).cast("string")
    either = F.when(F.col("lang").isNull(), F.array(none_such)).otherwise(F.array("lang", none_such))
    both = counts.select(F.explode(either).alias("lang"), "word", "n").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # in two rounds: the last task of a language gets SHARDS * TOP_WORDS words of
    # it, whatever the number of tasks before
    by_count = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))
    top = (
        both.withColumn("shard", F.pmod(F.col("word"), F.lit(SHARDS)))
        .withColumn("rank", by_count("lang", "shard"))
        .where(F.col("rank") <= TOP_WORDS)
        .withColumn("rank", by_count("lang"))
        .where(F.col("rank") <= TOP_WORDS)
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    )
    joined = shared.alias("a").join(top.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")), "left")
    top_or_none = F.coalesce(F.col("b.top"), F.array().cast("array<struct<rank:int,word:bigint,n:bigint>>"))
    listed = F.aggregate(top_or_none, F.lit(0).cast("double"), lambda s, x: s + x.n)
    total = F.coalesce(F.col("a.total").cast("double"), F.lit(0.0))
    none = F.concat(F.array_repeat(F.lit(0.0), TOP_WORDS), F.array(F.lit(1.0)))
    refs = joined.select(
        F.col("a.lang").alias("lang"),
        "docs",
        F.col("a.lang").isNotNull().alias("known"),
        "class_share",
        F.transform(top_or_none, lambda x: x.word).alias("ids"),
        # a word's number at its id's place, so that most words need one look
        F.transform(
            F.sequence(F.lit(0), F.lit(BINS - 1)),
            lambda k: F.exists(top_or_none, lambda x: F.pmod(x.word, F.lit(BINS)) == k),
        ).alias("bins"),
        # the words in order, then all others; short lists are filled with zeros
        shares(
            F.concat(
                F.transform(top_or_none, lambda x: x.n.cast("double")),
                F.array_repeat(F.lit(0.0), TOP_WORDS - F.size(top_or_none)),
                F.array(total - listed),
            )
        ).alias("word_share"),
    )
    return written(refs.withColumn("word_none", divergence(none, F.col("word_share"))), "references")


def with_references(docs: DataFrame, refs: DataFrame, lang: str, out: str) -> DataFrame:
    """``docs`` with the reference of their language in ``out``, null without one.

    The commonest languages are broadcast.  Where there are more, only documents
    of the others are shuffled, and none of those languages is a hot key."""
    own = refs.where("lang is not null")

    def joined(left: DataFrame, right: DataFrame, send: bool) -> DataFrame:
        named = right.select(F.col("lang").alias("__q_lang"), F.struct(*REFERENCE).alias(out))
        return left.join(F.broadcast(named) if send else named, F.col(lang) == F.col("__q_lang"), "left").drop("__q_lang")

    if own.count() <= BROADCAST_LANGUAGES:
        return joined(docs, own, True)
    common = written(own.orderBy(F.desc("docs"), "lang").limit(BROADCAST_LANGUAGES), "common-references")
    rare = own.join(F.broadcast(common.select("lang")), "lang", "left_anti")
    first = joined(docs, common, True)
    further = F.col(out).isNull() & F.col(lang).isNotNull()
    return first.where(~further).unionByName(joined(first.where(further).drop(out), rare, False))


def judge(docs: DataFrame, refs: DataFrame, text: str = "text", lang: str = "lang", out: str = "quality") -> DataFrame:
    """``docs`` with a struct ``out``: the base counts, both distances, the verdict."""
    pooled = refs.where("lang is null").drop("lang")
    r, p = "__q_ref", "__q_pooled"
    pooled_one = pooled.select(F.struct(*REFERENCE).alias(p))
    t = text_or_empty(text)
    staged = (
        with_references(docs.drop(out), refs, lang, r)
        .join(F.broadcast(pooled_one), F.lit(True), "left")
        .withColumn("__q_words", words_of(t))
        .withColumn("__q_ids", word_ids(F.col("__q_words")))
        .withColumn("__q_windows", window_hashes(F.col("__q_ids")))
        .withColumn("__q_ref", F.coalesce(F.col(r), F.col(p)))
    )
    w, ref = F.col("__q_words"), F.col("__q_ref")
    likely = F.filter(F.col("__q_ids"), lambda x: F.get(F.col("__q_ref.bins"), F.pmod(x, F.lit(BINS)).cast("int")))
    # one character for each common word, at its number; "@" where only the place is the same
    letters = F.array_join(
        F.transform(likely, lambda x: F.char((F.array_position(F.col("__q_ref.ids"), x) + 64))), ""
    )
    staged = (
        staged.withColumn("__q_rare", rare_characters(t))
        .withColumn("__q_dense", F.length(F.array_join(w, "")))
        .withColumn("__q_letters", letters)
        .withColumn("__q_repeat", repeated_words(w, F.col("__q_windows")))
    )
    dense, rare, found = F.col("__q_dense"), F.col("__q_rare"), F.col("__q_letters")
    n_words, n_repeat = F.size(w).cast("bigint"), F.col("__q_repeat")
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    common = F.transform(
        F.sequence(F.lit(65), F.lit(64 + TOP_WORDS)),
        lambda k: (F.length(found) - F.length(F.replace(found, F.char(k), F.lit("")))).cast("double"),
    )
    staged = staged.withColumn("__q_failed", failed).withColumn(
        "__q_classes", F.array(*class_counts(F.length(t), dense, rare))
    ).withColumn(
        "__q_counts",
        let(common, lambda c: F.concat(c, F.array(n_words - F.aggregate(c, F.lit(0.0), lambda a, x: a + x)))),
    )
    judged = staged.withColumn(
        out,
        F.struct(
            n_words.alias("n_words"),
            dense.cast("bigint").alias("word_chars"),
            (F.length(rare) - F.length(F.regexp_replace(rare, "[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
            duplicate_lines(t).cast("bigint").alias("n_dup_lines"),
            n_repeat.alias("n_repeat_words"),
            F.col("__q_failed").alias("base_failed"),
            F.when(
                ~F.col("__q_failed") & (F.length(t) >= MIN_CHARS_FOR_CLASSES),
                divergence(shares(F.col("__q_classes")), ref.class_share),
            ).alias("class_distance"),
            F.when(
                ~F.col("__q_failed") & (n_words >= MIN_WORDS_FOR_WORDS),
                divergence(shares(F.col("__q_counts")), ref.word_share),
            ).alias("word_distance"),
        ),
    )
    kept = (
        ~F.col(out).base_failed
        & (F.coalesce(F.col(out).class_distance, F.lit(0.0)) <= MAX_CLASS_DISTANCE)
        & (F.coalesce(F.col(out).word_distance, F.lit(0.0)) <= word_bar(n_words, ref))
    )
    return judged.withColumn(out, F.col(out).withField("kept", kept)).drop(
        *["__q_" + c for c in ("words", "ids", "windows", "ref", "pooled", "rare", "dense", "letters", "repeat", "failed", "classes", "counts")]
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    judged = judge(docs, references(docs), out="__quality")
    # a filter would be pushed below the projections, and every expression of the
    # verdict would be put into it and evaluated over and over; a generator stays
    once = F.explode(F.when(F.col("__quality.kept"), F.array(F.lit(True))))
    return judged.select(*docs.columns, once.alias("__kept")).select(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    q = judge(docs, references(docs), out="q")
    return q.select(
        "doc_id",
        *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
    )
