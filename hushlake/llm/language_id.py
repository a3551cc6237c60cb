"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in log space: how likely the text is in each
language, the language that the page's markup declares, the country suffix of
its address, and a prior of its host.  Host priors are smoothed in levels by
grouped aggregation: a host leans on its registered domain, the domain on all
pages, so a host with few pages says little by itself.  They count, for all
other rows, the language that text and markup alone would give; a row's own
count is taken out at every level, so nothing is counted twice.

Text likelihoods come from hashed byte trigrams, fitted on a bounded sample of
about TRAIN_ROWS rows of each of the TEXT_LANGUAGES commonest known languages.
The log-likelihood is a mean per trigram times a bounded number of trigrams:
neighbouring trigrams repeat each other, and a long text must not drown all
other evidence.  Beside the fitted languages stands one more candidate, the
language outside them that markup or else suffix names; its text is as likely
as one of the mean of all languages.

Documents have no address and no markup; their source stands for a host.
Their declared language trains the model in the sample and is not evidence.

Defined results for odd input: a null or empty text has no text evidence; no
evidence at all gives the commonest language of its host; a language that
nothing names is "und"; repeated rows are judged alike; texts of any length
are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_of_texts, forget, joined_to_unique, table, text_or_empty, written

#: Rows of a language in the training sample, in the mean, and the longest text
#: in it.  The model has 32 KB for a language, 8 MB at most.
TRAIN_ROWS = 500
TRAIN_CHARS = 20_000
TEXT_LANGUAGES = 256
BINS = 1 << 13
#: Trigrams that a text can count for, and the weight of one.
FULL_TEXT = 60
#: Odds of the other evidence: P(declared = true language), P(suffix = ...).
DECLARED = 0.9
SUFFIX = 0.8
#: Rows that the level above counts for.
SMOOTHING = 10.0
MIN_POSTERIOR = 0.5
#: Log evidence of a candidate that is none.
NOTHING = -1e6

#: Country suffix and the language it speaks for (fixed values).
SUFFIXES = {
    "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en",
    "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko",
}
#: Labels below a country suffix under which names are registered.
SECOND_LEVEL = "co|com|org|net|ac|gov|gob|edu|or|ne|go|gv"


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the text in lower case."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64)


def model_of(languages: list[str], counts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each bin by language, and by their mean)."""
    smooth = counts + 0.5
    p = smooth / smooth.sum(axis=1, keepdims=True)
    mean = p.mean(axis=0, keepdims=True) if len(languages) else np.full((1, BINS), 1 / BINS)
    return languages, np.log(np.concatenate([p, mean])).astype(np.float32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bin, n) of one task's rows."""
    counts: dict[str, np.ndarray] = {}
    for block in blocks_of_texts(batches, "text"):
        for lang, text in zip(block.column("lang").to_pylist(), block.column("text").to_pylist()):
            own = counts.setdefault(lang, np.zeros(BINS, np.int64))
            own += np.bincount(trigrams(text), minlength=BINS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at])], ["lang", "bin", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """The model of a sample: rows whose hash is below the share of their
    language that makes TRAIN_ROWS.  Trigrams are counted where the rows are."""
    usable = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    usable = usable.where(F.length("text").between(20, TRAIN_CHARS))
    sizes = written(usable.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    common = sizes.orderBy(F.desc("rows"), "lang").limit(TEXT_LANGUAGES)  # bounded by its parameter
    drawn = usable.join(F.broadcast(common), "lang").where(
        F.pmod(F.xxhash64("text"), F.lit(1 << 30)) * F.col("rows") < F.lit(TRAIN_ROWS << 30)
    )
    found = drawn.select("lang", "text").mapInArrow(_counted, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    forget(sizes)
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), BINS))
    counts[found["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(np.int64), found["bin"].to_numpy(np.int64)] = found["n"]
    return model_of(languages, counts)


def likelihood(text: str, logs: np.ndarray) -> list[float]:
    """Log-likelihoods of one text, the greatest zero; all zero without trigrams."""
    bins = trigrams(text)
    if not len(bins):
        return [0.0] * len(logs)
    seen = np.bincount(bins, minlength=BINS)
    at = np.flatnonzero(seen)
    mean = logs[:, at] @ seen[at] / len(bins)
    return ((mean - mean.max()) * min(len(bins), FULL_TEXT)).tolist()


def text_evidence(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``rows`` with their text replaced by an array of log-likelihoods."""
    shared = rows.sparkSession.sparkContext.broadcast(model[1])

    @F.pandas_udf("array<double>")
    def likelihoods(texts: pd.Series) -> pd.Series:
        return pd.Series([likelihood(t, shared.value) for t in texts])

    return rows.withColumn("text", likelihoods("text")).withColumnRenamed("text", "evidence")


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def fused(rows: DataFrame, languages: list[str], keep: tuple[str, ...]) -> DataFrame:
    """``rows`` (evidence, declared, suffix, host, domain) to ``keep`` with
    language, posterior and kept."""
    n = len(languages) + 1
    names = F.array(*[F.lit(x) for x in languages]).cast("array<string>")
    numbers = F.sequence(F.lit(1), F.lit(n))
    named = lambda x: F.nullif(F.col(x), F.lit(""))
    # the one candidate beside the fitted languages
    outside = lambda x: F.when(F.array_position(names, named(x)) == 0, named(x))
    staged = rows.withColumn("other", F.coalesce(outside("declared"), outside("suffix")))

    def says(x: str, right: float) -> Column:
        """Log evidence by candidate of something that names one; zeros without."""
        known = F.array_position(names, named(x)).cast("int")
        place = F.when(known > 0, known).when(named(x) == F.col("other"), F.lit(n)).otherwise(F.lit(0))
        rest = float(np.log((1 - right) / max(1, n - 1)))
        return F.when(named(x).isNull(), F.array_repeat(F.lit(0.0), n)).otherwise(
            F.transform(numbers, lambda k: F.when(k == place, float(np.log(right))).otherwise(rest))
        )

    best = lambda a: F.array_position(a, F.array_max(a)).cast("int")
    # without a name the other candidate is none, unless there is nothing else
    out = F.transform(numbers, lambda k: F.when((k == n) & F.col("other").isNull() & F.lit(n > 1), NOTHING).otherwise(0.0))
    local = _added(_added(F.col("evidence"), out), says("declared", DECLARED))
    place = F.struct(F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("host", F.lit("")).alias("host"))
    first = written(
        staged.withColumn("local", local).withColumn("guess", best(F.col("local"))).withColumn("place", place).drop("domain", "host", "evidence"),
        "language-evidence",
    )
    # counts by candidate, as maps of no more than n entries
    counted = lambda df: F.map_from_entries(F.collect_list(F.struct("guess", "n")))
    by_host = written(first.groupBy("place", "guess").agg(F.count("*").cast("double").alias("n")), "host-languages")
    by_domain = by_host.groupBy(F.col("place.domain").alias("domain"), "guess").agg(F.sum("n").alias("n"))
    overall = by_host.groupBy("guess").agg(F.sum("n").alias("n")).agg(counted(None).alias("c"))  # one row
    domains = by_domain.groupBy("domain").agg(counted(None).alias("of_domain"))
    hosts = by_host.groupBy("place").agg(counted(None).alias("of_host"))
    levels = written(
        hosts.join(domains, F.col("place.domain") == F.col("domain")).select("place", "of_host", "of_domain", overall.scalar().alias("of_all")),
        "host-levels",
    )
    joined = joined_to_unique(first, levels, "place")

    def without_own(counts: str) -> Column:
        """Counts by candidate without the row's own."""
        of = lambda k: F.coalesce(F.try_element_at(F.col(counts), k), F.lit(0.0))
        return F.transform(numbers, lambda k: of(k) - F.when(k == F.col("guess"), 1.0).otherwise(0.0))

    def lean(counts: str, above: Column, weight: float) -> Column:
        own = without_own(counts)
        return F.transform(F.array(F.struct(own.alias("c"), _total(own).alias("t"))), lambda x: F.zip_with(x.c, above, lambda c, p: (c + weight * p) / (x.t + weight)))[0]

    even = F.array_repeat(F.lit(1.0 / n), n)
    prior = lean("of_host", lean("of_domain", lean("of_all", even, float(n)), SMOOTHING), SMOOTHING)
    scored = joined.withColumn("logs", _added(_added(F.col("local"), says("suffix", SUFFIX)), F.transform(prior, lambda p: F.log(p))))
    exps = F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))
    done = scored.withColumn("k", best(F.col("logs"))).withColumn("posterior", 1 / _total(exps))
    return done.select(
        *keep,
        F.coalesce(F.get(names, F.col("k") - 1), F.col("other"), F.lit("und")).alias("language"),
        F.round("posterior", 6).alias("posterior"),
        (F.col("posterior") >= MIN_POSTERIOR).alias("kept"),
    )


def page_text(html: Column) -> Column:
    """What is left of a page without scripts, styles, comments and tags; one
    that is not closed goes on to the end of the page."""
    bare = F.regexp_replace(
        html,
        "(?is)<script\\b.*?(?:</script>|\\z)|<style\\b.*?(?:</style>|\\z)|<!--.*?(?:-->|\\z)|</?[a-z!?][^>]*+(?:>|\\z)",
        " ",
    )
    return F.regexp_replace(bare, "&[a-z]+;", " ")


def page_rows(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, "^[^/?#]*://([^/?#:]*)", 1))
    html = text_or_empty("html")
    suffix = F.regexp_extract(host, "([a-z]+)$", 1)
    return pages.select(
        F.lit(None).cast("bigint").alias("doc_id"),
        "page_id",
        page_text(html).alias("text"),
        F.lower(F.regexp_extract(html, "(?i)<html\\b[^<>]*?\\blang\\s*=\\s*[\"']?([a-zA-Z]{2})", 1)).alias("declared"),
        _suffix_language(suffix).alias("suffix"),
        host.alias("host"),
        F.regexp_extract(host, f"((?:[^.]+\\.(?:{SECOND_LEVEL})\\.[a-z]{{2}}|[^.]+\\.[^.]+))$", 1).alias("domain"),
    )


def _suffix_language(suffix: Column) -> Column:
    pairs = [F.lit(x) for kv in SUFFIXES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), suffix), F.lit(""))


def document_rows(docs: DataFrame) -> DataFrame:
    none = F.lit("")
    return docs.select(
        "doc_id",
        F.lit(None).cast("bigint").alias("page_id"),
        text_or_empty("text").alias("text"),
        none.alias("declared"),
        none.alias("suffix"),
        F.concat(F.lit("source:"), F.coalesce("source", none)).alias("host"),
        F.lit("source:").alias("domain"),
    )


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = fit(docs)
    rows = document_rows(docs).unionByName(page_rows(pages))
    return fused(text_evidence(rows, model), model[0], ("doc_id", "page_id"))
