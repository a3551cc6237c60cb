"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing,
tokens.  Each stage takes what its predecessor wrote; all but the last return
the columns of documents.

Defined results for odd input: a null or empty text fails the quality rules,
and goes through the other stages as an empty one; a null language is judged by
all documents, a null source is a source of its own, a null id sorts after all
others; of equal texts, repeated rows included, the first by id stays; further
columns go along whatever they are called; an empty table stays empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm.byte_bpe import digests, encoded
from hushlake.llm.common import table, written
from hushlake.llm.pii_spans import redact
from hushlake.llm.quality_rules import kept_documents
from hushlake.llm.simhash_neardup import one_of_each
from hushlake.llm.source_mixing import mix


def beside(docs: DataFrame, columns: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` on the columns it needs; all others go along in one, so that no
    name of theirs can clash with one that a stage makes."""
    rest = [c for c in docs.columns if c not in columns]
    packed = docs.select(*columns, *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []))
    return stage(packed).select(*[F.col(c) if c in columns else F.col(f"rest.`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return beside(docs, ("text", "lang"), kept_documents)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the first by id:
    those of op6 and texts of which 80 % of the 5-word shingles are the same."""
    return beside(docs, ("doc_id", "text"), lambda d: one_of_each(d, similar=True))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in angle brackets."""
    return beside(docs, ("text",), redact)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate, and shuffled."""
    return beside(docs, ("doc_id", "source"), lambda d: mix(d, out="__copy"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded bytes."""
    done = encoded(docs.select("doc_id", "source", "text"), keep=("doc_id", "source"))
    return digests(done, ("doc_id", "source"), ids=True)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Stages fit models and follow links, which SQL can't express; the tests hold
#: the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
