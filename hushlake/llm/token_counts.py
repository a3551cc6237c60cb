"""Token counts with a whole-token shortcut.

Before any text is read, it is proved for every string of the vocabulary
whether its ranked merges end in one token; most do, and those that do count
one without merging.  A pass over the texts splits them into pre-tokens as the
tokenizer does, looks each one up, and merges only the rest.  Counts of merged
pre-tokens are remembered per worker, up to a bound.

Special strings inside a text count one token each, as the tokenizer's
default has it; the text between them is counted by itself.

Defined results for odd input: a null or empty text has no tokens; repeated
rows have equal counts; columns beside the text are handed through as they are,
nulls included; texts of any length are counted whole; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import merge_bytes
from .common import blocks_of_texts, table, text_or_empty

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
REMEMBERED = 300_000
MAX_REMEMBERED_CHARS = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print
    stand for themselves, the others follow from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_tokenizer(path: str) -> tuple[dict[bytes, int], list[str]]:
    """(rank of each merged token by its bytes, special strings).

    A token's rank is the place of the merge that makes it; single bytes come
    before all merges.  Where several merges make one token, the first counts.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    raw = byte_alphabet()
    ranks = {bytes([b]): b - 256 for b in range(256)}
    for k, merge in enumerate(spec["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        ranks.setdefault(bytes(raw[c] for c in left + right), k)
    return ranks, [t["content"] for t in spec["added_tokens"]]


def proved_whole(ranks: dict[bytes, int]) -> frozenset[str]:
    """Vocabulary strings whose own merges end in one token.

    Every string is merged from its bytes without the shortcut; so it is known
    and not assumed that a pre-token equal to it counts one.
    """
    whole = set()
    for token in ranks:
        if len(merge_bytes(token, ranks, shortcut=False)) == 1:
            try:
                whole.add(token.decode())
            except UnicodeDecodeError:  # never a whole pre-token
                continue
    return frozenset(whole)


class _Counts(dict):
    """Pre-token: its tokens.  The rest are merged when asked for."""

    def __init__(self, whole: frozenset[str], ranks: dict[bytes, int]):
        super().__init__(dict.fromkeys(whole, 1))
        self.ranks, self.full = ranks, len(whole) + REMEMBERED

    def __missing__(self, piece: str) -> int:
        n = len(merge_bytes(piece.encode(), self.ranks, shortcut=False))
        if len(self) < self.full and len(piece) <= MAX_REMEMBERED_CHARS:
            self[piece] = n
        return n


def counted(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """``keep`` with n_bytes, n_tokens and over_limit."""
    spark = docs.sparkSession
    ranks, special = read_tokenizer(path or public_tokenizers.path(TOKENIZER))
    shared = spark.sparkContext.broadcast((proved_whole(ranks), ranks))

    names = [*keep, "n_bytes"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, ranks = shared.value
        counts = _Counts(whole, ranks)
        pieces = regex.compile(public_tokenizers.PATTERN).findall
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None

        def tokens(text: str) -> int:
            if cut is None or not any(s in text for s in special):
                return sum(map(counts.__getitem__, pieces(text)))
            parts = cut.split(text)
            return len(parts) - 1 + sum(sum(map(counts.__getitem__, pieces(p))) for p in parts)

        for block in blocks_of_texts(batches, "__text"):
            n = pa.array([tokens(t) for t in block.column("__text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in names], n], [*names, "n_tokens"])

    inner = docs.select(*keep, F.octet_length(text_or_empty(text)).cast("bigint").alias("n_bytes"), text_or_empty(text).alias("__text"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return inner.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents").select("doc_id", "text"))
