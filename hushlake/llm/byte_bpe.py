"""Byte-level BPE encoding and decoding.

A first pass counts the distinct pieces of all texts.  The commonest of them,
a bounded number, are encoded in Spark: higher-order functions fold the ranked
merges over the array of a piece's bytes, looking pairs up in a rank map that
is a literal of one row.  The encoded pieces are broadcast, and one pass over
the texts replaces each piece by its ids; a piece outside the dictionary is
folded there by the same ranked merges, so nothing is dropped or approximated.
Decoding concatenates the byte strings of the ids.

Which pieces are commonest follows from a histogram of their counts, so no
task sorts or sees them all.  The pass over the texts is Python (Arrow
batches): joining pieces to documents by a shuffle would move several times
the input.

Defined results for odd input: a null or empty text has no ids; ids of
repeated rows are equal, columns beside the text are handed through as they
are, nulls included; texts of any length are encoded whole, long pieces by
a heap in n log n; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks_of_texts, forget, let, table, text_or_empty, written

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pieces in the broadcast dictionary, and bytes of a piece: 4 MB at most.
DICTIONARY = 1 << 16
MAX_PIECE = 48
#: Bins of the histogram of counts for each doubling, and pieces that one row
#: of the fold holds.
BINS = 16
FOLDED = 512
#: Pieces that a worker remembers beside the dictionary.
REMEMBERED = 200_000
BUCKETS = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _place(left, right):
    return (left * 31337 + right * 7919) % BUCKETS


def rank_map(spark: SparkSession, path: str) -> DataFrame:
    """One row: the pairs that merge, of all splits of all tokens.  ``e`` has
    entries (pair * 2^17 + rank) in the order of their buckets, ``s`` where each
    bucket starts.  Its size is that of the vocabulary."""
    ranks = read_ranks(path)
    lefts, rights, merged_to = array("q"), array("q"), array("q")
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                lefts.append(left)
                rights.append(right)
                merged_to.append(rank)
    left, right, rank = (np.frombuffer(x, dtype=np.int64) for x in (lefts, rights, merged_to))
    place = _place(left, right)
    order = np.argsort(place, kind="stable")
    entries = (((left << 16) | right) << 17 | rank)[order]
    starts = np.searchsorted(place[order], np.arange(BUCKETS + 1)).astype(np.int32)
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
    return spark.createDataFrame(pa.table({"e": one(entries), "s": one(starts)}))


def merged(ids: Column, pairs: Column) -> Column:
    """Fold the ranked merges over an array of byte ids: each step joins the
    leftmost pair of least rank, until no pair has one."""

    def rank_of(left: Column, right: Column) -> Column:
        # get() takes one number from a large array, slice() would copy it all
        bucket = _place(left, right).cast("int")
        first, end = F.get(pairs.s, bucket), F.get(pairs.s, bucket + 1)
        entries = F.transform(F.when(end > first, F.sequence(first, end - 1)), lambda j: F.get(pairs.e, j))
        entry = F.get(F.filter(entries, lambda e: F.shiftright(e, 17) == left * 65536 + right), 0)
        return entry.bitwiseAND(F.lit((1 << 17) - 1))

    def step(acc: Column, _: Column) -> Column:
        found = F.zip_with(F.slice(acc, 1, F.size(acc) - 1), F.slice(acc, 2, F.size(acc)), rank_of)

        def join(x: Column) -> Column:
            at = F.array_position(x, F.array_min(x)).cast("int")
            return F.concat(F.slice(acc, 1, at - 1), F.array(F.array_min(x)), F.slice(acc, at + 2, F.size(acc)))

        return let(
            F.when(F.size(acc) > 1, found), lambda x: F.when(F.array_min(x).isNotNull(), join(x)).otherwise(acc)
        )

    return F.aggregate(F.slice(ids, 2, F.size(ids)), ids, step)


def commonest(pieces: DataFrame, size: int) -> DataFrame:
    """Of (piece, n), a written table, those from the least count on with which
    there are no more than ``size``; of pieces with that count alone, none or all."""
    bins = pieces.groupBy(F.floor(F.log2("n") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("pieces"))
    least, total = None, 0
    for row in sorted(bins.collect(), reverse=True):  # at most 63 * BINS rows
        total += row.pieces
        if total > size:
            break
        least = row.bin
    return pieces.where(F.floor(F.log2("n") * BINS) >= least) if least is not None else pieces.limit(0)


def counted_pieces(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(piece, n) of all distinct pieces that the dictionary can hold."""
    java = pattern.replace("\\s", "\\p{IsWhite_Space}").replace("\\S", "\\P{IsWhite_Space}")
    pieces = docs.select(F.explode(F.regexp_extract_all(text_or_empty(text), F.lit(java), F.lit(0))).alias("piece"))
    counts = pieces.where(F.octet_length("piece") <= MAX_PIECE).groupBy("piece").agg(F.count("*").alias("n"))
    return written(counts, "pieces")


def folded(pieces: DataFrame, path: str) -> DataFrame:
    """(piece, ids) of all of ``pieces``, by the fold of the ranked merges."""
    spark = pieces.sparkSession
    ranks = read_ranks(path)
    byte_ids = F.array(*[F.lit(ranks[bytes([b])]).cast("bigint") for b in range(256)])

    def ids_of(piece: Column, pairs: Column) -> Column:
        digits = F.hex(F.encode(piece, "UTF-8"))
        ids = F.transform(
            F.sequence(F.lit(0), F.octet_length(piece) - 1),
            lambda i: F.get(byte_ids, F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int")),
        )
        return merged(ids, pairs)

    # many pieces to a row, so that the map is handed to few rows
    rows = pieces.groupBy((F.pmod(F.xxhash64("piece"), F.lit(max(1, DICTIONARY // FOLDED)))).alias("k")).agg(F.collect_list("piece").alias("p"))
    with_map = rows.repartition(spark.sparkContext.defaultParallelism).withColumn("pairs", rank_map(spark, path).select(F.struct("e", "s")).scalar())
    done = F.transform("p", lambda x: F.struct(x.alias("piece"), ids_of(x, F.col("pairs")).alias("ids")))
    # outer, as a filter on an inner one would fold everything again
    return with_map.select(F.inline_outer(done))


def dictionary(docs: DataFrame, path: str, pattern: str, text: str = "text", size: int = DICTIONARY) -> DataFrame:
    """(piece, ids) of the commonest pieces of all texts, a written table."""
    pieces = counted_pieces(docs, pattern, text)
    done = written(folded(commonest(pieces, size), path), "dictionary")
    forget(pieces)
    return done


def merge_bytes(piece: bytes, ranks: dict[bytes, int], shortcut: bool = True) -> list[int]:
    """The same ranked merges for one piece, by a heap over a linked list.
    With ``shortcut`` a piece that is a token is that token."""
    whole = ranks.get(piece) if shortcut else None
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here; 0: not a start
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class _Pieces(dict):
    """Piece: ids as little-endian 32-bit integers; others are merged when asked."""

    def __init__(self, known: dict[str, bytes], ranks: dict[bytes, int]):
        super().__init__(known)
        self.ranks, self.full = ranks, len(known) + REMEMBERED

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", merge_bytes(piece.encode(), self.ranks)).tobytes()
        if len(self) < self.full and len(piece) <= MAX_PIECE:
            self[piece] = ids
        return ids


def encoded(
    docs: DataFrame,
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``keep`` with the ids of each text and the bytes that they decode to."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path(RANKS)
    pieces = dictionary(docs, path, pattern, text)
    # DICTIONARY rows at most; Arrow holds them without an object for each number
    rows = pieces.toArrow().combine_chunks()
    forget(pieces)
    known = {}
    for batch in rows.to_batches():
        ids = batch.column("ids")
        ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
        for k, piece in enumerate(batch.column("piece").to_pylist()):
            known[piece] = flat[ends[k] : ends[k + 1]].tobytes()
    del rows
    shared = spark.sparkContext.broadcast((known, read_ranks(path)))
    del known
    names = list(keep)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = shared.value
        pieces = _Pieces(known, ranks)
        split = regex.compile(pattern).findall
        token = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            token[r] = b
        for block in blocks_of_texts(batches, "__text"):
            texts = block.column("__text").to_pylist()
            ids = [b"".join(map(pieces.__getitem__, split(t))) for t in texts]
            decoded = [b"".join(map(token.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*[block.column(c) for c in names], pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], [*names, "ids", "decoded"]
            )

    inner = docs.select(*keep, text_or_empty(text).alias("__text"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return inner.mapInArrow(encode, schema)


def digests(done: DataFrame, keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Counts and digests of what :func:`encoded` gives, with the ids if asked."""
    return done.select(
        *keep,
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if ids else []),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encoded(table(spark, sf_dir, "documents").select("doc_id", "text")))
