"""Pieces that the training-data operators share.

Whitespace is the six ASCII characters of ``SPACE`` throughout; a null text is
an empty one.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.functions.arrays import let, regex_spans, running, running_sums  # noqa: F401

SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Spark's switch for deleting the shuffles of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of text that a Python worker takes at once.
TEXT_BYTES = 4 << 20
#: Most keys that joined_to_unique() treats as hot.
HOT_KEYS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test or production table; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Only a session whose executors are
    threads of this process may go without one; it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.conf.get("hushlake.shared.dir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="hushlake-")
        spark.conf.set("hushlake.shared.dir", own)
    return own


def written(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again;
    Python workers get batches of ``rows``.

    The files survive lost executors, so nothing before this point is ever
    computed twice, and the shuffles that led here go as soon as they are written.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{tag}-{uuid.uuid4().hex}")
    wanted = {SHUFFLE_CLEANUP: "true"} | ({BATCH_ROWS: str(rows)} if rows else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    again = spark.read.schema(df.schema).parquet(path)
    again._hushlake_path = path
    return again


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables from :func:`written` that no later plan reads, and
    have the driver let go of the plans and broadcasts that led to them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._hushlake_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    tables[0].sparkSession._jvm.System.gc()


def joined_to_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of ``left``, a written table, to ``right``, whose ``key`` is
    unique.  A key with more than one in HOT_KEYS of the rows of a large ``left``
    is hot; there are fewer than HOT_KEYS of them, so their rows of ``right`` are
    broadcast and no task gets all rows of one."""
    n = left.count()
    if n < HOT_KEYS * 16:
        return left.join(right, key)
    hot = written(left.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > n // HOT_KEYS).select(key), "hot-keys")
    if hot.isEmpty():
        return left.join(right, key)
    of_hot = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    rest = left.join(F.broadcast(hot), key, "left_anti")
    return left.join(of_hot, key).unionByName(rest.join(right, key))


def blocks_of_texts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in blocks of TEXT_BYTES, or one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.cumsum(sizes) // TEXT_BYTES
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        for at, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(at), int(end - at))


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """All maximal runs of non-space characters."""
    return F.array_remove(F.split(text, SPACE, -1), "")


def counted_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("bigint")


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` by start, then the kind's rank, comma-joined.

    ``spans`` holds structs of (start, rank, end, kind).
    """
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")),
        ),
        ",",
    )


def ranked(spans: Column, rank: int, kind: str) -> Column:
    """Spans of one kind in the shape that :func:`joined_spans` orders."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s.start.alias("start"), F.lit(rank).alias("rank"), s.end.alias("end"), F.lit(kind).alias("kind")
        ),
    )
