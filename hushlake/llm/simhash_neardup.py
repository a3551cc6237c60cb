"""Near-duplicates by SimHash and a Gray-order hierarchical index.

A document's 64-bit fingerprint is the majority vote of the XXH64 hashes of
its 3-word shingles.  Distinct fingerprints are sorted by Gray rank and dealt
in that order to partitions; neighbours in Gray order share many bits.  The
shared bits of a run of fingerprints stand once in the node above it, the bits
shared by a run of nodes in the node above those, and so on.  A search adds up
the differing bits on the way down and leaves a whole group as soon as the sum
passes the radius.  The top of the tree is a bounded number of nodes per
partition; it is broadcast and tells which partitions a fingerprint must
visit.  Below it every partition holds its own tree, and visitors stream
through.  A partition hands out a spanning forest of its links, never all
pairs.  Links become components by alternating large and small stars, each
round written to the shared folder.

Exact copies collapse into one fingerprint before anything is compared, so a
group of copies costs one code, whatever its size.

Defined results for odd input: a null or empty text has fingerprint zero and
is linked like any other; ties and repeated rows share a component; an id that
is null sorts after all ids; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, joined_to_unique, table, text_or_empty, written
from .components import components
from .similar_texts import similar_links

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Children of a node, and codes that a partition is meant to hold.
FANOUT = 16
CODES_PER_PARTITION = 1 << 17
#: Codes that a partition holds at least where cores would be idle otherwise.
LEAST_CODES = 1 << 13
MAX_PARTITIONS = 4096
#: Runs of each partition in the broadcast top of the tree: at most
#: MAX_PARTITIONS * TOP_RUNS nodes of 24 bytes, 6 MB.
TOP_RUNS = 64
#: Pairs of query and node that a search holds at once.
FRONTIER = 1 << 20
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """The contract's fingerprint as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)])) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64, count=n).astype(">u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([_signed(fingerprint(t)) for t in texts], dtype="int64")


def gray_rank(code: Column) -> Column:
    """The number whose Gray code this is: prefix parities of the bits."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code


def gray_ranks(codes: np.ndarray) -> np.ndarray:
    x = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayTree:
    """Masked patterns in levels: each node has the bits that all below it share."""

    def __init__(self, ones: np.ndarray, zeros: np.ndarray):
        """Leaves in Gray order: bits known to be one, bits known to be zero."""
        levels = [(ones, zeros)]
        while len(levels[-1][0]) > FANOUT:
            starts = np.arange(0, len(levels[-1][0]), FANOUT)
            levels.append(tuple(np.bitwise_and.reduceat(x, starts) for x in levels[-1]))
        self.levels = levels[::-1]
        # what a node adds to the pattern of the node above it
        self.added = [self.levels[0]]
        for above, here in zip(self.levels, self.levels[1:]):
            parent = np.arange(len(here[0])) // FANOUT
            self.added.append(tuple(h & ~a[parent] for a, h in zip(above, here)))

    @classmethod
    def of_codes(cls, codes: np.ndarray) -> GrayTree:
        return cls(codes, ~codes)

    def _kept(self, level, queries, q, node, diff, radius):
        ones, zeros = self.added[level]
        code = queries[q]
        diff = diff + np.bitwise_count(ones[node] & ~code) + np.bitwise_count(zeros[node] & code)
        ok = diff <= radius
        return q[ok], node[ok], diff[ok]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, leaf number) of all leaves within the radius, in blocks."""
        top, last = len(self.levels[0][0]), len(self.levels) - 1
        step = max(1, FRONTIER // max(1, top))
        for at in range(0, len(queries), step):
            n = min(step, len(queries) - at)
            q = np.repeat(np.arange(at, at + n), top)
            node = np.tile(np.arange(top), n)
            stack = [(0, *self._kept(0, queries, q, node, np.zeros(len(q), np.int64), radius))]
            while stack:
                level, q, node, diff = stack.pop()
                if not len(q):
                    continue
                if level == last:
                    yield q, node
                    continue
                half = FRONTIER // FANOUT
                if len(q) > half:
                    stack.append((level, q[half:], node[half:], diff[half:]))
                    q, node, diff = q[:half], node[:half], diff[:half]
                below = len(self.levels[level + 1][0])
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                there = child < below
                q, diff = np.repeat(q, FANOUT)[there], np.repeat(diff, FANOUT)[there]
                stack.append((level + 1, *self._kept(level + 1, queries, q, child[there], diff, radius)))


class _Forest:
    """Union-find over the codes of one partition."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _top_nodes(frame: pd.DataFrame) -> pd.DataFrame:
    """The masked patterns of TOP_RUNS runs of one partition."""
    codes = frame["code"].to_numpy().astype(np.uint64)
    codes = codes[np.argsort(gray_ranks(codes), kind="stable")]
    starts = np.unique(np.linspace(0, len(codes), TOP_RUNS, endpoint=False).astype(np.int64))
    return pd.DataFrame(
        {
            "pid": frame["pid"].iloc[0],
            "rank": gray_ranks(codes[starts]).astype(np.int64),
            "ones": np.bitwise_and.reduceat(codes, starts).astype(np.int64),
            "zeros": np.bitwise_and.reduceat(~codes, starts).astype(np.int64),
        }
    )


def links(codes: DataFrame, radius: int = RADIUS, n_codes: int | None = None) -> DataFrame:
    """(a, b): links that join all of ``codes`` (column code, distinct) whose
    distance is at most ``radius`` into the same components; a written table."""
    spark = codes.sparkSession
    n = codes.count() if n_codes is None else n_codes
    # enough for all cores, unless that makes them so small that codes meet elsewhere
    parts = max(-(-n // CODES_PER_PARTITION), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_CODES)))
    parts = int(min(MAX_PARTITIONS, max(1, parts)))
    placed = written(
        codes.repartitionByRange(parts, gray_rank(F.col("code"))).select(
            "code", F.spark_partition_id().alias("pid")
        ),
        "gray-codes",
    )
    # one row for each run of each partition: parts * TOP_RUNS at most
    top = placed.groupBy("pid").applyInPandas(_top_nodes, "pid int, rank long, ones long, zeros long").toPandas()
    order = np.argsort(top["rank"].to_numpy().astype(np.uint64), kind="stable")
    pids, ones, zeros = (
        top["pid"].to_numpy()[order],
        *(top[c].to_numpy().astype(np.uint64)[order] for c in ("ones", "zeros")),
    )
    shared = spark.sparkContext.broadcast((pids, ones, zeros))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pids, ones, zeros = shared.value
        tree = GrayTree(ones, zeros)
        for frame in frames:
            own, code = frame["pid"].to_numpy(), frame["code"].to_numpy()
            yield pd.DataFrame({"pid": own, "guest": 0, "code": code})
            for q, leaf in tree.search(code.astype(np.uint64), radius):
                there = pids[leaf]
                later = there > own[q]
                visit = pd.DataFrame({"pid": there[later], "guest": 1, "code": code[q[later]]})
                yield visit.drop_duplicates()

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        home: list[np.ndarray] = []
        state: dict = {"pid": None, "tree": None}

        def build() -> list[tuple[int, int]]:
            codes = np.concatenate(home).astype(np.uint64) if home else np.empty(0, np.uint64)
            codes = codes[np.argsort(gray_ranks(codes), kind="stable")]
            home.clear()
            forest, edges = _Forest(len(codes)), []
            if len(codes):
                state["tree"] = tree = GrayTree.of_codes(codes)
                for q, leaf in tree.search(codes, radius):
                    once = q < leaf
                    for i, j in zip(q[once].tolist(), leaf[once].tolist()):
                        if forest.union(i, j):
                            edges.append((codes[i], codes[j]))
            state["codes"], state["forest"] = codes, forest
            return edges

        def visit(guests: np.ndarray) -> list[tuple[int, int]]:
            edges, codes, forest = [], state["codes"], state["forest"]
            if not len(codes):
                return edges
            met: dict[int, int] = {}
            for q, leaf in state["tree"].search(guests, radius):
                for i, j in zip(q.tolist(), leaf.tolist()):
                    first = met.setdefault(i, j)
                    if first == j or forest.union(first, j):
                        edges.append((guests[i], codes[j]))
            return edges

        def frame_of(edges: list) -> pd.DataFrame:
            flat = np.array(edges, dtype=np.uint64).reshape(-1, 2).astype(np.int64)
            return pd.DataFrame({"a": flat[:, 0], "b": flat[:, 1]})

        for frame in frames:
            for pid, part in frame.groupby("pid", sort=True):
                if pid != state["pid"]:
                    if home:
                        yield frame_of(build())
                    state.update(pid=pid, tree=None, codes=None)
                own = part.loc[part["guest"] == 0, "code"].to_numpy()
                if len(own):
                    home.append(own)
                guests = part.loc[part["guest"] == 1, "code"].to_numpy().astype(np.uint64)
                if len(guests):
                    if home or state["codes"] is None:
                        yield frame_of(build())
                    yield frame_of(visit(guests))
        if home:
            yield frame_of(build())

    routed = placed.mapInPandas(route, "pid int, guest int, code long")
    dealt = routed.repartitionById(parts, F.col("pid")).sortWithinPartitions("pid", "guest")
    found = written(dealt.mapInPandas(meet, "a long, b long").where("a <> b").distinct(), "fingerprint-links")
    forget(placed)
    return found


def with_similar(docs: DataFrame, t: Column, printed: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` and those between the fingerprints of similar texts."""
    prints = written(printed.select("row_hash", "fp").distinct(), "text-fingerprints")
    side = lambda x: prints.select(F.col("row_hash").alias(x), F.col("fp").alias("f" + x))

    def added(pairs: DataFrame) -> DataFrame:
        named = pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
        return edges.unionByName(named.where("a <> b")).distinct()

    similar = similar_links(docs, t)
    every = written(added(similar), "all-links")
    forget(similar, prints, edges)
    return every


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: bool = False) -> DataFrame:
    """(doc_id, row_hash, fp, first): a row for each of ``docs``; ``first`` is
    the least (id is null, id, row hash) of its component.  ``similar`` links
    similar texts too, however far apart their fingerprints are."""
    spark = docs.sparkSession

    t = text_or_empty(text)
    printed = written(
        docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(t).alias("row_hash"), fingerprint_udf(t).alias("fp")),
        "fingerprints",
    )
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row_hash").alias("h"))
    distinct = written(printed.groupBy("fp").agg(F.min(me).alias("first")), "distinct-fingerprints")
    edges = links(distinct.select(F.col("fp").alias("code")))
    if similar:
        edges = with_similar(docs, t, printed, edges)
    if edges.isEmpty():
        firsts = distinct
    else:
        comp = components(edges)
        linked = distinct.join(comp, distinct.fp == comp.node)
        least = linked.groupBy("root").agg(F.min("first").alias("least"))
        moved = linked.join(least, "root").select("fp", "least")
        firsts = written(distinct.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("first")), "firsts")
        forget(edges)
    return joined_to_unique(printed, firsts, "fp").select("doc_id", "row_hash", "fp", "first")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: bool = False) -> DataFrame:
    """The first document of each group, with the columns it came with.  Of rows
    with equal id and text, any one stays."""
    key = lambda no_id, i, h: F.struct(no_id.alias("no_id"), F.coalesce(i, F.lit(0)).cast("bigint").alias("id"), h.alias("h"))
    chosen = (
        grouped(docs, text, doc_id, similar)
        .select(key(F.col("first.no_id"), F.col("first.id"), F.col("first.h")).alias("__n_key"))
        .distinct()
    )
    own = key(F.col(doc_id).isNull(), F.col(doc_id).cast("bigint"), F.xxhash64(text_or_empty(text)))
    kept = docs.withColumn("__n_key", own).join(chosen, "__n_key", "left_semi")
    return kept.dropDuplicates(["__n_key"]).select(*docs.columns)


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grouped(docs).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"),
    )
