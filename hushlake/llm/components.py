"""Connected components of links: of few by one task, of many by grouped minima
and equi-joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Links that one task joins, 4 MB of them; more go by stars.  A round of stars is
#: a dozen shuffles, whose plans, threads and tasks cost the driver memory however
#: few the links are.
IN_ONE_TASK = 1 << 18


def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root): the least node of each node's component."""
    links = [frame[["a", "b"]].to_numpy() for frame in frames]
    nodes, ends = np.unique(np.concatenate(links) if links else np.empty((0, 2), np.int64), return_inverse=True)
    up = list(range(len(nodes)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in ends.reshape(-1, 2).tolist():
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": nodes, "root": nodes[np.array([root(i) for i in range(len(nodes))], np.int64)]})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``, a written table; a table too."""
    edges = edges.where("a <> b").select("a", "b")
    if edges.count() <= IN_ONE_TASK:
        return written(edges.coalesce(1).mapInPandas(joined, "node long, root long"), "joined")
    return by_stars(edges)


def by_stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``; alternating large and small
    stars, each round written.  All work is grouped minima and equi-joins."""

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, side) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return side(e.join(least, "a")).where("a <> b").distinct()

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        last = now
        large = star(both(now), lambda j: j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = star(
            down,
            lambda j: j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                j.select("a", F.col("m").alias("b"))
            ),
        )
        now = written(small, "stars")
        forget(last)
        sign = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(pmod(xxhash64(b, a), 1000000007))")).first()
        if sign == seen:
            break
        seen = sign
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
