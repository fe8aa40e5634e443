"""Connected components by alternating large and small stars, staged round by round.

Defined cases: edges of a node with itself tie nothing and are left out; repeated edges count once, in either direction; without edges there
are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merged, stage, sweeping, unstage

#: Nodes that a task holds at once (about 200 bytes each); what it holds goes on as stars when there are more.
HELD = 1 << 19


def _united(held: int):
    """The edges of a task as stars: each node with the smallest that the task's edges tie it to. What tasks hand on connects as much as
    what they were given; a task that holds `held` nodes hands on their stars and begins anew."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}
        for pdf in frames:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
                x, y = _root(parent, a), _root(parent, b)
                parent.setdefault(x, x)
                parent[max(x, y)] = min(x, y)
                if len(parent) >= held:
                    yield _stars(parent)
                    parent.clear()
        yield _stars(parent)

    return run


def _root(parent: dict[int, int], x: int) -> int:
    top = x
    while (up := parent.get(top, top)) != top:
        top = up
    while x != top:
        parent[x], x = top, parent[x]
    return top


def _stars(parent: dict[int, int]) -> pd.DataFrame:
    ends = [(x, r) for x in parent if (r := _root(parent, x)) != x]
    return pd.DataFrame(ends, columns=["a", "b"], dtype="int64")


def _solved(edges: DataFrame) -> bool:
    """Whether the edges are stars that share no node: a node is the greater end of one edge, or the smaller end of any number."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("low")), F.struct(F.col("b").alias("node"), F.lit(0).alias("low")))).alias("e")).select("e.*")
    twice = ends.groupBy("node").agg(F.sum("low").alias("n"), F.min("low").alias("least")).where("n > 1 OR (n = 1 AND least = 0)")
    with sweeping(edges.sparkSession):
        return twice.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, held: int = HELD) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); root is the smallest node of its component.

    Each task first makes stars of its own edges, which are all there are in a small graph. Each round is then two joins against one row per node; a node
    with very many edges is summed before the exchange and split by the skew join. The rounds end when the edges are stars that share
    no node; their number grows with the logarithm of the longest path.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = stage(edges.mapInPandas(_united(held), "a long, b long"), "edges")
    while not _solved(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node go to its smallest neighbour
        large = both.join(merged(least), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its neighbours below it go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(merged(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        last, edges = edges, stage(small, "edges")
        unstage(last)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
