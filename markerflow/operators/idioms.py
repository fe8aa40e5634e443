"""Reusable shapes: the row that wins per key, ranks and running sums range by range, gaps and islands, neighbours within a distance."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], position: Column | str) -> DataFrame:
    """One row per key, the one with the largest position. One aggregate, summed before the exchange."""
    return _one(df, keys, position, F.max_by)


def first_wins(df: DataFrame, keys: list[str], position: Column | str) -> DataFrame:
    return _one(df, keys, position, F.min_by)


def _one(df: DataFrame, keys: list[str], position, by) -> DataFrame:
    rest = [n for n in df.columns if n not in keys]
    return df.groupBy(*keys).agg(by(F.struct(*rest), position).alias("_row")).select(*keys, "_row.*")


def pinned(df: DataFrame) -> DataFrame:
    """df computed once, where several branches of a plan or several actions read it: a reliable checkpoint in the folder that the
    cluster shares (spark.checkpoint.dir). Where it is unset a local master, which has no other machine, gets a temporary one; elsewhere that is an
    error, as every executor would write to a disk of its own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='markerflow-')}")
    return df.checkpoint()


def in_ranges(df: DataFrame, order: str) -> DataFrame:
    """Adds _range, the number of the range of `order` (a number or a time) that a row falls in. There are as many ranges as shuffle
    partitions, cut at quantiles, so that what is ordered as a whole needs no task that holds it as a whole. Nulls are in the first."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = sorted(set(df.agg(F.percentile_approx(order, shares, F.lit(10 * n)).alias("c")).first().c or [])) if n > 1 else []  # n values at most
    if not cuts:
        return df.withColumn("_range", F.lit(0))
    return df.withColumn("_range", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))))


def beside(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of few, one row of which has their keys; null keys meet null keys."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    if not names:
        return rows.crossJoin(F.broadcast(few))  # one row
    same = F.lit(True)
    for k, n in names.items():
        same = same & rows[k].eqNullSafe(F.col(n))
    return rows.join(few.withColumnsRenamed(names), same).drop(*names.values())


def running(df: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Adds the running sum of value in the order of `order`, within each key of `by`: summed in each range, to which the sums of the
    ranges before are added (one row a key and range)."""
    rows = in_ranges(df, order).withColumn("_value", value)
    per = rows.groupBy(*by, "_range").agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per.select(*by, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.sum("_value").over(Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return beside(rows, offsets, [*by, "_range"]).withColumn(name, F.col("_before") + own).drop("_range", "_value", "_before")


def ranked(df: DataFrame, order: str, name: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds the place of each row, 0 up, in the order of `order` within each key of `by`."""
    return running(df, by, order, F.lit(1), name).withColumn(name, F.col(name) - 1)


def dense_index(df: DataFrame, key: str, position: str) -> DataFrame:
    """(key, index): 0 up in order of first appearance. One row per key is ranked."""
    first = df.groupBy(key).agg(F.min(position).alias("_first"))
    return ranked(first, "_first", "index").select(key, F.col("index").cast("int").alias("index"))


def islands(spans: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi", gap: int = 1) -> DataFrame:
    """Union of spans: those that overlap or lie at most `gap` apart are one. Spans are taken range by range; how far those of the
    ranges before reach, and how many islands begin there, is one row a key and range."""
    rows = in_ranges(spans, lo)
    ranges = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*by, "_range").agg(F.max(hi).alias("_top"))
    rows = beside(rows, tops.select(*by, "_range", F.max("_top").over(ranges).alias("_before")), [*by, "_range"])
    within = Window.partitionBy(*by, "_range").orderBy(lo, hi)
    reach = F.greatest(F.max(hi).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    marked = rows.withColumn("_reach", reach).withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(lo) > F.col("_reach") + gap), 1).otherwise(0))
    begun = marked.groupBy(*by, "_range").agg(F.sum("_new").alias("_begun"))
    offsets = begun.select(*by, "_range", F.coalesce(F.sum("_begun").over(ranges), F.lit(0)).alias("_offset"))
    number = F.col("_offset") + F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return beside(marked, offsets, [*by, "_range"]).withColumn("_island", number).groupBy(*by, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def neighbours(points: DataFrame, by: list[str], key: str, x: str, y: str, radius: float, others: DataFrame | None = None) -> DataFrame:
    """(by, a, b, dist) for pairs a < b within radius: both sides fall in cells of that size, one side looks into the cells around,
    and the join is an equi join. For points at most a constant to a cell the pairs grow with the points. With others (same
    columns), pairs of a point and another key's of those, in both orders. The join is merged: both sides are points, and the file they
    come from says little about their size, so that a broadcast, which the driver builds, would hold all of them."""
    side = lambda d, k, u, v: d.select(*by, F.col(key).alias(k), F.col(x).alias(u), F.col(y).alias(v), F.floor(F.col(x) / radius).alias("cx"), F.floor(F.col(y) / radius).alias("cy"))
    cells = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = side(points if others is None else others, "b", "qx", "qy").select(*by, "b", "qx", "qy", cells.alias("at")).select("*", "at.cx", "at.cy").drop("at")
    pairs = side(points, "a", "px", "py").join(around.hint("merge"), [*by, "cx", "cy"]).where("a < b" if others is None else "a <> b")
    dist = F.sqrt((F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")) + (F.col("py") - F.col("qy")) * (F.col("py") - F.col("qy")))
    return pairs.withColumn("dist", dist).where(F.col("dist") <= radius).select(*by, "a", "b", "px", "py", "qx", "qy", "dist")


def closest(queries: DataFrame, rows: DataFrame, query_key: str, key: str, window: int) -> DataFrame:
    """For each query, the row whose key is nearest within the window; of equals, the lower key. Keys fall in buckets as wide as the
    window, so that the join is an equi join on at most three buckets."""
    width = 2 * window + 1
    q = queries.withColumn("_bucket", F.explode(F.array_distinct(F.array(F.floor((F.col(query_key) - window) / width), F.floor((F.col(query_key) + window) / width)))))
    r = rows.withColumn("_bucket", F.floor(F.col(key) / width))
    delta = F.abs(F.col(key) - F.col(query_key))
    near = q.join(r, "_bucket").where(delta <= window)
    return near.groupBy(query_key).agg(F.min(F.struct(delta.alias("delta"), F.col(key))).alias("_m")).select(query_key, f"_m.{key}", "_m.delta")

