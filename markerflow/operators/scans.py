"""Index generation and interval scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import c
from .idioms import islands, pinned, ranked


def halving_steps(base: int, levels: int = 4) -> list[int]:
    """base, base/2, ... down to 1, at most `levels` of them."""
    steps = [max(1, int(base))]
    while len(steps) < max(1, levels) and steps[-1] > 1:
        steps.append(max(1, steps[-1] // 2))
    return steps


def halved(base, levels: int = 4) -> Column:
    """halving_steps of a column of whole numbers, as an array."""
    step = lambda i: F.greatest(F.lit(1), F.floor(F.greatest(c(base), F.lit(1)) / F.pow(F.lit(2), i)).cast("int"))
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: (i == 0) | (step(i - 1) > 1)), step)


def iteration_count(total: int, start: int, step: int, most: int | None = None) -> int:
    if step <= 0 or total <= start:
        return 0
    n = -(-(total - start) // step)
    return n if most is None or most < 0 else min(most, n)


def roi_intervals(found: DataFrame, margin: int, lo: int, hi: int, by: list[str] = [], index: str = "idx", outside: bool = False) -> DataFrame:  # noqa: B006
    """Intervals of `margin` around the found indices, clipped, merged where they touch. Found indices whose whole interval lies outside
    the limits have none; with outside they stay as intervals that end before they begin."""
    margin = max(1, margin)
    spans = found.select(*by, F.greatest(F.col(index) - margin, F.lit(lo)).alias("lo"), F.least(F.col(index) + margin, F.lit(hi)).alias("hi")).distinct()
    return islands(spans if outside else spans.where("hi >= lo"), by)


def scan_indices(intervals: DataFrame, step: int, lo: int, hi: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Every step-th index of each interval, once."""
    a, b = F.greatest(F.col("lo"), F.lit(lo)), F.least(F.col("hi"), F.lit(hi))
    return intervals.where(b >= a).select(*by, F.explode(F.sequence(a, b, F.lit(max(1, step)).cast("long"))).alias("idx")).distinct()


def adaptive_scan(spark, total: int, start: int, step: int, budget: int, detect: Callable[[DataFrame], DataFrame], simple: bool = False) -> DataFrame:
    """Coarse to fine: each pass looks at the indices of its step around what was found before, skips what was seen and stops at the
    budget. Passes are few and fixed by the step; each is a DataFrame, and only its count comes to the driver."""
    lo, hi = max(0, start), total - 1
    intervals = spark.range(1).select(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))
    seen = found = None
    left = budget
    for s in [step] if simple else halving_steps(step):
        if left <= 0 or hi < lo:
            break
        todo = scan_indices(intervals, s, lo, hi)
        if seen is not None:
            todo = todo.join(seen, "idx", "left_anti")
        todo = pinned(todo.orderBy("idx").limit(left))
        left -= todo.count()
        hits = pinned(detect(todo))
        seen = todo if seen is None else seen.union(todo)
        found = hits if found is None else found.union(hits)
        if not found.isEmpty():
            intervals = roi_intervals(found, 2 * s, lo, hi)
    return found.orderBy("idx")


def chunks(df: DataFrame, order: str, size: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Number of the even chunk of each row, in the order of `order`."""
    return ranked(df, order, "_place", by).withColumn("chunk", F.floor(F.col("_place") / size)).drop("_place")


def grids(boards: DataFrame, cols: str, rows: str, square=1.0) -> DataFrame:
    """boards with the points (row, col, x, y) of their regular grids, row by row. A board has as many as its columns and rows say."""
    at = F.explode(F.sequence(F.lit(0), F.col(rows) * F.col(cols) - 1)).alias("_at")
    placed = boards.select("*", at).withColumns({"row": F.floor(F.col("_at") / F.col(cols)).cast("int"), "col": (F.col("_at") % F.col(cols)).cast("int")})
    side = square if isinstance(square, Column) else F.lit(float(square))
    return placed.withColumns({"x": F.col("col") * side, "y": F.col("row") * side}).drop("_at")


def point_grids_of(frames: DataFrame, side: str, layers: int, scale: int) -> DataFrame:
    """frames with the points (layer, x, y) at the centres of equal cells of the unit square, `side` cells each way, coarser by scale**layer."""
    n = F.greatest(F.floor(F.col(side) / F.pow(F.lit(scale), F.col("layer"))).cast("int"), F.lit(1))
    levels = frames.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers)))).withColumn("_n", n)
    return grids(levels, "_n", "_n").withColumns({"x": (F.col("col") + 0.5) / F.col("_n"), "y": (F.col("row") + 0.5) / F.col("_n")}).drop("row", "col", "_n")


def crops_of(frames: DataFrame, height: str, width: str, layers: int, overlap_share: float) -> DataFrame:
    """frames with the boxes (layer, x0, y0, x1, y1) of their crop pyramids: the frame, then 2**layer crops a side that overlap by a share of the frame's
    shorter side which halves with each layer, cut at the frame."""
    h, w = F.col(height), F.col(width)
    levels = frames.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers)))).withColumn("_n", F.pow(F.lit(2), F.col("layer")).cast("int"))
    overlap = F.when(F.col("layer") == 0, 0).otherwise(F.floor(F.least(h, w) * F.lit(overlap_share) * 2 / F.col("_n")).cast("int"))
    size = lambda extent: F.ceil((F.col("_o") * (F.col("_n") - 1) + extent) / F.col("_n")).cast("int")
    sized = levels.withColumn("_o", overlap).withColumns({"_cw": size(w), "_ch": size(h)})
    each = grids(sized, "_n", "_n")
    x0, y0 = F.col("col") * (F.col("_cw") - F.col("_o")), F.col("row") * (F.col("_ch") - F.col("_o"))
    boxes = each.withColumns({"x0": x0, "y0": y0, "x1": F.least(x0 + F.col("_cw"), w), "y1": F.least(y0 + F.col("_ch"), h)})
    return boxes.drop("row", "col", "x", "y", "_n", "_o", "_cw", "_ch")


def scan_budget(found: DataFrame, order: str, most: int) -> DataFrame:
    """The first `most` rows; all when most is negative. Each task hands on that many at most."""
    return found if most < 0 else found.orderBy(order).limit(most)
