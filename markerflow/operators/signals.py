"""Signals of a side: smoothing, local maxima, event picking, greedy peaks.

The samples of a side are numbered without gaps. Where a sample looks at its neighbours, a side is cut into blocks of BLOCK samples
and each block gets copies of the neighbours beyond its ends, so that a long signal is many tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import first_argmax
from .idioms import beside

BLOCK = 1 << 16


def _blocks(signal: DataFrame, by, order: str, before: int, after: int, block: int) -> tuple[DataFrame, Window]:
    """Rows with copies (_own is false) in the blocks that look at them, and the window along a block."""
    at = F.col(order)
    near = F.sequence(F.floor((at - after) / block), F.floor((at + before) / block))
    rows = signal.withColumn("_block", F.explode(near)).withColumn("_own", F.col("_block") == F.floor(at / block))
    return rows, Window.partitionBy(*by, "_block").orderBy(order)


def _own(rows: DataFrame) -> DataFrame:
    return rows.where("_own").drop("_own", "_block")


def _rise(signal: DataFrame, by, order: str, value: str, block: int) -> DataFrame:
    """Adds _rise, the difference to the sample before; null at the first."""
    rows, w = _blocks(signal, by, order, 1, 0, block)
    return _own(rows.withColumn("_rise", F.col(value) - F.lag(value).over(w)))


def moving_average(signal: DataFrame, width: int, by=("side",), order="idx", value="value", block: int = BLOCK) -> DataFrame:
    """Centred mean that counts missing neighbours as 0 and always divides by the width."""
    before, after = width // 2, (width + 1) // 2 - 1
    rows, w = _blocks(signal, by, order, before, after, block)
    return _own(rows.withColumn("smooth", F.sum(value).over(w.rowsBetween(-before, after)) / width))


def local_maxima(signal: DataFrame, by=("side",), order="idx", value="smooth", block: int = BLOCK) -> DataFrame:
    """Inner samples above the one before and not below the one after; a side without any gives all its samples."""
    rows, w = _blocks(signal, by, order, 1, 1, block)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    marked = _own(rows.withColumn("_peak", F.coalesce((F.col(value) > before) & (F.col(value) >= after), F.lit(False))))
    some = marked.groupBy(*by).agg(F.max("_peak").alias("_any"))
    return beside(marked, some, list(by)).where(F.col("_peak") | ~F.col("_any")).drop("_peak", "_any")


def greedy_peaks(peaks: DataFrame, most: int, separation: int, by=("side",), order="idx", value="smooth") -> DataFrame:
    """The highest peaks at least `separation` apart, in order of time; of equals the later one comes first.

    A peak that is kept rules out 2 (separation - 1) others, so the first `most` are among the most (2 separation - 1) highest, and no
    more of a side reach its task."""
    fields = ", ".join(f"{n} {t}" for n, t in peaks.dtypes)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(order).desc()))
    highest = peaks.withColumn("_rank", rank).where(F.col("_rank") <= most * max(1, 2 * separation - 1)).drop("_rank")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([value, order], ascending=False)
        at = pdf[order].tolist()
        kept: list[int] = []
        for i, t in enumerate(at):
            if len(kept) < most and all(abs(t - at[j]) >= separation for j in kept):
                kept.append(i)
        return pdf.iloc[sorted(kept, key=at.__getitem__)]

    return highest.groupBy(*by).applyInPandas(pick, fields)


def flash_frame(signal: DataFrame, threshold: float = 5.0, by=("side",), order="idx", value="value", block: int = BLOCK) -> DataFrame:
    """Frame of the steepest rise, if it is at least the threshold and there are five samples, else of the highest level; of equals
    the first."""
    rows = _rise(signal, by, order, value, block)
    picked = rows.groupBy(*by).agg(F.count("*").alias("n"), first_argmax("_rise", order).alias("r"), first_argmax(value, order).alias("l"))
    steep = (F.col("n") >= 5) & (F.col("r.value") >= threshold)
    return picked.select(*by, F.when(steep, -F.col("r.turned")).otherwise(-F.col("l.turned")).alias("event"), F.when(steep, "flash-rise").otherwise("flash-peak").alias("reason"))


def hybrid_event(signal: DataFrame, by=("side",), order="idx", value="value", motion="motion", block: int = BLOCK) -> DataFrame:
    """Frame with the largest sum of normalised rise and normalised motion."""
    rows = _rise(signal, by, order, value, block).withColumn("_rise", F.coalesce("_rise", F.lit(0.0)))
    spread = rows.groupBy(*by).agg(F.stddev_pop("_rise").alias("_sr"), F.stddev_pop(motion).alias("_sm"))
    score = F.col("_rise") / (F.col("_sr") + 1e-6) + F.col(motion) / (F.col("_sm") + 1e-6)
    return beside(rows, spread, list(by)).withColumn("_score", score).groupBy(*by).agg(first_argmax("_score", order).alias("m")).select(*by, (-F.col("m.turned")).alias("event"))


def motion_curve(pixels: DataFrame, by=("side",), frame="frame", pixel="pixel", value="value", block: int = BLOCK) -> DataFrame:
    """Mean level and mean absolute change of every frame from its per-pixel values. A pixel's frames may have gaps, so it is cut into blocks
    of frames, and each block's first change is from the last value of the block before that has one (a row a pixel and block)."""
    keys = [*by, pixel]
    rows = pixels.withColumn("_block", F.floor(F.col(frame) / block))
    w = Window.partitionBy(*keys, "_block").orderBy(frame)
    ends = rows.groupBy(*keys, "_block").agg(F.max(F.struct(F.col(frame), F.col(value).alias("_v"))).getField("_v").alias("_end"))
    before = ends.select(*keys, "_block", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_block")).alias("_before"))
    earlier = F.when(F.row_number().over(w) == 1, F.col("_before")).otherwise(F.lag(value).over(w))
    changed = beside(rows, before, [*keys, "_block"]).withColumn("_change", F.abs(F.col(value) - earlier))
    return changed.groupBy(*by, frame).agg(F.avg(value).alias("brightness"), F.coalesce(F.avg("_change"), F.lit(0.0)).alias("motion"))
