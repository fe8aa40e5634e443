"""Queries of the detectors and the operators on tiles, over frames of pixels drawn from `lineitem`."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import corners, detectors, tiles
from . import adapters as fx
from .adapters import PIXELS_SQL
from .queries import query, r6

_HSV_SQL = f"""(SELECT frame, x, y, CASE WHEN h < 0 THEN h + 180 ELSE h END AS h, s, v, luma FROM (SELECT frame, x, y, v, luma,
    CAST(floor((d * CASE WHEN v = 0 THEN 0 ELSE CAST(round_even(1044480.0 / v, 0) AS BIGINT) END + 2048) / 4096.0) AS BIGINT) AS s,
    CAST(floor((CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END * CASE WHEN d = 0 THEN 0 ELSE CAST(round_even(122880.0 / d, 0) AS BIGINT) END + 2048) / 4096.0) AS BIGINT) AS h
  FROM (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d, (b * 3735 + g * 19235 + r * 9798 + 16384) // 32768 AS luma FROM {PIXELS_SQL})))"""


@query(f"SELECT frame, x, y, h, s, v, luma FROM {_HSV_SQL}")
def m11_colours(spark, d):
    h, s, v = detectors.hsv(F.col("b"), F.col("g"), F.col("r"))
    return fx.pixels(spark, d).select("frame", "x", "y", h.alias("h"), s.alias("s"), v.alias("v"), detectors.gray(F.col("b"), F.col("g"), F.col("r")).alias("luma"))


_SQUARE = "sum({}) OVER (PARTITION BY frame, {} ORDER BY {} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)"


@query(f"""WITH a AS (SELECT frame, x, y, luma, {_SQUARE.format("luma", "y", "x")} AS s, {_SQUARE.format("1", "y", "x")} AS n FROM {_HSV_SQL}),
  b AS (SELECT frame, x, y, luma, {_SQUARE.format("s", "x", "y")} AS s, {_SQUARE.format("n", "x", "y")} AS n FROM a) SELECT frame, x, y, round(abs(luma - s / n), 6) AS contrast FROM b""")
def m11_local_contrast(spark, d):
    p = m11_colours(spark, d).select("frame", "x", "y", "luma")
    return tiles.local_mean(p, ["frame"], "luma", 4).select("frame", "x", "y", r6(F.abs(F.col("luma") - F.col("mean")), "contrast"))


_CROSS = "(VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) k(dx, dy)"
_STEP = f"SELECT p.frame, p.x, p.y, {{}}(q.m) AS m FROM {{}} p CROSS JOIN {_CROSS} JOIN {{}} q ON q.frame = p.frame AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY ALL"
_CLEAN_SQL = f"""(WITH m0 AS MATERIALIZED (SELECT frame, x, y, CASE WHEN h BETWEEN 14 AND 92 AND s >= 90 THEN 1 ELSE 0 END AS m FROM {_HSV_SQL}),
  m1 AS MATERIALIZED (SELECT p.frame, p.x, p.y, CASE WHEN sum(q.m) >= 5 THEN 1 ELSE 0 END AS m FROM m0 p CROSS JOIN range(-1, 2) a(dx) CROSS JOIN range(-1, 2) b(dy)
         JOIN m0 q ON q.frame = p.frame AND q.x = least(greatest(p.x + dx, 0), 63) AND q.y = least(greatest(p.y + dy, 0), 47) GROUP BY ALL),
  m2 AS MATERIALIZED ({_STEP.format("min", "m1", "m1")}), m3 AS MATERIALIZED ({_STEP.format("max", "m2", "m2")}), m4 AS MATERIALIZED ({_STEP.format("max", "m3", "m3")}), m5 AS ({_STEP.format("min", "m4", "m4")})
  SELECT * FROM m5)"""


@query(f"SELECT frame, x, y, CAST(m AS INT) AS m FROM {_CLEAN_SQL}")
def m11_cleaned_mask(spark, d):
    return tiles.unpack(_cleaned(spark, d), ["frame"], ["m"]).select("frame", "x", "y", F.col("m").cast("int").alias("m"))


def _cleaned(spark, d):
    p = m11_colours(spark, d)
    mask = p.select("frame", "x", "y", (F.col("h").between(14, 92) & (F.col("s") >= 90)).cast("int").alias("m"))
    return tiles.nearing(tiles.packing(mask, ["frame"], ["m"], 32), ["frame"], 1, tiles.CLEAN_REACH, tiles.cleaned, 32)


# the least pixel of a component reaches all of it over pixels that come after it
_LABELS = """(WITH RECURSIVE m AS MATERIALIZED ({}), r AS (SELECT {k}, x, y, CAST(y AS BIGINT) * 4294967296 + x AS l FROM m UNION
  SELECT {q}, m.x, m.y, r.l FROM r JOIN m ON {j} AND m.x BETWEEN r.x - 1 AND r.x + 1 AND m.y BETWEEN r.y - 1 AND r.y + 1 AND r.l < CAST(m.y AS BIGINT) * 4294967296 + m.x) SELECT {k}, x, y, min(l) AS label FROM r GROUP BY ALL)"""
_STATS = "CAST(count(*) AS BIGINT) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy"


@query(f"SELECT frame, label, {_STATS} FROM {_LABELS.format(f'SELECT frame, x, y FROM {_CLEAN_SQL} WHERE m = 1', k='frame', q='m.frame', j='m.frame = r.frame')} GROUP BY frame, label")
def m11_components(spark, d):
    """Components of the cleaned mask over tiles of 32 pixels."""
    stats = tiles.part_stats(tiles.parts(_cleaned(spark, d), ["frame"], ["m"], 32), ["frame"])
    return stats.select("frame", "label", "area", "x", "y", "w", "h", r6("cx"), r6("cy"))


_LEVELS = [190, 205, 220]


@query(f"""SELECT frame, threshold, label, {_STATS} FROM {_LABELS.format(f'SELECT frame, threshold, x, y FROM {_HSV_SQL} CROSS JOIN (SELECT unnest({_LEVELS}) AS threshold) WHERE luma > threshold', k='frame, threshold', q='m.frame, m.threshold', j='m.frame = r.frame AND m.threshold = r.threshold')} GROUP BY frame, threshold, label""")
def m11_threshold_components(spark, d):
    """The nodes of the component tree over thresholds."""
    luma = m11_colours(spark, d).select("frame", "x", "y", F.col("luma").alias("value"))
    stats = tiles.part_stats(detectors.threshold_parts(tiles.packing(luma, ["frame"], ["value"], 32), ["frame"], _LEVELS, 32), ["frame", "threshold"])
    return stats.select("frame", "threshold", "label", "area", "x", "y", "w", "h", r6("cx"), r6("cy"))


@query()
def m11_candidates(spark, d):
    """Candidates of all four detectors, merged over methods as the escalation takes them; tests hold the detectors against whole-image brute force."""
    from ..operators import candidates as cand

    found = detectors.detect(fx.pixels(spark, d), ["frame"], ("hsv", "lab", "gray", "blob"), fx.FRAME, 3.0, 400.0, 0.2, 4.0, size=32)
    return cand.merge_candidates(found, ["frame"], 4.0).select("frame", r6("x"), r6("y"), r6("area"), "method", r6("score"), "members")


_BOARD = (4, 3)


def _drawn_boards(spark, d):
    """For each supplier a frame of 64 x 48 with a turned board of 4 x 3 inner corners, each pixel the mean of 16 points; and the board's place."""
    key = F.col("s_suppkey")
    s = fx.table(spark, d, "supplier").select(key.alias("image"), ((key % 11 - 5) * 0.1 + 0.04).alias("angle"), (31.2 + key % 5).alias("cx"), (23.6 - key % 3).alias("cy"), (8.0 + key % 2 * 0.5).alias("step"))
    s = s.withColumns({"c": F.cos("angle"), "n": F.sin("angle")})

    def draw(frames):
        y, x, sy, sx = np.mgrid[0:48, 0:64, 0:4, 0:4]
        for pdf in frames:
            for image, cx, cy, step, c, n in pdf.itertuples(index=False):
                px, py = x + (sx + 0.5) / 4 - 0.5 - cx, y + (sy + 0.5) / 4 - 0.5 - cy
                u, v = (c * px + n * py) / step + (_BOARD[0] - 1) / 2, (c * py - n * px) / step + (_BOARD[1] - 1) / 2
                field = np.where((np.floor(u) + np.floor(v)) % 2 == 0, 30.0, 220.0)
                value = np.where((u >= -1) & (u <= _BOARD[0]) & (v >= -1) & (v <= _BOARD[1]), field, 128.0).mean(axis=(2, 3))
                yield pd.DataFrame({"image": np.full(value.size, image), "x": x[..., 0, 0].ravel(), "y": y[..., 0, 0].ravel(), "value": value.ravel()})

    # a frame is 3,072 times its supplier's row: the number of tasks is given, as rows so small would be one task otherwise
    dealt = s.select("image", "cx", "cy", "step", "c", "n").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image")
    return s, dealt.mapInPandas(draw, "image long, x int, y int, value double")


@query("SELECT s_suppkey AS image, CAST(pos AS INT) AS pos, true AS close FROM supplier, range(12) t(pos)")
def g13_board_corners(spark, d):
    """Corners found in drawn frames, each within a tenth of a pixel of where it was drawn."""
    s, frames = _drawn_boards(spark, d)
    found = corners.find_boards(frames, ["image"], *_BOARD, size=32)
    i, j = F.col("pos") % _BOARD[0] - (_BOARD[0] - 1) / 2, F.floor(F.col("pos") / _BOARD[0]) - (_BOARD[1] - 1) / 2
    x, y = F.col("cx") + F.col("step") * (F.col("c") * i - F.col("n") * j), F.col("cy") + F.col("step") * (F.col("n") * i + F.col("c") * j)
    return found.join(s, "image").select("image", "pos", ((F.abs(F.col("x") - x) < 0.1) & (F.abs(F.col("y") - y) < 0.1)).alias("close"))
