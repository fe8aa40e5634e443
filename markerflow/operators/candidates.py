"""Prompt candidates: shape filters, clustering, suppression, feature similarity and grid assignment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, compactness, percentile, shape_score
from ..functions.text import dot
from .idioms import pinned

# Limits of a component's shape and weights of its score.
ASPECT_MAX, EXTENT_MIN, COMPACT_MIN, SOLID_MIN, SCORE_WEIGHT, SHAPE_WEIGHT = 4.5, 0.16, 0.08, 0.22, 0.82, 0.18


def component_candidates(parts: DataFrame, min_area: float, max_area: float, min_score: float, scale: float = 1.0) -> DataFrame:
    """Components (area, w, h, perimeter, hull, score) that look like markers, with full-frame area and mixed score."""
    compact, solid = compactness("area", "perimeter"), F.col("area") / F.greatest("hull", F.lit(1.0))
    full = F.col("area") / max(scale * scale, 1e-9)
    aspect = F.greatest(F.col("w") / F.greatest("h", F.lit(1.0)), F.col("h") / F.greatest("w", F.lit(1.0)))
    shaped = parts.withColumns({"compactness": compact, "solidity": solid, "area_full": full, "aspect": aspect, "extent": F.col("area") / F.greatest(F.col("w") * F.col("h"), F.lit(1.0))})
    kept = shaped.where((F.col("area") > 0) & F.col("area_full").between(min_area, max_area) & (F.col("aspect") <= ASPECT_MAX) & (F.col("extent") >= EXTENT_MIN) & (F.col("compactness") >= COMPACT_MIN) & (F.col("solidity") >= SOLID_MIN))
    return kept.withColumn("mixed", clip(SCORE_WEIGHT * F.col("score") + SHAPE_WEIGHT * shape_score("compactness", "solidity"), 0.0, 1.0)).where(F.col("mixed") >= min_score)


def stretch_u8(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Contrast stretched between the 1st and 99th percentile to 0..255."""
    limits = df.groupBy(*by).agg(percentile(value, 0.01).alias("_lo"), percentile(value, 0.99).alias("_hi"))
    t = F.when(F.col("_hi") <= F.col("_lo"), 0.0).otherwise(clip((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), 0.0, 1.0))
    return df.join(limits, by).withColumn("u8", F.floor(t * 255).cast("int")).drop("_lo", "_hi")


def cluster(cands: DataFrame, by: list[str], distance: float) -> DataFrame:
    """Adds the cluster of each candidate: by descending score, then area (then y, x), it joins the first cluster whose weighted centre
    is within the distance. The centre moves with each member, so a frame of a side (the keys of `by`) is taken as a whole; its centres
    lie in cells as wide as the distance, and a candidate looks at those of the nine cells around it."""
    schema = ", ".join(f"`{n}` {t}" for n, t in cands.dtypes) + ", cluster int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "area", "y", "x"], ascending=[False, False, True, True], kind="stable")
        sums: list[list[float]] = []
        cells: dict[tuple[int, int], set[int]] = {}
        cell = lambda x, y: (math.floor(x / distance), math.floor(y / distance)) if distance > 0 else (x, y)
        spread = (-1, 0, 1) if distance > 0 else (0,)
        out = []
        for x, y, s in zip(pdf.x, pdf.y, pdf.score):
            w = max(s, 0.05)
            cx, cy = cell(x, y)
            near = sorted(i for dx in spread for dy in spread for i in cells.get((cx + dx, cy + dy), ()))
            i = next((i for i in near if math.hypot(x - sums[i][0] / sums[i][2], y - sums[i][1] / sums[i][2]) <= distance), len(sums))
            if i == len(sums):
                sums.append([0.0, 0.0, 0.0])
            else:
                cells[cell(sums[i][0] / sums[i][2], sums[i][1] / sums[i][2])].discard(i)
            sums[i] = [sums[i][0] + x * w, sums[i][1] + y * w, sums[i][2] + w]
            cells.setdefault(cell(sums[i][0] / sums[i][2], sums[i][1] / sums[i][2]), set()).add(i)
            out.append(i)
        return pdf.assign(cluster=np.array(out, dtype=np.int32))

    return cands.groupBy(*by).applyInPandas(run, schema)


def merge_clusters(cands: DataFrame, by: list[str]) -> DataFrame:
    """One candidate per cluster: weighted centre (of local_x and local_y too, if the candidates have them), largest area, bbox of the
    best member (of equals the first by area, y, x), methods joined, noisy-or confidence with a bonus for several methods."""
    w = F.greatest("score", F.lit(0.05))
    miss = F.product(1 - clip("score", 0.0, 0.96))
    methods = F.array_sort(F.collect_set("method"))
    confidence = F.least(F.lit(1.0), 1 - miss + F.when(F.size(methods) > 1, 0.08).otherwise(0.0))
    centre = [(F.sum(F.col(n) * w) / F.sum(w)).alias(n) for n in ("x", "y", "local_x", "local_y") if n in cands.columns]
    best = [F.max_by("bbox", F.struct("score", "area", -F.col("y"), -F.col("x"))).alias("bbox")] if "bbox" in cands.columns else []
    return cands.groupBy(*by, "cluster").agg(*centre, F.max("area").alias("area"), *best, F.concat_ws("+", methods).alias("method"), F.greatest(confidence, F.lit(0.0)).alias("score"), F.count("*").alias("members"))


def strongest(cands: DataFrame, by: list[str], most: int) -> DataFrame:
    """The best by score, then y, then x, in order of y and x; all when most is not positive."""
    if most <= 0:
        return cands.orderBy(*by, "y", "x")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "y", "x"))
    return cands.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank").orderBy(*by, "y", "x")


def merge_candidates(cands: DataFrame, by: list[str], distance: float, most: int = 0) -> DataFrame:
    """Candidates of all methods, merged per frame of a side (by): clusters, then the strongest of them."""
    return strongest(merge_clusters(cluster(cands, by, distance), by), by, most)


# The detection routes and the methods that each runs.
ROUTES = {"color": ("hsv", "lab"), "hsv": ("hsv",), "lab": ("lab",), "gray": ("gray",), "blob": ("blob",), "all": ("hsv", "lab", "gray", "blob")}


def routed(cands: DataFrame, route: str) -> DataFrame:
    """Candidates of the methods that a route runs."""
    return cands.where(F.col("method").isin(*ROUTES[route]))


def method_counts(cands: DataFrame, by: list[str] = [], route: str | None = None) -> DataFrame:  # noqa: B006
    """Candidates by method, before they are merged; with a route, those of its methods, 0 where one found nothing."""
    if route is None:
        return cands.groupBy(*by, "method").agg(F.count("*").alias("n"))
    counted = cands.groupBy(*by).agg(*[F.count_if(F.col("method") == m).alias(m) for m in ROUTES[route]])
    return counted.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("n")) for m in ROUTES[route]])).alias("_c")).select(*by, "_c.*")


def suppress(cands: DataFrame, by: list[str], distance: float, limit: int = 0) -> DataFrame:
    """Greedy spatial suppression by descending score: nothing nearer than the distance to one that is kept; stops at the limit. What
    is kept lies in cells as wide as the distance, so a candidate is compared with those of the nine cells around it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "y", "x"], ascending=[False, True, True], kind="stable")
        kept: list[int] = []
        cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
        for i, (x, y) in enumerate(zip(pdf.x.tolist(), pdf.y.tolist())):
            cx, cy = (math.floor(x / distance), math.floor(y / distance)) if distance > 0 else (0, 0)
            near = (p for dx in (-1, 0, 1) for dy in (-1, 0, 1) for p in cells.get((cx + dx, cy + dy), ()))
            if distance <= 0 or all(math.hypot(x - u, y - v) >= distance for u, v in near):
                kept.append(i)
                cells.setdefault((cx, cy), []).append((x, y))
                if 0 < limit <= len(kept):
                    break
        return pdf.iloc[kept]

    return cands.groupBy(*by).applyInPandas(run, cands.schema)


def box_nms(boxes: DataFrame, by: list[str], iou: float, score: str = "score") -> DataFrame:
    """Keeps boxes (x0, y0, x1, y1) by descending score, of equals in order of the corners, whose overlap with every kept one is at most iou."""
    corners = ["x0", "y0", "x1", "y1"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, *corners], ascending=[False, True, True, True, True], kind="stable")
        b = pdf[corners].to_numpy(float)
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        left, kept = np.arange(len(b)), []
        while len(left):
            i, left = left[0], left[1:]
            kept.append(i)
            wide = np.minimum(b[i, 2:], b[left, 2:]) - np.maximum(b[i, :2], b[left, :2])
            both = np.clip(wide, 0, None).prod(axis=1)
            left = left[both <= iou * (area[i] + area[left] - both)]
        return pdf.iloc[kept]

    return boxes.groupBy(*by).applyInPandas(run, boxes.schema)


def crop_nms(boxes: DataFrame, by: list[str], crop: list[str], iou: float, across: float, score: str = "score") -> DataFrame:
    """Boxes of a crop pyramid in crop coordinates, in the frame's afterwards: NMS by score within each crop, then over the crops of a
    frame by 1 / area of the crop, which prefers small crops. crop names the crop's corners; a frame with one crop has no second pass."""
    inside = box_nms(boxes, [*by, *crop], iou, score)
    moved = inside.withColumns({n: F.col(n) + F.col(crop[k % 2]) for k, n in enumerate(("x0", "y0", "x1", "y1"))})
    size = (F.col(crop[2]) - F.col(crop[0])) * (F.col(crop[3]) - F.col(crop[1]))
    several = inside.groupBy(*by).agg((F.count_distinct(F.struct(*crop)) > 1).alias("_several"))
    rows = moved.withColumn("_rank", 1 / size.cast("double")).join(several, by)
    return box_nms(rows.where("_several"), by, across, "_rank").unionByName(rows.where("NOT _several")).drop("_rank", "_several")


def prototype(vectors: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean vector per group, scaled to unit length (floor 1e-9)."""
    flat = vectors.select(*by, F.posexplode(vector).alias("dim", "v")).groupBy(*by, "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    whole = flat.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))
    length = F.greatest(F.sqrt(dot("mean", "mean")), F.lit(1e-9))
    return whole.withColumn("_n", length).select(*by, F.transform("mean", lambda x: x / F.col("_n")).alias("prototype"))


def similarity(vectors: DataFrame, vector: str, positive: DataFrame, negative: DataFrame | None = None, weight: float = 0.5) -> DataFrame:
    """Dot product with the positive prototype minus weight times that with the negative one, rescaled between the 2nd and 99th
    percentile. The prototypes are one row each."""
    out = vectors.crossJoin(F.broadcast(positive.select(F.col("prototype").alias("_p"))))
    raw = dot(vector, "_p")
    if negative is not None:
        out = out.crossJoin(F.broadcast(negative.select(F.col("prototype").alias("_q"))))
        raw = raw - weight * dot(vector, "_q")
    out = out.withColumn("raw", raw).drop("_p", "_q")
    limits = out.agg(percentile("raw", 0.02).alias("_lo"), percentile("raw", 0.99).alias("_hi"))
    scaled = F.when(F.col("_hi") <= F.col("_lo"), 0.0).otherwise(clip((F.col("raw") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), 0.0, 1.0))
    return out.crossJoin(F.broadcast(limits)).withColumn("similarity", scaled).drop("_lo", "_hi")


def grid_peaks(cells: DataFrame, by: list[str], reach: int) -> DataFrame:
    """Cells (gx, gy, score) whose 8-bit score is the largest within reach; plateaus stay. Maxima spread along x, then along y, so the
    work is 2 (2 reach + 1) rows a cell; cells that do not exist take no part."""
    u8 = cells.withColumn("u8", F.floor(F.col("score") * 255).cast("int"))
    around = u8.select(*by, "gx", "gy", F.col("u8").alias("_m"))
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for axis in ("gx", "gy"):
        spread = F.explode(F.sequence(F.col(axis) - reach, F.col(axis) + reach)).alias(axis)
        across = "gy" if axis == "gx" else "gx"
        # lines along the axis lie together in a task, so that a cell's rows are summed up where they are made
        lines = around.repartition(n, *by, across)
        around = lines.select(*by, *[spread if k == axis else F.col(k) for k in ("gx", "gy")], "_m").groupBy(*by, "gx", "gy").agg(F.max("_m").alias("_m"))
    return u8.join(around, [*by, "gx", "gy"]).where(F.col("u8") == F.col("_m")).drop("_m")


def assign_grid(cands: DataFrame, by: list[str], cols: int, rows: int, reach: float = 0.48) -> DataFrame:
    """Grid slots in row order, each with the nearest unused candidate (grid_x, grid_y, score) within reach, or none."""
    schema = ", ".join(f"{n} {t}" for n, t in cands.select(*by).dtypes) + ", row int, col int, grid_x double, grid_y double, score double, detected boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near = pdf[(pdf.grid_x >= -0.55) & (pdf.grid_x <= cols - 0.45) & (pdf.grid_y >= -0.55) & (pdf.grid_y <= rows - 0.45)]
        x, y, s = (near[n].to_numpy(float) for n in ("grid_x", "grid_y", "score"))
        free = np.ones(len(near), dtype=bool)
        out = []
        for r in range(rows):
            for c in range(cols):
                d = np.where(free, np.hypot(x - c, y - r), np.inf)
                best = np.lexsort((-s, d))[0] if len(d) else -1
                if best >= 0 and d[best] <= reach:
                    free[best] = False
                    out.append((r, c, x[best], y[best], s[best], True))
                else:
                    out.append((r, c, float(c), float(r), 0.0, False))
        slots = pd.DataFrame(out, columns=["row", "col", "grid_x", "grid_y", "score", "detected"])
        return slots.assign(**{n: pdf[n].iloc[0] for n in by})[[*by, "row", "col", "grid_x", "grid_y", "score", "detected"]]

    return cands.groupBy(*by).applyInPandas(run, schema)


def adaptive_threshold(values: DataFrame, value: str, share: float, least: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Detector threshold of each frame: a percentile of its pixels, held from below."""
    return values.groupBy(*by).agg(F.greatest(percentile(value, share), F.lit(float(least))).alias("threshold"))


def nearest_patch(points: DataFrame, cols: int, rows: int, patch: int, x="x", y="y", crop=("crop_w", "crop_h"), size=("input_w", "input_h")) -> DataFrame:
    """Adds patch_x and patch_y: the patch of the feature grid (cols x rows) over which a point of the crop lies, held inside the grid."""
    place = lambda v, extent, target, n: F.floor(clip(F.col(v) / F.greatest(F.col(extent), F.lit(1)) * F.col(target) / patch, 0.0, float(n - 1))).cast("int")
    return points.withColumns({"patch_x": place(x, crop[0], size[0], cols), "patch_y": place(y, crop[1], size[1], rows)})


def sample_features(points: DataFrame, features: DataFrame, by: list[str], cols: int, rows: int, patch: int, **names) -> DataFrame:
    """Points with the feature (patch_x, patch_y, feature; keys by) of the patch below them."""
    return nearest_patch(points, cols, rows, patch, **names).join(features, [*by, "patch_x", "patch_y"])


def escalate(counts: dict[str, int], order: list[str], expected: int) -> str:
    """The first method with enough merged candidates, else the last."""
    enough = max(4, round(0.75 * expected))
    return next((m for m in order if counts.get(m, 0) >= enough), order[-1])


def escalated(cands: DataFrame, by: list[str], routes: list[str], expected: int, distance: float, most: int = 0) -> DataFrame:
    """Per frame the merged candidates of the first route that finds enough, else of the last: every route is merged as a plan of its
    own, and of its count per frame only whether it is enough decides."""
    enough = max(4, round(0.75 * expected))
    out, left = None, None
    for k, route in enumerate(routes):
        found = routed(cands, route)
        merged = pinned(merge_candidates(found if left is None else found.join(left, by, "left_semi"), by, distance, most))
        if k < len(routes) - 1:
            full = merged.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= enough).select(*by)
            frames = (cands if left is None else cands.join(left, by, "left_semi")).select(*by).distinct()
            left = pinned(frames.join(full, by, "left_anti"))
            merged = merged.join(full, by, "left_semi")
        merged = merged.withColumn("route", F.lit(route))
        out = merged if out is None else out.unionByName(merged)
    return out
