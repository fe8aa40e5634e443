"""Masks: run lengths, components, distance peak, hull, track rows. Pixels of one mask stay together in one Python call."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_even, quality_score, restore, valid_flag


# Pixels of a mask that are counted as the bits of one number.
WORD = 32


def encode_rle(pixels: DataFrame, by: list[str], height: int, width: int) -> DataFrame:
    """Column-major run lengths that begin with background, from the foreground pixels (x, y) of each mask.

    Pixels meet as bits of words, so that what is sorted and sent is a row a word and no row a pixel; a run's ends follow from its words."""
    pos = (F.col("x") * height + F.col("y")).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_pos") % WORD)
    words = pixels.select(*by, pos.alias("_pos")).groupBy(*by, F.floor(F.col("_pos") / WORD).cast("int").alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    lowest = lambda n: F.bit_count(n.bitwiseAND(-n) - 1)

    def ends(word):
        """First pixels and ends of the word's runs, in turn."""
        bits, at = word["_bits"], word["_word"] * WORD
        first, last = bits.bitwiseAND(F.bitwise_not(F.shiftleft(bits, 1))), bits.bitwiseAND(F.bitwise_not(F.shiftright(bits, 1)))
        step = lambda s, _: F.struct(s["a"].bitwiseAND(s["a"] - 1).alias("a"), s["b"].bitwiseAND(s["b"] - 1).alias("b"), F.concat(s["out"], F.array((at + lowest(s["a"])).cast("int"), (at + lowest(s["b"]) + 1).cast("int"))).alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.bit_count(first).cast("int")), F.struct(first.alias("a"), last.alias("b"), F.array().cast("array<int>").alias("out")), step)["out"]

    masks = words.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_word", "_bits"))).alias("_words")).select(*by, F.flatten(F.transform("_words", ends)).alias("_ends"))
    # where a run goes on in the next word, its end there and its first pixel here are the same
    before, after = (lambda i: F.coalesce(F.get(F.col("_ends"), i - 1), F.lit(-1))), (lambda i: F.coalesce(F.get(F.col("_ends"), i + 1), F.lit(-1)))
    edges = masks.select(*by, F.filter("_ends", lambda e, i: (before(i) != e) & (after(i) != e)).alias("_edges"))
    gaps = F.transform("_edges", lambda e, i: e - F.coalesce(F.get(F.col("_edges"), i - 1), F.lit(0)))
    last = F.element_at("_edges", -1)
    return edges.select(*by, F.array(F.lit(height), F.lit(width)).alias("size"), F.concat(gaps, F.when(last < height * width, F.array(F.lit(height * width) - last)).otherwise(F.array().cast("array<int>"))).alias("counts"))


def rle_mask(counts, size) -> np.ndarray:
    on = np.repeat(np.arange(len(counts)) % 2 == 1, counts)
    return on.reshape(int(size[1]), int(size[0])).T


def mask_rle(mask: np.ndarray) -> list[int]:
    flat = np.concatenate([[False], mask.T.ravel(), [False]])
    edges = np.flatnonzero(flat[1:] != flat[:-1])
    runs = np.diff(np.concatenate([[0], edges, [mask.size]])).tolist()
    return runs if runs[-1] else runs[:-1]


def label(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Numbers of connected components (1 up in row-major order of their first pixel), 0 for background.

    Runs of pixels are the nodes: runs of neighbouring rows that touch are tied, and the least run's number spreads over the ties."""
    h, w = mask.shape
    wide = np.zeros((h, w + 1), np.int8)
    wide[:, :w] = mask
    edges = np.diff(wide.ravel(), prepend=np.int8(0))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)  # in rows of w + 1, so that no run goes over a row's end
    out = np.zeros((h, w), dtype=np.int32)
    if not len(start):
        return out
    reach = 1 if diagonal else 0
    # runs of the row below that begin before this one's end and end after its start
    first = np.searchsorted(end, start + (w + 1) - reach, side="right")
    last = np.searchsorted(start, end + (w + 1) + reach, side="left")
    many = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(start)), many)
    b = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    same = start[a] // (w + 1) + 1 == start[b] // (w + 1)
    a, b = a[same], b[same]
    root = np.arange(len(start))
    while True:
        before = root
        root = root.copy()
        np.minimum.at(root, before[b], before[a])
        np.minimum.at(root, before[a], before[b])
        np.minimum.at(root, b, before[a])
        np.minimum.at(root, a, before[b])
        root = root[root]
        if (root == before).all():
            break
    number = np.unique(root, return_inverse=True)[1] + 1
    out[mask] = np.repeat(number, end - start)
    return out


def largest_component(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """The component with most pixels, the first of equals."""
    if not mask.any():
        return mask
    parts = label(mask, diagonal)
    return parts == np.bincount(parts.ravel())[1:].argmax() + 1


def remove_small(mask: np.ndarray, least: int, holes: bool) -> np.ndarray:
    """Without islands (or holes) of fewer than `least` pixels, 8-connected; when every island is small, the largest stays."""
    parts = label(~mask if holes else mask, True)
    sizes = np.bincount(parts.ravel())
    sizes[0] = 0
    small = np.flatnonzero((sizes > 0) & (sizes < least))
    if not len(small):
        return mask
    if holes:
        return mask | np.isin(parts, small)
    keep = np.setdiff1d(np.flatnonzero(sizes > 0), small)
    return np.isin(parts, keep if len(keep) else [sizes.argmax()])


def fill_scores(scores: np.ndarray, most: int, fill: float = 0.1, sprinkle: int = 0, threshold: float = 0.0, drop: float = -10.0) -> np.ndarray:
    """Holes of at most `most` pixels in the area above the threshold get threshold + fill; with sprinkle, islands of at most that many
    pixels get threshold + drop. Both are judged on the scores as they come."""
    out = scores.astype(float)
    for on, limit, step in ((scores <= threshold, most, fill), (scores > threshold, sprinkle, drop)):
        if limit > 0:
            parts = label(on, True)
            sizes = np.bincount(parts.ravel())
            out = np.where((parts > 0) & (sizes[parts] <= limit), threshold + step, out)
    return out


# Step lengths of the 5 x 5 chamfer metric.
CHAMFER = ((0, 1, 1.0), (1, 1, 1.4), (1, 2, 2.1969))


def distance(mask: np.ndarray) -> np.ndarray:
    """Chamfer distance of each foreground pixel to the background; what lies outside the frame is no background."""
    h, w = mask.shape
    if mask.all():
        return np.where(mask, np.inf, 0.0)
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    out = np.zeros((h, w))
    if not len(rows):
        return out
    box = slice(max(0, rows[0] - 2), rows[-1] + 3), slice(max(0, cols[0] - 2), cols[-1] + 3)  # nothing nearer lies beyond
    moves = {(sy * y, sx * x): d for a, b, d in CHAMFER for y, x in ((a, b), (b, a)) for sy in (1, -1) for sx in (1, -1)}
    part = np.where(mask[box], np.inf, 0.0)
    n, m = part.shape
    while True:
        wide = np.pad(part, 2, constant_values=np.inf)
        new = part
        for (dy, dx), d in moves.items():
            new = np.minimum(new, wide[2 + dy : 2 + dy + n, 2 + dx : 2 + dx + m] + d)
        if (new == part).all():
            out[box] = part
            return out
        part = new


def peak(mask: np.ndarray):
    """(u, v, radius) of the first largest distance, row by row; nothing for an empty mask."""
    if not mask.any():
        return None, None, 0.0
    d = distance(mask)
    v, u = np.unravel_index(int(d.argmax()), d.shape)
    return float(u), float(v), float(d[v, u])


def hull_area(x: np.ndarray, y: np.ndarray) -> float:
    """Area of the convex hull of pixel centres."""
    points = sorted(set(zip(x.tolist(), y.tolist())))
    if len(points) < 3:
        return 0.0

    def chain(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(chain(points) + chain(points[::-1]), float)
    return float(abs(np.dot(ring[:, 0], np.roll(ring[:, 1], -1)) - np.dot(ring[:, 1], np.roll(ring[:, 0], -1))) / 2)


def solidity(mask: np.ndarray) -> float:
    """Pixels over hull area, which can exceed 1; masks without a hull count as solid."""
    y, x = np.nonzero(mask)
    if not len(x):
        return 0.0
    hull = hull_area(x, y) if len(x) > 2 else 0.0
    return len(x) / max(hull, 1) if hull else 1.0


def eroded(mask: np.ndarray) -> np.ndarray:
    """Pixels whose four neighbours inside the frame are foreground too."""
    p = np.pad(mask, 1, constant_values=True)
    return mask & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]


def centroid(mask: np.ndarray):
    y, x = np.nonzero(mask)
    return (float(x.mean()), float(y.mean())) if len(x) else None


def thinned(mask: np.ndarray) -> np.ndarray:
    """One pixel wide skeleton by Zhang and Suen's thinning (1984)."""
    skeleton = mask.copy()
    while True:
        before = skeleton.copy()
        for turn in (0, 1):
            p = np.pad(skeleton, 1)
            n, e, s, w = p[:-2, 1:-1], p[1:-1, 2:], p[2:, 1:-1], p[1:-1, :-2]
            ring = [n, p[:-2, 2:], e, p[2:, 2:], s, p[2:, :-2], w, p[:-2, :-2]]
            count = sum(r.astype(np.int8) for r in ring)
            changes = sum((~a & b).astype(np.int8) for a, b in zip(ring, ring[1:] + ring[:1]))
            ends = ~(n & e & s) & ~(e & s & w) if turn == 0 else ~(n & e & w) & ~(n & s & w)
            skeleton = skeleton & ~((count >= 2) & (count <= 6) & (changes == 1) & ends)
        if (skeleton == before).all():
            return skeleton


def junctions(skeleton: np.ndarray) -> np.ndarray:
    """Skeleton pixels with three neighbours or more."""
    p = np.pad(skeleton, 1).astype(np.int8)
    h, w = skeleton.shape
    around = sum(p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) - p[1:-1, 1:-1]
    return skeleton & (around >= 3)


def junction_point(mask: np.ndarray, least: int = 1):
    """(u, v, distance) of the junction farthest from the background, the first of equals; nothing with fewer than `least` junctions."""
    found = junctions(thinned(mask))
    if found.sum() < max(1, least):
        return None, None, 0.0
    d = np.where(found, distance(mask), -1.0)
    v, u = np.unravel_index(int(d.argmax()), d.shape)
    return float(u), float(v), float(d[v, u])


def point_of(mask: np.ndarray, skeleton: bool = False, least: int = 1, radius_min: float = 2.0) -> tuple:
    """(method, u, v, radius): a junction that is far enough from the background, where asked for, else the distance peak, else the
    centroid of the eroded mask, else the plain one."""
    u, v, radius = peak(mask)
    if skeleton:
        a, b, far = junction_point(mask, least)
        if a is not None and far >= radius_min:
            return "skeleton_junction", a, b, far
    if u is not None:
        return "dt_peak", u, v, radius
    for method, at in (("fallback_eroded_centroid", centroid(eroded(mask))), ("fallback_centroid", centroid(mask))):
        if at is not None:
            return method, *at, radius
    return "no_fallback", None, None, 0.0


def measure(mask: np.ndarray, diagonal: bool, **point) -> tuple:
    """(method, u, v, area, radius, solidity, box height, box width) of a mask's largest component."""
    nothing = (None, None, 0, 0.0, 0.0, 0, 0)
    if not mask.any():
        return "invalid", *nothing
    main = largest_component(mask, diagonal)
    if not main.any():
        return "invalid_after_cleanup", *nothing
    method, u, v, radius = point_of(main, **point)
    if u is None:
        return method, *nothing
    y, x = np.nonzero(main)
    return method, u, v, int(main.sum()), radius, solidity(main), int(np.ptp(y)) + 1, int(np.ptp(x)) + 1


def track_rows(masks: DataFrame, scale: float = 1.0, diagonal: bool = True, offset=("crop_x", "crop_y"), original: bool = True, **point) -> DataFrame:
    """2D track rows of run-length masks (frame, obj_id, size, counts, crop offsets): measures in numpy batches, the rest as Columns.

    Two presets exist. Live tracking (the default) joins pixels over corners and gives area (rounded half to even) and radius in original
    pixels, by which quality is judged; the mask tool (diagonal=False, original=False) joins over sides and judges the mask's own
    pixels. point: options of point_of."""
    keys = [n for n in masks.columns if n not in ("size", "counts")]
    schema = ", ".join(f"`{n}` {t}" for n, t in masks.select(*keys).dtypes) + ", method string, pu double, pv double, area int, radius double, solidity double, bh int, bw int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [measure(rle_mask(c, s), diagonal, **point) for c, s in zip(pdf["counts"], pdf["size"])]
            out = pd.DataFrame(found, columns=["method", "pu", "pv", "area", "radius", "solidity", "bh", "bw"])
            yield pd.concat([pdf[keys].reset_index(drop=True), out.astype({"pu": float, "pv": float})], axis=1)

    up = 1.0 / scale if original else 1.0
    rows = masks.mapInPandas(run, schema).withColumns({"area_px": half_even(F.col("area") * (up * up)).cast("int"), "core_radius_px": F.col("radius") * up})
    rows = rows.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in ("pu", "pv")})
    quality = F.when(F.col("area") > 0, quality_score("area_px", "core_radius_px", "solidity", "bh", "bw")).otherwise(0.0)
    rows = rows.withColumns({"quality": quality, "u_local": F.col("pu") / scale, "v_local": F.col("pv") / scale, "u": restore("pu", scale, F.col(offset[0])), "v": restore("pv", scale, F.col(offset[1]))})
    return rows.withColumn("valid", valid_flag("quality", "area_px")).select("frame", "obj_id", "u", "v", "u_local", "v_local", "method", "area_px", "core_radius_px", "solidity", "quality", "valid")


def cleaned(masks: DataFrame, least: int, holes: bool) -> DataFrame:
    """Run-length masks (size, counts and any other columns) without islands, or without holes, of fewer than `least` pixels; _changed
    tells whether there were any."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            before = [rle_mask(c, s) for c, s in zip(pdf["counts"], pdf["size"])]
            after = [remove_small(m, least, holes) for m in before]
            yield pdf.assign(counts=[mask_rle(m) for m in after], changed=[bool((a != b).any()) for a, b in zip(before, after)])

    return masks.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in masks.dtypes) + ", changed boolean")


def filled(scores: DataFrame, column: str, size: tuple[int, int], **limits) -> DataFrame:
    """Score maps (an array of rows end to end) after fill_scores."""

    @F.pandas_udf("array<double>")
    def run(maps: pd.Series) -> pd.Series:
        return pd.Series([fill_scores(np.asarray(m, float).reshape(size), **limits).ravel().tolist() for m in maps], dtype=object)

    return scores.withColumn(column, run(F.col(column).cast("array<double>")))


def thresholded(pixels: DataFrame, value: str = "value", least: int = 127) -> DataFrame:
    """Foreground pixels of a mask image: those brighter than `least`."""
    return pixels.where(F.col(value) > least).drop(value)


def split_labels(pixels: DataFrame, key: str = "label") -> DataFrame:
    """Pixels of each object of a label mask; 0 is background."""
    return pixels.where(F.col(key) > 0).withColumnRenamed(key, "obj_id")


def consolidate(pixels: DataFrame, scores: DataFrame, by: list[str], key: str, score: str, threshold: float = 0.0, exclusive_pixels: bool = True, fill: float = -1024.0) -> DataFrame:
    """Foreground (by, key) of every pixel and object: scores that an object lacks count as `fill`, overlaps go to the best if asked for,
    and what is above the threshold stays. pixels has a row (by, key) for each pixel and object of the frames."""
    whole = pixels.join(scores, [*by, key], "left").withColumn(score, F.coalesce(score, F.lit(fill)))
    return (exclusive(whole, by, key, score) if exclusive_pixels else whole).where(F.col(score) > threshold).select(*by, key)


def uncropped(masks: DataFrame, height: int, width: int, crop=("crop_x0", "crop_y0")) -> DataFrame:
    """Run-length masks of crops (their corner in the columns of crop) as masks of the frame: every column of the crop keeps its runs, and
    what is around it is background."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for counts, size, x0, y0 in zip(pdf["counts"], pdf["size"], pdf[crop[0]], pdf[crop[1]]):
                own = rle_mask(counts, size)
                whole = np.zeros((height, width), bool)
                whole[y0 : y0 + own.shape[0], x0 : x0 + own.shape[1]] = own
                out.append(mask_rle(whole))
            yield pdf.assign(counts=out, size=[[height, width]] * len(pdf))

    return masks.mapInPandas(run, masks.schema)


def shape_stats(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Area, centroid and box of each mask's pixels."""
    return pixels.groupBy(*by).agg(F.count("*").alias("area"), F.avg("x").alias("u"), F.avg("y").alias("v"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def exclusive(scores: DataFrame, by: list[str], key: str, score: str, other: float = -10.0) -> DataFrame:
    """Per pixel only the object with the largest score (the first of equals) keeps it; others are held to `other` at most."""
    w = Window.partitionBy(*by)
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(key)).alias("k"))).over(w)
    return scores.withColumn(score, F.when(-best["k"] == F.col(key), F.col(score)).otherwise(F.least(F.col(score), F.lit(other))))


def painted(pixels: DataFrame, by: list[str], key: str) -> DataFrame:
    """The palette mask: of objects on one pixel the lowest id shows."""
    return pixels.groupBy(*by).agg(F.min(key).alias(key))


def first_seed(areas: DataFrame, by: str, frame: str, area: str) -> DataFrame:
    """First frame with a mask of each object."""
    return areas.where(F.col(area) > 0).groupBy(by).agg(F.min(frame).alias("seed_frame"))
