"""Marker detectors over frames of colour pixels: two by colour, one by local contrast, one by blobs that last over thresholds.

Frames are pixels (by, x, y, b, g, r), 0 to 255. Colours and thresholds are column expressions; equalisation, blur and mask clean-up run on tiles;
components are found over tiles, and what has to see a component's outline gets one component's pixels. Nothing takes a frame as a whole but
percentiles of its pixels, and the blobs' merge, which takes the few components of a frame that have a blob's shape.

Differences from a whole-image library: colour distances are worked out in doubles, where that library's 8-bit tables may differ by one; holes of a
component are no blobs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, percentile, shape_score
from . import tiles
from .candidates import ASPECT_MAX, COMPACT_MIN, EXTENT_MIN, SCORE_WEIGHT, SHAPE_WEIGHT, SOLID_MIN
from .idioms import pinned

# Fixed values. Hue ranges (0 to 180) of paint: yellow to green, blue, and the two ends of red.
HUES = ((14, 92), (95, 135), (0, 8), (165, 180))
# Least thresholds and percentiles of each detector.
SATURATION, VALUE = (55.0, 0.91), (45.0, 0.38)
CHROMA, DISTANCE, LIGHT = (12.0, 0.90), (8.0, 0.93), (20.0, 0.25)
CONTRAST, CONTRAST_TOP = (18.0, 0.993), 0.999
# Equalisation: fields each way and how far a count may exceed the mean; blobs: thresholds, repeats, roundness.
FIELDS, CLIP_LIMIT = 8, 2.0
BLOB_FROM, BLOB_TO, BLOB_STEP, BLOB_REPEATS, BLOB_CONVEX, BLOB_INERTIA = 20, 245, 10, 2, 0.2, 0.08
BLUR_LEAST, BLUR_SHARE = 31, 18


# --- colours ------------------------------------------------------------------------------------------------------------------------


def gray(b: Column, g: Column, r: Column) -> Column:
    """Luma in whole numbers with weights of 15 bits."""
    return F.shiftright(b.cast("long") * 3735 + g.cast("long") * 19235 + r.cast("long") * 9798 + (1 << 14), 15)


def hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Hue (0 to 180), saturation and value (0 to 255) in whole numbers with reciprocals of 12 bits."""
    b, g, r = (x.cast("long") for x in (b, g, r))
    v = F.greatest(b, g, r)
    diff = v - F.least(b, g, r)
    per = lambda top, n: F.when(n == 0, 0).otherwise(F.rint(F.lit(float(top << 12)) / n)).cast("long")
    s = F.shiftright(diff * per(255, v) + (1 << 11), 12)
    h = F.when(v == r, g - b).when(v == g, b - r + 2 * diff).otherwise(r - g + 4 * diff)
    h = F.shiftright(h * per(30, diff) + (1 << 11), 12)
    return F.when(h < 0, h + 180).otherwise(h), s, v


def lab(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Lightness and the two colour axes on 0 to 255, rounded."""
    linear = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    b, g, r = (linear(c / F.lit(255.0)) for c in (b, g, r))
    x = (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456
    y = 0.212671 * r + 0.715160 * g + 0.072169 * b
    z = (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116)
    light = F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)
    return tuple(F.rint(clip(c, 0.0, 255.0)) for c in (light * 255 / 100, 500 * (f(x) - f(y)) + 128, 200 * (f(y) - f(z)) + 128))


# --- shapes -------------------------------------------------------------------------------------------------------------------------


_RING = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))  # clockwise from the left
# by a pixel's neighbours (a bit each) and where the border came from: the next neighbour, counterclockwise
_NEXT = bytes(next(((came - k) % 8 for k in range(1, 9) if code >> (came - k) % 8 & 1), 0) for code in range(256) for came in range(8))


def _neighbours(wide: np.ndarray) -> np.ndarray:
    """Which of a pixel's neighbours are set, a bit each; the mask's border is not set."""
    out = np.zeros(wide.shape, np.uint8)
    h, w = wide.shape
    for i, (dy, dx) in enumerate(_RING):
        out[1:-1, 1:-1] |= (wide[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] != 0).astype(np.uint8) << i
    return out


def _followed(codes: bytes, stride: int, start: int) -> list[int]:
    """The outer border's places, one after the other, from the first pixel of a component."""
    if not codes[start]:
        return [start]
    off = [dy * stride + dx for dy, dx in _RING]
    came = next(i for i in range(8) if codes[start] >> i & 1)
    last, at, out = start + off[came], start, []
    while True:
        out.append(at)
        step = _NEXT[codes[at] * 8 + came]
        after = at + off[step]
        if after == start and at == last:
            return out
        at, came = after, step ^ 4


def outline(mask: np.ndarray) -> np.ndarray:
    """Pixels (x, y) of the outer border of a component, one after the other, by border following from its first pixel."""
    wide = np.pad(mask, 1)
    ring = np.array(_followed(_neighbours(wide).tobytes(), wide.shape[1], int(np.flatnonzero(wide)[0])))
    return np.stack([ring % wide.shape[1] - 1, ring // wide.shape[1] - 1], axis=1)


def ring_moments(ring: np.ndarray) -> tuple[float, float, float, float, float, float]:
    """(area, sum of x, of y, of xx, of xy, of yy) of a polygon, the area not negative."""
    x, y = ring[:, 0].astype(float), ring[:, 1].astype(float)
    u, v = np.roll(x, -1), np.roll(y, -1)
    c = x * v - u * y
    m = np.array([c.sum() / 2, (c * (x + u)).sum() / 6, (c * (y + v)).sum() / 6, (c * (x * x + x * u + u * u)).sum() / 12, (c * (2 * x * y + x * v + u * y + 2 * u * v)).sum() / 24, (c * (y * y + y * v + v * v)).sum() / 12])
    return tuple(-m if m[0] < 0 else m)


_SHAPE = "ring_area double, perimeter double, hull double, mx double, my double, inertia double, radius double, score80 double"


def _hull(left: list[int], right: list[int]) -> float:
    """Area of the convex hull of pixel centres, from the first and last of each row."""

    def twice(xs: list[int]) -> int:
        """Twice the area between the lower hull of xs over the rows and 0."""
        out: list[tuple[int, int]] = []
        for y, x in enumerate(xs):
            while len(out) > 1 and (out[-1][1] - out[-2][1]) * (y - out[-1][0]) >= (x - out[-1][1]) * (out[-1][0] - out[-2][0]):
                out.pop()
            out.append((y, x))
        return sum((b[0] - a[0]) * (a[1] + b[1]) for a, b in itertools.pairwise(out))

    return (-twice([-x for x in right]) - twice(left)) / 2


def _shaped(masks: list[np.ndarray]) -> dict[str, np.ndarray]:
    """What shapes tells of each mask of a component, but for the scores. Masks are laid one below the other, in a stack as wide as the widest."""
    high, width = np.array([m.shape[0] for m in masks]), max(m.shape[1] for m in masks)
    stride, top = width + 2, np.cumsum(high + 1) - high
    stack = np.zeros((int(top[-1] + high[-1] + 1), stride), np.uint8)
    for m, t in zip(masks, top):
        stack[t : t + m.shape[0], 1 : 1 + m.shape[1]] = m
    codes = _neighbours(stack).tobytes()
    left, right = stack.argmax(axis=1), stride - 1 - stack[:, ::-1].argmax(axis=1)
    rings = [_followed(codes, stride, int(t * stride + left[t])) for t in top]
    hull = np.array([_hull(left[t : t + h].tolist(), right[t : t + h].tolist()) for t, h in zip(top, high)])
    n = np.array([len(r) for r in rings])
    start = np.cumsum(n) - n
    which = np.repeat(np.arange(len(masks)), n)
    places = np.fromiter(itertools.chain.from_iterable(rings), np.int64, int(n.sum()))
    x, y = (places % stride - 1).astype(float), (places // stride - top[which]).astype(float)
    after = np.arange(len(places)) + 1
    after[start + n - 1] = start
    u, v = x[after], y[after]
    c = x * v - u * y
    total = lambda t: np.add.reduceat(t, start)
    moments = np.stack([total(c) / 2, total(c * (x + u)) / 6, total(c * (y + v)) / 6, total(c * (x * x + x * u + u * u)) / 12, total(c * (2 * x * y + x * v + u * y + 2 * u * v)) / 24, total(c * (y * y + y * v + v * v)) / 12])
    area, sx, sy, sxx, sxy, syy = np.where(moments[0] < 0, -moments, moments)
    some = area > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        cx, cy = np.where(some, sx / area, total(x) / n), np.where(some, sy / area, total(y) / n)
        p, q, r = sxx - sx * cx, sxy - sx * cy, syy - sy * cy
        spread = np.hypot(2 * q, p - r)
        inertia = np.where(some & (spread > 1e-2 * area), (p + r - spread) / (p + r + spread), 1.0)
    far = np.hypot(x - cx[which], y - cy[which])
    far = far[np.lexsort([far, which])]
    radius = (far[start + (n - 1) // 2] + far[start + n // 2]) / 2
    length = total(np.hypot(u - x, v - y))
    return {"ring_area": area, "perimeter": np.maximum(length, 1.0), "hull": np.maximum(hull, 1.0), "mx": cx, "my": cy, "inertia": inertia, "radius": radius}


def shapes(parts: DataFrame, by: list[str], score: str | None = None) -> DataFrame:
    """(by, label, ring_area, perimeter, hull, mx, my, inertia, radius, score80) of the parts of components: what a component's outline encloses, its length
    and hull (1 at least each), its centre, roundness (least by largest second moment), median distance of the outline from the centre, and the 80th
    percentile of the score."""
    types = dict(parts.dtypes)
    keys = [*by, "label"]
    columns = [*keys, *[c.split(" ")[0] for c in _SHAPE.split(", ")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Components are taken some at a time, those of a width together, as a stack of masks is as wide as its widest."""
        for pdf, starts in tiles.whole(frames, keys):
            low = {n: np.minimum.reduceat(pdf[n].to_numpy(), starts) for n in "xy"}
            high = {n: np.maximum.reduceat((pdf[n] + pdf[d]).to_numpy(), starts) for n, d in zip("xy", "wh")}
            ends = np.append(starts[1:], len(pdf))
            width = np.ceil(np.log2(high["x"] - low["x"])).astype(int)
            order = np.argsort(width, kind="stable")
            rows = list(zip(*(pdf[n].to_numpy() for n in ("x", "y", "w", "h", "bits"))))
            cuts = np.flatnonzero((np.diff(width[order]) != 0) | (np.arange(1, len(order)) % 1024 == 0)) + 1
            for some in np.split(order, cuts):
                masks = []
                for i in some:
                    x0, y0 = low["x"][i], low["y"][i]
                    mask = np.zeros((high["y"][i] - y0, high["x"][i] - x0), np.uint8)
                    for x, y, w, h, bits in rows[starts[i] : ends[i]]:
                        mask[y - y0 : y - y0 + h, x - x0 : x - x0 + w] |= tiles.mask_of(bits, w, h)
                    masks.append(mask)
                out = _shaped(masks)
                out["mx"], out["my"] = out["mx"] + low["x"][some], out["my"] + low["y"][some]
                scores = [np.percentile(np.frombuffer(b"".join(pdf[score].iloc[starts[i] : ends[i]]), np.float32).astype(float), 80) for i in some] if score else np.zeros(len(some))
                yield pd.DataFrame({**{k: pdf[k].to_numpy()[starts[some]] for k in keys}, **out, "score80": scores})[columns]

    # a component's parts lie together in a task, some components are held at a time
    dealt = tiles.together(parts.select(*keys, "x", "y", "w", "h", "bits", *([score] if score else [])), keys)
    return dealt.mapInPandas(run, ", ".join(f"`{n}` {types[n]}" for n in keys) + ", " + _SHAPE)


def candidates_of(parts: DataFrame, by: list[str], method: str, least: float, most: float, score: float, scale: float = 1.0, crop: tuple[float, float] = (0, 0)) -> DataFrame:
    """Candidates (by, x, y, area, method, score, local_x, local_y, bbox) among the components of parts with a score."""
    stats = tiles.part_stats(parts, by)
    full = F.col("area") / max(scale * scale, 1e-9)
    aspect = F.greatest(F.col("w") / F.greatest("h", F.lit(1)), F.col("h") / F.greatest("w", F.lit(1)))
    extent = F.col("area") / F.greatest(F.col("w") * F.col("h"), F.lit(1))
    able = stats.where(full.between(least, most) & (aspect <= ASPECT_MAX) & (extent >= EXTENT_MIN))
    shaped = shapes(parts.join(able.select(*by, "label"), [*by, "label"], "left_semi"), by, "score").drop("mx", "my")
    area = F.greatest("ring_area", F.lit(1.0))
    compact, solid = 4 * np.pi * area / (F.col("perimeter") * F.col("perimeter")), area / F.col("hull")
    mixed = clip(SCORE_WEIGHT * F.col("score80") + SHAPE_WEIGHT * shape_score("compact", "solid"), 0.0, 1.0)
    good = able.join(shaped, [*by, "label"]).withColumns({"compact": compact, "solid": solid}).where((F.col("compact") >= COMPACT_MIN) & (F.col("solid") >= SOLID_MIN)).withColumn("score", mixed).where(F.col("score") >= score)
    lx, ly = F.col("cx") / scale, F.col("cy") / scale
    box = F.struct((crop[0] + F.col("x") / scale).alias("x"), (crop[1] + F.col("y") / scale).alias("y"), (F.col("w") / scale).alias("w"), (F.col("h") / scale).alias("h"))
    return good.select(*by, (lx + crop[0]).alias("x"), (ly + crop[1]).alias("y"), full.alias("area"), F.lit(method).alias("method"), "score", lx.alias("local_x"), ly.alias("local_y"), box.alias("bbox"))


# --- detectors ----------------------------------------------------------------------------------------------------------------------


def _limits(pixels: DataFrame, by: list[str], **shares) -> DataFrame:
    """pixels with a column for each (value, share, least): the percentile of the frame's values, held from below."""
    at = pixels.groupBy(*by).agg(*[F.greatest(percentile(value, share), F.lit(float(least))).alias(name) for name, (value, share, least) in shares.items()])
    return pixels.join(at, by) if by else pixels.crossJoin(F.broadcast(at))  # one row


def components(pixels: DataFrame, by: list[str], mask: Column, score: Column, size: int = tiles.SIZE) -> DataFrame:
    """Parts of the components, with their score, of a mask that was cleaned."""
    packed = tiles.packing(pixels.select(*by, "x", "y", mask.cast("double").alias("mask"), score.alias("score")), by, ["mask", "score"], size)
    clean = tiles.nearing(packed, by, 2, tiles.CLEAN_REACH, lambda a: np.concatenate([tiles.cleaned(a[:1]), a[1:]]), size)
    return pinned(tiles.parts(clean, by, ["mask", "score"], size))


def detect_hsv(pixels: DataFrame, by: list[str], least: float, most: float, score: float, scale: float = 1.0, crop=(0, 0), size: int = tiles.SIZE) -> DataFrame:
    """Saturated paint against a dull background."""
    h, s, v = hsv(F.col("b"), F.col("g"), F.col("r"))
    rows = _limits(pixels.select(*by, "x", "y", h.alias("h"), s.alias("s"), v.alias("v")), by, s_least=("s", SATURATION[1], SATURATION[0]), v_least=("v", VALUE[1], VALUE[0]))
    hue = F.lit(False)
    for lo, hi in HUES:
        hue = hue | F.col("h").between(lo, hi)
    over = lambda n: clip((F.col(n) - F.col(f"{n}_least")) / F.greatest(255.0 - F.col(f"{n}_least"), F.lit(1.0)), 0.0, 1.0)
    mask = hue & (F.col("s") >= F.col("s_least")) & (F.col("v") >= F.col("v_least"))
    return candidates_of(components(rows, by, mask, F.greatest(over("s"), over("v") * 0.35), size), by, "hsv", least, most, score, scale, crop)


def detect_lab(pixels: DataFrame, by: list[str], least: float, most: float, score: float, scale: float = 1.0, crop=(0, 0), size: int = tiles.SIZE) -> DataFrame:
    """Colour far from the frame's median colour."""
    light, a, b = lab(F.col("b"), F.col("g"), F.col("r"))
    rows = pixels.select(*by, "x", "y", light.alias("l"), a.alias("a"), b.alias("c"))
    rows = _limits(rows, by, a_mid=("a", 0.5, 0.0), c_mid=("c", 0.5, 0.0))
    far = lambda p, q: F.sqrt((F.col("a") - p) * (F.col("a") - p) + (F.col("c") - q) * (F.col("c") - q))
    rows = rows.withColumns({"chroma": far(128.0, 128.0), "dist": far(F.col("a_mid"), F.col("c_mid"))})
    rows = _limits(rows, by, chroma_least=("chroma", CHROMA[1], CHROMA[0]), dist_least=("dist", DISTANCE[1], DISTANCE[0]), l_least=("l", LIGHT[1], LIGHT[0]), dist_top=("dist", 0.99, 0.0))
    mask = (F.col("chroma") >= F.col("chroma_least")) & (F.col("dist") >= F.col("dist_least")) & (F.col("l") >= F.col("l_least"))
    return candidates_of(components(rows, by, mask, clip((F.col("dist") - F.col("dist_least")) / F.greatest(F.col("dist_top") - F.col("dist_least"), F.lit(1.0)), 0.0, 1.0), size), by, "lab", least, most, score, scale, crop)


def table_of(counts: np.ndarray, area: int) -> np.ndarray:
    """What each of 256 grays becomes in a field of that many pixels: counts above the limit are shared out, then summed up."""
    limit = max(int(CLIP_LIMIT * area / 256), 1)
    over = int(np.maximum(counts - limit, 0).sum())
    counts = np.minimum(counts, limit) + over // 256
    left = over % 256
    if left:
        step = max(256 // left, 1)
        counts[np.arange(0, 256, step)[:left]] += 1
    return np.clip(np.rint(np.cumsum(counts) * np.float32(255 / area)), 0, 255)


def equalised(pixels: DataFrame, by: list[str], value: str = "value", size: int = tiles.SIZE) -> DataFrame:
    """Tiles of one channel: the gray values (whole numbers, 0 to 255) after contrast-limited adaptive equalisation in 8 x 8 fields.

    A field's counts are an aggregate; the tables of a frame's fields (16 kB) come to each of its tiles, which blend the four around a
    pixel. A frame that eight fields do not divide goes on mirrored at its last row and column."""
    frame = pixels.groupBy(*by).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    rows = pixels.join(frame, by) if by else pixels.crossJoin(F.broadcast(frame))  # one row
    whole = (F.col("_w") % FIELDS == 0) & (F.col("_h") % FIELDS == 0)
    padded = {n: F.when(whole, F.col(f"_{n}")).otherwise(F.col(f"_{n}") + FIELDS - F.col(f"_{n}") % FIELDS) for n in "wh"}
    field = {n: (padded[n] / FIELDS).cast("int") for n in "wh"}

    def seen(place: str, extent: str) -> Column:
        """The place itself, and where the mirror shows it beyond the end."""
        mirror = 2 * (F.col(f"_{extent}") - 1) - F.col(place)
        return F.array_compact(F.array(F.col(place), F.when((mirror >= F.col(f"_{extent}")) & (mirror < padded[extent]), mirror)))

    counted = rows.select(*by, F.col(value).cast("int").alias("_v"), field["w"].alias("_fw"), field["h"].alias("_fh"), F.explode(seen("x", "w")).alias("_x"), seen("y", "h").alias("_ys")).withColumn("_y", F.explode("_ys"))
    counts = counted.groupBy(*by, "_fw", "_fh", F.floor(F.col("_x") / F.col("_fw")).cast("int").alias("_gx"), F.floor(F.col("_y") / F.col("_fh")).cast("int").alias("_gy"), "_v").agg(F.count("*").alias("_n"))
    fields = counts.groupBy(*by, "_fw", "_fh").agg(F.collect_list(((F.col("_gy") * FIELDS + F.col("_gx")) * 256 + F.col("_v")).cast("long") * (1 << 32) + F.col("_n")).alias("_counts"))  # at most 64 x 256 a frame

    @F.pandas_udf("binary")
    def tables(w: pd.Series, h: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for fw, fh, cs in zip(w, h, counts):
            c = np.zeros((FIELDS, FIELDS, 256), np.int64)
            at = np.asarray(cs, np.int64)
            c.reshape(-1)[at >> 32] = at & 0xFFFFFFFF
            out.append(np.array([[table_of(x, fw * fh) for x in line] for line in c], np.uint8).tobytes())
        return pd.Series(out, dtype=object)

    known = fields.select(*by, "_fw", "_fh", tables("_fw", "_fh", "_counts").alias("_tables"))
    packed = tiles.pack(pixels, by, [value], size)

    def change(a: np.ndarray, row: dict) -> np.ndarray:
        lut = np.frombuffer(row["_tables"], np.uint8).reshape(FIELDS, FIELDS, 256).astype(np.float32)
        v = a[0].astype(np.int64)

        def around(start: int, n: int, extent: int):
            at = (np.arange(start, start + n, dtype=np.float32)) * np.float32(1 / extent) - np.float32(0.5)
            low = np.floor(at).astype(int)
            return np.maximum(low, 0), np.minimum(low + 1, FIELDS - 1), at - low

        x1, x2, fx = around(row["x"], row["w"], row["_fw"])
        y1, y2, fy = around(row["y"], row["h"], row["_fh"])
        get = lambda gy, gx: lut[gy[:, None], gx[None, :], v]
        top, low = get(y1, x1) * (1 - fx) + get(y1, x2) * fx, get(y2, x1) * (1 - fx) + get(y2, x2) * fx
        return np.clip(np.rint(top * (1 - fy)[:, None] + low * fy[:, None]), 0, 255)[None]

    joined = packed.join(known, by) if by else packed.crossJoin(F.broadcast(known))  # one row
    return tiles.each(joined, by, 1, change)


def equalised_gray(pixels: DataFrame, by: list[str], size: int = tiles.SIZE) -> DataFrame:
    return equalised(pixels.select(*by, "x", "y", gray(F.col("b"), F.col("g"), F.col("r")).alias("value")), by, "value", size)


def blur_size(width: int, height: int) -> int:
    size = max(BLUR_LEAST, min(width, height) // BLUR_SHARE)
    return size + 1 - size % 2


def detect_gray(pixels: DataFrame, by: list[str], frame: tuple[int, int], least: float, most: float, score: float, scale: float = 1.0, crop=(0, 0), size: int = tiles.SIZE, even: DataFrame | None = None) -> DataFrame:
    """What differs from its blurred surroundings. frame: width and height, from which the blur's size follows; even: the equalised tiles, if there are."""
    even = equalised_gray(pixels, by, size) if even is None else even
    blur = tiles.gaussian(blur_size(*frame))
    differ = tiles.nearing(even, by, 1, blur_size(*frame) // 2, lambda a: np.abs(a - np.rint(blur(a))), size)
    rows = _limits(pinned(tiles.unpack(differ, by, ["response"])), by, r_least=("response", CONTRAST[1], CONTRAST[0]), r_top=("response", CONTRAST_TOP, 0.0))
    over = clip((F.col("response") - F.col("r_least")) / F.greatest(F.col("r_top") - F.col("r_least"), F.lit(1.0)), 0.0, 1.0)
    return candidates_of(components(rows, by, F.col("response") >= F.col("r_least"), over, size), by, "gray", least, most, max(score, 0.5), scale, crop)


def threshold_parts(packed: DataFrame | tiles.Pending, by: list[str], thresholds: list[int], size: int = tiles.SIZE) -> DataFrame:
    """Parts (by, threshold, label, ...) of the components of the tiles' pixels above each threshold: the component tree's nodes, level by level. A component lies
    in one of the level below."""
    return tiles.parts(packed, by, ["value"], size, levels=thresholds)


def merge_blobs(found: DataFrame, by: list[str], apart: float, repeats: int = BLOB_REPEATS) -> DataFrame:
    """(by, x, y, size, seen) from components (by, threshold, mx, my, radius, inertia) of rising thresholds: a component belongs to the blob whose middle
    member is nearer than `apart` or than either radius; blobs with enough members stay, at the mean of centres weighed by roundness squared."""
    types = dict(found.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blobs: list[list[tuple]] = []
        pdf = pdf.sort_values(["threshold", "my", "mx"])
        columns = [pdf[n].to_numpy() for n in ("mx", "my", "radius", "inertia")]
        cuts = np.flatnonzero(np.diff(pdf["threshold"].to_numpy())) + 1
        for level in np.split(np.stack(columns, axis=1), cuts):
            middle = np.array([b[len(b) // 2][:3] for b in blobs]).reshape(-1, 3)
            for x, y, radius, inertia in level.tolist():
                d = np.hypot(middle[:, 0] - x, middle[:, 1] - y)
                at = np.flatnonzero((d < apart) | (d < middle[:, 2]) | (d < radius))
                if len(at):
                    group = blobs[at[0]]
                    group.append((x, y, radius, inertia))
                    group.sort(key=lambda c: c[2])
                else:
                    blobs.append([(x, y, radius, inertia)])
        out = []
        for b in blobs:
            if len(b) >= repeats:
                w = np.array([c[3] ** 2 for c in b])
                w = w if w.sum() > 0 else np.ones(len(b))
                out.append((*[pdf[n].iloc[0] for n in by], float(np.dot(w, [c[0] for c in b]) / w.sum()), float(np.dot(w, [c[1] for c in b]) / w.sum()), 2 * b[len(b) // 2][2], len(b)))
        return pd.DataFrame(out, columns=[*by, "x", "y", "size", "seen"])

    rows = found if by else found.withColumn("_all", F.lit(0))
    return rows.groupBy(*(by or ["_all"])).applyInPandas(run, "".join(f"`{n}` {types[n]}, " for n in by) + "x double, y double, size double, seen long")


def detect_blob(pixels: DataFrame, by: list[str], least: float, most: float, score: float, distance: float, scale: float = 1.0, crop=(0, 0), size: int = tiles.SIZE, even: DataFrame | None = None) -> DataFrame:
    """Bright blobs that stay round and in place over several thresholds; the score is the gray value at the centre. even: the equalised tiles, if there are."""
    even = pinned(equalised_gray(pixels, by, size)) if even is None else even
    small = max(3.0, least * scale * scale)
    large = max(small + 1.0, most * scale * scale)
    parts = pinned(threshold_parts(even, by, list(range(BLOB_FROM, BLOB_TO, BLOB_STEP)), size))
    # what an outline encloses is no more than its box between the outer pixels' centres
    able = tiles.part_stats(parts, [*by, "threshold"]).where((F.col("w") - 1) * (F.col("h") - 1) >= small).select(*by, "threshold", "label")
    shaped = shapes(parts.join(able, [*by, "threshold", "label"], "left_semi"), [*by, "threshold"]).where((F.col("ring_area") >= small) & (F.col("ring_area") < large) & (F.col("inertia") >= BLOB_INERTIA) & (F.col("ring_area") / F.col("hull") >= BLOB_CONVEX))
    blobs = merge_blobs(shaped, by, max(2.0, distance * scale))
    radius = F.greatest(F.col("size") / 2, F.lit(1.0))
    area = np.pi * (radius / max(scale, 1e-9)) * (radius / max(scale, 1e-9))
    at = blobs.where(area.between(least, most)).withColumns({"_x": F.rint("x").cast("int"), "_y": F.rint("y").cast("int")})
    values = tiles.unpack(even, by, ["value"]).select(*by, F.col("x").alias("_x"), F.col("y").alias("_y"), (F.col("value") / 255).alias("score"))
    seen = at.join(values, [*by, "_x", "_y"]).where(F.col("score") >= max(score, 0.45))
    lx, ly = F.col("x") / scale, F.col("y") / scale
    side = F.col("size") / scale
    box = F.struct((crop[0] + (F.col("x") - radius) / scale).alias("x"), (crop[1] + (F.col("y") - radius) / scale).alias("y"), side.alias("w"), side.alias("h"))
    return seen.select(*by, (lx + crop[0]).alias("x"), (ly + crop[1]).alias("y"), area.alias("area"), F.lit("blob").alias("method"), "score", lx.alias("local_x"), ly.alias("local_y"), box.alias("bbox"))


def detect(pixels: DataFrame, by: list[str], methods: tuple[str, ...], frame: tuple[int, int], least: float, most: float, score: float, distance: float, scale: float = 1.0, crop=(0, 0), size: int = tiles.SIZE) -> DataFrame:
    """Candidates of all the methods named, as merge_candidates takes them."""
    pixels = pinned(pixels)
    even = pinned(equalised_gray(pixels, by, size)) if {"gray", "blob"} & set(methods) else None
    common = {"least": least, "most": most, "score": score, "scale": scale, "crop": crop, "size": size}
    run = {"hsv": lambda: detect_hsv(pixels, by, **common), "lab": lambda: detect_lab(pixels, by, **common), "gray": lambda: detect_gray(pixels, by, frame, even=even, **common), "blob": lambda: detect_blob(pixels, by, distance=distance, even=even, **common)}
    out = None
    for m in methods:
        out = run[m]() if out is None else out.unionByName(run[m]())
    return out
