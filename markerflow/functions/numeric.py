"""Column functions with the numeric semantics of the reference data model: NaN fails comparisons, ties and rounding are explicit."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def at_least(x, y) -> Column:
    """x >= y, false for NaN and null."""
    return F.coalesce((c(x) >= c(y)) & ~F.isnan(c(x)) & ~F.isnan(c(y).cast("double")), F.lit(False))


def above(x, y) -> Column:
    """x > y, false for NaN and null."""
    return F.coalesce((c(x) > c(y)) & ~F.isnan(c(x)) & ~F.isnan(c(y).cast("double")), F.lit(False))


def at_most(x, y) -> Column:
    """x <= y, false for NaN and null."""
    return at_least(y, x)


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(c(x), c(lo)), c(hi))


def norm(*xs) -> Column:
    total = c(xs[0]) * c(xs[0])
    for x in xs[1:]:
        total = total + c(x) * c(x)
    return F.sqrt(total)


def half_even(x) -> Column:
    """Rounding of .5 to the even neighbour."""
    return F.rint(c(x))


def percentile(x, p: float) -> Column:
    """Exact percentile with linear interpolation; NaN if any value is NaN."""
    x = c(x)
    return F.when(F.max(F.isnan(x)), F.lit(float("nan"))).otherwise(F.percentile(x, p))


def percentiles(x, *shares: float) -> Column:
    """Several exact percentiles as an array; all NaN if any value is NaN."""
    x = c(x)
    return F.when(F.max(F.isnan(x)), F.array(*[F.lit(float("nan"))] * len(shares))).otherwise(F.percentile(x, F.array(*[F.lit(s) for s in shares])))


def first_argmax(value, index, *payload) -> Column:
    """Aggregate: the struct (value, turned, payload) of the largest value; turned is minus the smallest index among equals. Nulls do
    not count."""
    return F.max(F.when(c(value).isNotNull(), F.struct(c(value).alias("value"), (-c(index)).alias("turned"), *[c(p) for p in payload])))


def quality_score(area, radius, solidity, box_h, box_w, area_min=50, area_max=20000, radius_min=3.0, solidity_min=0.7) -> Column:
    """Product of penalties for area, core radius, solidity and aspect, in 0..1."""
    aspect = F.greatest(c(box_h), c(box_w)) / F.greatest(F.least(c(box_h), c(box_w)), F.lit(1))
    q = F.when((c(area) < area_min) | (c(area) > area_max), 0.5).otherwise(1.0)
    q = q * F.when(c(radius) < radius_min, 0.8).otherwise(1.0)
    q = q * F.when(c(solidity) < solidity_min, 0.7).otherwise(1.0)
    q = q * F.when((c(box_h) > 0) & (c(box_w) > 0) & (aspect > 5), 0.6).otherwise(1.0)
    return clip(q, 0.0, 1.0)


def valid_flag(quality, area) -> Column:
    return F.when((c(quality) > 0) & (c(area) > 0), 1).otherwise(0)


def event_drops(left, right) -> tuple[Column, Column]:
    """(left_drop, right_drop) of two event frames as the auto mode reports them."""
    offset = c(left) - c(right)
    return F.greatest(offset, F.lit(0)), F.greatest(-offset, F.lit(0))


def restore(local, scale, offset) -> Column:
    """Full-frame coordinate of a processed-pixel one."""
    return c(local) / c(scale) + F.coalesce(c(offset), F.lit(0))


def compactness(area, perimeter) -> Column:
    return F.when(c(perimeter) > 0, 4 * PI * c(area) / (c(perimeter) * c(perimeter))).otherwise(0.0)


def shape_score(compact, solidity) -> Column:
    return clip(0.55 * c(compact) + 0.45 * c(solidity), 0.0, 1.0)


def stability(hits_high, hits_low, empty: float | None = float("nan")) -> Column:
    """Share of the low-threshold area that stays at the high threshold; an empty one gives `empty` (NaN in batch filters, 1.0
    in the decoder)."""
    return F.when(c(hits_low) == 0, F.lit(empty)).otherwise(c(hits_high) / c(hits_low))


# The five stops (R, G, B) of the colour ramp.
RAMP = ((68, 1, 84), (59, 82, 139), (33, 144, 141), (94, 201, 98), (253, 231, 37))


def ramp(z, lo, hi) -> Column:
    """struct(b, g, r) of a value between lo and hi on a five-stop ramp."""
    t = clip(F.when(c(hi) <= c(lo), 0.5).otherwise((c(z) - c(lo)) / F.nullif(c(hi) - c(lo), F.lit(0.0))), 0.0, 1.0)
    pos = t * (len(RAMP) - 1)
    i0 = F.floor(pos).cast("int")
    i1 = F.least(i0 + 1, F.lit(len(RAMP) - 1))
    part = pos - i0
    mixed = [F.floor((1 - part) * F.get(F.array(*[F.lit(float(s[k])) for s in RAMP]), i0) + part * F.get(F.array(*[F.lit(float(s[k])) for s in RAMP]), i1)).cast("int") for k in range(3)]
    return F.struct(mixed[2].alias("b"), mixed[1].alias("g"), mixed[0].alias("r"))


def time_text(frame, fps) -> Column:
    """HH:MM:SS.mmm of a frame."""
    s = c(frame) / c(fps)
    return F.format_string("%02d:%02d:%06.3f", F.floor(s / 3600).cast("int"), F.floor((s % 3600) / 60).cast("int"), s % 60)


def seek_parts(start_frame, end_frame, fps, pre: float = 5.0) -> list[Column]:
    """fast_seek, fine_offset and duration in seconds of a clip."""
    start = c(start_frame) / c(fps)
    early = F.least(F.lit(pre), start)
    return [(start - early).alias("fast_seek"), early.alias("fine_offset"), ((c(end_frame) - c(start_frame)) / c(fps)).alias("duration")]


def angle_delta(a, b) -> Column:
    """Distance of two undirected angles."""
    return F.abs(F.pmod(c(a) - c(b) + PI / 2, F.lit(PI)) - PI / 2)


def local_xyz(x, y, z, origin, basis) -> list[Column]:
    """Coordinates in a frame given by origin and the rows of basis."""
    d = [c(x) - origin[0], c(y) - origin[1], c(z) - origin[2]]
    return [d[0] * r[0] + d[1] * r[1] + d[2] * r[2] for r in basis]


def bilinear(corners, col, row, cols, rows) -> tuple[Column, Column]:
    """Point of a cols x rows grid between four corner points (top left, top right, bottom right, bottom left)."""
    s = c(col) / F.greatest(c(cols) - 1, F.lit(1)).cast("double")
    t = c(row) / F.greatest(c(rows) - 1, F.lit(1)).cast("double")
    return tuple((1 - t) * ((1 - s) * corners[0][k] + s * corners[1][k]) + t * ((1 - s) * corners[3][k] + s * corners[2][k]) for k in (0, 1))


def uncrop_box(box: Column, crop_x, crop_y) -> Column:
    """Corners of a crop's box in the frame."""
    return F.struct((box["x0"] + c(crop_x)).alias("x0"), (box["y0"] + c(crop_y)).alias("y0"), (box["x1"] + c(crop_x)).alias("x1"), (box["y1"] + c(crop_y)).alias("y1"))


def box_xywh(box: Column) -> Column:
    return F.struct(box["x0"].alias("x"), box["y0"].alias("y"), (box["x1"] - box["x0"]).alias("w"), (box["y1"] - box["y0"]).alias("h"))


def near_crop_edge(box: Column, crop: Column, frame: Column, tolerance: float = 20.0) -> Column:
    """A side of the box lies at its crop's edge, and that edge is not the frame's."""
    hits = [(F.abs(box[n] - crop[n]) <= tolerance) & ~(F.abs(box[n] - frame[n]) <= tolerance) for n in ("x0", "y0", "x1", "y1")]
    return hits[0] | hits[1] | hits[2] | hits[3]


def unit_coordinate(value, extent, resolution=None) -> Column:
    """A pixel coordinate as share of the extent, or at another resolution."""
    share = c(value) / c(extent)
    return share if resolution is None else share * c(resolution)


def precedence(given, saved, default) -> Column:
    """An explicitly given value, else the saved one, else the default; a given value that equals the default counts as not given."""
    return F.coalesce(F.when(c(given) != c(default), c(given)), c(saved), c(default))


def chosen_crop(own, shared, saved, disabled=None, ignore_saved: bool = False) -> Column:
    """A side's crop: its own argument, else that of both sides, else the saved one unless saved crops are ignored; none where the crop
    is disabled."""
    crop = F.coalesce(c(own), c(shared)) if ignore_saved else F.coalesce(c(own), c(shared), c(saved))
    return crop if disabled is None else F.when(F.coalesce(c(disabled), F.lit(False)), F.lit(None)).otherwise(crop)


def shift_of(disabled, saved: Column, field: str) -> Column:
    """How far saved points move on an axis: by the saved crop's corner where its crop is disabled, else not."""
    return F.when(F.coalesce(c(disabled), F.lit(False)), F.coalesce(saved[field], F.lit(0))).otherwise(0)


def target_count(side, both) -> Column:
    """How many candidates a side should give: its own number, else that of both, else 0, which sets no target; 0 counts as not given."""
    return F.coalesce(F.nullif(c(side), F.lit(0)), c(both), F.lit(0))


# The least value of each argument (exclusive for scale) and what is said of a smaller one.
LIMITS = {
    "scale": (0, "--scale must be > 0"),
    "step": (1, "--step must be >= 1"),
    "cols": (2, "--cols must be >= 2"),
    "rows": (2, "--rows must be >= 2"),
    "max_scan": (1, "--max-scan must be >= 1"),
    "max_frames": (None, "--max-frames cannot be 0 (use -1 for all frames)"),
    "max_pairs": (1, "--max-pairs must be >= 1"),
    "workers": (1, "--workers must be >= 1"),
}


def argument_errors(arguments: dict) -> list[str]:
    """What is wrong with the arguments that are given, in the order of LIMITS."""
    out = []
    for name, (least, message) in LIMITS.items():
        if name in arguments:
            value = arguments[name]
            if value == 0 if least is None else value <= least if name == "scale" else value < least:
                out.append(message)
    return out


def check_arguments(**arguments) -> None:
    """Raises the first of them."""
    for message in argument_errors(arguments):
        raise ValueError(message)


def argument_error(**columns) -> Column:
    """The same first message for rows of arguments, null where all are right."""
    tests = []
    for name, (least, message) in LIMITS.items():
        if name in columns:
            value = c(columns[name])
            tests.append(F.when(value == 0 if least is None else value <= least if name == "scale" else value < least, message))
    return F.coalesce(*tests, F.lit(None).cast("string"))
