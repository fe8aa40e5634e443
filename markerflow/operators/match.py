"""Matching of two cameras' observations and other keyed look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import at_least
from .idioms import first_wins, last_wins


def usable(tracks: DataFrame, quality_min: float) -> DataFrame:
    """Valid rows of at least that quality; NaN quality never passes. The predicate reaches the scan."""
    return tracks.where((F.col("valid") == 1) & at_least("quality", quality_min))


def on_clock(tracks: DataFrame, drop: int | Column) -> DataFrame:
    return tracks.withColumn("gframe", F.col("frame") + drop)


def stereo_match(left: DataFrame, right: DataFrame, quality_min: float, left_drop=0, right_drop=0, position: str = "pos") -> DataFrame:
    """Observations of one object at one time by both cameras. Of rows with one (gframe, obj_id), the last in file order counts, so
    keys meet once; Catalyst picks the join, each side being one row per key after its aggregate."""
    sides = []
    for rows, drop, s in ((left, left_drop, "L"), (right, right_drop, "R")):
        kept = on_clock(usable(rows, quality_min), drop).select("gframe", "obj_id", F.col("u").alias(f"u{s}"), F.col("v").alias(f"v{s}"), F.col("quality").alias(f"q{s}"), F.col("frame").alias(f"frame_{s}"), F.col(position).alias("_pos"))
        sides.append(last_wins(kept, ["gframe", "obj_id"], "_pos").drop("_pos"))
    return sides[0].join(sides[1], ["gframe", "obj_id"])


def paired_indices(left: DataFrame, right: DataFrame, trim_left: int, trim_right: int) -> DataFrame:
    """(g, left_idx, right_idx) of detections on the shared clock; before time 0 nothing counts, of equals the first does."""
    sides = [
        first_wins(d.select((F.col("idx") - trim).alias("g"), F.col("idx").alias(f"{s}_idx"), F.col("pos").alias("_pos")).where("g >= 0"), ["g"], "_pos").drop("_pos")
        for d, trim, s in ((left, trim_left, "left"), (right, trim_right, "right"))
    ]
    return sides[0].join(sides[1], "g")


# Columns that may hold one error of a whole point, the first that is there counts.
SCALAR_ERRORS = ("err_3d", "err_xyz", "error_3d", "err", "err_px")
AXIS_ERRORS = ("X_err", "Y_err", "Z_err")


def error_columns(names: list[str]) -> tuple[str, ...]:
    """The columns that hold a point's error: the three of its axes, if all are there; none if only some are; else a scalar one."""
    if any(n in names for n in AXIS_ERRORS):
        return AXIS_ERRORS if all(n in names for n in AXIS_ERRORS) else ()
    return next(((n,) for n in SCALAR_ERRORS if n in names), ())


def pair_distance(points: DataFrame, first: int, second: int, frame: str = "frame", errors: tuple[str, ...] | None = None) -> DataFrame:
    """Distance of two objects per frame with its first-order error, from the errors of the axes or from one of the whole point; null where
    there is none. errors: their columns, found by error_columns unless given. Rows with a null or NaN are dropped, repeats
    multiply, and validity flags are not looked at."""
    errors = error_columns(points.columns) if errors is None else errors
    names = ["X", "Y", "Z", *errors]
    sides = [points.where(F.col("obj_id") == i).select(frame, *names).dropna(subset=[frame, *names]).select(frame, *[F.col(n).alias(f"{n}_{k}") for n in names]) for k, i in enumerate((first, second))]
    both = sides[0].join(sides[1], frame)
    d = [F.col(f"{a}_1") - F.col(f"{a}_0") for a in "XYZ"]
    dist = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    safe = F.greatest(dist, F.lit(1e-12))
    total = lambda e: F.col(f"{e}_0") * F.col(f"{e}_0") + F.col(f"{e}_1") * F.col(f"{e}_1")
    if len(errors) == 3:
        parts = [(d[i] / safe) * (d[i] / safe) * total(e) for i, e in enumerate(errors)]
        error = F.sqrt(parts[0] + parts[1] + parts[2])
    else:
        error = F.sqrt(total(errors[0])) if errors else F.lit(None).cast("double")
    return both.withColumn("distance", dist).withColumn("distance_err", error)


def missing_ids(rows: DataFrame, expected: list[int], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Expected ids without a valid row, per frame."""
    seen = rows.groupBy(*by, "frame").agg(F.collect_set(F.when(F.col("valid") == 1, F.col("obj_id"))).alias("seen"))
    return seen.select(*by, "frame", F.array_sort(F.array_except(F.array(*[F.lit(i) for i in expected]), "seen")).alias("missing"), F.size("seen").alias("n_valid"))


def overlapping(queries: DataFrame, regions: DataFrame, width: int = 1024) -> DataFrame:
    """Queries (start, end) that overlap a region, half open. Both are cut into buckets of a fixed width for an equi join."""
    cut = lambda d, a, b: d.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))))
    r = cut(regions.select(F.col("start").alias("_s"), F.col("end").alias("_e")).where("_e > _s"), "_s", "_e")
    hits = cut(queries.where("end > start"), "start", "end").join(r, "_bucket").where("start < _e AND end > _s")
    return hits.select("start", "end").distinct()


def closest_frames(frames: DataFrame, by: list[str], query: str, frame: str, most: int) -> DataFrame:
    """Of each key's conditioning frames at most `most`: the closest before, the closest at or after, then the nearest others in
    order of distance and of insertion (pos)."""
    w = Window.partitionBy(*by)
    before, after = F.max(F.when(F.col(frame) < F.col(query), F.col(frame))).over(w), F.min(F.when(F.col(frame) >= F.col(query), F.col(frame))).over(w)
    ranked = frames.withColumn("_kind", F.when((F.col(frame) == before) | (F.col(frame) == after), 0).otherwise(1))
    order = w.orderBy("_kind", F.abs(F.col(frame) - F.col(query)), "pos")
    kept = ranked.withColumn("_rank", F.row_number().over(order))
    return (kept if most == -1 else kept.where(F.col("_rank") <= most)).drop("_kind", "_rank")


def memory_frames(frame: Column, count: int, stride: int, reverse: bool = False) -> Column:
    """array of (slot, frame) looked up for a frame: the one before, then every stride-th before that; in reverse, after it."""
    if reverse:
        near, step = frame + 1, [F.ceil((frame + 2) / stride) * stride + (k - 2) * stride for k in range(2, count)]
    else:
        near, step = frame - 1, [F.floor((frame - 2) / stride) * stride - (k - 2) * stride for k in range(2, count)]
    return F.array(F.struct(F.lit(1).alias("slot"), near.cast("long").alias("frame")), *[F.struct(F.lit(k).alias("slot"), s.cast("long").alias("frame")) for k, s in enumerate(step, 2)])


def recalled(queries: DataFrame, by: list[str], others: DataFrame, unselected: DataFrame, frame: str, value: str, count: int, stride: int, reverse: bool = False) -> DataFrame:
    """(by, frame, slot, looked_up, value): what each frame's memory slots hold, from the other outputs or, where those lack the frame,
    from conditioning frames that were not selected; empty slots have no row."""
    slots = queries.select(*by, frame, F.explode(memory_frames(F.col(frame), count, stride, reverse)).alias("m")).select(*by, frame, "m.slot", F.col("m.frame").alias("looked_up"))
    for name, rows in (("_other", others), ("_unselected", unselected)):
        slots = slots.join(rows.select(*by, F.col(frame).alias("looked_up"), F.col(value).alias(name)), [*by, "looked_up"], "left")
    return slots.withColumn(value, F.coalesce("_other", "_unselected")).where(F.col(value).isNotNull()).select(*by, frame, "slot", "looked_up", value)


def active_corrections(corrections: DataFrame, active: DataFrame, start: int = 0) -> DataFrame:
    """Corrections of the active objects (obj_id) from a frame on, in order of frame."""
    return corrections.where(F.col("frame") >= start).join(active.select("obj_id").distinct(), "obj_id", "left_semi").orderBy("frame")


def correction_bounds(corrections: DataFrame, active: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """First and last corrected frame of the active objects; null where there is none."""
    return corrections.join(active.select("obj_id").distinct(), "obj_id", "left_semi").groupBy(*by).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


def common_keys(left: DataFrame, right: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """Keys of both sides, once, less those of a third."""
    both = left.intersect(right)
    return both if without is None else both.join(without, both.columns, "left_anti")


def concatenated(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Rows of all batches in order; sorted in range partitions."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(*order)


def first_present(keys: DataFrame, sources: list[DataFrame], on: list[str], value: str, default) -> DataFrame:
    """The value of the first source that has the key, else the default."""
    out, names = keys, []
    for i, s in enumerate(sources):
        names.append(f"_v{i}")
        out = out.join(s.select(*on, F.col(value).alias(names[-1])), on, "left")
    return out.select(*on, F.coalesce(*names, F.lit(default)).alias(value))


def upsert(rows: DataFrame, keys: list[str], version: str, restart: int | None = None, frame: str = "frame") -> DataFrame:
    """Rows of each key's latest version. With restart, what earlier versions than the latest of all wrote from that frame on is cut
    off, whether or not the latest writes the frame again."""
    if restart is not None:
        latest = rows.agg(F.max(version).alias("_latest"))
        rows = rows.crossJoin(F.broadcast(latest)).where((F.col(frame) < restart) | (F.col(version) == F.col("_latest"))).drop("_latest")  # one row
    return last_wins(rows, keys, version)


def auto_pause(rows: DataFrame, expected: list[int], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Per frame how many of the expected objects are valid, which are missing, and whether tracking pauses for them, with its reason."""
    found = missing_ids(rows.where(F.col("obj_id").isin(expected)), expected, by)
    shown = F.concat(F.array_join(F.transform(F.slice("missing", 1, 20), lambda i: i.cast("string")), ", "), F.lit("]"), F.when(F.size("missing") > 20, "...").otherwise(""))
    reason = F.concat(F.lit("  AUTO missing ["), shown, F.format_string(" (%d/%d)", "n_valid", F.lit(len(expected))))
    return found.withColumn("pause", F.col("n_valid") < len(expected)).withColumn("reason", F.when(F.col("pause"), reason).otherwise(""))
