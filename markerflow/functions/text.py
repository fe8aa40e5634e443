"""Column functions on text, arrays and nested values."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import c

# Words that read as true, and file name suffixes of videos.
TRUE_WORDS = ("1", "true", "yes", "y", "on")
VIDEO_SUFFIXES = (".mp4", ".lrv", ".360")


def truthy(x) -> Column:
    return F.lower(F.trim(c(x))).isin(*TRUE_WORDS)


def base_url(x) -> Column:
    """With a scheme, without a trailing slash."""
    t = F.trim(c(x))
    return F.rtrim(F.when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("http://"), t)), F.lit("/"))


def id_set(x, n) -> Column:
    """Ids of a text such as '1-3,7' in order, repeats dropped; null, '' and 'all' mean 0..n-1. Ranges may run down. An id
    outside 0..n-1 raises."""
    t = F.lower(F.trim(F.coalesce(c(x), F.lit(""))))
    parts = F.filter(F.transform(F.split(c(x), ","), lambda p: F.trim(p)), lambda p: p != "")
    bound = lambda p, i: F.trim(F.get(F.split(p, "-", 2), i)).cast("int")
    ids = F.flatten(F.transform(parts, lambda p: F.when(F.contains(p, F.lit("-")), F.sequence(bound(p, F.lit(0)), bound(p, F.lit(1)))).otherwise(F.array(p.cast("int")))))
    out = F.when(t.isin("", "all"), F.when(c(n) > 0, F.sequence(F.lit(0), c(n) - 1)).otherwise(F.array().cast("array<int>"))).otherwise(F.array_distinct(ids))
    return F.when(F.exists(out, lambda i: (i < 0) | (i >= c(n))), F.raise_error(F.lit("object id out of range")).cast("array<int>")).otherwise(out)


def stem(name) -> Column:
    return F.regexp_replace(c(name), r"(.)\.[^.]*$", "$1")


def suffix(name) -> Column:
    return F.lower(F.regexp_extract(c(name), r".(\.[^.]*)$", 1))


def clip_key(name) -> Column:
    """Recording that a chapter file belongs to: prefix and clip number, without the chapter number."""
    s = F.upper(stem(name))
    new, old = r"^([A-Z]{2})(\d{2})(\d{4})$", r"^([A-Z]{2,4})(\d{4})$"
    return (
        F.when(s.rlike(new), F.concat(F.regexp_extract(s, new, 1), F.regexp_extract(s, new, 3)))
        .when(s.rlike(old), F.concat(F.substring(F.regexp_extract(s, old, 1), 1, 2), F.regexp_extract(s, old, 2)))
        .otherwise(s)
    )


def chapter(name) -> Column:
    return F.coalesce(F.regexp_extract(F.upper(stem(name)), r"^[A-Z]{2}(\d{2})\d{4}$", 1).try_cast("int"), F.lit(0))


def crop_of(text) -> Column:
    """struct(x, y, w, h) of 'x,y,w,h'; null where it is not four whole numbers with positive size."""
    p = F.transform(F.split(c(text), ","), lambda s: F.trim(s).try_cast("int"))
    ok = (F.size(p) == 4) & ~F.exists(p, lambda v: v.isNull()) & (F.get(p, F.lit(2)) > 0) & (F.get(p, F.lit(3)) > 0)
    return F.when(ok, F.struct(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate("xywh")]))


def clip_crop(crop: Column, width, height) -> Column:
    """The part of a crop inside a frame; null if nothing is."""
    x0, y0 = F.greatest(crop["x"], F.lit(0)), F.greatest(crop["y"], F.lit(0))
    x1, y1 = F.least(crop["x"] + crop["w"], c(width)), F.least(crop["y"] + crop["h"], c(height))
    return F.when(crop.isNotNull() & (x1 > x0) & (y1 > y0), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))


def rle_area(counts) -> Column:
    """Foreground pixels of run lengths that begin with background."""
    return F.aggregate(F.filter(c(counts), lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, x: a + x)


def rle_pixels(counts) -> Column:
    """Positions of the foreground pixels, in the order of the runs."""
    step = F.aggregate(
        c(counts),
        F.struct(F.lit(0).cast("int").alias("at"), F.lit(False).alias("on"), F.array().cast("array<int>").alias("out")),
        lambda s, n: F.struct((s["at"] + n).cast("int").alias("at"), (~s["on"]).alias("on"), F.when(s["on"] & (n > 0), F.concat(s["out"], F.sequence(s["at"], (s["at"] + n - 1).cast("int")))).otherwise(s["out"]).alias("out")),
    )
    return step["out"]


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def head_tail(values, n: int = 10) -> Column:
    """struct(count, head, tail) of a list; short lists are all head."""
    v = c(values)
    return F.struct(F.size(v).alias("count"), F.slice(v, 1, n).alias("head"), F.when(F.size(v) > n, F.slice(v, F.greatest(F.size(v) - n + 1, F.lit(n + 1)), n)).otherwise(F.slice(v, 1, 0)).alias("tail"))


def stable_hash(payload) -> str:
    """SHA-256 of canonical JSON: sorted keys, no white space."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def row_hash(*columns: str) -> Column:
    """The same digest of one row's columns."""
    return F.sha2(F.to_json(F.struct(*[F.col(n) for n in sorted(columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def prompt(positive, negative, scale, box=None) -> list[Column]:
    """points and labels of a prompt: box corners first (2, 3), then positive (1) and negative (0) points, all scaled."""
    scaled = lambda a: F.transform(a, lambda p: F.struct((p["x"] * c(scale)).alias("x"), (p["y"] * c(scale)).alias("y")))
    points, labels = F.concat(scaled(c(positive)), scaled(c(negative))), F.concat(F.transform(c(positive), lambda p: F.lit(1)), F.transform(c(negative), lambda p: F.lit(0)))
    if box is not None:
        b = c(box)
        corners = scaled(F.array(F.struct(b["x0"].alias("x"), b["y0"].alias("y")), F.struct(b["x1"].alias("x"), b["y1"].alias("y"))))
        points = F.when(b.isNull(), points).otherwise(F.concat(corners, points))
        labels = F.when(b.isNull(), labels).otherwise(F.concat(F.array(F.lit(2), F.lit(3)), labels))
    return [points.alias("points"), labels.alias("labels")]


def best_mask(scores, stability_single, least=0.98) -> Column:
    """Index of the mask to keep: the single one if stable enough, else the first with the best predicted score of the others."""
    rest = F.slice(c(scores), 2, 1 << 30)
    return F.when(c(stability_single) >= least, 0).otherwise(F.array_position(rest, F.array_max(rest)).cast("int"))


def translate_points(points, dx, dy) -> Column:
    """Every point of an array moved."""
    return F.transform(c(points), lambda p: F.struct((p["x"] + c(dx)).alias("x"), (p["y"] + c(dy)).alias("y")))


def appended(points, labels, more_points, more_labels, clear: bool) -> list[Column]:
    """A frame's prompt after another click: the old points first unless they are cleared."""
    old = (F.array().cast("array<struct<x:double,y:double>>"), F.array().cast("array<int>")) if clear else (F.coalesce(c(points), F.array().cast("array<struct<x:double,y:double>>")), F.coalesce(c(labels), F.array().cast("array<int>")))
    return [F.concat(old[0], c(more_points)).alias("points"), F.concat(old[1], c(more_labels)).alias("labels")]


def correction(clicks, scale, box=None) -> list[Column]:
    """positive and negative points of labelled clicks (x, y, label), and the box (an array of corners, or null), at full scale."""
    of = lambda k: F.transform(F.filter(c(clicks), lambda p: p["label"] == k), lambda p: F.struct((p["x"] / c(scale)).alias("x"), (p["y"] / c(scale)).alias("y")))
    out = [of(1).alias("positive"), F.transform(F.filter(c(clicks), lambda p: p["label"] != 1), lambda p: F.struct((p["x"] / c(scale)).alias("x"), (p["y"] / c(scale)).alias("y"))).alias("negative")]
    return out if box is None else [*out, F.transform(c(box), lambda v: v / c(scale)).alias("box")]


def applied(positive, negative, scale, box) -> list[Column]:
    """A correction as the prompt that is given to the model (points, labels, box at its scale, clear); all null where it holds neither
    points nor a box, which changes nothing. A box clears what was clicked before."""
    points, labels = prompt(positive, negative, scale)
    box = F.transform(c(box), lambda v: v * c(scale))
    some = (F.size(points) > 0) | box.isNotNull()
    return [F.when(some, points).alias("points"), F.when(some, labels).alias("labels"), F.when(some, box).alias("box"), F.when(some, box.isNotNull()).alias("clear")]


def point_method(usable: Column, junction: Column, peak: Column, eroded: Column, centroid: Column) -> Column:
    """Which point stands for a mask: a good skeleton junction, the distance peak, then the eroded and the plain centroid."""
    return (
        F.when(~usable, "invalid")
        .when(junction, "skeleton_junction")
        .when(peak.isNotNull(), "dt_peak")
        .when(eroded.isNotNull(), "fallback_eroded_centroid")
        .when(centroid.isNotNull(), "fallback_centroid")
        .otherwise("no_fallback")
    )
