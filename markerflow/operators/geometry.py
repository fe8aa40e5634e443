"""Stereo geometry: rays, linear triangulation, projection with distortion, homographies. numpy batches where Columns cannot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import above, c, percentile


class Rig:
    """Two cameras: intrinsics, distortion (4, 5, 8, 12 or 14 coefficients), rotation and translation from left to right, and the scale
    at which the rig was calibrated."""

    def __init__(self, k1, d1, k2, d2, r, t, scale: float = 1.0) -> None:
        self.k1, self.k2, self.r = (np.asarray(x, float).reshape(3, 3) for x in (k1, k2, r))
        self.d1, self.d2 = (np.concatenate([np.ravel(d), np.zeros(14 - np.size(d))]) for d in (d1, d2))
        self.t, self.scale = np.asarray(t, float).reshape(3), float(scale)

    @classmethod
    def load(cls, path: str) -> Rig:
        with np.load(path) as z:
            return cls(z["K1"], z["D1"], z["K2"], z["D2"], z["R"], z["T"], float(z["scale"][0]) if "scale" in z else 1.0)


def tilt(d) -> np.ndarray:
    """The sensor's tilt (the 13th and 14th coefficient) as a homography of normalised coordinates."""
    a, b = float(d[12]), float(d[13])
    about_x = np.array([[1, 0, 0], [0, np.cos(a), np.sin(a)], [0, -np.sin(a), np.cos(a)]])
    about_y = np.array([[np.cos(b), 0, -np.sin(b)], [0, 1, 0], [np.sin(b), 0, np.cos(b)]])
    turn = about_y @ about_x
    back = np.array([[turn[2, 2], 0, -turn[0, 2]], [0, turn[2, 2], -turn[1, 2]], [0, 0, 1]])
    return back @ turn


def mapped(x, y, h: np.ndarray):
    """x and y, Columns or arrays, through a homography."""
    u, v, w = (x * float(r[0]) + y * float(r[1]) + float(r[2]) for r in h)
    return u / w, v / w


def lens(x, y, d):
    """Normalised coordinates with the lens's distortion, without the sensor's tilt (rational model with thin prism)."""
    k1, k2, p1, p2, k3, k4, k5, k6, s1, s2, s3, s4 = [float(v) for v in d[:12]]
    r2 = x * x + y * y
    radial = (1 + r2 * (k1 + r2 * (k2 + r2 * k3))) / (1 + r2 * (k4 + r2 * (k5 + r2 * k6)))
    return (
        x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x) + r2 * (s1 + s2 * r2),
        y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y + r2 * (s3 + s4 * r2),
    )


def distort(x, y, d):
    """Normalised coordinates with all 14 coefficients; works on Columns and arrays alike."""
    u, v = lens(x, y, d)
    return mapped(u, v, tilt(d)) if d[12] or d[13] else (u, v)


def project(x, y, z, k, d) -> tuple[Column, Column]:
    """Pixel of a camera point as Columns; a point in the camera's plane has none (null)."""
    z = F.nullif(c(z), F.lit(0.0))
    u, v = distort(c(x) / z, c(y) / z, d)
    return u * float(k[0][0]) + v * float(k[0][1]) + float(k[0][2]), v * float(k[1][1]) + float(k[1][2])


def rays(uv: np.ndarray, k: np.ndarray, d: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Undistorted normalised coordinates by fixed-point iteration: distort() of the result gives the pixel back to 1e-9 for the
    distortions of real lenses."""
    y0 = (uv[:, 1] - k[1, 2]) / k[1, 1]
    x0 = (uv[:, 0] - k[0, 2] - k[0, 1] * y0) / k[0, 0]
    if d[12] or d[13]:
        x0, y0 = mapped(x0, y0, np.linalg.inv(tilt(d)))
    x, y = x0.copy(), y0.copy()
    for _ in range(rounds):
        dx, dy = lens(x, y, d)
        dx, dy = x0 - dx, y0 - dy
        x, y = x + dx, y + dy
        if max(np.abs(dx).max(initial=0), np.abs(dy).max(initial=0)) < 1e-13:
            break
    return np.stack([x, y], axis=1)


def rays_of(pixels: DataFrame, k: np.ndarray, d: np.ndarray, scale: float = 1.0) -> DataFrame:
    """Adds x and y, the normalised ray of each pixel (u, v); null where a pixel is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            uv = pdf[["u", "v"]].to_numpy(float) * scale
            ok = np.isfinite(uv).all(axis=1)
            out = np.full(uv.shape, np.nan)
            out[ok] = rays(uv[ok], k, d)
            yield pdf.assign(x=out[:, 0], y=out[:, 1])

    rows = pixels.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in pixels.dtypes) + ", x double, y double")
    return rows.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in "xy"})


def triangulate(left: np.ndarray, right: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Linear triangulation of normalised rays, all rows in one batched SVD; a point at infinity gives infinite coordinates."""
    p1, p2 = np.eye(3, 4), np.hstack([r, t.reshape(3, 1)])
    a = np.stack([left[:, :1] * p1[2] - p1[0], left[:, 1:] * p1[2] - p1[1], right[:, :1] * p2[2] - p2[0], right[:, 1:] * p2[2] - p2[1]], axis=1)
    h = np.linalg.svd(a)[2][:, 3]
    with np.errstate(divide="ignore", invalid="ignore"):
        return h[:, :3] / h[:, 3:]


def triangulate_matches(matches: DataFrame, rig: Rig, max_error: float = 20.0) -> DataFrame:
    """3D observations of matched pixels: rays and triangulation run in Arrow batches, everything after them as Columns.

    Pixels are scaled to the rig's calibration and back, so errors are in the input's pixels. A row is valid if it lies before both
    cameras and its mean reprojection error is not above max_error; a NaN error does not make it invalid."""
    names = ["uL", "vL", "uR", "vR"]
    extra = "X double, Y double, Z double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            p = pdf[names].to_numpy(float) * rig.scale
            ok = np.isfinite(p).all(axis=1)
            xyz = np.full((len(p), 3), np.nan)
            if ok.any():
                xyz[ok] = triangulate(rays(p[ok, :2], rig.k1, rig.d1), rays(p[ok, 2:], rig.k2, rig.d2), rig.r, rig.t)
            yield pdf.assign(X=xyz[:, 0], Y=xyz[:, 1], Z=xyz[:, 2])

    schema = ", ".join(f"`{n}` {t}" for n, t in matches.dtypes) + ", " + extra
    return with_errors(matches.mapInPandas(run, schema), rig, max_error)


def with_errors(points: DataFrame, rig: Rig, max_error: float) -> DataFrame:
    """Adds the right camera's depth, reprojections, errors and validity to left-camera points, all as Columns."""
    xr = [F.col("X") * float(rig.r[i, 0]) + F.col("Y") * float(rig.r[i, 1]) + F.col("Z") * float(rig.r[i, 2]) + float(rig.t[i]) for i in range(3)]
    out = points.withColumns({"_xr": xr[0], "_yr": xr[1], "Z_right": xr[2]})
    for s, (x, y, z), k, d in (("L", ("X", "Y", "Z"), rig.k1, rig.d1), ("R", ("_xr", "_yr", "Z_right"), rig.k2, rig.d2)):
        u, v = project(x, y, z, k, d)
        out = out.withColumns({f"u{s}_hat": u / rig.scale, f"v{s}_hat": v / rig.scale})
        du, dv = F.col(f"u{s}") - F.col(f"u{s}_hat"), F.col(f"v{s}") - F.col(f"v{s}_hat")
        out = out.withColumn(f"err{s}_px", F.sqrt(du * du + dv * dv))
    out = out.withColumn("err_px", (F.col("errL_px") + F.col("errR_px")) * 0.5)
    behind = F.coalesce((F.col("Z") <= 0) | (F.col("Z_right") <= 0), F.lit(False))
    return out.withColumn("valid_3d", F.when(behind | above("err_px", max_error), 0).otherwise(1)).drop("_xr", "_yr")


def rectified(matches: DataFrame, focal: float, baseline: float, cx: float = 0.0, cy: float = 0.0) -> DataFrame:
    """Left-camera points of a rectified pair without distortion, as Columns: depth is focal * baseline / disparity."""
    z = focal * baseline / F.nullif(F.col("uL") - F.col("uR"), F.lit(0.0))
    mean_v = (F.col("vL") + F.col("vR")) / 2
    return matches.withColumns({"Z": z, "X": (F.col("uL") - cx) * z / focal, "Y": (mean_v - cy) * z / focal})


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """3 x 3 matrix that maps four points onto four others."""
    rows, values = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        values += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(values, float)), 1.0).reshape(3, 3)


def apply_homography(x, y, h: np.ndarray) -> tuple[Column, Column]:
    w = c(x) * float(h[2, 0]) + c(y) * float(h[2, 1]) + float(h[2, 2])
    return tuple((c(x) * float(h[i, 0]) + c(y) * float(h[i, 1]) + float(h[i, 2])) / F.nullif(w, F.lit(0.0)) for i in (0, 1))


def fit_homographies(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, h): the homography, row by row, of each key's four point pairs (pos, x, y, u, v); null if there are not four or they
    determine none. A key's rows are four, so they meet in one array."""

    @F.pandas_udf("array<double>")
    def solve(points: pd.Series) -> pd.Series:
        out = []
        for rows in points:
            p = np.array([[r["x"], r["y"], r["u"], r["v"]] for r in rows], dtype=float)
            try:
                out.append(homography(p[:, :2], p[:, 2:]).ravel().tolist() if len(p) == 4 else None)
            except np.linalg.LinAlgError:
                out.append(None)
        return pd.Series(out, dtype=object)

    first = F.slice(F.sort_array(F.collect_list(F.struct("pos", "x", "y", "u", "v"))), 1, 5)
    return pairs.groupBy(*by).agg(first.alias("p")).select(*by, solve("p").alias("h"))


def canonical_corners(corners, cols: int) -> Column:
    """Corners (x, y) of a grid, row by row, in the order in which the first row grows in x and the first column in y."""
    grid = c(corners)
    n = F.size(grid)
    at = lambda i: F.get(grid, F.lit(i) if isinstance(i, int) else i)
    mirrored = F.coalesce(at(0)["x"] > at(cols - 1)["x"], F.lit(False))
    other = lambda i: i - i % cols + (cols - 1) - i % cols
    last = (((n / cols).cast("int") - 1) * cols).cast("int")
    first, below = (F.when(mirrored, at(other(i))["y"]).otherwise(at(i)["y"]) for i in (F.lit(0), last))
    upright = F.coalesce(first <= below, F.lit(False))
    # of each corner only where it comes from is worked out: an array inside another's lambda is made anew for each element
    row = lambda i: F.when(upright, i).otherwise((last - i + i % cols + i % cols).cast("int"))
    source = lambda i: F.when((row(i) >= 0) & (row(i) < n), F.when(mirrored, other(row(i))).otherwise(row(i)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(grid, source(i)))


def reprojection_stats(errors: DataFrame, by: list[str] = [], sample="sample", error="error") -> DataFrame:  # noqa: B006
    """mean, median and largest of the samples' mean errors; 0 where there are none."""
    means = errors.groupBy(*by, sample).agg(F.avg(error).alias("_e"))
    return means.groupBy(*by).agg(*[F.coalesce(v, F.lit(0.0)).alias(n) for n, v in (("mean_px", F.avg("_e")), ("median_px", percentile("_e", 0.5)), ("max_px", F.max("_e")))])
