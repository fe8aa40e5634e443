"""Camera and stereo calibration from board views, and rectification of the pair.

A view is one row: its board points (x, y on the board's plane) and the pixels at which one camera, or both, see them. Parameters shared by
all views (a lens, or how the right camera stands to the left) are a handful of numbers on the driver. A round is one Spark job: each task
brings the pose of its views to its best for the shared parameters (batched Levenberg-Marquardt over six numbers a view), eliminates it from the
normal equations by its Schur complement, and adds what is left to one small sum; tasks' sums are added by an aggregate. Poses are
worked out anew from the view itself, so rounds leave nothing behind that a lost executor could take along.

Defined cases: views with fewer than four usable points, or whose points lie on a line, take no part; null or non-finite coordinates are no points;
without any view the calibration raises ValueError, as nothing is determined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import Rig, distort, rays
from .idioms import pinned

#: Views worked on together, rounds of a pose and of the shared parameters, and the relative gain at which rounds end.
TOGETHER, POSE_ROUNDS, POSE_GAIN, ROUNDS, GAIN = 256, 30, 1e-9, 60, 1e-13
LEAST_POINTS = 4


# --- views ------------------------------------------------------------------------------------------------------------------------


def views(corners: DataFrame, by: str = "view", pixels: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """(by, points): a row for each view of its corners (x, y and the pixels), in order of x and y. A board has a fixed number of them."""
    names = ["x", "y", *pixels]
    finite = F.lit(True)
    for n in names:
        finite = finite & F.col(n).isNotNull() & ~F.isnan(F.col(n)) & (F.abs(F.col(n)) < float("inf"))
    point = F.when(finite, F.struct(*[F.col(n).cast("double").alias(n) for n in names]))  # a filter would be pushed into the expressions of the pixels
    rows = corners.groupBy(by).agg(F.sort_array(F.collect_list(point)).alias("points"))
    return rows.where(F.size("points") >= LEAST_POINTS)


def _dealt(rows: DataFrame) -> DataFrame:
    """Views over all tasks: they are few bytes each, but work, and every round reads them."""
    return pinned(rows.select("points").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _flat(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Views whose points are one array of numbers, point by point, which numpy takes as it is; as structs each would be a Python dictionary."""
    return rows.withColumn("points", F.flatten(F.transform("points", lambda p: F.array(*[p[n] for n in names]))))


def _batches(pdf: pd.DataFrame, names: tuple[str, ...]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(rows, points (views, most points, names), weights 0 or 1) of flat views taken together."""
    for at in range(0, len(pdf), TOGETHER):
        part = pdf.iloc[at : at + TOGETHER]
        many = np.array([len(p) for p in part["points"]]) // len(names)
        on = np.arange(many.max()) < many[:, None]
        data, weight = np.zeros((*on.shape, len(names))), on.astype(float)
        data[on] = np.concatenate(list(part["points"])).reshape(-1, len(names))
        yield part, data, weight


# --- numbers of a batch of views ----------------------------------------------------------------------------------------------------


def turn(w: np.ndarray) -> np.ndarray:
    """Rotation matrices of rotation vectors (..., 3)."""
    angle = np.linalg.norm(w, axis=-1)[..., None, None]
    x, y, z = w[..., 0], w[..., 1], w[..., 2]
    o = np.zeros_like(x)
    k = np.stack([np.stack([o, -z, y], -1), np.stack([z, o, -x], -1), np.stack([-y, x, o], -1)], -2)
    small = angle < 1e-8
    safe = np.where(small, 1.0, angle)
    a, b = np.where(small, 1.0, np.sin(safe) / safe), np.where(small, 0.5, (1 - np.cos(safe)) / safe**2)
    return np.eye(3) + a * k + b * (k @ k)


def turn_vector(r: np.ndarray) -> np.ndarray:
    """Rotation vector of one rotation matrix."""
    w = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / 2
    sine, cosine = np.linalg.norm(w), (np.trace(r) - 1) / 2
    if sine > 1e-9:
        return w / sine * np.arctan2(sine, cosine)
    if cosine > 0:
        return w
    axis = np.sqrt(np.maximum((np.diag(r) + 1) / 2, 0))  # half a turn
    lead = int(axis.argmax())
    return np.pi * np.where(np.arange(3) == lead, axis, np.sign(r[lead]) * axis)


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(m)
    fix = np.ones(m.shape[:-2] + (3,))
    fix[..., 2] = np.linalg.det(u @ v)
    return (u * fix[..., None, :]) @ v


def homographies(source: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of each view the 3 x 3 matrix that maps source points to target points best (normalised direct linear transform)."""

    def normal(p):
        n = weight.sum(axis=1)[:, None]
        mean = (p * weight[..., None]).sum(axis=1) / n
        spread = np.sqrt((((p - mean[:, None]) ** 2).sum(axis=2) * weight).sum(axis=1) / n[:, 0] / 2)
        s = 1 / np.where(spread > 0, spread, 1)
        m = np.zeros((len(p), 3, 3))
        m[:, 0, 0], m[:, 1, 1], m[:, 2, 2], m[:, :2, 2] = s, s, 1, -s[:, None] * mean
        return (p - mean[:, None]) * s[:, None, None], m

    (p, tp), (q, tq) = normal(source), normal(target)
    o, one = np.zeros(p.shape[:2]), np.ones(p.shape[:2])
    x, y, u, v = p[..., 0], p[..., 1], q[..., 0], q[..., 1]
    rows = np.concatenate([np.stack([x, y, one, o, o, o, -u * x, -u * y, -u], -1), np.stack([o, o, o, x, y, one, -v * x, -v * y, -v], -1)], axis=1)
    rows *= np.concatenate([weight, weight], axis=1)[..., None]
    h = np.linalg.eigh(np.swapaxes(rows, 1, 2) @ rows)[1][:, :, 0].reshape(-1, 3, 3)
    return np.linalg.inv(tq) @ h @ tp


def board_poses(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rotations, translations) of boards from homographies onto normalised coordinates; boards lie before the camera."""
    scale = 2 / (np.linalg.norm(h[:, :, 0], axis=1) + np.linalg.norm(h[:, :, 1], axis=1))
    h = h * (scale * np.where(h[:, 2, 2] < 0, -1, 1))[:, None, None]
    r = np.stack([h[:, :, 0], h[:, :, 1], np.cross(h[:, :, 0], h[:, :, 1])], axis=2)
    return nearest_rotation(r), h[:, :, 2]


def seen(points: np.ndarray, lens_of: np.ndarray, by_lens: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(pixels, their derivatives by the camera point, and by the lens where asked for) of camera points (..., 3). lens_of: fx, fy, cx, cy, then
    up to 8 coefficients in the usual order k1 k2 p1 p2 k3 k4 k5 k6."""
    fx, fy, cx, cy = lens_of[:4]
    d = np.zeros(8)
    d[: len(lens_of) - 4] = lens_of[4:]
    k1, k2, p1, p2, k3, k4, k5, k6 = d
    z = np.where(np.abs(points[..., 2]) < 1e-12, 1e-12, points[..., 2])
    x, y = points[..., 0] / z, points[..., 1] / z
    r2 = x * x + y * y
    up, down = 1 + r2 * (k1 + r2 * (k2 + r2 * k3)), 1 + r2 * (k4 + r2 * (k5 + r2 * k6))
    radial = up / down
    slope = (k1 + r2 * (2 * k2 + 3 * r2 * k3)) / down - radial * (k4 + r2 * (2 * k5 + 3 * r2 * k6)) / down
    xd, yd = x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    pixels = np.stack([fx * xd + cx, fy * yd + cy], -1)
    xx, xy = radial + 2 * x * x * slope + 2 * p1 * y + 6 * p2 * x, 2 * x * y * slope + 2 * p1 * x + 2 * p2 * y
    yy = radial + 2 * y * y * slope + 6 * p1 * y + 2 * p2 * x
    by_point = np.stack([np.stack([fx * xx / z, fx * xy / z, -fx * (xx * x + xy * y) / z], -1), np.stack([fy * xy / z, fy * yy / z, -fy * (xy * x + yy * y) / z], -1)], -2)
    if not by_lens:
        return pixels, by_point, None
    o, one = np.zeros_like(x), np.ones_like(x)
    r4, r6 = r2 * r2, r2 * r2 * r2
    u = [xd, o, one, o, fx * x * r2 / down, fx * x * r4 / down, fx * 2 * x * y, fx * (r2 + 2 * x * x), fx * x * r6 / down, -fx * x * radial * r2 / down, -fx * x * radial * r4 / down, -fx * x * radial * r6 / down]
    v = [o, yd, o, one, fy * y * r2 / down, fy * y * r4 / down, fy * (r2 + 2 * y * y), fy * 2 * x * y, fy * y * r6 / down, -fy * y * radial * r2 / down, -fy * y * radial * r4 / down, -fy * y * radial * r6 / down]
    n = len(lens_of)
    return pixels, by_point, np.stack([np.stack(u[:n], -1), np.stack(v[:n], -1)], -2)


def cross(p: np.ndarray) -> np.ndarray:
    """Matrices of the cross product with vectors (..., 3)."""
    o = np.zeros_like(p[..., 0])
    return np.stack([np.stack([o, -p[..., 2], p[..., 1]], -1), np.stack([p[..., 2], o, -p[..., 0]], -1), np.stack([-p[..., 1], p[..., 0], o], -1)], -2)


def by_pose_of(points: np.ndarray, by_point: np.ndarray) -> np.ndarray:
    """Derivatives (..., 2, 6) by a turn about the origin and a shift of points (..., 3), from those by the point (..., 2, 3)."""
    (x, y, z), (a, b, c) = np.moveaxis(points[..., None, :], -1, 0), np.moveaxis(by_point, -1, 0)
    return np.stack([y * c - z * b, z * a - x * c, x * b - y * a, a, b, c], -1)


#: (residuals, derivatives by what is shared unless only the pose is asked for, by the pose)
Residuals = Callable[..., tuple[np.ndarray, np.ndarray | None, np.ndarray]]


def mono_residuals(shared: np.ndarray, data: np.ndarray, r: np.ndarray, t: np.ndarray, whole: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(residuals, derivatives by the lens, by the pose) of one camera; data has x, y, u, v."""
    turned = data[..., :2] @ np.swapaxes(r[:, :, :2], 1, 2)  # boards are flat
    pixels, by_point, by_lens = seen(turned + t[:, None], shared, whole)
    return pixels - data[..., 2:4], by_lens, by_pose_of(turned, by_point)


def stereo_residuals(rig: Rig) -> Residuals:
    """Of both cameras with known lenses: shared is the rotation vector and translation from left to right, data has x, y, uL, vL, uR, vR."""
    left, right = (np.concatenate([[k[0, 0], k[1, 1], k[0, 2], k[1, 2]], d[:8]]) for k, d in ((rig.k1, rig.d1), (rig.k2, rig.d2)))

    def run(shared: np.ndarray, data: np.ndarray, r: np.ndarray, t: np.ndarray, whole: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        turned = data[..., :2] @ np.swapaxes(r[:, :, :2], 1, 2)
        here = turned + t[:, None]
        over = turn(shared[:3])
        there = here @ over.T
        pixels_l, by_l, _ = seen(here, left, False)
        pixels_r, by_r, _ = seen(there + shared[3:], right, False)
        residual = np.concatenate([pixels_l - data[..., 2:4], pixels_r - data[..., 4:6]], -1)
        by_pose = np.concatenate([by_pose_of(turned, by_l), by_pose_of(turned, by_r @ over)], -2)
        if not whole:
            return residual, None, by_pose
        by_shared = by_pose_of(there, by_r)
        return residual, np.concatenate([np.zeros_like(by_shared), by_shared], -2), by_pose

    return run


def best_poses(residuals: Residuals, shared: np.ndarray, data: np.ndarray, weight: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Poses at their least squared error for the shared parameters. Views go on together, each until its own error falls no more."""
    best_r, best_t = r.copy(), t.copy()
    views, damp = np.arange(len(data)), np.full(len(data), 1e-3)
    w, floor = weight[..., None], 1e-22 * weight.sum(axis=1)
    e, _, j = residuals(shared, data, r, t, False)
    cost = ((e * w) ** 2).sum(axis=(1, 2))
    for _ in range(POSE_ROUNDS):
        jw = (j * w[..., None]).reshape(len(views), -1, 6)
        to = np.swapaxes(jw, 1, 2)
        a, g = to @ jw, to @ (e * w).reshape(len(views), -1, 1)
        step = -np.linalg.solve(a + (damp[:, None] * np.einsum("vii->vi", a) + 1e-12)[:, :, None] * np.eye(6), g)[..., 0]
        new_r, new_t = turn(step[:, :3]) @ r, t + step[:, 3:]
        new_e, _, new_j = residuals(shared, data, new_r, new_t, False)
        new_cost = ((new_e * w) ** 2).sum(axis=(1, 2))
        good = np.isfinite(new_cost) & (new_cost <= cost)
        best_r[views[good]], best_t[views[good]] = new_r[good], new_t[good]
        damp = np.clip(np.where(good, damp * 0.1, damp * 10), 1e-15, 1e9)
        # a step that changes the error by no more than its rounding ends the view too
        done = (np.abs(new_cost - cost) <= POSE_GAIN * cost) | (good & (new_cost <= floor)) | (~good & (damp > 1e6))
        if done.all():
            break
        go = ~done
        pick = good[go, None, None]
        r, t = np.where(pick, new_r[go], r[go]), np.where(good[go, None], new_t[go], t[go])
        e, j = np.where(pick, new_e[go], e[go]), np.where(pick[..., None], new_j[go], j[go])
        views, damp, cost, data, w, floor = views[go], damp[go], np.where(good, new_cost, cost)[go], data[go], w[go], floor[go]
    return best_r, best_t


def reduced(residuals: Residuals, shared: np.ndarray, data: np.ndarray, weight: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(matrix, gradient, squared error, points) of the shared parameters, the poses eliminated."""
    w = weight[..., None]
    e, by_shared, by_pose = residuals(shared, data, r, t)
    n, m = len(data), len(shared)
    e, a, b = (e * w).reshape(n, -1), (by_shared * w[..., None]).reshape(n, -1, m), (by_pose * w[..., None]).reshape(n, -1, 6)
    u, v, mixed = np.swapaxes(a, 1, 2) @ a, np.swapaxes(b, 1, 2) @ b, np.swapaxes(a, 1, 2) @ b
    solved = np.linalg.solve(v + 1e-12 * np.eye(6), np.concatenate([np.swapaxes(mixed, 1, 2), np.einsum("vni,vn->vi", b, e)[..., None]], -1))
    return (u - mixed @ solved[..., :m]).sum(axis=0), (np.einsum("vni,vn->vi", a, e) - np.einsum("vij,vj->vi", mixed, solved[..., m])).sum(axis=0), float((e**2).sum()), float(weight.sum())


# --- rounds over all views ----------------------------------------------------------------------------------------------------------


def _summed(rows: DataFrame, numbers: Callable[[Iterator[pd.DataFrame]], np.ndarray], size: int) -> np.ndarray:
    """The sum over tasks of each task's numbers, a vector of a known small size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"i": np.arange(size), "v": numbers(frames)})

    got = rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r.v for r in got]) if got else np.zeros(size)


def start_poses(shared_lens: np.ndarray, data: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Poses from the homographies of boards onto the lens's undistorted coordinates."""
    k = np.array([[shared_lens[0], 0, shared_lens[2]], [0, shared_lens[1], shared_lens[3]], [0, 0, 1]])
    d = np.zeros(14)
    d[: len(shared_lens) - 4] = shared_lens[4:]
    flat = rays(data[..., 2:4].reshape(-1, 2), k, d, 5).reshape(data.shape[:2] + (2,))
    return board_poses(homographies(data[..., :2], np.clip(np.nan_to_num(flat), -1e3, 1e3), weight))


def refine(rows: DataFrame, names: tuple[str, ...], residuals: Residuals, shared: np.ndarray, lens_at: Callable[[np.ndarray], np.ndarray], move: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add, least_gain: float = GAIN) -> tuple[np.ndarray, float]:
    """(shared parameters, root mean square error in pixels a point) at the least squared error, from a start on. lens_at: the lens that poses start from;
    move: parameters after a step."""
    m = len(shared)

    def at(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        def numbers(frames: Iterator[pd.DataFrame]) -> np.ndarray:
            out = np.zeros(m * m + m + 2)
            for pdf in frames:
                for _, data, weight in _batches(pdf, names):
                    r, t = best_poses(residuals, values, data, weight, *start_poses(lens_at(values), data, weight))
                    a, g, cost, n = reduced(residuals, values, data, weight, r, t)
                    out += np.concatenate([a.ravel(), g, [cost, n]])
            return out

        s = _summed(rows, numbers, m * m + m + 2)
        return s[: m * m].reshape(m, m), s[m * m : -2], s[-2], s[-1]

    a, g, cost, n = at(shared)
    if not n:
        raise ValueError("no view with enough points")
    damp = 1e-3
    for _ in range(ROUNDS):
        step = -np.linalg.lstsq(a + damp * np.diag(np.diag(a)), g, rcond=1e-15)[0]
        new = move(shared, step)
        new_a, new_g, new_cost, _ = at(new)
        if np.isfinite(new_cost) and new_cost <= cost:
            gain = cost - new_cost
            shared, a, g, cost, damp = new, new_a, new_g, new_cost, max(damp * 0.1, 1e-15)
            if gain <= least_gain * cost or cost <= 1e-18 * n:
                break
        else:
            damp *= 10
            if damp > 1e8:
                break
    return shared, float(np.sqrt(cost / n))


# --- calibration --------------------------------------------------------------------------------------------------------------------


def start_lens(rows: DataFrame, names: tuple[str, ...], size: tuple[int, int]) -> np.ndarray:
    """Focal lengths in closed form from all views' homographies, with the middle of the image as the principal point: columns of a rotation are
    orthogonal and of one length."""
    cx, cy = (size[0] - 1) / 2, (size[1] - 1) / 2

    def numbers(frames: Iterator[pd.DataFrame]) -> np.ndarray:
        out = np.zeros(7)
        for pdf in frames:
            for _, data, weight in _batches(pdf, names):
                h = homographies(data[..., :2], data[..., 2:4], weight)
                h = h - np.array([cx, cy, 0])[:, None] * h[:, 2:3, :]
                one, two = h[:, :, 0], h[:, :, 1]
                plus, minus = (one + two) / 2, (one - two) / 2
                unit = [np.linalg.norm(v, axis=1)[:, None] for v in (one, two, plus, minus)]
                one, two, plus, minus = one / unit[0], two / unit[1], plus / unit[2], minus / unit[3]
                for p, q in ((one, two), (plus, minus)):
                    a = (p * q)[:, :2]
                    b = -(p * q)[:, 2]
                    out += np.concatenate([(a.T @ a).ravel(), a.T @ b, [len(a)]])
        return out

    s = _summed(rows, numbers, 7)
    if not s[-1]:
        raise ValueError("no view with enough points")
    inverse = np.linalg.lstsq(s[:4].reshape(2, 2), s[4:6], rcond=None)[0]  # 1 / fx^2, 1 / fy^2
    wide = float(max(size))
    f = [np.sqrt(1 / v) if v > 1e-12 else wide for v in inverse]
    return np.array([f[0], f[1], cx, cy])


def calibrate_camera(corners: DataFrame, size: tuple[int, int], coefficients: int = 8, by: str = "view", pixels: tuple[str, str] = ("u", "v")) -> tuple[np.ndarray, np.ndarray, float]:
    """(K, distortion, root mean square error) of a camera from its views' corners (by, x, y, pixels). coefficients: 0, 2, 4, 5 or 8 (rational)."""
    names = ("x", "y", *pixels)
    rows = _dealt(_flat(views(corners, by, pixels), names))
    found = start_lens(rows, names, size)
    for n in sorted({0, min(2, coefficients), min(5, coefficients), coefficients}):  # each lens starts from a simpler one
        found, rms = refine(rows, names, mono_residuals, np.concatenate([found, np.zeros(4 + n - len(found))]), lambda v: v, least_gain=GAIN if n == coefficients else 1e-2)
    k = np.array([[found[0], 0, found[2]], [0, found[1], found[3]], [0, 0, 1]])
    return k, found[4:], rms


def view_poses(corners: DataFrame, k: np.ndarray, d: np.ndarray, by: str = "view", pixels: tuple[str, str] = ("u", "v")) -> DataFrame:
    """(by, rx, ry, rz, tx, ty, tz, rms): the pose of each view's board for a known lens, and its error."""
    shared = np.concatenate([[k[0, 0], k[1, 1], k[0, 2], k[1, 2]], np.ravel(d)[:8]])
    names = ("x", "y", *pixels)
    out = ["rx", "ry", "rz", "tx", "ty", "tz", "rms"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part, data, weight in _batches(pdf, names):
                r, t = best_poses(mono_residuals, shared, data, weight, *start_poses(shared, data, weight))
                e, _, _ = mono_residuals(shared, data, r, t)
                rms = np.sqrt(((e * weight[..., None]) ** 2).sum(axis=(1, 2)) / weight.sum(axis=1))
                yield pd.concat([part[[by]].reset_index(drop=True), pd.DataFrame(np.column_stack([np.array([turn_vector(x) for x in r]), t, rms]), columns=out)], axis=1)

    rows = _flat(views(corners, by, pixels), names)
    return rows.mapInPandas(run, f"`{by}` {dict(rows.dtypes)[by]}, " + ", ".join(f"{n} double" for n in out))


def calibrate_stereo(corners: DataFrame, k1, d1, k2, d2, by: str = "view") -> tuple[Rig, float]:
    """(rig, root mean square error a point of both cameras) from views that both cameras see (by, x, y, uL, vL, uR, vR), the lenses known."""
    names = ("x", "y", "uL", "vL", "uR", "vR")
    rig = Rig(k1, d1, k2, d2, np.eye(3), np.zeros(3))
    left, right = (np.concatenate([[k[0, 0], k[1, 1], k[0, 2], k[1, 2]], d[:8]]) for k, d in ((rig.k1, rig.d1), (rig.k2, rig.d2)))
    rows = _dealt(_flat(views(corners, by, names[2:]), names))

    def numbers(frames: Iterator[pd.DataFrame]) -> np.ndarray:
        out = np.zeros(13)
        for pdf in frames:
            for _, data, weight in _batches(pdf, names):
                r1, t1 = best_poses(mono_residuals, left, data[..., :4], weight, *start_poses(left, data, weight))
                other = data[..., [0, 1, 4, 5]]
                r2, t2 = best_poses(mono_residuals, right, other, weight, *start_poses(right, other, weight))
                over = r2 @ np.swapaxes(r1, 1, 2)
                out += np.concatenate([over.sum(axis=0).ravel(), (t2 - np.einsum("vij,vj->vi", over, t1)).sum(axis=0), [len(over)]])
        return out

    s = _summed(rows, numbers, 13)
    if not s[-1]:
        raise ValueError("no view with enough points")
    start = np.concatenate([turn_vector(nearest_rotation(s[:9].reshape(3, 3))), s[9:12] / s[12]])

    def move(shared: np.ndarray, step: np.ndarray) -> np.ndarray:
        return np.concatenate([turn_vector(turn(step[:3]) @ turn(shared[:3])), shared[3:] + step[3:]])

    shared, rms = refine(rows, names, stereo_residuals(rig), start, lambda v: left, move)
    return Rig(k1, d1, k2, d2, turn(shared[:3]), shared[3:]), rms


def essential(rig: Rig) -> np.ndarray:
    return cross(rig.t) @ rig.r


def fundamental(rig: Rig) -> np.ndarray:
    """Maps a left pixel to its line in the right image; the last entry is 1 where it is not 0."""
    f = np.linalg.inv(rig.k2).T @ essential(rig) @ np.linalg.inv(rig.k1)
    return f / f[2, 2] if abs(f[2, 2]) > 1e-300 else f


# --- rectification ------------------------------------------------------------------------------------------------------------------


class Rectification:
    """r1, r2: rotations of the cameras; p1, p2: 3 x 4 projections of the rectified pair; q: 4 x 4 from disparity to depth."""

    def __init__(self, rig: Rig, size: tuple[int, int], alpha: float = -1.0) -> None:
        """alpha: 0 shows valid pixels only, 1 all source pixels, between them a mix; negative leaves the focal length as it is."""
        self.rig, self.size = rig, size
        w, h = size
        half = turn(-turn_vector(rig.r) / 2)  # both cameras turn half the way
        t = half @ rig.t
        self.axis = 0 if abs(t[0]) > abs(t[1]) else 1
        along = np.zeros(3)
        along[self.axis] = 1 if t[self.axis] > 0 else -1
        about = np.cross(t, along)
        if np.linalg.norm(about) > 0:
            about *= np.arccos(np.clip(abs(t[self.axis]) / np.linalg.norm(t), -1, 1)) / np.linalg.norm(about)
        level = turn(about)
        self.r1, self.r2 = level @ half.T, level @ half
        base = self.r2 @ rig.t
        other = 1 - self.axis
        focal = min(k[other, other] * (1 + d[0] * (w * w + h * h) / (4 * k[other, other] ** 2) if d[0] < 0 else 1) for k, d in ((rig.k1, rig.d1), (rig.k2, rig.d2)))
        centres = []
        for k, d, r in ((rig.k1, rig.d1, self.r1), (rig.k2, rig.d2, self.r2)):
            corners = np.array([[0, 0], [w - 1, 0], [0, h - 1], [w - 1, h - 1]], float)
            centres.append(np.array([(w - 1) / 2, (h - 1) / 2]) - focal * self._turned(corners, k, d, r).mean(axis=0))
        centre = (centres[0] + centres[1]) / 2
        if alpha >= 0:
            focal *= self._zoom(focal, centre, alpha)
        self.focal, self.centre = float(focal), centre
        self.p1 = np.array([[focal, 0, centre[0], 0], [0, focal, centre[1], 0], [0, 0, 1, 0]])
        self.p2 = self.p1.copy()
        self.p2[self.axis, 3] = base[self.axis] * focal
        self.q = np.array([[1, 0, 0, -centre[0]], [0, 1, 0, -centre[1]], [0, 0, 0, focal], [0, 0, -1 / base[self.axis], 0]])

    @staticmethod
    def _turned(pixels: np.ndarray, k: np.ndarray, d: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Normalised coordinates of pixels in the turned camera."""
        p = np.concatenate([rays(pixels, k, d), np.ones((len(pixels), 1))], axis=1) @ r.T
        return p[:, :2] / p[:, 2:]

    def _zoom(self, focal: float, centre: np.ndarray, alpha: float) -> float:
        w, h = self.size
        n = 9
        grid = np.array([[x * (w - 1) / (n - 1), y * (h - 1) / (n - 1)] for y in range(n) for x in range(n)])
        inside, outside = [], []
        for k, d, r in ((self.rig.k1, self.rig.d1, self.r1), (self.rig.k2, self.rig.d2, self.r2)):
            p = (focal * self._turned(grid, k, d, r) + centre).reshape(n, n, 2)
            valid = (p[:, 0, 0].max(), p[0, :, 1].max(), p[:, -1, 0].min(), p[-1, :, 1].min())
            whole = (p[..., 0].min(), p[..., 1].min(), p[..., 0].max(), p[..., 1].max())
            for (x0, y0, x1, y1), into in ((valid, inside), (whole, outside)):
                into += [centre[0] / (centre[0] - x0), centre[1] / (centre[1] - y0), (w - centre[0]) / (x1 - centre[0]), (h - centre[1]) / (y1 - centre[1])]
        return max(inside) * (1 - alpha) + min(outside) * alpha

    def source(self, u: np.ndarray, v: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where in its camera's image rectified pixels (u, v) come from."""
        k, d, r = (self.rig.k2, self.rig.d2, self.r2) if right else (self.rig.k1, self.rig.d1, self.r1)
        x, y = (u - float(self.centre[0])) / self.focal, (v - float(self.centre[1])) / self.focal
        a, b, c = (x * float(m[0]) + y * float(m[1]) + float(m[2]) for m in r.T)
        xd, yd = distort(a / c, b / c, d)
        return xd * float(k[0, 0]) + yd * float(k[0, 1]) + float(k[0, 2]), yd * float(k[1, 1]) + float(k[1, 2])

    def pixels(self, points: DataFrame, right: bool, u: str = "u", v: str = "v", out: tuple[str, str] = ("ru", "rv")) -> DataFrame:
        """points with the rectified place of each pixel (u, v) of a camera's image."""
        k, d, r = (self.rig.k2, self.rig.d2, self.r2) if right else (self.rig.k1, self.rig.d1, self.r1)
        focal, centre = self.focal, self.centre

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                p = pdf[[u, v]].to_numpy(float)
                ok = np.isfinite(p).all(axis=1)
                at = np.full(p.shape, np.nan)
                at[ok] = focal * Rectification._turned(p[ok], k, d, r) + centre
                yield pdf.assign(**{out[0]: at[:, 0], out[1]: at[:, 1]})

        rows = points.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in points.dtypes) + f", {out[0]} double, {out[1]} double")
        return rows.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in out})


def rectify_map(spark: SparkSession, flat: Rectification, right: bool) -> DataFrame:
    """(u, v, sx, sy): for each pixel of the rectified image where it comes from."""
    w, h = flat.size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            u, v = pdf["id"].to_numpy() % w, pdf["id"].to_numpy() // w
            sx, sy = flat.source(u.astype(float), v.astype(float), right)
            yield pd.DataFrame({"u": u, "v": v, "sx": sx, "sy": sy})

    return spark.range(w * h).mapInPandas(run, "u int, v int, sx double, sy double")


def remap(pixels: DataFrame, source: DataFrame, by: list[str], tile: int = 64) -> DataFrame:
    """(by, u, v, value): images (by, x, y, value 0 to 255) seen through a map (u, v, sx, sy), between pixels bilinearly, places in steps of 1/32 and
    what lies outside as 0, rounded half up.

    Pixels become tiles of one row each, with the first row and column of the tiles right and below (the halo), so that the four neighbours of
    any place lie in one tile; tiles and places meet in an equi join on the tile's number. Tiles without a pixel give 0.
    """
    size = tile + 1
    near = lambda n: F.explode(F.when(F.col(n) % tile == 0, F.array(F.floor(F.col(n) / tile), F.floor(F.col(n) / tile) - 1)).otherwise(F.array(F.floor(F.col(n) / tile))))
    spread = pixels.withColumn("_tx", near("x")).withColumn("_ty", near("y"))
    place = ((F.col("y") - F.col("_ty") * tile) * size + F.col("x") - F.col("_tx") * tile).cast("int")
    tiles = spread.groupBy(*by, "_tx", "_ty").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("k"), F.col("value").cast("long").alias("v")))).alias("_data"))
    at = source.select("u", "v", F.rint(F.col("sx") * 32).cast("long").alias("_sx"), F.rint(F.col("sy") * 32).cast("long").alias("_sy"))
    at = at.select("u", "v", *[F.floor(F.col(f"_s{a}") / 32).alias(f"_i{a}") for a in "xy"], *[F.pmod(F.col(f"_s{a}"), F.lit(32)).alias(f"_f{a}") for a in "xy"])
    at = at.withColumns({f"_t{a}": F.floor(F.col(f"_i{a}") / tile) for a in "xy"})
    first = ((F.col("_iy") - F.col("_ty") * tile) * size + F.col("_ix") - F.col("_tx") * tile).cast("int")
    get = lambda k: F.coalesce(F.try_element_at("_data", first + k), F.lit(0).cast("long"))
    fx, fy = F.col("_fx"), F.col("_fy")
    total = (32 - fy) * ((32 - fx) * get(0) + fx * get(1)) + fy * ((32 - fx) * get(size) + fx * get(size + 1))
    images = pixels.select(*by).distinct()
    seen_ = tiles.join(at, ["_tx", "_ty"]).select(*by, "u", "v", F.floor((total + 512) / 1024).cast("int").alias("value"))
    # places whose tile an image does not have are 0: every image has every place of the map
    every = images.join(F.broadcast(source.agg(F.max("u").alias("_w"), F.max("v").alias("_h"))))
    blank = every.select(*by, F.explode(F.sequence(F.lit(0), F.col("_h"))).alias("v"), F.col("_w")).select(*by, F.explode(F.sequence(F.lit(0), F.col("_w"))).alias("u"), "v")
    return blank.join(seen_, [*by, "u", "v"], "left").select(*by, "u", "v", F.coalesce("value", F.lit(0)).alias("value"))
