"""Inner corners of a checkerboard in gray frames: saddle points on tiles, then a board grown from one of them.

Corners of four fields are saddles of the blurred image: the Hessian's determinant is negative there and nowhere as much as at such a corner. Responses
are worked out tile by tile with a halo; what is left of a frame are its few saddles, from which the board is grown: a saddle whose four
neighbours lie opposite each other is the seed, and each corner predicts its neighbours' places from the last step.

Defined cases: a frame without a whole board gives no rows; of several boards the one with most corners counts; null pixels read as 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .idioms import pinned

#: Size of the blur, how far a saddle has to be the strongest, share of the frame's strongest that it needs, and how far from its predicted
#: place a corner may lie (in steps of the board).
BLUR, APART, SHARE, REACH = 7, 3, 0.25, 0.3
#: Radius of the window from whose gradients a corner's place follows, which all point across edges through it.
WINDOW = 4


def saddle_response(a: np.ndarray) -> np.ndarray:
    """(response, dx, dy): minus the determinant of the Hessian where it is negative and strongest around, and the corner's place from the pixel's
    centre: the point through which the edges of the window go, by least squares over its gradients."""
    g = np.pad(tiles.gaussian(BLUR)(a)[0], 1, mode="edge")
    x, y = (g[1:-1, 2:] - g[1:-1, :-2]) / 2, (g[2:, 1:-1] - g[:-2, 1:-1]) / 2
    xx, yy = g[1:-1, 2:] - 2 * g[1:-1, 1:-1] + g[1:-1, :-2], g[2:, 1:-1] - 2 * g[1:-1, 1:-1] + g[:-2, 1:-1]
    xy = (g[2:, 2:] - g[2:, :-2] - g[:-2, 2:] + g[:-2, :-2]) / 4
    det = xx * yy - xy * xy
    response = np.maximum(-det, 0)
    h, w = response.shape
    wide = np.pad(response, APART, constant_values=-1)
    top = np.max([wide[j : j + h, i : i + w] for j in range(2 * APART + 1) for i in range(2 * APART + 1)], axis=0)
    dx, dy, keep = np.zeros((h, w)), np.zeros((h, w)), np.zeros((h, w))
    at = np.nonzero((response == top) & (response > 0))
    if len(at[0]):
        place, good = _settled(x, y, np.stack([at[1], at[0]], axis=1).astype(float))
        dx[at], dy[at], keep[at] = place[:, 0] - at[1], place[:, 1] - at[0], good * response[at]
    return np.stack([keep, dx, dy])


def _settled(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether they settled near the start): in a window that moves along, gradients (x, y) stand across edges through the corner."""
    j, i = np.mgrid[-WINDOW : WINDOW + 1, -WINDOW : WINDOW + 1]
    i, j = i.ravel(), j.ravel()
    weight = np.exp(-(i * i + j * j) / WINDOW**2)
    place = start.copy()
    for _ in range(10):
        u, v = np.clip(place[:, :1] + i, 0, x.shape[1] - 1.001), np.clip(place[:, 1:] + j, 0, x.shape[0] - 1.001)
        iu, iv = u.astype(int), v.astype(int)
        iu, iv = np.minimum(iu, max(x.shape[1] - 2, 0)), np.minimum(iv, max(x.shape[0] - 2, 0))
        fu, fv = u - iu, v - iv
        gx, gy = ((m[iv, iu] * (1 - fu) + m[iv, iu + 1] * fu) * (1 - fv) + (m[iv + 1, iu] * (1 - fu) + m[iv + 1, iu + 1] * fu) * fv for m in (x, y))
        a, b, c = ((weight * v).sum(axis=1) for v in (gx * gx, gx * gy, gy * gy))
        p, q = (weight * gx * (gx * i + gy * j)).sum(axis=1), (weight * gy * (gx * i + gy * j)).sum(axis=1)
        both = np.where(a * c - b * b > 1e-9, a * c - b * b, np.inf)
        step = np.stack([(c * p - b * q) / both, (a * q - b * p) / both], axis=1)
        place = place + np.clip(step, -1, 1)
        if np.abs(step).max(initial=0) < 1e-3:
            break
    return place, np.isfinite(both) & (np.abs(place - start).max(axis=1) <= 1.5)


def saddles(pixels: DataFrame, by: list[str], value: str = "value", size: int = tiles.SIZE) -> DataFrame:
    """(by, x, y, response) of the saddles of frames (by, x, y, value), to a part of a pixel."""
    packed = tiles.packing(pixels.select(*by, "x", "y", value), by, [value], size)
    reach = BLUR // 2 + 3 + max(APART, WINDOW)
    answered = tiles.nearing(packed, by, 1, reach, saddle_response, size)
    found = pinned(tiles.unpack(answered, by, ["response", "dx", "dy"], positive=True))  # the few saddles of a frame, which are read twice
    top = found.groupBy(*by).agg(F.max("response").alias("_top"))
    strong = (found.join(top, by) if by else found.crossJoin(F.broadcast(top))).where(F.col("response") >= SHARE * F.col("_top"))  # one row
    return strong.select(*by, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "response")


def grow(points: np.ndarray, cols: int, rows: int, strength: np.ndarray | None = None) -> np.ndarray | None:
    """Corners (rows, cols, 2) of a board among points, or nothing. Where more fits than the board (its outer edge gives weak saddles too), the strongest
    cols x rows are taken."""
    strength = np.ones(len(points)) if strength is None else strength
    best: dict[tuple[int, int], int] = {}
    used: set[int] = set()
    for seed in np.argsort(np.hypot(*(points - points.mean(axis=0)).T)).tolist():
        if seed in used:
            continue
        away = points - points[seed]
        near = np.argsort(np.hypot(*away.T))[1:5]
        if len(near) < 4:
            return None
        u = away[near[0]]
        across = min(near[1:], key=lambda k: abs(away[k] @ u) / (np.hypot(*away[k]) * np.hypot(*u)))
        v = away[across]
        if abs(u[0] * v[1] - u[1] * v[0]) < 0.5 * np.hypot(*u) * np.hypot(*v):
            continue
        at = {(0, 0): seed}
        steps = {(0, 0): (u, v)}
        todo = [(0, 0)]
        taken = {seed}
        while todo:
            i, j = todo.pop(0)
            here, (a, b) = points[at[i, j]], steps[i, j]
            for di, dj, step in ((1, 0, a), (-1, 0, -a), (0, 1, b), (0, -1, -b)):
                if (i + di, j + dj) in at:
                    continue
                d = np.hypot(*(points - (here + step)).T)
                k = int(d.argmin())
                if d[k] <= REACH * np.hypot(*step) and k not in taken:
                    at[i + di, j + dj] = k
                    taken.add(k)
                    moved = points[k] - here
                    steps[i + di, j + dj] = (moved if di == 1 else -moved if di == -1 else a, moved if dj == 1 else -moved if dj == -1 else b)
                    todo.append((i + di, j + dj))
        used |= taken
        if len(at) > len(best):
            best = at
    found, most = None, -np.inf
    for w, h, turned in ((cols, rows, False), (rows, cols, True)):
        for i0 in sorted({i for i, _ in best}):
            for j0 in sorted({j for _, j in best}):
                at = [[best.get((i0 + i, j0 + j)) for i in range(w)] for j in range(h)]
                if all(k is not None for line in at for k in line) and strength[np.array(at)].sum() > most:
                    most, found = strength[np.array(at)].sum(), points[np.array(at)]
                    found = found.transpose(1, 0, 2) if turned else found
    return found


def canonical(board: np.ndarray) -> np.ndarray:
    """The board's first row grows in x and its first column in y."""
    if board[0, 0, 0] > board[0, -1, 0]:
        board = board[:, ::-1]
    return board[::-1] if board[0, 0, 1] > board[-1, 0, 1] else board


def find_boards(pixels: DataFrame, by: list[str], cols: int, rows: int, value: str = "value", size: int = tiles.SIZE) -> DataFrame:
    """(by, pos, x, y): the inner corners, row by row, of the cols x rows board that a frame shows."""
    found = saddles(pixels, by, value, size)
    types = dict(found.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        board = grow(pdf[["x", "y"]].to_numpy(float), cols, rows, pdf["response"].to_numpy(float)) if len(pdf) >= cols * rows else None
        at = canonical(board).reshape(-1, 2) if board is not None else np.empty((0, 2))
        return pd.DataFrame({**{n: [pdf[n].iloc[0]] * len(at) for n in by}, "pos": np.arange(len(at), dtype=np.int32), "x": at[:, 0], "y": at[:, 1]})

    grouped = found if by else found.withColumn("_all", F.lit(0))
    return grouped.groupBy(*(by or ["_all"])).applyInPandas(run, "".join(f"`{n}` {types[n]}, " for n in by) + "pos int, x double, y double")
