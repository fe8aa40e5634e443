"""Calibration, rectification and remapping on made-up rigs."""

import numpy as np
import pytest


from markerflow.operators import calibration as cal
from markerflow.operators import geometry as geo

RIG = geo.Rig([700, 0, 320, 0, 705, 240, 0, 0, 1], [-0.2, 0.05, 0.001, -0.0005, 0.01], [710, 0, 325, 0, 700, 236, 0, 0, 1], [-0.18, 0.04, 0.0, 0.0005, 0.0], cal.turn(np.array([0.01, -0.06, 0.02])), [-0.25, 0.01, 0.005])
SIZE = (640, 480)


def corners(n, seed, noise=0.0):
    rng = np.random.default_rng(seed)
    board = np.array([[0.03 * i - 0.12, 0.03 * j - 0.07, 0.0] for j in range(6) for i in range(9)])
    out = []
    for v in range(n):
        r, t = cal.turn(rng.uniform(-0.5, 0.5, 3)), np.array([rng.uniform(-0.1, 0.1), rng.uniform(-0.08, 0.08), rng.uniform(0.45, 0.9)])
        p = board @ r.T + t
        q = p @ RIG.r.T + RIG.t
        sides = []
        for points, k, d in ((p, RIG.k1, RIG.d1), (q, RIG.k2, RIG.d2)):
            x, y = geo.distort(points[:, 0] / points[:, 2], points[:, 1] / points[:, 2], d)
            sides.append(np.stack([k[0, 0] * x + k[0, 2], k[1, 1] * y + k[1, 2]], axis=1) + rng.normal(0, noise, (len(p), 2)) if noise else np.stack([k[0, 0] * x + k[0, 2], k[1, 1] * y + k[1, 2]], axis=1))
        out += [(v, float(a), float(b), *map(float, (*l, *r_)), *map(float, t)) for (a, b, _), l, r_ in zip(board, *sides)]
    return out


SCHEMA = "view long, x double, y double, uL double, vL double, uR double, vR double, tx double, ty double, tz double"


def test_lens_and_rig_are_found_again(spark):
    rows = corners(12, 1)
    rows += [(90, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0)] * 3 + [(91, float(i), None, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0) for i in range(9)]  # too few points, and none
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    k, d, rms = cal.calibrate_camera(df, SIZE, 5, pixels=("uL", "vL"))
    assert np.allclose(k, RIG.k1, atol=1e-5) and np.allclose(d, RIG.d1[:5], atol=1e-6) and rms < 1e-7
    found, rms = cal.calibrate_stereo(df, RIG.k1, RIG.d1, RIG.k2, RIG.d2)
    assert np.allclose(found.r, RIG.r, atol=1e-9) and np.allclose(found.t, RIG.t, atol=1e-9) and rms < 1e-8
    poses = {r.view: r for r in cal.view_poses(df.where("view < 12").drop("tx", "ty", "tz"), RIG.k1, RIG.d1, pixels=("uL", "vL")).collect()}
    truth = {r[0]: r[7:] for r in rows if r[0] < 12}
    assert all(np.allclose([poses[v].tx, poses[v].ty, poses[v].tz], t, atol=1e-8) for v, t in truth.items()) and len(poses) == 12
    e, f = cal.essential(RIG), cal.fundamental(RIG)
    assert np.allclose(np.linalg.svd(e)[1][2], 0, atol=1e-12) and np.isclose(f[2, 2], 1)
    with pytest.raises(ValueError, match="no view"):
        cal.calibrate_camera(df.where("view = 90"), SIZE, 5, pixels=("uL", "vL"))


def test_noise_is_averaged_out(spark):
    df = spark.createDataFrame(corners(30, 2, 0.2), SCHEMA)
    k, d, rms = cal.calibrate_camera(df, SIZE, 8, pixels=("uL", "vL"))
    assert abs(k[0, 0] - 700) < 5 and abs(k[0, 2] - 320) < 5 and 0.2 < rms < 0.35 and len(d) == 8
    found, rms = cal.calibrate_stereo(df, RIG.k1, RIG.d1, RIG.k2, RIG.d2)
    assert np.allclose(found.r, RIG.r, atol=2e-3) and np.allclose(found.t, RIG.t, atol=2e-3) and 0.35 < rms < 0.45


def test_derivatives_are_those_of_differences():
    rng = np.random.default_rng(0)
    lens = np.array([700, 710, 320, 240, -0.1, 0.02, 0.001, -0.002, 0.01, 0.02, -0.01, 0.005])
    points = rng.uniform(-0.3, 0.3, (5, 3)) + [0, 0, 1.2]
    _, by_point, by_lens = cal.seen(points, lens)
    for i in range(len(lens)):
        h = 1e-6 * max(1, abs(lens[i]))
        up, down = (cal.seen(points, lens + s * h * np.eye(len(lens))[i])[0] for s in (1, -1))
        assert np.allclose((up - down) / (2 * h), by_lens[..., i], rtol=1e-5, atol=1e-4)
    for i in range(3):
        up, down = (cal.seen(points + s * 1e-6 * np.eye(3)[i], lens)[0] for s in (1, -1))
        assert np.allclose((up - down) / 2e-6, by_point[..., i], rtol=1e-5, atol=1e-3)
    for w in ([0, 0, 0], [0.3, -0.2, 0.9], [np.pi, 0, 0], [0, 2.0, -2.2], [1e-9, 0, 0]):
        r = cal.turn(np.array(w, float))
        assert np.allclose(cal.turn(cal.turn_vector(r)), r, atol=1e-9)


@pytest.mark.parametrize("alpha", [-1.0, 0.0, 1.0])
def test_rectified_rows_agree(spark, alpha):
    flat = cal.Rectification(RIG, SIZE, alpha)
    assert np.allclose(flat.r1 @ flat.r1.T, np.eye(3)) and np.allclose(flat.r2 @ RIG.r @ flat.r1.T, np.eye(3), atol=1e-12)
    df = spark.createDataFrame(corners(3, 3), SCHEMA).select("view", "x", "y", "uL", "vL", "uR", "vR")
    both = flat.pixels(flat.pixels(df, False, "uL", "vL", ("a", "b")), True, "uR", "vR", ("c", "d")).toPandas()
    assert np.allclose(both.b, both.d, atol=1e-8) and (both.a > both.c).all()
    u, v = flat.source(both.a.to_numpy(), both.b.to_numpy(), False)
    assert np.allclose(u, both.uL, atol=1e-6) and np.allclose(v, both.vL, atol=1e-6)
    if alpha == 0:  # no place of the result lies outside the source
        edge = np.array([[0, 0], [639, 0], [0, 479], [639, 479], [320, 0], [320, 479], [0, 240], [639, 240]], float)
        for right in (False, True):
            x, y = flat.source(edge[:, 0], edge[:, 1], right)
            assert x.min() > -2 and x.max() < 641 and y.min() > -2 and y.max() < 481


@pytest.mark.parametrize("tile", [5, 16, 100])
def test_remap(spark, tile):
    rng = np.random.default_rng(5)
    w, h = 23, 17
    images = {k: rng.integers(0, 256, (h, w)) for k in (1, 2)}
    rows = [(k, x, y, int(im[y, x])) for k, im in images.items() for y in range(h) for x in range(w) if (k, x, y) != (2, 3, 3)]
    images[2][3, 3] = 0
    place = [(u, v, float(u * 1.1 - 1.3 + 0.1 * v), float(v * 0.9 + 0.7 * np.sin(u))) for u in range(20) for v in range(15)] + [(20, 0, 500.0, -3.0)]
    df = spark.createDataFrame(rows, "image int, x int, y int, value int").repartition(3)
    got = cal.remap(df, spark.createDataFrame(place, "u int, v int, sx double, sy double"), ["image"], tile).collect()
    at = {(r.image, r.u, r.v): r.value for r in got}
    assert len(at) == len(got)
    for k, im in images.items():
        get = lambda x, y: int(im[y, x]) if 0 <= x < w and 0 <= y < h else 0  # noqa: B023, E731
        for u, v, sx, sy in place:
            ix, iy = int(np.rint(sx * 32)), int(np.rint(sy * 32))
            x, fx, y, fy = ix >> 5, ix & 31, iy >> 5, iy & 31
            total = (32 - fy) * ((32 - fx) * get(x, y) + fx * get(x + 1, y)) + fy * ((32 - fx) * get(x, y + 1) + fx * get(x + 1, y + 1))
            assert at[k, u, v] == (total + 512) >> 10
