"""Queries of calibration, rectification and remapping: boards drawn from `part` are seen through a known rig, which is found again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration as cal
from ..operators import geometry as geo
from . import adapters as fx
from .adapters import VIEWS_SQL
from .queries import query, r6

_ANGLE = 0.02
RIG = geo.Rig([900, 0, 640, 0, 905, 360, 0, 0, 1], [-0.05, 0.01, 0.001, -0.0005, 0.002], [910, 0, 645, 0, 900, 355, 0, 0, 1], [-0.04, 0.008, 0.0, 0.0005, 0.001], cal.turn(cal.np.array([0.0, _ANGLE, 0.0])), [-0.3, 0.001, 0.002])
SIZE = (1280, 720)


def _row(spark: SparkSession, d: str, values: dict[str, float], places: int) -> DataFrame:
    """One row of the values, with the number of views."""
    return fx.board_views(spark, d).agg(F.count("*").alias("n_views")).select("n_views", *[F.round(F.lit(float(v)), places).alias(n) for n, v in values.items()])


@query("SELECT count(*) AS n_views, 900.0 AS fx, 905.0 AS fy, 640.0 AS cx, 360.0 AS cy, -0.05 AS k1, 0.01 AS k2, 0.001 AS p1, -0.0005 AS p2, 0.002 AS k3, 0.0 AS rms FROM part")
def g12_calibrated_camera(spark, d):
    k, dist, rms = cal.calibrate_camera(fx.board_corners(spark, d, RIG), SIZE, 5, pixels=("uL", "vL"))
    return _row(spark, d, {"fx": k[0, 0], "fy": k[1, 1], "cx": k[0, 2], "cy": k[1, 2], "k1": dist[0], "k2": dist[1], "p1": dist[2], "p2": dist[3], "k3": dist[4], "rms": rms}, 5)


@query(f"SELECT count(*) AS n_views, 0.0 AS rx, {_ANGLE} AS ry, 0.0 AS rz, -0.3 AS tx, 0.001 AS ty, 0.002 AS tz, 0.0 AS rms FROM part")
def g12_calibrated_rig(spark, d):
    rig, rms = cal.calibrate_stereo(fx.board_corners(spark, d, RIG), RIG.k1, RIG.d1, RIG.k2, RIG.d2)
    return _row(spark, d, dict(zip(("rx", "ry", "rz", "tx", "ty", "tz", "rms"), [*cal.turn_vector(rig.r), *rig.t, rms])), 6)


@query(f"""WITH m AS (SELECT view, tx, ty, tz, cos(b) * sin(a) - (sin(c) * sin(b) * cos(a) - cos(c) * sin(a)) AS wx,
    (cos(c) * sin(b) * cos(a) + sin(c) * sin(a)) + sin(b) AS wy, sin(c) * cos(b) - (cos(c) * sin(b) * sin(a) - sin(c) * cos(a)) AS wz,
    cos(c) * cos(b) + sin(c) * sin(b) * sin(a) + cos(c) * cos(a) + cos(b) * cos(a) AS trace FROM {VIEWS_SQL}),
  s AS (SELECT *, sqrt(wx * wx + wy * wy + wz * wz) / 2 AS sine FROM m), f AS (SELECT *, CASE WHEN sine > 1e-12 THEN atan2(sine, (trace - 1) / 2) / (2 * sine) ELSE 0.5 END AS f FROM s)
  SELECT view, round(wx * f, 5) + 0.0 AS rx, round(wy * f, 5) + 0.0 AS ry, round(wz * f, 5) + 0.0 AS rz, round(tx, 5) AS tx, round(ty, 5) AS ty, round(tz, 5) AS tz, 0.0 AS rms FROM f""")
def g12_view_poses(spark, d):
    p = cal.view_poses(fx.board_corners(spark, d, RIG).select("view", "x", "y", "uL", "vL"), RIG.k1, RIG.d1, pixels=("uL", "vL"))
    return p.select("view", *[(F.round(n, 5) + 0.0).alias(n) for n in ("rx", "ry", "rz", "tx", "ty", "tz", "rms")])


FLAT = cal.Rectification(RIG, SIZE)
_POINTS_SQL = f"""(SELECT view, x, y, cos(c) * cos(b) * x + (cos(c) * sin(b) * sin(a) - sin(c) * cos(a)) * y + tx AS PX, sin(c) * cos(b) * x + (sin(c) * sin(b) * sin(a) + cos(c) * cos(a)) * y + ty AS PY,
  -sin(b) * x + cos(b) * sin(a) * y + tz AS PZ FROM {VIEWS_SQL}, (SELECT i * 0.1 - 0.35 AS x FROM range(8) u(i)), (SELECT j * 0.1 - 0.2 AS y FROM range(5) w(j)))"""


@query(f"SELECT view, round(x, 2) AS x, round(y, 2) AS y, round(PX, 5) + 0.0 AS px, round(PY, 5) + 0.0 AS py, round(PZ, 5) AS pz, 0.0 AS row_gap FROM {_POINTS_SQL}")
def g12_rectified_points(spark, d):
    """Rows of a rectified pair agree, and the disparity gives the point back: Q takes it to the rectified camera, whose turn is undone."""
    seen = fx.board_corners(spark, d, RIG).select("view", "x", "y", "uL", "vL", "uR", "vR")
    p = FLAT.pixels(FLAT.pixels(seen, False, "uL", "vL", ("lu", "lv")), True, "uR", "vR", ("ru", "rv"))
    disparity = F.col("lu") - F.col("ru")
    q = [sum((float(m) * c for m, c in zip(row, (F.col("lu"), F.col("lv"), disparity, F.lit(1.0)))), F.lit(0.0)) for row in FLAT.q]
    back = [sum((float(FLAT.r1[i, k]) * q[i] / q[3] for i in range(3)), F.lit(0.0)) for k in range(3)]
    return p.select("view", r6("x", places=2), r6("y", places=2), *[(F.round(b, 5) + 0.0).alias(n) for n, b in zip(("px", "py", "pz"), back)], F.abs(F.round(F.col("lv") - F.col("rv"), 5)).alias("row_gap"))


SMALL = cal.Rectification(geo.Rig([50, 0, 31.5, 0, 50, 23.5, 0, 0, 1], [-0.1, 0.02, 0.001, 0.0005, 0.0], [51, 0, 32, 0, 50.5, 24, 0, 0, 1], [-0.08, 0.01, 0, 0, 0], cal.turn(cal.np.array([0.01, 0.06, -0.02])), [-0.3, 0.01, 0.02]), fx.FRAME)
_R = [[float(v) for v in row] for row in SMALL.r1]
_MAP_SQL = f"""(SELECT u, v, CAST(round_even((xd * 50 + 31.5) * 32, 0) AS BIGINT) AS sx, CAST(round_even((yd * 50 + 23.5) * 32, 0) AS BIGINT) AS sy FROM (SELECT u, v,
    x * (1 + r2 * (-0.1 + r2 * 0.02)) + 0.002 * x * y + 0.0005 * (r2 + 2 * x * x) AS xd, y * (1 + r2 * (-0.1 + r2 * 0.02)) + 0.001 * (r2 + 2 * y * y) + 0.001 * x * y AS yd
  FROM (SELECT *, x * x + y * y AS r2 FROM (SELECT u, v, (a * {_R[0][0]!r} + b * {_R[1][0]!r} + {_R[2][0]!r}) / (a * {_R[0][2]!r} + b * {_R[1][2]!r} + {_R[2][2]!r}) AS x, (a * {_R[0][1]!r} + b * {_R[1][1]!r} + {_R[2][1]!r}) / (a * {_R[0][2]!r} + b * {_R[1][2]!r} + {_R[2][2]!r}) AS y
    FROM (SELECT u, v, (u - {float(SMALL.centre[0])!r}) / {SMALL.focal!r} AS a, (v - {float(SMALL.centre[1])!r}) / {SMALL.focal!r} AS b FROM range(64) p(u), range(48) q(v))))))"""


@query(f"""WITH p AS (SELECT frame, x, y, r FROM {fx.PIXELS_SQL}), f AS (SELECT DISTINCT frame FROM p),
  m AS (SELECT u, v, (sx // 32) - CASE WHEN sx % 32 < 0 THEN 1 ELSE 0 END AS ix, (sy // 32) - CASE WHEN sy % 32 < 0 THEN 1 ELSE 0 END AS iy, ((sx % 32) + 32) % 32 AS fx, ((sy % 32) + 32) % 32 AS fy FROM {_MAP_SQL}),
  n AS (SELECT u, v, ix + dx AS x, iy + dy AS y, (CASE WHEN dx = 1 THEN fx ELSE 32 - fx END) * (CASE WHEN dy = 1 THEN fy ELSE 32 - fy END) AS w FROM m, range(2) a(dx), range(2) b(dy))
  SELECT f.frame, CAST(n.u AS INT) AS u, CAST(n.v AS INT) AS v, CAST(floor((sum(w * coalesce(p.r, 0)) + 512) / 1024) AS INT) AS value FROM f CROSS JOIN n LEFT JOIN p ON p.frame = f.frame AND p.x = n.x AND p.y = n.y GROUP BY 1, 2, 3""")
def g12_remapped(spark, d):
    p = fx.pixels(spark, d).select("frame", "x", "y", F.col("r").alias("value"))
    return cal.remap(p, cal.rectify_map(spark, SMALL, False), ["frame"], 16).select("frame", "u", "v", "value")
