"""Relations of the engine drawn from the driver's tables, in Spark and as DuckDB text. Both say the same."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geometry import Rig, project
from ..operators.idioms import last_wins, ranked

# l_shipdate, l_partkey, l_suppkey give the rows of one (frame, obj_id) an order that stands for the file's.
TRACKS_SQL = """(SELECT CASE WHEN l_linestatus = 'O' THEN 'left' ELSE 'right' END AS side, l_orderkey AS frame, l_linenumber AS obj_id,
  l_extendedprice / 50 AS u, l_quantity * 20 AS v, 1 - 5 * l_discount AS quality, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS valid,
  l_shipdate, l_partkey, l_suppkey FROM lineitem)"""
DAY = "CAST(date_diff('day', (SELECT min(l_shipdate) FROM lineitem), l_shipdate) AS INT)"
POINTS_SQL = f"""(SELECT frame_L, obj_id, X, Y, Z, valid_3d, err FROM (
  SELECT {DAY} AS frame_L, CAST(l_suppkey % 64 AS INT) AS obj_id, l_extendedprice / 1000 AS X, l_quantity AS Y, 1 + l_discount AS Z, l_tax AS err,
    CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS valid_3d,
    row_number() OVER (PARTITION BY {DAY}, l_suppkey % 64 ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_shipdate DESC) AS rn FROM lineitem) WHERE rn = 1)"""
SIGNAL_SQL = "(SELECT CAST(user_id % 2 AS INT) AS side, CAST(row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) - 1 AS INT) AS idx, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM events)"
MEDIA_SQL = "(SELECT 'GX' || lpad(CAST(o_orderkey % 3 + 1 AS VARCHAR), 2, '0') || lpad(CAST((o_orderkey // 3) % 10000 AS VARCHAR), 4, '0') || '.MP4' AS name, CAST(floor(o_totalprice) AS BIGINT) AS size, strftime(o_orderdate, '%Y-%m-%d') AS timestamp, o_orderkey FROM orders)"
CANDS_SQL = "(SELECT p_partkey AS id, p_retailprice AS x, p_size * 20.0 AS y, p_size * 3.0 AS area, p_brand AS method, (p_partkey % 97) / 100.0 AS score, p_partkey // 50 AS cluster FROM part)"
RLE_SQL = "(SELECT l_orderkey AS mask, list(CAST(l_quantity AS INT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS counts FROM lineitem GROUP BY l_orderkey)"


# Frames of 64 x 48 pixels, 1500 order keys each; a pixel that no row falls on is black, of several the brightest counts.
FRAME = (64, 48)
PIXELS_SQL = """(SELECT frame, CAST(x AS INT) AS x, CAST(y AS INT) AS y, coalesce(b, 0) AS b, coalesce(g, 0) AS g, coalesce(r, 0) AS r
  FROM (SELECT DISTINCT l_orderkey // 1500 AS frame FROM lineitem) CROSS JOIN range(64) u(x) CROSS JOIN range(48) w(y)
  LEFT JOIN (SELECT l_orderkey // 1500 AS frame, (l_partkey * 7 + l_linenumber * 13) % 64 AS x, (l_suppkey * 5 + l_orderkey) % 48 AS y, max(CAST(floor(l_extendedprice) AS BIGINT) % 256) AS b,
             max(CAST(l_quantity * 5 AS BIGINT)) AS g, max(l_partkey % 256) AS r FROM lineitem GROUP BY 1, 2, 3) USING (frame, x, y))"""
# Views of a board of 8 x 5 points, one for each part: the board's turn (about x by a, then y by b, then z by c) and place.
VIEWS_SQL = """(SELECT p_partkey AS view, (p_size - 25) / 60.0 AS a, (CAST(floor(p_retailprice) AS BIGINT) % 97 - 48) / 150.0 AS b, (p_partkey % 31 - 15) / 40.0 AS c,
  (p_partkey % 7 - 3) / 20.0 AS tx, (p_partkey % 5 - 2) / 20.0 AS ty, 1.0 + p_size / 100.0 AS tz FROM part)"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all tasks by key: each is a few bytes but becomes many rows or much work, and a file of so few bytes is read by one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def tracks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "left").otherwise("right").alias("side"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("obj_id"), (F.col("l_extendedprice") / 50).alias("u"), (F.col("l_quantity") * 20).alias("v"),
        (1 - 5 * F.col("l_discount")).alias("quality"), F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("valid"), F.struct("l_shipdate", "l_partkey", "l_suppkey").alias("pos"),
    )


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = tracks(spark, d)
    return t.where("side = 'left'"), t.where("side = 'right'")


def points(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    start = line.agg(F.min("l_shipdate").alias("start"))  # one row
    rows = line.crossJoin(F.broadcast(start)).select(
        F.date_diff(F.col("l_shipdate").cast("date"), F.col("start").cast("date")).alias("frame_L"), (F.col("l_suppkey") % 64).cast("int").alias("obj_id"), (F.col("l_extendedprice") / 1000).alias("X"), F.col("l_quantity").alias("Y"), (1 + F.col("l_discount")).alias("Z"),
        F.col("l_tax").alias("err"), F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("valid_3d"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").alias("pos"),
    )
    return last_wins(rows, ["frame_L", "obj_id"], "pos")


def signal(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("user_id") % 2).cast("int").alias("side"), "event_id", F.col("value").cast("float").cast("double").alias("value"))
    return ranked(rows, "event_id", "idx", ["side"]).select("side", F.col("idx").cast("int").alias("idx"), "value")


def media(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.concat(F.lit("GX"), F.lpad((key % 3 + 1).cast("string"), 2, "0"), F.lpad((F.floor(key / 3) % 10000).cast("string"), 4, "0"), F.lit(".MP4"))
    return table(spark, d, "orders").select(name.alias("name"), F.floor("o_totalprice").alias("size"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), "o_orderkey")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"), (F.col("p_size") * 20.0).alias("y"), (F.col("p_size") * 3.0).alias("area"), F.col("p_brand").alias("method"), ((F.col("p_partkey") % 97) / 100.0).alias("score"), F.floor(F.col("p_partkey") / 50).alias("cluster"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("mask")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.col("l_quantity").cast("int").alias("n")))).alias("r"))
    return rows.select("mask", F.transform("r", lambda s: s["n"]).alias("counts"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").withColumn("frame", F.floor(F.col("l_orderkey") / 1500))
    at = {"x": ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 64).cast("int"), "y": ((F.col("l_suppkey") * 5 + F.col("l_orderkey")) % 48).cast("int")}
    lit = line.groupBy("frame", *[c.alias(n) for n, c in at.items()]).agg(F.max(F.floor("l_extendedprice") % 256).alias("b"), F.max((F.col("l_quantity") * 5).cast("long")).alias("g"), F.max(F.col("l_partkey") % 256).alias("r"))
    grid = line.select("frame").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(FRAME[0] - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(FRAME[1] - 1))))
    return grid.join(lit, ["frame", "x", "y"], "left").select("frame", "x", "y", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in "bgr"])


def board_views(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        key.alias("view"), ((F.col("p_size") - 25) / 60.0).alias("a"), ((F.floor("p_retailprice") % 97 - 48) / 150.0).alias("b"), ((key % 31 - 15) / 40.0).alias("c"),
        ((key % 7 - 3) / 20.0).alias("tx"), ((key % 5 - 2) / 20.0).alias("ty"), (1.0 + F.col("p_size") / 100.0).alias("tz"),
    )


def board_points(spark: SparkSession, d: str) -> DataFrame:
    """(view, x, y, PX, PY, PZ): the boards' points and where they are before the left camera."""
    board = F.explode(F.array(*[F.struct(F.lit(i * 0.1 - 0.35).alias("x"), F.lit(j * 0.1 - 0.2).alias("y")) for j in range(5) for i in range(8)]))
    rows = dealt(board_views(spark, d), "view").withColumn("q", board).select("*", "q.x", "q.y")
    (ca, sa), (cb, sb), (cc, sc) = ((F.cos(n), F.sin(n)) for n in "abc")
    x, y = F.col("x"), F.col("y")
    return rows.select("view", "x", "y", (cc * cb * x + (cc * sb * sa - sc * ca) * y + F.col("tx")).alias("PX"), (sc * cb * x + (sc * sb * sa + cc * ca) * y + F.col("ty")).alias("PY"), (-sb * x + cb * sa * y + F.col("tz")).alias("PZ"))


def board_corners(spark: SparkSession, d: str, rig: Rig) -> DataFrame:
    """(view, x, y, PX, PY, PZ, uL, vL, uR, vR): the boards' points as both cameras of a rig see them."""
    rows = board_points(spark, d)
    rows = rows.withColumns({f"Q{n}": F.col("PX") * float(rig.r[i, 0]) + F.col("PY") * float(rig.r[i, 1]) + F.col("PZ") * float(rig.r[i, 2]) + float(rig.t[i]) for i, n in enumerate("XYZ")})
    for side, name, k, dist in (("L", "P", rig.k1, rig.d1), ("R", "Q", rig.k2, rig.d2)):
        rows = rows.withColumns({f"_{n}": F.col(f"{name}{n}") / F.col(f"{name}Z") for n in "XY"})
        u, v = project("_X", "_Y", F.lit(1.0), k, dist)
        rows = rows.withColumns({f"u{side}": u, f"v{side}": v})
    rows = rows.drop("_X", "_Y", "QX", "QY", "QZ")
    return rows


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, for queries that write files and read them back."""
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        folder = f"file://{tempfile.mkdtemp(prefix='markerflow-')}"
    return f"{folder}/files-{uuid.uuid4().hex}"
