"""Properties and traps of the operators, on small inputs with independent plain-Python answers."""

import collections
import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markerflow.functions import numeric as num
from markerflow.functions import text as txt
from markerflow.operators import candidates as cand
from markerflow.operators import geometry as geo
from markerflow.operators import idioms, masks, match, media, netframe, scans, signals
from markerflow.sources import files
from markerflow.streaming import memory

RIG = geo.Rig([900, 0, 640, 0, 905, 360, 0, 0, 1], [-0.05, 0.01, 0.001, -0.0005, 0.002, 0.01, 0.002, 0.0001], [910, 0, 645, 0, 900, 355, 0, 0, 1], [-0.04, 0.008, 0, 0.0005, 0], np.eye(3), [-0.3, 0.001, 0.002], 0.5)


def values(df):
    return [tuple(r) for r in df.collect()]


def test_nan_quality_and_errors(spark):
    nan = float("nan")
    t = spark.createDataFrame([(1, 1, nan, 1), (2, 1, 0.6, 1), (3, 1, 0.59, 1), (4, 1, 0.9, 0)], "frame int, obj_id int, quality double, valid int")
    assert [r.frame for r in match.usable(t, 0.6).collect()] == [2]
    p = spark.createDataFrame([(nan,), (20.0,), (20.1,)], "err_px double")
    assert values(p.select(num.above("err_px", 20.0))) == [(False,), (False,), (True,)]
    assert math.isnan(p.agg(num.percentile("err_px", 0.5)).first()[0])


def test_last_row_wins_and_first_row_wins(spark):
    rows = [(1, 1, 1.0, 1.0, 1.0, 1, 0), (1, 1, 9.0, 9.0, 1.0, 1, 1), (2, 1, 5.0, 5.0, 1.0, 1, 2)]
    t = spark.createDataFrame(rows, "frame int, obj_id int, u double, v double, quality double, valid int, pos long")
    m = match.stereo_match(t, t, 0.5)
    assert sorted((r.gframe, r.uL, r.uR) for r in m.collect()) == [(1, 9.0, 9.0), (2, 5.0, 5.0)]
    d = spark.createDataFrame([(5, 0), (2, 1), (5, 2)], "idx int, pos int")
    assert values(match.paired_indices(d, d, 3, 3)) == [(2, 5, 5)]
    assert match.stereo_match(t, t, 0.5, 100, -100).count() == 0
    s = media.match_summary(spark.createDataFrame([], "valid_3d int, err_px double")).first()
    assert (s.total_matched_obs, s.valid_pct, s.err_mean) == (0, 0.0, None)


def test_projection_round_trip(spark):
    rng = np.random.default_rng(1)
    xyz = np.column_stack([rng.uniform(-1, 1, 200), rng.uniform(-0.6, 0.6, 200), rng.uniform(2, 5, 200)])
    right = xyz @ RIG.r.T + RIG.t
    pixels = []
    for p, k, d in ((xyz, RIG.k1, RIG.d1), (right, RIG.k2, RIG.d2)):
        x, y = geo.distort(p[:, 0] / p[:, 2], p[:, 1] / p[:, 2], d)
        pixels += [(x * k[0, 0] + k[0, 2]) / RIG.scale, (y * k[1, 1] + k[1, 2]) / RIG.scale]
    m = spark.createDataFrame(pd.DataFrame(dict(zip(("uL", "vL", "uR", "vR"), pixels))).assign(i=range(200)))
    got = geo.triangulate_matches(m, RIG).orderBy("i").toPandas()
    assert np.abs(got[["X", "Y", "Z"]].to_numpy() - xyz).max() < 1e-6
    assert (got.valid_3d == 1).all() and got.err_px.max() < 1e-6


def test_invalid_points(spark):
    nan = float("nan")
    p = spark.createDataFrame([(0.0, 0.0, -1.0), (0.0, 0.0, 0.0), (nan, nan, nan)], "X double, Y double, Z double").withColumns({n: F.lit(0.0) for n in ("uL", "vL", "uR", "vR")})
    assert [r.valid_3d for r in geo.with_errors(p, RIG, 20.0).collect()] == [0, 0, 1]  # a NaN error does not make a row invalid


def test_homography():
    a, b = np.array([[0, 0], [10, 1], [11, 9], [-1, 8]], float), np.array([[0, 0], [4, 0], [4, 3], [0, 3]], float)
    h = geo.homography(a, b)
    q = np.column_stack([a, np.ones(4)]) @ h.T
    assert np.allclose(q[:, :2] / q[:, 2:], b)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 8), st.integers(1, 8), st.integers(0, 2**31))
def test_rle_round_trip_and_components(h, w, seed):
    mask = np.random.default_rng(seed).random((h, w)) < 0.5
    runs = masks.mask_rle(mask)
    assert (masks.rle_mask(runs, [h, w]) == mask).all() and sum(runs) == h * w
    for diagonal in (False, True):
        got = masks.label(mask, diagonal)
        steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
        want, n = np.zeros((h, w), int), 0
        for y, x in zip(*np.nonzero(mask)):
            if not want[y, x]:
                n += 1
                todo = [(y, x)]
                want[y, x] = n
                while todo:
                    a, b = todo.pop()
                    for dy, dx in steps:
                        c, d = a + dy, b + dx
                        if 0 <= c < h and 0 <= d < w and mask[c, d] and not want[c, d]:
                            want[c, d] = n
                            todo.append((c, d))
        assert (got == want).all()


def test_mask_measures():
    blobs = np.zeros((6, 8), bool)
    blobs[0:2, 0:2] = blobs[2:5, 2:6] = True
    assert masks.largest_component(blobs, False).sum() == 12 and masks.largest_component(blobs, True).sum() == 16
    assert masks.peak(np.zeros((3, 3), bool)) == (None, None, 0.0)
    u, v, r = masks.peak(np.pad(np.ones((3, 3), bool), 1))
    assert (u, v, r) == (2.0, 2.0, 2.0)
    assert masks.solidity(np.ones((3, 3), bool)) == 9 / 4  # pixels over the hull of their centres
    assert masks.eroded(np.pad(np.ones((3, 3), bool), 1)).sum() == 1
    small = np.array([[1, 0, 0, 0], [0, 0, 1, 1]], bool)
    assert masks.remove_small(small, 2, False).tolist() == [[0, 0, 0, 0], [0, 0, 1, 1]]
    assert masks.remove_small(small, 9, False).sum() == 2
    assert masks.remove_small(~small, 2, True).all() == False  # noqa: E712  a hole of two pixels stays
    assert (masks.fill_scores(np.array([[1.0, 1, 1], [1, -1, 1], [1, 1, 1]]), 1) > 0).all()


def test_rle_columns(spark):
    d = spark.createDataFrame([([0, 2, 3, 1],), ([6],), ([2, 1, 3],)], "counts array<int>")
    assert values(d.select(txt.rle_area("counts"), txt.rle_pixels("counts"))) == [(3, [0, 1, 5]), (0, []), (1, [2])]
    px = d.withColumn("mask", F.monotonically_increasing_id()).select("mask", F.explode(txt.rle_pixels("counts")).alias("p")).select("mask", F.floor(F.col("p") / 2).cast("int").alias("x"), (F.col("p") % 2).alias("y"))
    assert sorted(tuple(r.counts) for r in masks.encode_rle(px, ["mask"], 2, 3).collect()) == [(0, 2, 3, 1), (2, 1, 3)]


def test_intervals(spark):
    d = spark.createDataFrame([(i,) for i in (0, 3, 4, 10, 16)], "idx long")
    got = sorted(values(scans.roi_intervals(d, 1, 0, 16)))
    assert got == [(0, 5), (9, 11), (15, 16)]
    again = idioms.islands(spark.createDataFrame(got, "lo long, hi long"), [])
    assert sorted(values(again)) == got
    assert scans.halving_steps(8) == [8, 4, 2, 1] and scans.halving_steps(1) == [1] and scans.halving_steps(20, 2) == [20, 10]
    assert scans.iteration_count(10, 0, 3) == 4 and scans.iteration_count(10, 0, 3, 2) == 2 and scans.iteration_count(5, 5, 1) == 0
    hits = scans.adaptive_scan(spark, 101, 0, 8, 1000, lambda i: i.where("idx BETWEEN 40 AND 47"))
    assert {r.idx for r in hits.collect()} >= {40, 44}


def test_signals(spark):
    v = [0.0, 1.0, 5.0, 5.0, 1.0, 9.0, 2.0]
    s = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "side int, idx int, value double")
    for w in (4, 5):
        got = [r.smooth for r in signals.moving_average(s, w).orderBy("idx").collect()]
        assert np.allclose(got, np.convolve(v, np.ones(w) / w, "same"))
    peaks = signals.local_maxima(s, value="value")
    assert sorted(r.idx for r in peaks.collect()) == [2, 5]
    assert [r.idx for r in signals.greedy_peaks(peaks, 5, 4, value="value").collect()] == [5]
    flat = s.withColumn("value", F.lit(1.0))
    assert signals.local_maxima(flat, value="value").count() == 7
    assert signals.flash_frame(s).first().event == 5 and signals.flash_frame(flat).first().event == 0
    assert signals.flash_frame(s.where("idx < 3")).first().reason == "flash-peak"


def test_argmax_takes_the_first(spark):
    d = spark.createDataFrame([(1, 2.0), (0, 2.0), (2, 1.0)], "i int, v double")
    assert -d.agg(num.first_argmax("v", "i").alias("m")).first().m.turned == 0


def test_clusters_against_plain_python(spark):
    rng = np.random.default_rng(3)
    rows = [(0, float(x), float(y), 1.0 + i, "ab"[i % 2], float(s)) for i, (x, y, s) in enumerate(rng.random((60, 3)) * [100, 100, 1])]
    d = spark.createDataFrame(rows, "side int, x double, y double, area double, method string, score double")
    got = cand.cluster(d, ["side"], 15).toPandas()
    clusters = []
    for r in sorted(rows, key=lambda r: (-r[5], -r[3])):
        for c in clusters:
            w = sum(max(q[5], 0.05) for q in c)
            if math.hypot(r[1] - sum(q[1] * max(q[5], 0.05) for q in c) / w, r[2] - sum(q[2] * max(q[5], 0.05) for q in c) / w) <= 15:
                c.append(r)
                break
        else:
            clusters.append([r])
    assert got.cluster.nunique() == len(clusters)
    assert sorted(got.groupby("cluster").size()) == sorted(map(len, clusters))
    kept = cand.suppress(d, ["side"], 15).toPandas()
    assert all(math.hypot(a.x - b.x, a.y - b.y) >= 15 for i, a in kept.iterrows() for j, b in kept.iterrows() if i < j)


def test_nms_and_grid(spark):
    b = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 1.0, 1.0, 10.0, 10.0, 0.8), (0, 20.0, 20.0, 30.0, 30.0, 0.1)], "g int, x0 double, y0 double, x1 double, y1 double, score double")
    assert sorted(r.score for r in cand.box_nms(b, ["g"], 0.5).collect()) == [0.1, 0.9]
    c = spark.createDataFrame([(0, 0.1, 0.0, 0.5), (0, 0.2, 0.0, 0.9), (0, 5.0, 5.0, 1.0)], "g int, grid_x double, grid_y double, score double")
    slots = cand.assign_grid(c, ["g"], 2, 1).toPandas()
    assert slots.detected.tolist() == [True, False] and slots.grid_x[0] == 0.1


def test_lattice(spark):
    pts = [(r * 4 + c, c * 1.0 + 0.05 * r, r * 1.2) for r in range(5) for c in range(4)]
    d = spark.createDataFrame(pts, "obj_id int, ly double, lz double")
    edges = set(values(netframe.lattice_edges(d)))
    assert edges == {(r * 4 + c, r * 4 + c + 1) for r in range(5) for c in range(3)} | {(r * 4 + c, r * 4 + c + 4) for r in range(4) for c in range(4)}
    assert netframe.lattice_edges(d.limit(1)).count() == 0
    assert netframe.grid_shape(20, 3, 5) == (4, 5) and netframe.grid_shape(20, 5, 3) == (5, 4)
    assert netframe.grid_shape(0, 1, 1) == (0, 0) and netframe.grid_shape(20, 1, 1, cols=5) == (5, 4)


def test_net_frame(spark):
    rng = np.random.default_rng(5)
    xyz = np.column_stack([rng.normal(0, 0.01, 40), rng.normal(0, 3, 40), rng.normal(0, 1, 40)])
    refs = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "obj_id int, X0 double, Y0 double, Z0 double")
    low = [int(i) for i in np.argsort(-xyz[:, 1])[:5]]
    origin, basis = netframe.net_frame(refs, spark.createDataFrame([(i,) for i in low], "obj_id int"))
    assert np.allclose(np.array(basis) @ np.array(basis).T, np.eye(3), atol=1e-9)
    assert abs(basis[0][0]) > 0.99 and basis[0][0] > 0
    assert ((xyz[low] - origin) @ np.array(basis[1])).mean() < 0
    two = netframe.net_frame(refs.limit(2), refs.limit(0).select("obj_id"))
    assert np.allclose(np.abs(two[1]), np.eye(3))


def test_texts(spark):
    one = spark.range(1)
    ids = lambda t, n=10: one.select(txt.id_set(F.lit(t), F.lit(n))).first()[0]
    assert ids("1-3,7") == [1, 2, 3, 7] and ids("5-3") == [5, 4, 3] and ids("2,2") == [2] and ids("", 3) == [0, 1, 2] and ids(" ALL ", 2) == [0, 1]
    with pytest.raises(Exception, match="out of range"):
        ids("11")
    names = spark.createDataFrame([("GX010123.MP4",), ("GX020123.mp4",), ("GOPR0123.MP4",), ("GP010123.MP4",), ("other.mov",)], "n string")
    assert [r[0] for r in names.select(txt.clip_key("n")).collect()] == ["GX0123", "GX0123", "GO0123", "GP0123", "OTHER"]
    assert [r[0] for r in names.select(txt.chapter("n")).collect()] == [1, 2, 0, 1, 0]
    assert txt.stable_hash({"b": 1, "a": [1, 2]}) == txt.stable_hash({"a": [1, 2], "b": 1})
    assert one.select(txt.crop_of(F.lit("1,2,0,4"))).first()[0] is None
    assert values(one.select(num.time_text(F.lit(3723), F.lit(1.0)))) == [("01:02:03.000",)]
    assert values(one.select(num.half_even(F.lit(2.5)), num.half_even(F.lit(3.5)))) == [(2.0, 4.0)]
    assert math.isnan(one.select(num.stability(F.lit(0), F.lit(0))).first()[0]) and one.select(num.stability(F.lit(0), F.lit(0), 1.0)).first()[0] == 1.0


def test_media(spark):
    good = {"media": [{"d": "100", "fs": [{"n": "GX010001.MP4", "s": "12", "cre": "5"}, {"name": "GX020001.MP4", "size": "x"}, {"n": "a.JPG"}, {"s": "1"}]}, {"directory": "", "fs": [{"n": "b.MP4"}]}]}
    rows = media.flatten_media(spark.createDataFrame([(json.dumps(good),), ("{}",), (None,)], "payload string"))
    assert sorted(values(rows)) == [("100", "GX010001.MP4", ".mp4", 12, "5"), ("100", "GX020001.MP4", ".mp4", 0, "")]
    g = media.recordings(rows).first()
    assert (g.key, g.files, g.timestamp, g.total_size) == ("GX0001", ["GX010001.MP4", "GX020001.MP4"], "5", 12)


def test_files(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("obj_id,frame,quality,valid,v,u,extra\n1,2,0.5,1,3.0,4.0,x\n1,2,,0,,,y\n")
    t = files.read_tracks(spark, str(p)).orderBy("pos").collect()
    assert (t[0].frame, t[0].u, t[1].u, t[1].quality) == (2, 4.0, None, None)
    p.write_text("frame,obj_id\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        files.read_tracks(spark, str(p))
    assert files.read_tracks_or_none(spark, str(tmp_path / "none.csv")).count() == 0
    j = tmp_path / "s.json"
    j.write_text(json.dumps({"trim_left": 3, "trim_right": -2}))
    assert files.read_sync(spark, str(j)).select("left_drop", "right_drop").first() == (-3, 2)
    j.write_text("{}")
    with pytest.raises(ValueError):
        files.read_sync(spark, str(j))
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"corrections": {"left": [{"frame": 1, "obj_id": 2}], "right": []}}))
    assert values(files.read_corrections(spark, str(c)).select("side", "frame", "positive")) == [("left", 1, [])]
    for body, want in (([{"x": 1, "y": 2}], (1.0, 2.0, 1)), ({"left": [{"click_xy": [3, 4], "label": 0}]}, (3.0, 4.0, 0)), ({"candidates": [{"x": 1, "y": 2, "local_x": 5, "local_y": 6}]}, (5.0, 6.0, 1))):
        c.write_text(json.dumps(body))
        assert values(files.read_prompts(spark, str(c), "left").select("x", "y", "label")) == [want]
    np.savez(tmp_path / "rig.npz", K1=RIG.k1, D1=RIG.d1, K2=RIG.k2, D2=RIG.d2, R=RIG.r, T=RIG.t, scale=[0.5])
    assert geo.Rig.load(str(tmp_path / "rig.npz")).scale == 0.5
    files.write_csv(spark.createDataFrame([(2, 1), (1, 1)], "frame int, obj_id int"), str(tmp_path / "out"), ["frame", "obj_id"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_sync_decision():
    d = "work/sync.json"
    assert files.resolve_sync(None, d, None, None, d) == "json" and files.resolve_sync("audio", d, None, None, d) == "auto"
    assert files.resolve_sync(None, "none", 1, None, d) == "manual" and files.resolve_sync(None, None, None, None, d) == "auto"
    for bad in (("audio", "other.json", None, None), (None, d, 1, None)):
        with pytest.raises(ValueError):
            files.resolve_sync(*bad, d)


def test_memory():
    m = memory.Memory(size=3)
    for f in range(5):
        m.put(f, float(f))
    assert sorted(m.other) == [3, 4]
    m.correct(6, 1.0)
    assert m.cond == {6: 1.0} and m.other == {}


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, f, float(f % 7), f % 10 == 0) for s in (0, 1) for f in range(30)]
    d = spark.createDataFrame(rows, "side int, frame int, value double, corrected boolean")
    d.repartition(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = memory.propagate_stream(stream, "side").writeStream.format("memory").queryName("walked").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    a = {(r.side, r.frame): r.output for r in spark.table("walked").collect()}
    b = {(r.side, r.frame): r.output for r in memory.propagate(d, ["side"]).collect()}
    assert a == b and len(a) == 60


def test_memory_recalls_near_conditions_and_strided_others():
    m = memory.Memory(size=4, stride=2, conds=2)
    for f in (0, 20, 40):
        m.correct(f, float(f))
    for f in range(41, 47):
        m.put(f, float(f))
    assert m.recall(47) == [40.0, 20.0, 42.0, 44.0, 46.0]  # conditions before, nearest other; then 45 // 2 * 2 - 2, 45 // 2 * 2, 46
    assert memory.closest([0, 20, 40], 10, 2) == [0, 20] and memory.closest([0, 20, 40], 50, -1) == [0, 20, 40]
    spare = memory.Memory(size=3, conds=2)
    for f in (1, 8, 9, 30):
        spare.correct(f, float(f))
    assert spare.recall(10) == [9.0, 30.0, 8.0]  # 8 was not chosen, and stands in the slot that looks it up
    back = memory.Memory(size=4, stride=2, reverse=True)
    assert back.slots(10) == [14, 12, 11] and memory.Memory(size=4, stride=2).slots(10) == [6, 8, 9]
    many = memory.Memory(keep=5)
    for f in range(100):
        many.correct(f, 1.0)
    assert sorted(many.cond) == [0, 96, 97, 98, 99]


def test_propagation_limits(spark):
    d = spark.createDataFrame([(0, f, float(f), f in (3, 9)) for f in range(12)], "side int, frame int, value double, corrected boolean")
    frames = lambda **k: sorted(r.frame for r in memory.propagate(d, ["side"], **k).collect())
    assert frames() == list(range(3, 12)) and frames(start=5, limit=2) == [5, 6, 7]
    assert frames(reverse=True, start=6, limit=3) == [3, 4, 5, 6]
    whole = {r.frame: r.output for r in memory.propagate(d, ["side"]).collect()}
    assert {r.frame: r.output for r in memory.propagate(d, ["side"], restart=8).collect()} == {f: v for f, v in whole.items() if f >= 8}


def test_tilted_lens_round_trip():
    d = np.array([-0.05, 0.01, 0.001, -0.0005, 0, 0, 0, 0, 0, 0, 0, 0, 0.02, -0.03])
    rng = np.random.default_rng(3)
    x, y = rng.uniform(-0.4, 0.4, 50), rng.uniform(-0.3, 0.3, 50)
    u, v = geo.distort(x, y, d)
    k = np.array([[900, 0, 640], [0, 905, 360], [0, 0, 1.0]])
    back = geo.rays(np.stack([u * 900 + 640, v * 905 + 360], axis=1), k, d)
    assert np.abs(back - np.stack([x, y], axis=1)).max() < 1e-9
    assert np.abs(np.stack(geo.lens(x, y, d)) - np.stack([u, v])).max() > 1e-3
    assert np.allclose(geo.tilt(np.zeros(14)), np.eye(3))


def test_nan_in_percentiles(spark):
    nan = float("nan")
    s = media.match_summary(spark.createDataFrame([(1, nan), (1, 2.0), (0, 5.0)], "valid_3d int, err_px double")).first()
    assert math.isnan(s.err_median) and math.isnan(s.err_p95) and s.valid_3d_obs == 2
    m = netframe.motion(spark.createDataFrame([(1, nan), (1, 1.0), (2, 1.0)], "obj_id int, disp double")).orderBy("obj_id").collect()
    assert math.isnan(m[0].p95) and m[1].p95 == 1.0 and not m[0].fixed and not m[1].fixed
    limits = netframe.padded_limits(spark.createDataFrame([(nan,), (1.0,)], "lx double"), ("lx",)).first()
    assert math.isnan(limits.lx_lo) and math.isnan(limits.lx_hi)


def brute_label(mask, diagonal):
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if not out[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                    out[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or not i or not j]
    return out


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 1 << 30), st.booleans())
def test_labels_equal_a_flood_fill(h, w, seed, diagonal):
    mask = np.random.default_rng(seed).random((h, w)) < 0.55
    assert (masks.label(mask, diagonal) == brute_label(mask, diagonal)).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 1 << 30))
def test_chamfer_distance_equals_relaxation(h, w, seed):
    mask = np.random.default_rng(seed).random((h, w)) < 0.8
    want = np.where(mask, np.inf, 0.0)
    for _ in range(h * w):
        for y in range(h):
            for x in range(w):
                for a, b, d in masks.CHAMFER:
                    for i, j in ((a, b), (b, a)):
                        for si in (1, -1):
                            for sj in (1, -1):
                                if 0 <= y + si * i < h and 0 <= x + sj * j < w:
                                    want[y, x] = min(want[y, x], want[y + si * i, x + sj * j] + d)
        if h * w > 40:
            break
    got = masks.distance(mask)
    assert (got <= want + 1e-9).all() and (h * w > 40 or np.allclose(got, want))


def test_skeleton_junction_and_fallbacks():
    cross = np.zeros((31, 31), bool)
    cross[13:18, 2:29] = cross[2:29, 13:18] = True
    thin = masks.thinned(cross)
    assert thin.sum() < 70 and (thin & ~cross).sum() == 0
    u, v, far = masks.junction_point(cross)
    assert abs(u - 15) <= 2 and abs(v - 15) <= 2 and far >= 2
    assert masks.point_of(cross, skeleton=True)[0] == "skeleton_junction" and masks.point_of(cross)[0] == "dt_peak"
    assert masks.point_of(cross, skeleton=True, radius_min=50.0)[0] == "dt_peak"
    assert masks.point_of(np.zeros((3, 3), bool))[0] == "no_fallback"
    bar = np.zeros((9, 30), bool)
    bar[3:6, 2:28] = True
    assert masks.junction_point(bar) == (None, None, 0.0)  # a line has no junction


def test_png_round_trip(spark, tmp_path):
    import struct
    import zlib

    from markerflow.sources import images

    rng = np.random.default_rng(5)
    pixels = rng.integers(0, 4, (13, 17)).astype(np.uint8)
    for palette in (None, [(0, 0, 0), (9, 9, 9), (1, 2, 3), (4, 5, 6)]):
        assert (images.read_png(images.write_png(pixels, palette)) == pixels).all()
    assert images.read_png(b"no image") is None and images.read_png(images.SIGNATURE + b"xx") is None
    # every filter, by its definition
    grey = rng.integers(0, 256, (6, 9)).astype(np.uint8)
    rows = bytearray()
    for y, kind in enumerate([0, 1, 2, 3, 4, 4]):
        rows.append(kind)
        for x in range(9):
            a, b, c = (int(grey[y, x - 1]) if x else 0, int(grey[y - 1, x]) if y else 0, int(grey[y - 1, x - 1]) if x and y else 0)
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][kind]
            rows.append((int(grey[y, x]) - guess) & 255)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 6, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(rows))) + chunk(b"IEND", b"")
    assert (images.read_png(data) == grey).all()
    bits = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 1, 2, 3, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes([0, 0b00011011, 0b11000000]))) + chunk(b"IEND", b"")
    assert images.read_png(bits).tolist() == [[0, 1, 2, 3, 3]]
    for name in ("a/00001.png", "a/00003.png", "b/002/00001.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(images.write_png(pixels))
    (tmp_path / "a" / "00002.png").write_bytes(b"broken")
    got = files.read_masks(spark, str(tmp_path / "a"))
    assert sorted({(r.video, r.frame, r.obj_id) for r in got.collect()}) == [("a", f, k) for f in (1, 3) for k in (1, 2, 3)]
    assert [(r.video, r.obj_id) for r in files.read_masks(spark, str(tmp_path / "b"), per_object=True).collect()] == [("b", 2)]
    frames = spark.createDataFrame([("a", 1), ("a", 2)], "video string, frame int")
    assert files.masks_of(frames, got, allow_missing=True).select("frame").distinct().count() == 1
    with pytest.raises(Exception, match="no mask of a 2"):
        files.masks_of(frames, got).collect()


def test_error_columns():
    assert match.error_columns(["X", "err_px", "err"]) == ("err",) and match.error_columns(["X"]) == ()
    assert match.error_columns(["X_err", "err"]) == () and match.error_columns(["X_err", "Y_err", "Z_err", "err"]) == ("X_err", "Y_err", "Z_err")


def plain_islands(spans, gap):
    out = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def test_ranges_hold_what_one_task_would(spark):
    rng = np.random.default_rng(6)
    rows = [(None if i % 50 == 0 else i % 3, int(rng.integers(0, 4000))) for i in range(600)]
    d = spark.createDataFrame(rows, "k int, t int").repartition(5)
    got = collections.defaultdict(list)
    for r in idioms.running(d, ["k"], "t", F.lit(1), "n").collect():
        got[r.k].append((r.t, r.n))
    for k, pairs in got.items():
        assert sorted(n for _, n in pairs) == list(range(1, len(pairs) + 1)) and [t for t, _ in sorted(pairs, key=lambda p: p[1])] == sorted(t for t, _ in pairs)
    spans = [(k, t, t + int(rng.integers(0, 30))) for k, t in rows] + [(1, 5, 3900)]
    merged = collections.defaultdict(list)
    for r in idioms.islands(spark.createDataFrame(spans, "k int, lo int, hi int"), ["k"]).collect():
        merged[r.k].append((r.lo, r.hi))
    for k in {k for k, _, _ in spans}:
        assert sorted(merged[k]) == plain_islands([(a, b) for c, a, b in spans if c == k], 1)
    assert idioms.islands(spark.createDataFrame([], "lo int, hi int"), []).count() == 0 and idioms.ranked(d.limit(0), "t", "n").count() == 0
    plan = idioms.ranked(d, "t", "n")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "t#" in line]
    assert windows and all("_range" in line for line in windows)


def test_signals_in_blocks_equal_whole(spark):
    rng = np.random.default_rng(7)
    d = spark.createDataFrame([(s, i, float(rng.integers(0, 9))) for s in (0, 1) for i in range(101)], "side int, idx int, value double")
    for width in (1, 4, 5):
        a, b = (sorted(values(signals.moving_average(d, width, block=block))) for block in (7, 1 << 16))
        assert a == b
    same = [(signals.local_maxima, {"value": "value"}), (signals.flash_frame, {"threshold": 3.0}), (signals.hybrid_event, {"motion": "value"})]
    for f, names in same:
        assert sorted(values(f(d, block=7, **names))) == sorted(values(f(d, **names)))


def test_nearest_of_scattered_points(spark):
    rng = np.random.default_rng(8)
    p = np.concatenate([rng.normal(0, 0.01, (40, 2)), rng.normal(50, 5, (30, 2)), [[1000, 1000], [0.0, 0.0], [0.0, 0.0]]])
    d = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "obj_id int, ly double, lz double")
    far = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)) + np.diag([np.inf] * len(p))
    got = {r.obj_id: r.nearest for r in netframe.nearest(d).collect()}
    assert len(got) == len(p) and max(abs(got[i] - far[i].min()) for i in got) < 1e-9
    assert netframe.nearest(d.limit(1)).count() == 0 and netframe.nearest(d.limit(0)).count() == 0


def test_grid_shape_is_the_least_misfit():
    def misfit(c, r, y, z):
        turned = 0.25 if (c < r if y >= z else r < c) else 0
        return abs(max(c - 1, r - 1) / max(min(c - 1, r - 1), 1) - max(y, z) / max(min(y, z), 1e-9)) + turned + abs(c - r) / (c * r)

    for n in range(1, 61):
        for y, z in ((1.0, 1.0), (5.0, 2.0), (1.0, 7.0), (0.0, 0.0)):
            pairs = [(c, n // c) for c in range(1, n + 1) if n % c == 0]
            pairs = [p for p in pairs if min(p) > 1] or pairs
            assert misfit(*netframe.grid_shape(n, y, z), y, z) == min(misfit(*p, y, z) for p in pairs)


def test_w9_and_a5_scan_the_points_once(spark):
    from markerflow.plans.queries import QUERIES

    for name in ("w9_displacement", "a5_low_motion_objects"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan  # both read the checkpoint


def test_escalation_and_decisions(spark):
    assert cand.escalate({"a": 3, "b": 15}, ["a", "b", "c"], 20) == "b" and cand.escalate({}, ["a", "c"], 2) == "c"
    one = spark.range(1)
    assert values(one.select(num.precedence(F.lit(3), F.lit(7), F.lit(3)), num.precedence(F.lit(4), F.lit(7), F.lit(3)), num.precedence(F.lit(3), F.lit(None).cast("int"), F.lit(3)))) == [(7, 4, 3)]
    t = F.lit(True)
    none = F.lit(None).cast("int")
    assert values(one.select(txt.point_method(~t, t, none, none, none), txt.point_method(t, ~t, none, none, none))) == [("invalid", "no_fallback")]
    assert [r.b for r in one.select(num.ramp(F.lit(5.0), F.lit(1.0), F.lit(1.0)).alias("c")).select("c.b").collect()] == [141]


def test_closest_frames_keep_both_sides(spark):
    rows = [(0, f, p, 10) for p, f in enumerate([1, 8, 9, 20, 11])]
    d = spark.createDataFrame(rows, "k int, frame int, pos int, q int")
    assert sorted(r.frame for r in match.closest_frames(d, ["k"], "q", "frame", 2).collect()) == [9, 11]
    assert sorted(r.frame for r in match.closest_frames(d, ["k"], "q", "frame", 3).collect()) == [8, 9, 11]
    assert match.closest_frames(d, ["k"], "q", "frame", -1).count() == 5


def test_stream_match(spark, tmp_path):
    t = spark.createDataFrame([(f, 1, 1.0 * f, 2.0, 0.9, 1) for f in range(5)], "frame int, obj_id int, u double, v double, quality double, valid int").withColumn("ts", F.current_timestamp())
    t.repartition(1).write.parquet(str(tmp_path / "t"))
    side = lambda: spark.readStream.schema(t.schema).parquet(str(tmp_path / "t"))
    q = memory.stream_match(side(), side(), 0.5, 1, 0).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.gframe, r.uL, r.uR) for r in spark.table("pairs").collect()) == [(g, g - 1.0, float(g)) for g in range(1, 5)]


def test_batch_states_give_the_lists_of_batch_status(spark):
    rows = [("L", "ok", 2, 10), ("L", "ok", 1, 5), ("L", "ok", 2, 1), ("L", "failed", 3, 7), ("L", "ok", None, 4), ("R", "other", 9, 2), ("R", None, 9, 3)]
    batches = spark.createDataFrame(rows, "side string, status string, batch int, rows long")
    states = media.batch_states(batches).collect()
    assert {tuple(r) for r in states} == {("L", "ok", 1, 1, 5), ("L", "ok", 2, 2, 11), ("L", "failed", 3, 1, 7), ("L", "ok", None, 1, 4), ("R", "other", 9, 1, 2), ("R", None, 9, 1, 3)}
    for side in media.batch_status(batches).collect():
        mine = [r for r in states if r.side == side.side]
        assert side.rows == sum(r["rows"] for r in mine)
        for status in ("ok", "stopped", "failed"):
            assert side[status] == sorted(b for r in mine if r.status == status and r.batch is not None for b in [r.batch] * r.times)
    assert media.batch_states(batches.limit(0)).count() == 0


def test_small_sources(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(np.array([0, 16384, -32768], "<i2").tobytes())
    assert [(r.idx, r.value) for r in files.read_audio(spark, str(tmp_path / "a.wav")).orderBy("idx").collect()] == [(0, 0.0), (1, 0.5), (2, -1.0)]

    for n, name in ((2, "00002.jpg"), (10, "10.JPEG"), (1, "f1.jpg")):
        (tmp_path / name).write_bytes(b"x" * n)
    assert [(r.frame, len(r.content)) for r in files.read_frames(spark, str(tmp_path)).collect()] == [(1, 1), (2, 2), (10, 10)]
    (tmp_path / "clip.MP4").write_bytes(b"")
    assert files.resolve_video(str(tmp_path / "clip.mp4")).endswith("clip.MP4")
    with pytest.raises(FileNotFoundError):
        files.resolve_video(str(tmp_path / "none.mp4"))
    with pytest.raises(ValueError, match="workers"):
        num.check_arguments(scale=0.5, step=1, workers=0)
    num.check_arguments(scale=0.5, max_frames=-1)
    files.write_package(spark.createDataFrame([("a/b.json", "{}")], "path string, body string"), str(tmp_path / "pkg"))
    assert (tmp_path / "pkg" / "a" / "b.json").read_text() == "{}"
    (tmp_path / "s.json").write_text("{}")
    with pytest.raises(ValueError, match="detected_frame_indices"):
        files.read_detections(spark, str(tmp_path / "s.json"))


def test_viewer_lines_are_the_document(spark, tmp_path):
    import json

    from pyspark.sql import functions as F

    rows = [(f, o, float(f + o)) for f in range(30) for o in range(3)]
    frames = spark.createDataFrame(rows, "frame_L int, obj_id int, X double").groupBy("frame_L").agg(F.sort_array(F.collect_list(F.struct("obj_id", "X"))).alias("points"))
    edges = spark.createDataFrame([(2, 3), (0, 1), (0, 5)], "a int, b int")
    whole = json.loads(files.viewer_payload(frames, edges, {"label": "a \"run\""}).first().json)
    lines = files.viewer_lines(frames, edges, {"label": "a \"run\""})
    files.write_lines(lines, str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    assert json.loads(text) == whole and len(whole["frames"]) == 30
    empty = files.viewer_lines(frames.where("false"), edges.where("false"), {})
    files.write_lines(empty, str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))) == {"frameCount": 0, "frames": [], "edges": []}
