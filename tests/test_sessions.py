"""Prompt sessions, as a log and as a stream with late events; camera sources against a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerflow.sources import cameras
from markerflow.streaming import sessions

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def log(n=60, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for s in (1, 2):
        for i in range(n):
            kind = sessions.KINDS[int(rng.choice(5, p=[0.6, 0.15, 0.1, 0.1, 0.05]))]
            box = rng.random() < 0.2
            labels = [2, 3, 1] if box else [int(rng.integers(2))] * int(rng.integers(3))
            out.append((s, i, int(rng.integers(3)), int(rng.integers(2)), kind, [(float(i), float(k)) for k in range(len(labels))] if kind == "points" else None, labels if kind == "points" else None, bool(rng.random() < 0.3)))
    return out


def folded(rows):
    """(session, seq) -> (accepted, labels, masked, prompted, objects)."""
    out = {}
    for s in {r[0] for r in rows}:
        state = {}
        for _, seq, obj, frame, kind, points, labels, fresh in sorted(r for r in rows if r[0] == s):
            ok = True
            if kind == "reset":
                state = {}
            elif kind == "remove":
                state = {k: v for k, v in state.items() if k[0] != obj}
            elif kind == "clear":
                state = {k: v for k, v in state.items() if k != (obj, frame)} | ({(obj, None): "known"} if any(k[0] == obj for k in state) else {})
            elif kind == "mask":
                state[obj, frame] = "mask"
            elif fresh or 2 not in labels:
                old = state.get((obj, frame), [])
                state[obj, frame] = (old if not fresh and old != "mask" else []) + labels
            else:
                ok = False
            now = state.get((obj, frame), [])
            real = {k for k, v in state.items() if k[1] is not None}
            out[s, seq] = (ok, [] if now == "mask" else now, now == "mask", len(real), len({k[0] for k in state}))
    return out


def answers(df):
    return {(r.session, r.seq): (r.accepted, list(r.labels), r.masked, r.prompted, r.objects) for r in df.collect()}


def test_states_of_a_log(spark):
    rows = log()
    df = spark.createDataFrame(rows + rows[:5], sessions.EVENT).repartition(3)
    got = sessions.states(df)
    assert answers(got) == folded(rows)
    end = {(r.session, r.obj_id, r.frame): (list(r.labels), r.masked) for r in sessions.at_frame(got).collect()}
    last = {}
    for (s, seq), (ok, labels, masked, *_) in sorted(folded(rows).items()):
        r = next(x for x in rows if x[:2] == (s, seq))
        if r[4] == "reset":
            last = {k: v for k, v in last.items() if k[0] != s}
        elif r[4] == "remove":
            last = {k: v for k, v in last.items() if k[:2] != (s, r[2])}
        else:
            last[s, r[2], r[3]] = (labels, masked)
    assert end == {k: v for k, v in last.items() if v[0] or v[1]}
    assert sessions.states(df.where("false")).count() == 0


@pytest.mark.parametrize("every", [8, 1000])
def test_a_stream_replays_late_events_from_its_snapshot(spark, tmp_path, every):
    rows = log(40, 3)
    order = {1: [*range(12), *range(16, 24), *range(12, 16), *range(24, 40)]}  # four events come after later ones
    order[2] = order[1]
    batches = [[r for r in rows if r[1] in order[1][a:b]] for a, b in ((0, 16), (16, 26), (26, 40))]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = []
    try:
        for i, batch in enumerate(batches):  # each run starts again from the checkpoint
            spark.createDataFrame(batch, sessions.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(sessions.EVENT).parquet(str(tmp_path / "in"))
            q = sessions.session_stream(stream, every).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, k: out.extend(df.collect())).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    final = {(r.session, r.seq): r for r in out if r.kind != "late"}
    late = {(r.session, r.seq) for r in out if r.kind == "late"}
    if every == 1000:
        assert not late
        assert {k: (r.accepted, list(r.labels), r.masked, r.prompted, r.objects) for k, r in final.items()} == folded(rows)
        assert len(out) > len(rows)  # events after the late ones were given again
    else:
        kept = [r for r in rows if (r[0], r[1]) not in late]
        assert {k: (r.accepted, list(r.labels), r.masked, r.prompted, r.objects) for k, r in final.items()} == folded(kept)


class Camera(BaseHTTPRequestHandler):
    asked: list = []
    flaky = {"left": 1}

    def do_GET(self):  # noqa: N802
        self.asked.append(self.path)
        if self.path.endswith("/gopro/media/list"):
            self.send_error(404)
        elif self.path.endswith("/gp/gpMediaList"):
            if Camera.flaky["left"]:
                Camera.flaky["left"] -= 1
                body = b"busy"
            else:
                body = json.dumps({"media": [{"d": "100GOPRO", "fs": [{"n": "GX010001.MP4", "s": "3"}]}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)
        elif "bad" in self.path:
            self.send_error(500)
        else:
            self.send_response(200)
            self.end_headers()
            self.wfile.write(self.path.encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def camera():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Camera)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Camera.asked.clear()
    Camera.flaky["left"] = 1
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_media_list_falls_back_and_retries(spark, camera):
    lists = cameras.media_lists(spark, [camera, camera + "/"], timeout=2)
    assert lists.rdd.getNumPartitions() == 2
    row = lists.select("path", F.from_json("payload", "media array<struct<d:string>>").alias("m")).collect()
    assert [(r.path, r.m.media[0].d) for r in row] == [("/gp/gpMediaList", "100GOPRO")] * 2
    with pytest.raises(Exception):
        cameras.media_lists(spark, ["127.0.0.1:9"], timeout=1, retries=1).collect()
    assert "/gopro/media/list" in Camera.asked
    with pytest.raises(ValueError):
        cameras.base_url(" ")
    assert cameras.base_url("10.0.0.1/ ") == "http://10.0.0.1"


def test_recordings_are_fetched_once(spark, camera, tmp_path):
    folder = str(tmp_path / "shared")
    rows = [(camera, "100GOPRO", f"GX0{i}0001.MP4", f"k{i % 2}") for i in range(4)]
    df = spark.createDataFrame(rows, "camera string, directory string, name string, key string")
    bad = df.union(spark.createDataFrame([(camera, "bad", "x.MP4", "k0")], df.schema)).repartition(5)
    with pytest.raises(Exception):
        cameras.fetch(bad, folder)
    left = [p for p in (tmp_path / "shared").rglob("*") if p.is_file()]
    assert left == []  # nothing was committed, nothing lies about
    cameras.fetch(df, folder)
    assert {(r.key, r.name, r.size) for r in cameras.manifests(spark, folder).collect()} == {(k, n, len(f"/videos/DCIM/100GOPRO/{n}")) for _, _, n, k in rows}
    assert (tmp_path / "shared" / "k1" / "GX010001.MP4").read_text() == "/videos/DCIM/100GOPRO/GX010001.MP4"
    asked = len(Camera.asked)
    more = df.union(spark.createDataFrame([(camera, "100GOPRO", "GX990001.MP4", "k1")], df.schema))
    cameras.fetch(more, folder)
    assert len(Camera.asked) == asked + 1  # what the manifest lists was not asked for again
    assert cameras.manifests(spark, folder).count() == 5
    for name in ("../x", ".hidden", ""):
        with pytest.raises(ValueError):
            cameras._safe(name)
