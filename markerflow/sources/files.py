"""Readers and writers of the engine's files. Types are enforced by name; a missing required column raises ValueError."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.idioms import running
from ..operators.masks import mask_rle
from ..schemas import CANDIDATE, OBS_3D, TRACK_2D, conform
from . import images

TRACK_REQUIRED = ["frame", "obj_id", "u", "v", "quality", "valid"]
OBS_REQUIRED = ["frame_L", "obj_id", "X", "Y", "Z", "valid_3d"]


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows as text with pos, their order: by file name (of a folder's parts), then by place in the file."""
    raw = spark.read.csv(path, header=True)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return raw.select("*", place.alias("pos"))


POS = ", pos struct<file:string,block:bigint,row:bigint>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, wherever the session's file systems keep it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """2D tracks with pos, the order of the rows in the file."""
    raw = _csv(spark, path)
    return conform(raw.drop("pos"), TRACK_2D, TRACK_REQUIRED, path, ["pos"], raw)


def read_tracks_or_none(spark: SparkSession, path: str) -> DataFrame:
    """The same, no rows where the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], TRACK_2D + POS)
    return read_tracks(spark, path)


def count_tracks(spark: SparkSession, path: str) -> int:
    """Rows of a track file, 0 where it is missing."""
    return read_tracks_or_none(spark, path).count()


def read_points(spark: SparkSession, path: str, pixels: bool = True) -> DataFrame:
    """3D observations; with pixels, uL and vL are required too."""
    raw = _csv(spark, path)
    return conform(raw.drop("pos"), OBS_3D, OBS_REQUIRED + (["uL", "vL"] if pixels else []), path, ["pos"], raw)


def read_valid_points(spark: SparkSession, path: str) -> DataFrame:
    rows = read_points(spark, path, pixels=False).where("valid_3d = 1")
    if rows.isEmpty():
        raise ValueError(f"{path} has no valid_3d rows.")
    return rows


PROMPT = "struct<x:double,y:double,local_x:double,local_y:double,click_xy:array<double>,label:int>"


def read_prompts(spark: SparkSession, path: str, side: str, prefer_local: bool = True) -> DataFrame:
    """Prompt points (x, y, label) of CSV, of a JSON list, of {side: list} or of {candidates: list}."""
    if path.lower().endswith(".csv"):
        raw = _csv(spark, path)
        raw = conform(raw.drop("pos"), CANDIDATE + ", label int", [], path, ["pos"], raw)
        rows = raw.select(F.struct("x", "y", "local_x", "local_y", F.lit(None).cast("array<double>").alias("click_xy"), "label").alias("p"), F.col("pos.row").alias("i"))
    else:
        text = spark.read.text(path, wholetext=True)
        parsed = text.select(F.from_json("value", f"array<{PROMPT}>").alias("l"), F.from_json("value", f"struct<`{side}`:array<{PROMPT}>,candidates:array<{PROMPT}>>").alias("s"), "value")
        listed = F.when(F.ltrim("value").startswith("["), F.col("l")).otherwise(F.coalesce(F.col(f"s.{side}"), F.col("s.candidates")))
        rows = parsed.select(F.posexplode(listed).alias("i", "p"))
    value = lambda n, k: F.coalesce(*([F.col(f"p.local_{n}")] if prefer_local else []), F.col(f"p.{n}"), F.get("p.click_xy", F.lit(k)))
    return rows.select(F.col("i").alias("pos"), value("x", 0).alias("x"), value("y", 1).alias("y"), F.coalesce("p.label", F.lit(1)).alias("label"))


def read_sync(spark: SparkSession, path: str) -> DataFrame:
    """Trims of a sync file with the drops that undo them."""
    rows = spark.read.schema("mode string, trim_left long, trim_right long, left_flash long, right_flash long, left_reason string, right_reason string, scale double").json(path, multiLine=True)
    first = rows.first()
    if first is None or first.trim_left is None or first.trim_right is None:
        raise ValueError(f"{path} is not a calibration sync JSON with trim_left/trim_right.")
    return rows.withColumns({"left_drop": -F.col("trim_left"), "right_drop": -F.col("trim_right")})


def resolve_sync(mode: str | None, json_path: str | None, left_drop: int | None, right_drop: int | None, default_json: str) -> str:
    """Which sync applies: 'json', 'manual' or 'auto'. An explicit mode sets aside only the default file."""
    path = None if json_path is None or json_path.strip().lower() in ("", "none", "null", "false") else json_path
    if mode is not None and path == default_json:
        path = None
    manual = left_drop is not None or right_drop is not None
    if mode is not None and path:
        raise ValueError("Use either a sync mode for new sync or a sync file for saved sync, not both.")
    if path and manual:
        raise ValueError("Use either a sync file or manual drops, not both.")
    return "json" if path else "manual" if manual else "auto"


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detected frame indices (idx, pos) of a statistics file, which has to hold a list of them."""
    rows = spark.read.schema("detected_frame_indices array<int>").json(path, multiLine=True)
    first = rows.first()
    if first is None or first.detected_frame_indices is None:
        raise ValueError(f"{path} holds no detected_frame_indices; run the statistics again.")
    return rows.select(F.posexplode("detected_frame_indices").alias("pos", "idx"))


def parse_nested(df: DataFrame, column: str, ddl: str, defaults: dict) -> DataFrame:
    """The fields of a column of JSON text, each with its default where it is absent or null."""
    parsed = df.withColumn("_json", F.from_json(column, ddl))
    names = [f.strip().split(" ", 1)[0] for f in ddl.split(",")]
    return parsed.withColumns({n: F.coalesce(F.col(f"_json.{n}"), F.lit(defaults[n])) if n in defaults else F.col(f"_json.{n}") for n in names}).drop("_json")


CORRECTIONS = "version int, coordinate_space string, corrections struct<left:array<{0}>,right:array<{0}>>".format("struct<frame:int,obj_id:int,positive:array<struct<x:double,y:double>>,negative:array<struct<x:double,y:double>>,box:array<double>>")


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """(side, frame, obj_id, positive, negative, box) with absent lists as empty ones."""
    rows = spark.read.schema(CORRECTIONS).json(path, multiLine=True)
    empty = F.array().cast("array<struct<x:double,y:double>>")
    sides = [rows.select(F.lit(s).alias("side"), F.explode(f"corrections.{s}").alias("c")) for s in ("left", "right")]
    return sides[0].union(sides[1]).select("side", "c.frame", "c.obj_id", F.coalesce("c.positive", empty).alias("positive"), F.coalesce("c.negative", empty).alias("negative"), "c.box")


def resolve_video(path: str) -> str:
    """The path, or the same with its suffix in another case if that exists."""
    p = Path(path)
    for q in (p, p.with_suffix(p.suffix.lower()), p.with_suffix(p.suffix.upper())):
        if q.exists():
            return str(q)
    raise FileNotFoundError(path)


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """JPEG frames by the number in their names."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.[jJ][pP]*[gG]").load(folder)
    return rows.withColumn("frame", F.regexp_extract("path", r"(\d+)\.[^./]+$", 1).cast("int")).select("frame", "path", "content").orderBy("frame")


MASKS = "video string, frame int, obj_id int, size array<int>, counts array<int>"


def decode_masks(files: DataFrame, per_object: bool = False, threshold: int | None = None) -> DataFrame:
    """Run-length masks (video, frame, obj_id, size, counts) of PNG files (path, content) named <video>/<frame>.png.

    A palette mask gives a row for each label above 0; with per_object, files are <video>/<object>/<frame>.png and every pixel above 0 is the
    object; with a threshold, a file is one object (id 1) of the pixels brighter than that. A frame without a mask has no row, and a file
    that is no image none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                pixels = images.read_png(bytes(content))
                if pixels is None:
                    continue
                parts = path.split("/")
                frame, size = int(parts[-1].rsplit(".", 1)[0]), list(pixels.shape)
                if per_object:
                    found = [(parts[-3], int(parts[-2]), pixels > 0)]
                elif threshold is not None:
                    found = [(parts[-2], 1, pixels > threshold)]
                else:
                    found = [(parts[-2], int(k), pixels == k) for k in np.unique(pixels) if k > 0]
                rows += [(video, frame, obj, size, mask_rle(mask)) for video, obj, mask in found]
            yield pd.DataFrame(rows, columns=["video", "frame", "obj_id", "size", "counts"])

    return files.select("path", "content").mapInPandas(run, MASKS)


def read_masks(spark: SparkSession, folder: str, per_object: bool = False, threshold: int | None = None) -> DataFrame:
    """The same of all PNG files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(folder)
    return decode_masks(files, per_object, threshold)


def masks_of(frames: DataFrame, masks: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Masks of the listed frames (video, frame); those without one are left out if allowed, else they raise."""
    out = frames.join(masks, ["video", "frame"], "left")
    if allow_missing:
        return out.where(F.col("counts").isNotNull())
    missing = F.concat(F.lit("no mask of "), F.col("video"), F.lit(" "), F.col("frame").cast("string"))
    return out.withColumn("counts", F.when(F.col("counts").isNull(), F.raise_error(missing).cast("array<int>")).otherwise(F.col("counts")))


def stepped(frames: DataFrame, start: int, step: int, most: int | None = None, frame: str = "frame") -> DataFrame:
    """Every step-th frame from start on, `most` of them at most."""
    kept = frames.where((F.col(frame) >= start) & ((F.col(frame) - start) % max(1, step) == 0))
    return kept if most is None or most < 0 else kept.where(F.col(frame) < start + most * max(1, step))


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """Samples (idx, value) of mono 16-bit WAV files, scaled to -1..1; a file is one array."""
    import io
    import wave

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                with wave.open(io.BytesIO(bytes(content))) as w:
                    rate, data = w.getframerate(), np.frombuffer(w.readframes(w.getnframes()), "<i2")
                for i in range(0, len(data), 1 << 16):
                    part = data[i : i + (1 << 16)]
                    yield pd.DataFrame({"path": name, "rate": rate, "idx": np.arange(i, i + len(part)), "value": part / 32768.0})

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, rate int, idx long, value double")


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV with a header; sorted by range partitions, so no single task holds the table."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True)


def candidate_rows(cands: DataFrame) -> DataFrame:
    """Candidates as the file has them: ids in order of y, x (of equals the best first) and numbers as text with three (score: four) decimals."""
    levels = running(cands.groupBy("y").agg(F.count("*").alias("_n")), [], "y", F.col("_n"), "_upto").select(F.col("y").alias("_y"), (F.col("_upto") - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("y").orderBy("x", F.col("score").desc(), "method")) - 1
    numbered = cands.withColumn("_within", within).join(levels, F.col("y") == F.col("_y")).withColumn("candidate_id", (F.col("_before") + F.col("_within")).cast("int"))
    three = lambda n: F.format_string("%.3f", F.col(n)).alias(n)
    return numbered.select("candidate_id", three("x"), three("y"), three("area"), "method", F.format_string("%.4f", F.col("score")).alias("score"), three("local_x"), three("local_y"))


def crop_record(side: str, video: str, crop: tuple[int, int, int, int] | None, frame: tuple[int, int]) -> dict:
    """What a crop file says: the crop, or the whole frame where there is none, whether it applies, and whose it is."""
    x, y, w, h = crop or (0, 0, *frame)
    return {"crop_applied": crop is not None, "x": x, "y": y, "w": w, "h": h, "full_width": frame[0], "full_height": frame[1], "side": side, "video": video}


def setup_package(points: DataFrame, crops: dict[str, dict]) -> DataFrame:
    """(path, body) of a portable setup: the prompts of both sides, those of each side and its crop, and a manifest. points are the first
    frame's prompts (side, pos, x, y, label), a few for each object."""
    listed = points.groupBy("side").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x", "y", "label"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["label"].alias("label"))).alias("points"))
    empty = F.array().cast("array<struct<x:double,y:double,label:int>>")
    of = {s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("points"))), empty).alias(s) for s in ("left", "right")}
    both = listed.agg(*of.values())  # one row of two lists
    crop = {s: F.from_json(F.lit(json.dumps(crops[s])), "crop_applied boolean, x int, y int, w int, h int, full_width int, full_height int, side string, video string") for s in ("left", "right")}
    parts = [("prompts/points_left_right.json", F.to_json(F.struct("left", "right", F.struct(*[crop[s].alias(s) for s in crop]).alias("crops"))))]
    for s in crop:
        parts += [(f"{s}/prompts/frame0_points.json", F.to_json(s)), (f"{s}/prompts/crop_roi.json", F.to_json(crop[s]))]
    manifest = F.to_json(F.struct(*[F.lit(crops[s]["video"]).alias(f"{s}_input") for s in crop], F.lit("prompts/points_left_right.json").alias("points_json"), *[F.size(s).alias(f"{s}_count") for s in crop]))
    parts.append(("setup_manifest.json", manifest))
    return both.select(F.explode(F.array(*[F.struct(F.lit(p).alias("path"), b.alias("body")) for p, b in parts])).alias("f")).select("f.path", "f.body")


def write_package(package: DataFrame, root: str) -> None:
    """Writes each text of a package (path, body) under root, one small file each."""
    for row in package.toLocalIterator():  # a handful of files
        at = Path(root) / row.path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(row.body)


def candidate_json(cands: DataFrame, about: dict[str, str]) -> DataFrame:
    """One JSON text: parameters, counts per method and the candidates."""
    one = cands.agg(F.count("*").alias("candidate_count"), F.sort_array(F.collect_list(F.struct("y", "x", "area", "method", "score"))).alias("candidates"))
    counts = cands.groupBy("method").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", "n")))).alias("method_counts"))
    both = one.crossJoin(counts)  # one row each
    return both.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in about.items()], "candidate_count", "method_counts", "candidates")).alias("json"))


def summary_json(summary: DataFrame, about: dict[str, float]) -> DataFrame:
    err = F.struct(F.col("err_mean").alias("mean"), F.col("err_median").alias("median"), F.col("err_p95").alias("p95"))
    return summary.select(F.to_json(F.struct("total_matched_obs", "valid_3d_obs", "valid_pct", *[F.lit(v).alias(k) for k, v in about.items()], err.alias("reproj_err_px")), {"ignoreNullFields": "false"}).alias("json"))


def viewer_payload(frames: DataFrame, edges: DataFrame, about: dict[str, str]) -> DataFrame:
    """The viewer's JSON: frames in order and edges. A run's payload is one document by its format, so a run has to fit a task: limit
    its frames (frames_list's `most`) where it does not."""
    f = frames.agg(F.sort_array(F.collect_list(F.struct(*frames.columns))).alias("frames"), F.count("*").alias("frameCount"))
    e = edges.agg(F.sort_array(F.collect_list(F.array("a", "b"))).alias("edges"))
    return f.crossJoin(e).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in about.items()], "frameCount", "frames", "edges")).alias("json"))


def viewer_lines(frames: DataFrame, edges: DataFrame, about: dict[str, str], frame: str = "frame_L") -> DataFrame:
    """The viewer's JSON in lines (section, a, b, line), which are the document one after the other in this order: its head, a line for each frame, what is
    between, a line for each edge, its end. No row holds more than a frame, so a run of any length is written by as many tasks as it has ranges."""
    blank = F.lit(None).cast("long")
    comma = lambda first, text: F.concat(F.when(first, "").otherwise(","), text)
    stats = frames.agg(F.count("*").alias("_n"), F.min(frame).alias("_first"))
    least = edges.agg(F.min(F.struct("a", "b")).alias("_least"))
    head = F.concat(F.lit("{" + "".join(f"{json.dumps(k)}:{json.dumps(v)}," for k, v in about.items()) + '"frameCount":'), F.col("_n").cast("string"), F.lit(',"frames":['))
    body = frames.crossJoin(F.broadcast(stats))  # one row
    ends = edges.crossJoin(F.broadcast(least))  # one row
    parts = [
        stats.select(F.lit(0).alias("section"), blank.alias("a"), blank.alias("b"), head.alias("line")),
        body.select(F.lit(1), F.col(frame).cast("long"), blank, comma(F.col(frame) == F.col("_first"), F.to_json(F.struct(*frames.columns)))),
        stats.select(F.lit(2), blank, blank, F.lit('],"edges":[')),
        ends.select(F.lit(3), F.col("a").cast("long"), F.col("b").cast("long"), comma((F.col("a") == F.col("_least.a")) & (F.col("b") == F.col("_least.b")), F.to_json(F.array("a", "b")))),
        stats.select(F.lit(4), blank, blank, F.lit("]}")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes a document's lines as text files whose names are in its order."""
    lines.orderBy("section", F.asc_nulls_first("a"), F.asc_nulls_first("b")).select("line").write.text(path)


def viewer_runs(runs: list[DataFrame], limits: list[DataFrame], axes=("lx", "ly", "lz")) -> DataFrame:
    """One JSON of several runs' payloads (json) in the order given, with limits that hold all of them and 0."""
    from ..operators.netframe import merged_limits

    every = payloads = None
    for k, (run, own) in enumerate(zip(runs, limits)):
        run = run.withColumn("_k", F.lit(k))
        payloads, every = (run, own) if payloads is None else (payloads.unionByName(run), every.unionByName(own))
    listed = payloads.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "json"))), lambda r: r["json"]), ",").alias("_runs"), F.count("*").alias("_n"))
    box = merged_limits(every, axes).select(F.to_json(F.struct(*[F.array(f"{a}_lo", f"{a}_hi").alias(a[-1].lower()) for a in axes])).alias("_box"))
    return listed.crossJoin(box).select(F.concat(F.lit('{"runCount":'), F.col("_n").cast("string"), F.lit(',"limits":'), "_box", F.lit(',"runs":['), "_runs", F.lit("]}")).alias("json"))  # one row each
