"""Media lists and recording groups; batch bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import percentiles
from ..functions.text import VIDEO_SUFFIXES, chapter, clip_key, row_hash, suffix

#: The nested list with all its alternative key names, oldest camera software included.
MEDIA = "media array<struct<d:string,directory:string,fs:array<struct<n:string,name:string,filename:string,s:string,size:string,cre:string,mod:string,created:string,modified:string>>>>"


def flatten_media(lists: DataFrame, column: str = "payload") -> DataFrame:
    """Rows (directory, name, ext, size, timestamp) of JSON media lists; entries without a name or folder and other files are left
    out, a size that is no number is 0."""
    parsed = lists.select(F.from_json(column, MEDIA).alias("m")).select(F.explode("m.media").alias("f"))
    files = parsed.select(F.coalesce(F.nullif("f.d", F.lit("")), "f.directory").alias("directory"), F.explode("f.fs").alias("x"))
    given = lambda *names: F.coalesce(*[F.nullif(f"x.{n}", F.lit("")) for n in names])
    rows = files.select("directory", given("n", "name", "filename").alias("name"), F.coalesce(F.coalesce("x.s", "x.size").try_cast("long"), F.lit(0)).alias("size"), F.coalesce(given("cre", "mod", "created", "modified"), F.lit("")).alias("timestamp"))
    return rows.withColumn("ext", suffix("name")).where(F.col("directory").isNotNull() & (F.col("directory") != "") & F.col("name").isNotNull() & F.col("ext").isin(*VIDEO_SUFFIXES)).select("directory", "name", "ext", "size", "timestamp")


def recordings(files: DataFrame) -> DataFrame:
    """Chapters of one recording in order, with newest timestamp and name and total size."""
    f = files.where(suffix("name") == ".mp4").select(clip_key("name").alias("key"), "name", "size", "timestamp", chapter("name").alias("chapter"))
    parts = F.sort_array(F.collect_list(F.struct("chapter", "name")))
    return f.groupBy("key").agg(F.transform(parts, lambda s: s["name"]).alias("files"), F.max("timestamp").alias("timestamp"), F.max("name").alias("sort_name"), F.sum("size").alias("total_size"))


def newest(groups: DataFrame, n: int) -> DataFrame:
    """The n-th newest recording (0 first), by timestamp, then name."""
    return groups.orderBy(F.col("timestamp").desc(), F.col("sort_name").desc()).limit(n + 1).withColumn("_r", F.row_number().over(Window.orderBy(F.col("timestamp").desc(), F.col("sort_name").desc()))).where(F.col("_r") == n + 1).drop("_r")


def devices(adverts: DataFrame) -> DataFrame:
    """First advertisement of each serial and the camera's short id."""
    return adverts.groupBy("serial").agg(F.min_by(F.struct("name", "pos"), "pos").alias("a")).select("serial", "a.name", F.right("serial", F.lit(4)).alias("short_id"))


def batch_status(batches: DataFrame) -> DataFrame:
    """Per side the batches by status and the rows of all of them, whatever their status. A side's lists are one row; batch_states
    gives the same as rows, for runs whose batches don't fit one."""
    named = lambda s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("batch")))).alias(s)
    return batches.groupBy("side").agg(named("ok"), named("stopped"), named("failed"), F.sum("rows").alias("rows"))


def batch_states(batches: DataFrame) -> DataFrame:
    """What batch_status lists, a row for each batch of a side and status: how often it occurs, and its rows. Other statuses and null
    batches, whose rows batch_status counts but which it does not list, are rows too."""
    return batches.groupBy("side", "status", "batch").agg(F.count("*").alias("times"), F.sum("rows").alias("rows"))


def complete(batches: DataFrame, fingerprint) -> DataFrame:
    ok = (F.col("status") == "ok") & (F.col("fingerprint") == fingerprint) & (F.col("rows") >= F.col("frames") * F.size("object_ids"))
    return batches.withColumn("complete", F.coalesce(ok, F.lit(False)))


def cache_status(frames: DataFrame, by: str, total) -> DataFrame:
    """Frames present, first and last of a cache, and whether that is all."""
    return frames.groupBy(by).agg(F.count_distinct("frame").alias("present"), F.min("frame").alias("first"), F.max("frame").alias("last")).withColumn("complete", F.col("present") >= total)


def dropout(tracks: DataFrame) -> DataFrame:
    """Observations, invalid ones and their share by object."""
    bad = F.count_if(F.col("valid") == 0)
    return tracks.groupBy("obj_id").agg(F.count("*").alias("total"), bad.alias("invalid"), (100.0 * bad / F.greatest(F.count("*"), F.lit(1))).alias("pct"))


def counters(tracks: DataFrame) -> DataFrame:
    """Frames, missing masks, and invalid frames, which the format reports and never counts."""
    return tracks.agg(F.count_distinct("frame").alias("frames_processed"), F.count_if(F.col("method") == "missing").alias("missing_masks"), F.lit(0).alias("invalid_frames"))


def match_summary(points: DataFrame) -> DataFrame:
    """Counts and error statistics of valid observations; the statistics are null when there are none."""
    ok = F.col("valid_3d") == 1
    err = F.when(ok, F.col("err_px"))
    pct = percentiles(err, 0.5, 0.95)
    return points.agg(F.count("*").alias("total_matched_obs"), F.count_if(ok).alias("valid_3d_obs"), (100.0 * F.count_if(ok) / F.greatest(F.count("*"), F.lit(1))).alias("valid_pct"), F.avg(err).alias("err_mean"), F.get(pct, F.lit(0)).alias("err_median"), F.get(pct, F.lit(1)).alias("err_p95"))


def found_share(frames: DataFrame, found, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Frames scanned, those with a detection and their share in percent, 0 of none."""
    hit, n = F.count_if(found), F.count("*")
    return frames.groupBy(*by).agg(n.alias("scanned"), hit.alias("found"), F.coalesce(100.0 * hit / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("found_pct"))


def cache_validity(caches: DataFrame, inputs: list[str], stored: str = "hash", present: str = "present", total: str = "total") -> DataFrame:
    """Adds hash_now, valid and why a cache has to be built again: its inputs changed, or frames are missing."""
    now = row_hash(*inputs)
    same, whole = F.coalesce(F.col(stored) == F.col("hash_now"), F.lit(False)), F.col(present) >= F.col(total)
    reason = F.when(~same, F.when(F.col(stored).isNull(), "no hash").otherwise("inputs changed")).when(~whole, "incomplete")
    return caches.withColumn("hash_now", now).withColumns({"valid": same & whole, "reason": reason})


def dropout_merged(parts: DataFrame) -> DataFrame:
    """dropout() of several workers' counts (obj_id, total, invalid) together."""
    bad, n = F.sum("invalid"), F.sum("total")
    return parts.groupBy("obj_id").agg(n.alias("total"), bad.alias("invalid"), (100.0 * bad / F.greatest(n, F.lit(1))).alias("pct"))
