"""Data sources over a camera's web server: its media list, and recordings fetched into a shared folder with a manifest.

`media_list` is a source: a partition for each camera, read where it runs; each path is tried in turn, all of them `retries` times, and the first answer
counts. Filters are left to Spark: in Spark 4.1 a filter that a Python source takes stays with the loaded table and would hold for other uses of it. `recordings` is a sink with two phases: tasks fetch files under temporary names,
and only the commit on the driver gives them their names and writes the manifest; an abort removes what was fetched, and a job that ran before is
resumed by leaving out what the manifest lists.
"""

from __future__ import annotations

import json
import os
import shutil
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Where cameras answer with their media list.
MEDIA_PATHS = ("/gopro/media/list", "/gp/gpMediaList")
LIST = "camera string, path string, payload string"
MANIFEST = "manifest.json"


def base_url(text: str) -> str:
    """A camera's address with a scheme and without a last slash."""
    text = text.strip().rstrip("/")
    if not text:
        raise ValueError("no camera address")
    return text if text.startswith(("http://", "https://")) else f"http://{text}"


def first_answer(base: str, paths: tuple[str, ...], retries: int, timeout: float) -> tuple[str, str]:
    """(path, body) of the first path that answers with JSON; the last failure is raised if none does."""
    failure: Exception = ValueError("no path to ask")
    for _ in range(max(1, retries)):
        for path in paths:
            try:
                with urllib.request.urlopen(base + path, timeout=timeout) as answer:
                    body = answer.read().decode("utf-8")
                json.loads(body)
                return path, body
            except (OSError, ValueError) as e:  # no connection, no such path, no JSON
                failure = e
    raise failure


@dataclass
class _Camera(InputPartition):
    url: str


class _ListReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.cameras = [base_url(c) for c in options.get("cameras", "").split(",") if c.strip()]
        self.paths = tuple(p.strip() for p in options.get("paths", ",".join(MEDIA_PATHS)).split(","))
        self.retries, self.timeout = int(options.get("retries", 2)), float(options.get("timeout", 15))
        if not self.cameras:
            raise ValueError("option cameras names no camera")

    def partitions(self) -> list[InputPartition]:
        return [_Camera(c) for c in self.cameras]

    def read(self, partition: _Camera) -> Iterator[tuple]:
        path, body = first_answer(partition.url, self.paths, self.retries, self.timeout)
        yield partition.url, path, body


class MediaList(DataSource):
    """spark.read.format("media_list").option("cameras", "a,b").load(): LIST, a row for each camera. Options: paths, retries, timeout in seconds."""

    @classmethod
    def name(cls) -> str:
        return "media_list"

    def schema(self) -> str:
        return LIST

    def reader(self, schema) -> DataSourceReader:
        return _ListReader(self.options)


@dataclass
class _Fetched(WriterCommitMessage):
    files: list


class _RecordingWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.timeout = options["path"].removeprefix("file://"), float(options.get("timeout", 60))
        self.job = uuid.uuid4().hex

    def _part(self, key: str, name: str, task: str) -> str:
        return os.path.join(self.folder, key, f".{name}.{self.job}.{task}.part")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        task, files = uuid.uuid4().hex, []
        for row in iterator:
            key, name = (_safe(row[n]) for n in ("key", "name"))
            os.makedirs(os.path.join(self.folder, key), exist_ok=True)
            part = self._part(key, name, task)
            with urllib.request.urlopen(row["url"], timeout=self.timeout) as answer, open(part, "wb") as f:
                shutil.copyfileobj(answer, f, length=1 << 20)
            files.append({"key": key, "name": name, "url": row["url"], "size": os.path.getsize(part), "part": part})
        return _Fetched(files)

    def commit(self, messages: list) -> None:
        by: dict[str, list] = {}
        for m in messages:
            for f in m.files if m else ():
                by.setdefault(f["key"], []).append(f)
        for key, files in by.items():
            folder = os.path.join(self.folder, key)
            listed = {f["name"]: f for f in _listed(folder)}
            for f in files:
                os.replace(f.pop("part"), os.path.join(folder, f["name"]))
                listed[f["name"]] = f
            made = os.path.join(folder, f".{MANIFEST}.{self.job}")
            with open(made, "w") as out:
                json.dump({"key": key, "files": sorted(listed.values(), key=lambda f: f["name"])}, out, indent=2)
            os.replace(made, os.path.join(folder, MANIFEST))

    def abort(self, messages: list) -> None:
        """Removes every temporary file of this job, those of tasks that gave no message too."""
        for folder, _, names in os.walk(self.folder):
            for n in names:
                if n.endswith(".part") and f".{self.job}." in n:
                    os.remove(os.path.join(folder, n))


def _safe(name) -> str:
    """A file or folder name that stays where it is put."""
    name = str(name)
    if not name or name in (".", "..") or "/" in name or "\\" in name or name.startswith("."):
        raise ValueError(f"no name of a file: {name!r}")
    return name


def _listed(folder: str) -> list[dict]:
    try:
        with open(os.path.join(folder, MANIFEST)) as f:
            return json.load(f)["files"]
    except FileNotFoundError:
        return []


class Recordings(DataSource):
    """df.write.format("recordings").mode("append").save(folder): fetches (key, name, url) into folder/key/name, a folder that driver and executors share, and
    lists it in folder/key/manifest.json."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _RecordingWriter(self.options)


def register(spark: SparkSession) -> None:
    for source in (MediaList, Recordings):
        spark.dataSource.register(source)


def media_lists(spark: SparkSession, cameras: list[str], **options) -> DataFrame:
    register(spark)
    return spark.read.format("media_list").options(cameras=",".join(base_url(c) for c in cameras), **{k: str(v) for k, v in options.items()}).load()


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """(key, name, url, size) of all that was fetched into a folder; nothing where it has no manifest."""
    files = "array<struct<name:string,url:string,size:long>>"
    try:
        found = spark.read.schema(f"key string, files {files}").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", MANIFEST).json(folder)
    except Exception as e:  # the folder does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "key string, name string, url string, size long")
    return found.select("key", F.explode("files").alias("f")).select("key", "f.name", "f.url", "f.size")


def fetch(recordings: DataFrame, folder: str) -> None:
    """Fetches the files (camera, directory, name, key) of recordings that the manifests of the folder do not list yet."""
    spark = recordings.sparkSession
    register(spark)
    quoted = F.udf(lambda text: urllib.parse.quote(text or "", safe=""), "string")  # a handful of names
    rows = recordings.select("key", "name", F.concat("camera", F.lit("/videos/DCIM/"), quoted("directory"), F.lit("/"), quoted("name")).alias("url"))
    left = rows.join(manifests(spark, folder), ["key", "name"], "left_anti").dropDuplicates(["key", "name"])
    left.write.format("recordings").mode("append").save(folder)
