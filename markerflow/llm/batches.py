"""Distinct texts in packed batches, and counts of 64-bit keys over all of them by exchanging sorted runs.

Texts travel and rest compressed, some megabytes to a row, so that exchanges have few rows. A batch's number is its task's
partition and a running number, a text's number is that of its batch and its slot, so numbers are unique without coordination.

Defined cases: null text is empty; a null doc_id is told from every other by a flag and ranks above all but the largest long, with which
it ranks alike; an empty table gives no batch; a table of more partitions, or a task of more batches, than the numbers can tell
apart raises.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, merged, partitions, stage

#: Bytes of text in a batch (a longer text is a batch of its own), bits of a slot number.
BATCH_BYTES, SLOT_BITS = 4 << 20, 20
#: Bits of a batch's running number in its task, and of the task's.
BATCH_BITS, TASK_BITS = 23, 20
#: The rank of a null doc_id; a flag tells it from the id of that value.
NO_ID = (1 << 63) - 1
#: Counts end here: so many or more.
MANY = 255


def give_back() -> None:
    """Returns freed memory to the system, which a worker that waits for its next task would keep."""
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def pack(texts: list[bytes]) -> bytes:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return zstandard.ZstdCompressor(level=3).compress(np.int64(len(texts)).tobytes() + sizes.tobytes() + b"".join(texts))


def unpack(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(bytes(data))
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.int64, n, 8)) + 8 * (n + 1)
    starts = np.concatenate([[8 * (n + 1)], ends[:-1]]).astype(np.int64)
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _collect(normal: Callable[[bytes], bytes], more: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        if task >> TASK_BITS:
            raise ValueError(f"more than {1 << TASK_BITS} partitions: coalesce the documents first")
        first, number = task << BATCH_BITS, 0
        seen: dict[bytes, int] = {}
        texts, keys, size = [], [], 0

        def batch() -> pd.DataFrame:
            if number >> BATCH_BITS:
                raise ValueError(f"more than {1 << BATCH_BITS} batches in a partition: repartition the documents first")
            return pd.DataFrame([(first + number, None, None, None, b"".join(keys), pack(texts))], columns=["batch", "node", "doc_id", "none", "keys", "packed"]).assign(**dict.fromkeys(more))

        for pdf in frames:
            nodes = np.empty(len(pdf), dtype=np.int64)
            for i, data in enumerate(pdf["data"]):
                text = normal(bytes(data))
                key = hashlib.blake2b(text, digest_size=16).digest()
                node = seen.get(key)
                if node is None:
                    if texts and (size + len(text) > BATCH_BYTES or len(texts) >> SLOT_BITS):
                        yield batch()
                        number, size = number + 1, 0
                        texts.clear()
                        keys.clear()
                    node = seen[key] = ((first + number) << SLOT_BITS) + len(texts)
                    texts.append(text)
                    keys.append(key)
                    size += len(text)
                nodes[i] = node
            yield pd.DataFrame({"batch": None, "node": nodes, "doc_id": pdf["doc_id"].to_numpy(np.int64), "none": pdf["none"].to_numpy(bool), "keys": None, "packed": None} | {c: pdf[c].to_numpy(np.int64) for c in more})
        if texts:
            yield batch()

    return run


def collect(docs: DataFrame, normal: Callable[[bytes], bytes], name: str, tie: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(batches: batch, keys, packed; members: doc_id, none, node; the staged table of the batches). Equal texts of a task have one node.
    none tells that a row has no doc_id, which is NO_ID then. tie: a column of longs that tells rows with one doc_id apart; members have it too, as tie."""
    more = ["tie"] if tie else []
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").cast("long").isNull().alias("none"), as_bytes(F.col("text")).alias("data"), *[F.col(tie).alias(c) for c in more])
    log = stage(rows.mapInPandas(_collect(normal, more), "batch long, node long, doc_id long, none boolean, keys binary, packed binary" + ", tie long" * len(more)), name, "snappy")
    members = stage(log.where("batch IS NULL").select("doc_id", "none", "node", *more), f"{name}-members")
    return log.where("batch IS NOT NULL").select("batch", "keys", "packed"), members, log


def firsts(batches: DataFrame, members: DataFrame) -> DataFrame:
    """(node, head, first): for each node the one node that stands for all of its text, and that text's smallest (doc_id, none), with a
    tie the smallest (doc_id, none, tie).

    Of a text there is a row per task that saw it, however many copies it has.
    """

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for b, k in zip(pdf["batch"], pdf["keys"]):
                n = len(k) // 16
                yield pd.DataFrame({"node": (int(b) << SLOT_BITS) + np.arange(n), "key": [bytes(k[16 * i : 16 * i + 16]) for i in range(n)]})

    least = members.groupBy("node").agg(F.min(F.struct("doc_id", "none", *(["tie"] if "tie" in members.columns else []))).alias("least"))
    rows = batches.select("batch", "keys").mapInPandas(keys, "node long, key binary").join(merged(least), "node")
    same = Window.partitionBy("key")
    return rows.select("node", F.min("node").over(same).alias("head"), F.min("least").over(same).alias("first"))


def _runs(keys_of, parts: int):
    """Each batch's distinct keys as a sorted run per key range, with how often the batch has them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=1)
        for pdf in frames:
            for i in range(len(pdf)):
                row = pdf.iloc[i]
                keys, times = np.unique(np.concatenate([np.empty(0, np.uint64), *keys_of(row)]), return_counts=True)
                if not len(keys):
                    continue
                times = np.minimum(times, MANY).astype(np.uint8)
                edges = np.append(np.searchsorted(keys, part_starts(parts), side="left"), len(keys))
                rows = [(p, int(row["batch"]), packer.compress(front(keys[edges[p] : edges[p + 1]])), packer.compress(times[edges[p] : edges[p + 1]].tobytes())) for p in range(parts) if edges[p] < edges[p + 1]]
                yield pd.DataFrame(rows, columns=["part", "batch", "run", "times"])

    return run


def part_starts(parts: int) -> np.ndarray:
    return np.array([(p << 64) // parts for p in range(parts)], dtype=np.uint64)


def front(run: np.ndarray) -> bytes:
    """A sorted run as differences, byte plane by byte plane, so that shared leading bytes cost next to nothing."""
    return np.diff(run, prepend=np.uint64(0)).astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unfront(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def _counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges the runs of one key range: how often each key occurs in all (MANY: or more), given back run by run. A key is in a run
    once, however many texts of its batch have it."""
    unpacker, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    runs = [unfront(unpacker.decompress(bytes(r))) for r in pdf["run"]]
    own = np.concatenate([np.frombuffer(unpacker.decompress(bytes(t)), np.uint8) for t in pdf["times"]])
    keys = np.concatenate(runs)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.minimum(np.add.reduceat(own[order].astype(np.int64), heads), MANY).astype(np.uint8)
    out = np.empty(len(keys), dtype=np.uint8)
    out[order] = np.repeat(total, np.diff(np.append(heads, len(ordered))))
    ends = np.cumsum([len(r) for r in runs])
    return pd.DataFrame({"batch": pdf["batch"], "part": pdf["part"], "flags": [packer.compress(out[e - len(r) : e].tobytes()) for e, r in zip(ends, runs)]})


def count_keys(batches: DataFrame, keys_of: Callable[[pd.Series], list[np.ndarray]]) -> DataFrame:
    """(batch, flags): for each batch, the counts over all batches of its distinct sorted keys, in order of the key ranges."""
    parts = 2 * partitions(batches.sparkSession)
    runs = batches.mapInPandas(_runs(keys_of, parts), "part int, batch long, run binary, times binary")
    back = runs.groupBy("part").applyInPandas(_counts, "batch long, part int, flags binary")
    return back.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("part", "flags"))).alias("flags"))


def flags_of(flags) -> np.ndarray:
    """Counts aligned with the batch's distinct sorted keys."""
    unpacker = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join(unpacker.decompress(bytes(f["flags"])) for f in (flags if flags is not None else ())), np.uint8)
