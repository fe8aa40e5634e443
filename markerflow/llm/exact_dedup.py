"""Exact dedup through an extendible-hash index kept as files in the shared folder.

1. Each task normalises its whole texts, collapses the copies it sees (comparing bytes) and writes one index entry per
   distinct text and one row per document: the index log, a table in the shared folder.
2. The directory grows from a histogram of the entries' hash prefixes: a bucket whose entries exceed `bucket_bytes` is split
   by one more bit, and the directory doubles when a bucket has used all its bits.
3. Owner tasks take ranges of buckets, which are ranges of the hash, of about as many bytes each; they chain the entries of a bucket by hash and compare bytes within a chain; each chain
   node counts its documents and keeps the largest doc_id.
4. The verdict of an entry goes back to the documents of that entry. An entry never spans tasks, so a text that a third of
   all rows share makes one entry per task, and no join key is hot.

Defined cases: null text is the empty text; texts are equal after lower-casing A-Z only; of rows with one doc_id and one
text, exactly one is kept; a null doc_id ranks below all others; an empty table gives no rows. Other columns are ignored
unless named in `carry`.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import give_back
from .common import as_bytes, partitions, stage, sweeping

#: Entries' bytes that a bucket holds before it is split, and the most bits that the directory may use; the directory has at
#: most 2**MAX_DEPTH slots whatever the input.
BUCKET_BYTES, MAX_DEPTH = 256 << 10, 20
#: A task writes out the entries it holds when their texts reach this many bytes; later copies start a new entry.
RUN_BYTES = 16 << 20


def _log(carry: T.StructType):
    names = [f.name for f in carry]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, task = zstandard.ZstdCompressor(level=3), uuid.uuid4().hex
        held: dict[bytes, list] = {}
        size = made = 0

        def entries() -> pd.DataFrame:
            rows = []
            for text, (number, count, (known, top), lead) in held.items():
                sha = hashlib.sha256(text).digest()
                rows.append((f"{task}-{number}", int.from_bytes(sha[:8], "big", signed=True), sha, count, known, top, lead, packer.compress(text)))
            out = pd.DataFrame(rows, columns=["entry", "h", "sha", "n", "known", "top", "lead", "packed"])
            for c in ("row", *names):
                out[c] = None
            return out

        row = 0
        for pdf in batches:
            entry, numbers = [], []
            values = list(zip(pdf["known"].tolist(), pdf["id"].tolist()))
            for value, data in zip(values, pdf["data"]):
                text = bytes(data).lower()
                at = held.get(text)
                if at is None:
                    at = held[text] = [made, 0, value, row]
                    made += 1
                    size += len(text)
                at[1] += 1
                if value > at[2]:
                    at[2], at[3] = value, row
                entry.append(f"{task}-{at[0]}")
                numbers.append(row)
                row += 1
            out = pdf[names].assign(entry=entry, known=pdf["known"], top=pdf["id"], row=np.array(numbers, dtype="int64"))
            for c in ("h", "sha", "n", "lead", "packed"):
                out[c] = None
            yield out[["entry", "h", "sha", "n", "known", "top", "lead", "packed", "row", *names]]
            if size >= RUN_BYTES:
                yield entries()
                held.clear()
                size = 0
                give_back()
        if held:
            yield entries()
            held.clear()
        give_back()

    return run


class Directory:
    """The index's directory: 2**depth slots, each naming a bucket; buckets have local depths of their own."""

    def __init__(self, sizes: np.ndarray, bucket_bytes: int) -> None:
        """sizes: bytes by the first bits of the hash, one for each of 2**n values of them."""
        most = len(sizes).bit_length() - 1
        weight = [np.asarray(sizes, dtype=np.int64)]
        for _ in range(most):
            weight.append(weight[-1].reshape(-1, 2).sum(axis=1))
        self.depth, done, prefixes = 0, [], np.zeros(1, np.int64)
        for d in range(most + 1):
            full = (weight[most - d][prefixes] > bucket_bytes) & (d < most)
            done.append((d, prefixes[~full]))
            if not full.any():
                break
            self.depth = d + 1  # the directory doubles
            prefixes = (2 * prefixes[full][:, None] + np.array([0, 1])).ravel()
        width = np.concatenate([np.full(len(p), 1 << (self.depth - d)) for d, p in done])
        start = np.concatenate([p << (self.depth - d) for d, p in done])
        order = np.argsort(start)
        self.slots = np.repeat(np.arange(len(start), dtype=np.int32), width[order])

        held = np.bincount(self.slots[np.arange(len(sizes)) >> (most - self.depth)], weights=sizes, minlength=len(start))
        self.middle = (np.cumsum(held) - held / 2) / max(1.0, held.sum())

    def owners(self, n: int) -> np.ndarray:
        """Of each bucket the owner among n: neighbours of about equal bytes go together."""
        return np.minimum((self.middle * n).astype(np.int32), n - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        u = h.astype(np.int64).view(np.uint64)
        return self.slots[(u >> np.uint64(64 - self.depth)).astype(np.int64)] if self.depth else np.zeros(len(u), np.int32)


def _owner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries come sorted by bucket and hash: the chain of one hash is held at a time, and each of its nodes has one text."""
    unpack = zstandard.ZstdDecompressor()
    chain: list[list] = []  # [text, group, entries] by node
    last: tuple | None = None

    def settle() -> list[tuple]:
        out = []
        for _, number, members in chain:
            out += [(e, f"{last[1]}-{number}", *rest) for e, *rest in members]
        return out

    rows: list[tuple] = []
    columns = ["entry", "node", "n", "known", "top", "lead"]
    for pdf in batches:
        for bucket, h, entry, n, known, top, lead, packed in zip(pdf["bucket"], pdf["h"], pdf["entry"], pdf["n"], pdf["known"], pdf["top"], pdf["lead"], pdf["packed"]):
            if (bucket, h) != last:
                rows += settle()
                chain, last = [], (bucket, h)
            text = unpack.decompress(bytes(packed))
            for node in chain:
                if node[0] == text:
                    break
            else:
                node = [text, len(chain), []]
                chain.append(node)
            node[2].append((entry, n, known, top, lead))
        if len(rows) > 20000:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    rows += settle()
    yield pd.DataFrame(rows, columns=columns)


def exact_dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, carry: list[str] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the columns named in carry, a row for each row of docs."""
    spark = docs.sparkSession
    names = {c: f"carry_{i}" for i, c in enumerate(carry or [])}
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.lit(0)).alias("id"), as_bytes(F.col("text")).alias("data"), *[F.col(c).alias(a) for c, a in names.items()])
    extra = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema if f.name in names.values()])
    schema = T.StructType(T.StructType.fromDDL("entry string, h long, sha binary, n long, known boolean, top long, lead long, packed binary, row long").fields + extra.fields)
    log = stage(rows.mapInPandas(_log(extra), schema), "dedup-log")
    entries, members = log.where("packed IS NOT NULL"), log.where("packed IS NULL")

    # bounded by 2**MAX_DEPTH prefixes, whatever the input
    histogram = entries.groupBy(F.shiftrightunsigned("h", 64 - MAX_DEPTH).alias("p")).agg(F.sum(F.length("packed") + F.lit(64)).alias("s"))
    sizes = np.zeros(1 << MAX_DEPTH, np.int64)
    with sweeping(spark):
        for r in histogram.toLocalIterator():
            sizes[r.p] = r.s
    directory, owners = Directory(sizes, bucket_bytes), partitions(spark)
    shared = spark.sparkContext.broadcast((directory, directory.owners(owners)))

    @F.pandas_udf("bucket int, owner int")
    def place(h: pd.Series) -> pd.DataFrame:
        index, owner = shared.value
        bucket = index.find(h.to_numpy())
        return pd.DataFrame({"bucket": bucket, "owner": owner[bucket]})

    placed = entries.select(place("h").alias("at"), "h", "entry", "n", "known", "top", "lead", "packed").select("at.bucket", "at.owner", "h", "entry", "n", "known", "top", "lead", "packed")
    dealt = placed.repartitionById(owners, "owner").drop("owner").sortWithinPartitions("bucket", "h")
    # an owner's chain nodes hold one text each; what is summed over a node's entries is one row per task that saw the text
    nodes = stage(dealt.mapInPandas(_owner, "entry string, node string, n long, known boolean, top long, lead long"), "dedup-nodes")
    whole = Window.partitionBy("node")
    best = F.max(F.struct("known", "top", "entry")).over(whole)
    verdict = nodes.select("entry", F.sum("n").over(whole).alias("group_size"), best["known"].alias("any_id"), best["top"].alias("keep"), F.when(best["entry"] == F.col("entry"), F.col("lead")).alias("chosen"))
    about = entries.select("entry", F.lower(F.hex("sha")).alias("text_sha256")).join(verdict, "entry")
    return members.select("entry", "known", "top", "row", *names.values()).join(about, "entry").select(
        F.when(F.col("known"), F.col("top")).alias("doc_id"),
        F.when(F.col("any_id"), F.col("keep")).alias("keep_id"),
        "group_size",
        (F.col("chosen").isNotNull() & (F.col("chosen") == F.col("row"))).alias("kept"),
        "text_sha256",
        *[F.col(a).alias(c) for c, a in names.items()],
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
