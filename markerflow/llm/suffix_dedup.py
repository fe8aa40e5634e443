"""Suffix-array dedup of byte strings that repeat across documents, by a common-prefix-aware distributed merge sort.

Every string of SPAN bytes is found through an anchor inside it: the K-byte string with the least hash of the window. Two equal
strings have equal anchors at equal offsets, so only the suffixes at anchors are sorted, each with the SPAN - K bytes before it
as a tie-breaker; that is a sparse suffix array which loses no repeat.

1. Equal texts collapse to one node per task, one head over all, each with the smallest doc_id that has it.
2. Anchors that no second text has are left out (counts by exchanged sorted runs).
3. Tasks write front-coded sorted runs of distinct contexts (anchor, what follows, what precedes) with the smallest doc_id of
   each. Runs are dealt by the anchor's hash (of an anchor in very many texts, by that of more bytes too) and merged by a loser tree that carries each run's common prefix with the last
   winner, so known prefixes are never compared again.
4. The merged order's common prefixes, and those of the contexts' left sides, give for each of the window's offsets the classes of
   equal SPAN-byte strings and the smallest doc_id of each. What a text holds of a smaller doc_id's strings is removed.
A string in very many documents is one context per run, however many documents hold it.

Defined cases: null text is empty; of rows with one text, those with its smallest doc_id are first and the others' bytes repeat them
(texts shorter than SPAN have no strings and lose nothing); a null doc_id ranks above all others but the largest long, with which it
ranks alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import MANY, SLOT_BITS, collect, count_keys, firsts, flags_of, give_back, part_starts, unpack
from .common import partitions, stage, unstage
from .ngram_join import mix, prefix_sums, range_hashes, short

SPAN, K = 50, 24
REST = SPAN - K  # bytes on each side of an anchor that its windows can reach
WIDTH = SPAN + REST
HALF = REST // 2
#: Stands for the bytes beyond a text; it is no byte of UTF-8.
BEYOND = 255
#: Contexts that a task holds before it writes its runs.
RUN = 400_000


def _slide(values: np.ndarray, width: int, better) -> np.ndarray:
    """Best of each run of width values."""
    step, out = 1, values
    while 2 * step <= width:
        out = better(out[:-step], out[step:])
        step *= 2
    return better(out[: len(values) - width + 1], out[width - step : width - step + len(values) - width + 1])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): every K-byte string whose hash is the least of some window of SPAN bytes around it."""
    n = len(text)
    if n < SPAN:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = prefix_sums(np.frombuffer(text, np.uint8))
    start = np.arange(n - K + 1)
    h = range_hashes(sums, start, start + K)
    least = _slide(h, REST + 1, np.minimum)
    padded = np.concatenate([np.zeros(REST, np.uint64), least, np.zeros(REST, np.uint64)])
    at = np.flatnonzero(_slide(padded, REST + 1, np.maximum) == h)
    return at, mix(h[at])  # least hashes are small ones: mixed again, they spread over the key ranges


def _keys(row: pd.Series) -> list[np.ndarray]:
    return [np.unique(short(anchors(t)[1])) for t in unpack(row["packed"])]


def contexts(text: bytes, at: np.ndarray) -> np.ndarray:
    """Rows of WIDTH bytes: the SPAN bytes from the anchor on, then the REST bytes before it, nearest first."""
    pad = np.full(REST, BEYOND, np.uint8)
    data = np.concatenate([pad, np.frombuffer(text, np.uint8), pad])
    offsets = np.concatenate([np.arange(REST, REST + SPAN), np.arange(REST - 1, -1, -1)])
    return data[at[:, None] + offsets]


def spread(rows: np.ndarray, keys: np.ndarray, at: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of hot anchors twice: once with a key of the anchor and the HALF bytes after it, once of it and the HALF bytes before it.

    A window has HALF bytes of its own on one of the anchor's sides at least, so equal strings still meet, and an anchor that very many
    different contexts have is no single key. A hit among some of an anchor's contexts is one among all."""
    if not hot.any():
        return rows, keys, at
    one, more = rows[hot], []
    for begin in (K, SPAN):
        key = keys[hot] ^ np.uint64(begin)
        for column in range(begin, begin + HALF):
            key = (key ^ one[:, column]) * np.uint64(0x100000001B3)
        more.append(mix(key))
    return np.concatenate([rows[~hot], one, one]), np.concatenate([keys[~hot], *more]), np.concatenate([at[~hot], at[hot], at[hot]])


def inside(rows: np.ndarray) -> np.ndarray:
    """Bytes of each context that the text has: from the anchor on, and before it."""
    outside = rows == BEYOND
    return np.stack([np.where(x.any(axis=1), x.argmax(axis=1), x.shape[1]) for x in (outside[:, :SPAN], outside[:, SPAN:])]).astype(np.uint8)


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian words, for sorting."""
    width = -(-rows.shape[1] // 8) * 8
    wide = np.zeros((len(rows), width), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def sort_rows(rows: np.ndarray) -> np.ndarray:
    words = _words(rows)
    return np.lexsort(words.T[::-1])


def common(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it; the first has none."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def encode(rows: np.ndarray) -> bytes:
    """Front coding of sorted rows: the common prefixes, then what each row adds."""
    shared = common(rows)
    return zstandard.ZstdCompressor(level=3).compress(shared.astype(np.uint8).tobytes() + rows[np.arange(rows.shape[1]) >= shared[:, None]].tobytes())


def decode(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, common prefixes)."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), np.uint8)
    shared = raw[:n].astype(np.int64)
    ends = np.cumsum(WIDTH - shared)
    rows = np.empty((n, WIDTH), np.uint8)
    index = np.arange(n)
    for c in range(WIDTH):  # a byte comes from the last row that did not share it
        source = np.maximum.accumulate(np.where(shared <= c, index, 0))
        rows[:, c] = raw[n + ends[source] - WIDTH + c]
    return rows, shared


class LoserTree:
    """Merges sorted runs of WIDTH-byte strings, each given as its bytes end to end and each string's common prefix with its predecessor.

    Every waiting head knows its common prefix with the last string that came out. Of two heads the one that shares more with
    it is smaller, without a look at either; of equals only the bytes beyond the known prefix are compared, and the loser remembers
    where they differ.
    """

    def __init__(self, runs: list[bytes], shared: list[bytes]) -> None:
        self.runs, self.shared = runs, shared
        self.k = max(1, len(runs))
        self.at = [0] * len(runs)
        self.head = [r[:WIDTH] or None for r in runs]
        self.lcp = [0] * len(runs)
        self.tree = [0] * self.k
        self.tree[0] = self._build(1)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's common prefix becomes that with the winner."""
        x, y = self.head[a], self.head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = self.lcp[a], self.lcp[b]
        if p > q:
            return a, b
        if p < q:
            return b, a
        x, y = x[p:], y[p:]
        if x == y:
            self.lcp[b] = WIDTH
            return a, b
        same = WIDTH - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8
        if x < y:
            self.lcp[b] = same
            return a, b
        self.lcp[a] = same
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        winner, loser = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.tree[node] = loser
        return winner

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """(run, common prefix with the string before) of each string in order."""
        run, prefix = array("i"), array("B")
        head, lcp, at, tree, k, play = self.head, self.lcp, self.at, self.tree, self.k, self._play
        winner = tree[0]
        while len(head) and head[winner] is not None:
            run.append(winner)
            prefix.append(lcp[winner])
            at[winner] = i = at[winner] + 1
            if i < len(self.shared[winner]):
                head[winner] = self.runs[winner][i * WIDTH : (i + 1) * WIDTH]
                lcp[winner] = self.shared[winner][i]
            else:
                head[winner] = None
            node = (winner + k) >> 1
            while node:
                other = tree[node]
                a, b = play(winner, other)
                if a != winner:
                    tree[node] = b
                    winner = a
                node >>= 1
        return np.array(run, dtype=np.int64), np.array(prefix, dtype=np.int64)


def _classes(order: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the classes of rows that agree in their first `length` bytes, from a sorted order and its common prefixes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < length)
    return out


def smallest(rows: np.ndarray, shared: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct sorted contexts and the smallest doc_id of each: by offset and context, the smallest doc_id of all
    contexts that agree in the SPAN bytes that begin `offset` bytes before the anchor, as places in the sorted doc_ids."""
    n = len(rows)
    known, rank = np.unique(ids, return_inverse=True)
    rank = rank.astype(np.int32)
    left = rows[:, SPAN:]
    by_left = sort_rows(left)
    left_shared = common(left[by_left])
    same = np.arange(n)
    out = np.empty((REST + 1, n), np.int32)
    for offset in range(REST + 1):
        key = _classes(same, shared, SPAN - offset) * (n + 1) + _classes(by_left, left_shared, offset)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        least = np.minimum.reduceat(rank[order], np.flatnonzero(head))
        out[offset, order] = least[np.cumsum(head) - 1]
    return known, out


def _write_runs(parts: int):
    starts = part_starts(parts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3)
        held: list[tuple] = []
        count = 0

        def write() -> pd.DataFrame:
            rows, hashes, ids, nodes, places = (np.concatenate(x) for x in zip(*held))
            name, out = uuid.uuid4().hex, []
            part = np.searchsorted(starts, hashes, side="right") - 1
            by_part = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[by_part], np.arange(parts + 1))
            for p in np.unique(part).tolist():
                mine = by_part[edges[p] : edges[p + 1]]
                mine = mine[sort_rows(rows[mine])]
                own = rows[mine]
                head = common(own) < WIDTH
                head[0] = True
                which = np.cumsum(head) - 1
                least = np.minimum.reduceat(ids[mine], np.flatnonzero(head))
                # the records of the run: which context, and where it is
                records = np.stack([which, ids[mine], nodes[mine], places[mine]])
                out.append((name, p, int(head.sum()), encode(own[head]), packer.compress(least.tobytes()), packer.compress(inside(own[head]).tobytes()), packer.compress(np.diff(records, axis=1, prepend=0).tobytes())))
            return pd.DataFrame(out, columns=["run", "part", "n", "keys", "ids", "inside", "records"])

        for pdf in frames:
            for batch, packed, flags, heads in zip(pdf["batch"], pdf["packed"], pdf["flags"], pdf["heads"]):
                if heads is None or not len(heads):
                    continue
                texts = unpack(packed)
                found = [anchors(t) for t in texts]
                ordered = np.unique(np.concatenate([short(h) for _, h in found]))
                counts = flags_of(flags)
                for h in heads:
                    slot = int(h["node"]) - (int(batch) << SLOT_BITS)
                    at, keys = found[slot]
                    if len(at):
                        times = counts[np.searchsorted(ordered, short(keys))]
                        at, keys, times = at[times > 1], keys[times > 1], times[times > 1]
                    if len(at):
                        rows = contexts(texts[slot], at)
                        rows, keys, at = spread(rows, keys, at, times == MANY)
                        held.append((rows, keys, np.full(len(at), h["first"], np.int64), np.full(len(at), h["node"], np.int64), at))
                        count += len(at)
                    if count >= RUN:
                        yield write()
                        held.clear()
                        count = 0
                        give_back()
        if held:
            yield write()
            held.clear()
        give_back()

    return run


def _merge_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges the runs of one part; for each run's contexts, the smallest doc_id by offset."""
    unpacker, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
    decoded = [decode(k, n) for k, n in zip(pdf["keys"], pdf["n"])]
    ids = [np.frombuffer(unpacker.decompress(bytes(i)), np.int64) for i in pdf["ids"]]
    run, prefix = LoserTree([rows.tobytes() for rows, _ in decoded], [s.astype(np.uint8).tobytes() for _, s in decoded]).merge()
    # where each string of the merged order lies in the runs put end to end
    begin = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    source = np.empty(len(run), np.int64)
    for r in range(len(ids)):
        source[run == r] = begin[r] + np.arange(len(ids[r]))
    head = prefix < WIDTH
    head[0] = True
    which = np.cumsum(head) - 1
    least = np.minimum.reduceat(np.concatenate(ids)[source], np.flatnonzero(head))
    rows = np.concatenate([r for r, _ in decoded])[source[head]]
    del decoded
    known, found = smallest(rows, prefix[head], least)
    back = np.empty(len(run), np.int64)
    back[source] = which
    out = [packer.compress(known[found[:, back[begin[r] : begin[r + 1]]]].tobytes()) for r in range(len(ids))]
    del rows, known, found, back, source, which
    give_back()
    return pd.DataFrame({"run": pdf["run"], "part": pdf["part"], "found": out})


def _repeats(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of runs with their answers: the bytes to remove, by batch."""
    unpacker, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
    for pdf in frames:
        for within, records, found in zip(pdf["inside"], pdf["records"], pdf["found"]):
            right, left = np.frombuffer(unpacker.decompress(bytes(within)), np.uint8).reshape(2, -1)
            which, ids, nodes, at = np.cumsum(np.frombuffer(unpacker.decompress(bytes(records)), np.int64).reshape(4, -1), axis=1)
            least = np.frombuffer(unpacker.decompress(bytes(found)), np.int64).reshape(REST + 1, -1)
            low, high = np.full(len(which), -1), np.full(len(which), -1)
            for offset in range(REST + 1):
                hit = ((offset <= left) & (SPAN - offset <= right))[which] & (least[offset][which] < ids)
                high[hit] = offset
                low[hit & (low < 0)] = offset
            hit = np.flatnonzero(high >= 0)
            hit = hit[np.argsort(nodes[hit], kind="stable")]
            if len(hit):
                spans = np.stack([nodes[hit], at[hit] - high[hit], at[hit] - low[hit] + SPAN])
                batch = nodes[hit] >> SLOT_BITS
                cuts = np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]])).tolist() + [len(hit)]
                yield pd.DataFrame([(int(batch[a]), packer.compress(spans[:, a:b].tobytes())) for a, b in zip(cuts, cuts[1:])], columns=["batch", "spans"])


def _apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, n_bytes, n_removed, n_spans, kept_sha256, spans) of the heads, as their first document has them."""
    unpacker = zstandard.ZstdDecompressor()
    for pdf in frames:
        for batch, packed, heads, spans in zip(pdf["batch"], pdf["packed"], pdf["heads"], pdf["spans"]):
            texts = unpack(packed)
            parts = [np.frombuffer(unpacker.decompress(bytes(s)), np.int64).reshape(3, -1) for s in (spans if spans is not None else ())]
            nodes, low, high = np.concatenate(parts, axis=1) if parts else np.empty((3, 0), np.int64)
            order = np.argsort(nodes, kind="stable")
            nodes, low, high = nodes[order], low[order], high[order]
            out = []
            for h in heads:
                node = int(h["node"])
                text = texts[node - (int(batch) << SLOT_BITS)]
                a, b = np.searchsorted(nodes, [node, node + 1])
                gone: list[tuple[int, int]] = []
                if a < b:
                    depth = np.zeros(len(text) + 1, np.int32)
                    np.add.at(depth, low[a:b], 1)
                    np.add.at(depth, high[a:b], -1)
                    covered = np.concatenate([[0], (np.cumsum(depth[:-1]) > 0).astype(np.int8), [0]])
                    edges = np.flatnonzero(np.diff(covered))
                    gone = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
                kept, last = [], 0
                for x, y in gone:
                    kept.append(text[last:x])
                    last = y
                kept.append(text[last:])
                out.append((node, len(text), sum(y - x for x, y in gone), len(gone), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": x, "end": y} for x, y in gone]))
            yield pd.DataFrame(out, columns=["node", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte ranges to remove), a row for each row of docs."""
    batches, members, _ = collect(docs, bytes, "suffix")
    about = stage(firsts(batches, members), "suffix-heads")
    heads = about.where("node = head").groupBy(F.shiftright("node", SLOT_BITS).alias("batch")).agg(F.collect_list(F.struct("node", F.col("first.doc_id").alias("first"))).alias("heads"))
    texts = batches.select("batch", "packed")
    parts = 2 * partitions(docs.sparkSession)
    counted = texts.join(count_keys(batches, _keys), "batch").join(heads, "batch")
    runs = stage(counted.mapInPandas(_write_runs(parts), "run string, part int, n int, keys binary, ids binary, inside binary, records binary"), "suffix-runs", "snappy")
    found = runs.select("run", "part", "n", "keys", "ids").groupBy("part").applyInPandas(_merge_runs, "run string, part int, found binary")
    spans = runs.select("run", "part", "inside", "records").join(found, ["run", "part"]).mapInPandas(_repeats, "batch long, spans binary")
    spans = stage(spans.groupBy("batch").agg(F.collect_list("spans").alias("spans")), "suffix-spans", "snappy")
    unstage(runs)
    applied = texts.join(heads, "batch").join(spans, "batch", "left").mapInPandas(_apply, "node long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    known = about.select(F.col("node").alias("member"), "head", "first").join(applied, F.col("head") == F.col("node")).drop("node", "head")
    rows = members.join(known, F.col("node") == F.col("member"))
    copy = (F.col("doc_id") > F.col("first.doc_id")) & (F.col("n_bytes") >= SPAN)
    return rows.select(
        F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.col("spans")).alias("spans"),
    )
