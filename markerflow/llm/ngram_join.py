"""N-gram Jaccard self join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

1. Equal word sequences collapse to one node per task, one head over all.
2. Two sets with Jaccard similarity s or more share a shingle among the first |x| - ceil(s |x|) + 1 of each in any one total
   order. Counts of such prefixes, by exchanged sorted runs, leave the texts that share one at all; among those, all shingles
   are counted, and prefixes are taken again with the rarest shingles first, so that what very many texts share is in
   hardly any prefix. A shingle that no other text has joins nothing.
3. The texts of a shingle are put in order of size, and each is compared with the next: as many pairs as postings at most, each once
   however many shingles give it, dealt evenly. What links ties nearly all of a group of near copies, and its label is known. A shingle that
   MANY texts have is dealt over lanes, each put in order by itself, and the lanes' first texts are compared and tied in turn.
4. Only shingles whose texts have different labels are left. Their labels are tied into blocks. A block is cut into cells by size (a
   band is a factor 1/s wide, so only cells of neighbouring bands can hold linked pairs), by label where a label fills half a cell,
   and by hash when there are more than TILE texts; two cells of one label never meet. A task compares a pair of cells: bitmaps give an
   upper bound of the overlap, exact intersection decides. Texts with one label, or already connected inside a tile, need no
   comparison, as only connectivity is asked for. A block of at most TILE texts is one cell, in which size bounds the pairs.
5. Links become components, and every document gets that of its node.

No pair of equal texts is expanded, and no candidate is capped: a block of any size is compared in full, tile by tile.

Defined cases: null or empty text (or only white space) has no shingles and is its own component; a null doc_id counts as above
all others and is null as a component only among its like; rows with one doc_id are rows each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import MANY, SLOT_BITS, collect, count_keys, firsts, flags_of, front, pack, part_starts, unfront, unpack
from .common import merged, partitions, stage, unstage
from .graph import components

SHINGLE = 5
#: Linked from 75 / 100 on; texts and bytes of text in a cell of a tile.
SIMILAR, OF = 75, 100
TILE, TILE_BYTES = 1000, 8 << 20
_BASE = 0x9E3779B97F4A7C15
_TURN = np.uint64(0xD6E8FEB86659FD93)  # order of prefixes, unlike the order of keys


class Powers:
    """Powers of _BASE modulo 2**64 and their inverses, as far as the longest text so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up), 1 << 16)
            cls.up, cls.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = Powers.of(len(data) + 1)
    return np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they are."""
    return mix((sums[end] - sums[start]) * Powers.of(len(sums))[1][start])


def words_joined(text: bytes) -> bytes:
    """Lower-cased (A-Z) words with one space between."""
    return b" ".join(text.lower().split())


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of joined words."""
    if not text:
        return np.empty(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    spaces = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], spaces + 1]), np.append(spaces, len(data))
    k = min(SHINGLE, len(start))
    return np.unique(range_hashes(prefix_sums(data), start[: len(start) - k + 1], end[k - 1 :]))


def prefix_length(n: int) -> int:
    return n - -(-SIMILAR * n // OF) + 1 if n else 0


def hash_prefix(keys: np.ndarray) -> np.ndarray:
    return keys[np.argsort(keys * _TURN)[: prefix_length(len(keys))]]


def short(keys: np.ndarray) -> np.ndarray:
    """What is counted: the upper 48 bits of the hashes. Shingles that agree in them are counted as one, which can only add to a
    count, and alike in every text; exact intersection has all 64 bits."""
    return keys & np.uint64(0xFFFFFFFFFFFF0000)


def _prefixes(row: pd.Series) -> list[np.ndarray]:
    return [short(hash_prefix(shingles(t))) for t in unpack(row["packed"])]


def _all(row: pd.Series) -> list[np.ndarray]:
    return [short(shingles(t)) for t in unpack(row["packed"])]


def _sharing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of batches with counts: a row (node, n) for each head, and batches of the heads that share a prefix shingle."""
    for pdf in frames:
        for batch, packed, flags, heads in zip(pdf["batch"], pdf["packed"], pdf["flags"], pdf["heads"]):
            if heads is None or not len(heads):
                continue
            texts = unpack(packed)
            own = [shingles(t) for t in texts]
            some = [short(hash_prefix(k)) for k in own]
            ordered = np.unique(np.concatenate([np.empty(0, np.uint64), *some]))
            counts = flags_of(flags)
            nodes = sorted(int(h) for h in heads)
            slots = [h - (int(batch) << SLOT_BITS) for h in nodes]
            kept = [s for s in slots if (counts[np.searchsorted(ordered, some[s])] > 1).any()]
            yield pd.DataFrame({"node": nodes, "n": [len(own[s]) for s in slots], "batch": None, "nodes": None, "packed": None})
            if kept:
                yield pd.DataFrame({"node": [None], "n": [None], "batch": [batch], "nodes": [[(int(batch) << SLOT_BITS) + s for s in kept]], "packed": [pack([texts[s] for s in kept])]})


def _rare(parts: int, many: int):
    """Runs of (key, node, size) of the prefixes with the rarest shingles first, without those that one text has alone. A shingle that MANY texts or more
    have is no key of one part: its postings go to lanes (parts from `parts` on) by node."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=1)
        for pdf in frames:
            for nodes, packed, flags in zip(pdf["nodes"], pdf["packed"], pdf["flags"]):
                own = [shingles(t) for t in unpack(packed)]
                ordered, counts = np.unique(short(np.concatenate(own))), flags_of(flags)
                keys, at, sizes, hot = [], [], [], []
                for node, k in zip(nodes, own):
                    times = counts[np.searchsorted(ordered, short(k))]
                    first = np.lexsort((k * _TURN, times))[: prefix_length(len(k))]
                    first = first[times[first] > 1]
                    keys.append(k[first])
                    at.append(np.full(len(first), node, np.int64))
                    sizes.append(np.full(len(first), len(k), np.int64))
                    hot.append(times[first] >= many)
                keys, at, hot = np.concatenate(keys), np.stack([np.concatenate(at), np.concatenate(sizes)]), np.concatenate(hot)
                part = np.searchsorted(part_starts(parts), keys, side="right") - 1
                part = np.where(hot, parts + (mix(at[0].astype(np.uint64)) % np.uint64(parts)).astype(np.int64), part)
                order = np.lexsort((keys, part))
                keys, at, part = keys[order], at[:, order], part[order]
                edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
                rows = [(int(part[a]), packer.compress(front(keys[a:b])), packer.compress(np.ascontiguousarray(at[:, a:b]).tobytes())) for a, b in zip(edges, edges[1:])]
                yield pd.DataFrame(rows, columns=["part", "run", "nodes"])

    return run


def _postings(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a posting has the key of the one before, node, size) of a key range, by key, size and node."""
    unpacker = zstandard.ZstdDecompressor()
    keys = np.concatenate([unfront(unpacker.decompress(bytes(r))) for r in pdf["run"]])
    nodes, sizes = np.concatenate([np.frombuffer(unpacker.decompress(bytes(r)), np.int64).reshape(2, -1) for r in pdf["nodes"]], axis=1)
    order = np.lexsort((nodes, sizes, keys))
    keys, nodes, sizes = keys[order], nodes[order], sizes[order]
    return np.concatenate([[False], keys[1:] == keys[:-1]]), nodes, sizes


def _pairs(pairs: np.ndarray) -> pd.DataFrame:
    pairs = np.unique(np.sort(pairs, axis=1), axis=0) if len(pairs) else np.empty((0, 2), np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _neighbours(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each text of a shingle with the next in size, if sizes allow a link."""
    same, nodes, sizes = _postings(pdf)
    at = np.flatnonzero(same)
    at = at[OF * sizes[at - 1] >= SIMILAR * sizes[at]]
    return _pairs(np.stack([nodes[at - 1], nodes[at]], axis=1))


def _ties(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each text of a shingle tied to the shingle's first."""
    same, nodes, _ = _postings(pdf)
    first = nodes[~same][np.cumsum(~same) - 1]
    return _pairs(np.stack([nodes, first], axis=1)[same])


def _lane_firsts(pdf: pd.DataFrame) -> pd.DataFrame:
    """(key, node, size) of the first text of each shingle of a lane."""
    same, nodes, sizes = _postings(pdf)
    keys = np.unique(np.concatenate([unfront(zstandard.ZstdDecompressor().decompress(bytes(r))) for r in pdf["run"]]))
    return pd.DataFrame({"key": keys.view(np.int64), "node": nodes[~same], "size": sizes[~same]})


def _linked_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of pairs with their texts, those that link. Rows come sorted by a, whose shingles are made once."""
    unpacker = zstandard.ZstdDecompressor()
    last, left = None, None
    for pdf in frames:
        out = []
        for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"]):
            if a != last:
                last, left = a, shingles(unpacker.decompress(bytes(x)))
            if linked(left, shingles(unpacker.decompress(bytes(y)))):
                out.append((a, b))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    packer = zstandard.ZstdCompressor(level=3)
    for pdf in frames:
        for nodes, packed in zip(pdf["nodes"], pdf["packed"]):
            texts = unpack(packed)
            yield pd.DataFrame({"node": nodes, "text": [packer.compress(t) for t in texts], "size": [len(t) for t in texts]})


def linked(left: np.ndarray, right: np.ndarray) -> bool:
    if len(left) > len(right):
        left, right = right, left
    at = np.searchsorted(right, left)
    both = int((right[np.minimum(at, len(right) - 1)] == left).sum())
    return OF * both >= SIMILAR * (len(left) + len(right) - both)


def tile_links(sets: list[np.ndarray], side: np.ndarray, across: bool, label: np.ndarray | None = None, every: bool = False) -> list[tuple[int, int]]:
    """Links that connect the sets of a tile as all its links do, or every link; across: only between the two sides; label: what is connected already."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets, side = [sets[i] for i in order], side[order]
    n = np.array([len(s) for s in sets], dtype=np.int64)
    bits = min(1 << 14, max(256, 1 << int(2 * n[-1]).bit_length()))
    maps = np.zeros((len(sets), bits // 64), dtype=np.uint64)
    for i, s in enumerate(sets):
        b = s % np.uint64(bits)
        np.bitwise_or.at(maps[i], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
    label = np.arange(len(sets)) if label is None else np.unique(label, return_inverse=True)[1][order]
    out = []
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(n, n[i] * OF // SIMILAR, side="right"))
        if end <= i + 1:
            continue
        ys = np.arange(i + 1, end)
        ys = ys[label[ys] != label[i]]
        if across:
            ys = ys[side[ys] != side[i]]
        if not len(ys):
            continue
        only_x = np.bitwise_count(maps[i] & ~maps[ys]).sum(axis=1, dtype=np.int64)
        only_y = np.bitwise_count(~maps[i] & maps[ys]).sum(axis=1, dtype=np.int64)
        most = np.minimum(n[i] - only_x, n[ys] - only_y)
        for y in ys[OF * most >= SIMILAR * (n[i] + n[ys] - most)].tolist():
            if label[y] != label[i] and linked(sets[i], sets[y]):
                if not every:
                    label[label == label[y]] = label[i]
                out.append((order[i], order[y]))
    return out


def _tiles(every: bool):
    """Rows come sorted by tile; a tile has at most two cells."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacker = zstandard.ZstdDecompressor()
        held: list[tuple] = []
        tile = None

        def settle() -> pd.DataFrame:
            sets = [shingles(unpacker.decompress(bytes(t))) for _, t, _, _ in held]
            found = tile_links(sets, np.array([s for _, _, s, _ in held]), tile[1] != tile[2], np.array([g for _, _, _, g in held]), every) if len(held) > 1 else []
            return pd.DataFrame([(held[i][0], held[j][0]) for i, j in found], columns=["a", "b"], dtype="int64")

        for pdf in frames:
            for root, low, high, node, text, cell, label in zip(pdf["root"], pdf["low"], pdf["high"], pdf["node"], pdf["text"], pdf["cell"], pdf["label"]):
                if (root, low, high) != tile:
                    if held:
                        yield settle()
                    tile, held = (root, low, high), []
                held.append((node, text, cell, label))
        if held:
            yield settle()

    return run


def tiled(texts: DataFrame, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(root, low, high, cell, node, label, text): each text (root, label, node, text, n, size) once for every tile of its block that it belongs to."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(OF / SIMILAR)) + 1e-9).cast("int")
    whole = texts.groupBy("root").agg(F.count("*").alias("texts"), F.sum("size").alias("bytes"))
    small = (F.col("texts") <= tile) & (F.col("bytes") <= tile_bytes)
    # blocks of more than a tile are at most one for each tile of texts or of bytes, and labels with cells of their own two for each half cell: they are
    # broadcast, as a block dealt by its root would be one task
    rows = texts.withColumn("band", band).join(F.broadcast(whole.where(~small).select("root", F.col("texts").alias("large"))), "root", "left").withColumn("small", F.col("large").isNull()).drop("large")
    # a label with half a cell of texts in a band has cells of its own (its group), the others share cells (no group)
    sizes = rows.where("NOT small").groupBy("root", "band", "label").agg(F.count("*").alias("texts"), F.sum("size").alias("bytes"))
    own = F.when((2 * F.col("texts") >= tile) | (2 * F.col("bytes") >= tile_bytes), F.col("label"))
    groups = sizes.withColumn("grp", own).groupBy("root", "band", "grp").agg(F.sum("texts").alias("texts"), F.sum("bytes").alias("bytes"))
    groups = groups.withColumn("subs", F.greatest(F.ceil(F.col("texts") / tile), F.ceil(F.col("bytes") / tile_bytes)).cast("int"))
    start = F.coalesce(F.sum("subs").over(Window.partitionBy("root").orderBy("band", "grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    # groups of a block are at most two for each half cell of texts and one for each band, and bands the logarithm of the largest set
    plan = groups.withColumn("start", start).groupBy("root").agg(F.collect_list(F.struct("band", "grp", "subs", "start")).alias("plan"))
    rows = rows.join(F.broadcast(sizes.select("root", "band", "label", own.alias("grp")).where("grp IS NOT NULL")), ["root", "band", "label"], "left").join(F.broadcast(plan), "root", "left")
    mine = F.get(F.filter("plan", lambda g: (g["band"] == F.col("band")) & g["grp"].eqNullSafe(F.col("grp"))), F.lit(0))
    rows = rows.withColumn("mine", mine).withColumn("cell", F.when(F.col("small"), 0).otherwise(F.col("mine.start") + F.pmod(F.xxhash64("node"), F.col("mine.subs").cast("long")).cast("int")))
    near = F.filter("plan", lambda g: (F.abs(g["band"] - F.col("band")) <= 1) & (F.col("grp").isNull() | ~g["grp"].eqNullSafe(F.col("grp"))))
    others = F.flatten(F.transform(near, lambda g: F.sequence(g["start"], g["start"] + g["subs"] - 1)))
    rows = rows.withColumn("other", F.explode(F.when(F.col("small"), F.array(F.lit(0))).otherwise(others)))
    return rows.select("root", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"), "cell", "node", "label", "text")


def ngram_join(docs: DataFrame, tile: int = TILE, tile_bytes: int = TILE_BYTES, tie: str | None = None, every: bool = False, many: int = MANY) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), a row for each row of docs.

    many: texts from which on a shingle's are dealt over lanes (MANY at most).
    every: compare all texts that share a prefix shingle, connected or not, and return n_links too: how many other texts (equal ones are one) a text is linked with.

    tie: a column of longs that tells rows with one doc_id apart. It is returned too, and stays, which is true for the rows with
    the component's smallest pair of doc_id and tie and for those without shingles.
    """
    spark = docs.sparkSession
    batches, members, log = collect(docs, words_joined, "grams", tie)
    about = stage(firsts(batches, members), "grams-heads")
    heads = about.where("node = head").groupBy(F.shiftright("node", SLOT_BITS).alias("batch")).agg(F.collect_list("node").alias("heads"))
    counted = batches.select("batch", "packed").join(merged(count_keys(batches, _prefixes)), "batch", "left").join(merged(heads), "batch")
    sharing = stage(counted.mapInPandas(_sharing, "node long, n long, batch long, nodes array<long>, packed binary"), "grams-sharing", "snappy")
    unstage(log)
    sizes = stage(sharing.where("node IS NOT NULL").select("node", "n"), "grams-sizes")
    some = sharing.where("batch IS NOT NULL").select("batch", "nodes", "packed")

    parts = 2 * partitions(spark)
    runs = stage(some.join(merged(count_keys(some, _all)), "batch").mapInPandas(_rare(parts, many), "part int, run binary, nodes binary"), "grams-runs", "snappy")
    texts = stage(some.mapInPandas(_texts, "node long, text binary, size long").join(merged(sizes), "node"), "grams-texts", "snappy")
    unstage(sharing)
    text = lambda side: texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
    # a shingle's lanes are tied by their first texts, which are as many as lanes at most
    lanes = runs.where(F.col("part") >= parts).groupBy("part").applyInPandas(_lane_firsts, "key long, node long, size long")
    last = lambda c: F.lag(c).over(Window.partitionBy("key").orderBy("size", "node"))
    chain = stage(lanes.select(last("node").alias("a"), F.col("node").alias("b"), last("size").alias("size_a"), "size").where("a IS NOT NULL").distinct(), "grams-lanes")
    links = None
    if not every:
        near = runs.groupBy("part").applyInPandas(_neighbours, "a long, b long").union(chain.where(OF * F.col("size_a") >= SIMILAR * F.col("size")).select(F.least("a", "b"), F.greatest("a", "b")))
        near = near.distinct().join(merged(text("b")), "b").join(merged(text("a")), "a")
        links = stage(near.repartition(partitions(spark), "a").sortWithinPartitions("a").mapInPandas(_linked_pairs, "a long, b long"), "grams-links")
    ties = stage(runs.groupBy("part").applyInPandas(_ties, "a long, b long").union(chain.select("a", "b")).distinct(), "grams-ties")
    unstage(runs)
    unstage(chain)

    found = stage(components(links) if links is not None else spark.createDataFrame([], "node long, root long"), "grams-labels")
    label = lambda side: found.select(F.col("node").alias(side), F.col("root").alias(f"label_{side}"))
    labelled = ties.join(merged(label("a")), "a", "left").join(merged(label("b")), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    blocks = components(labelled.where("a <> b"))
    mixed = texts.join(merged(found.withColumnRenamed("root", "label")), "node", "left").withColumn("label", F.coalesce("label", "node")).join(merged(blocks.withColumnRenamed("node", "label")), "label")
    mixed = stage(mixed, "grams-mixed", "snappy")
    unstage(texts)
    unstage(ties)
    dealt = tiled(mixed, tile, tile_bytes).repartition(partitions(spark), "root", "low", "high").sortWithinPartitions("root", "low", "high")
    compared = stage(dealt.mapInPandas(_tiles(every), "a long, b long"), "grams-compared")
    groups = components(compared if links is None else links.union(compared))
    unstage(mixed)

    known = about.where("node = head").select("head", "first").join(merged(sizes.withColumnRenamed("node", "head")), "head").join(merged(groups.withColumnRenamed("node", "head")), "head", "left")
    if every:
        ends = compared.select(F.explode(F.array("a", "b")).alias("head")).groupBy("head").agg(F.count("*").alias("links"))
        known = known.join(merged(ends), "head", "left")
    least = known.groupBy(F.coalesce("root", "head").alias("group")).agg(F.min("first").alias("component"))
    more = [F.coalesce("links", F.lit(0).cast("long")).alias("n_links")] if every else []
    nodes = about.select("node", "head").join(merged(known.select("head", "n", *more, F.coalesce("root", "head").alias("group"))), "head").join(merged(least), "group")
    alone = F.col("n") == 0
    out = members.join(merged(nodes), "node").select(
        F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(alone & ~F.col("none"), F.col("doc_id")).when(~alone & ~F.col("component.none"), F.col("component.doc_id")).alias("component_id"),
        *(["n_links"] if every else []),
        *([F.col("tie").alias(tie), (alone | (F.struct("doc_id", "none", "tie") == F.col("component"))).alias("stays")] if tie else []),
    )
    return out
