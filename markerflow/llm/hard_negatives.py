"""Hard-negative mining with an orthogonal PCA rotation that discards candidates early.

1. Every vector becomes whole numbers, floor(256 x), and is stored in blocks with its rotation. The rotation's columns are the eigenvectors of
   the second moments over all rows (one d x d sum per task), leading components first; it keeps inner products.
2. Anchors are dealt in passes of PASS_ANCHORS, which are broadcast; all blocks are read for each pass. A block takes part in products of the
   leading components; what is left is bounded by the norms of the remainders plus a slack for rounding. Pairs that can't reach the
   anchor's worst place so far, or its band, are discarded; the others go on to more components, and survivors get the integer product.
3. A task hands on an anchor's best rows only, which are merged by anchor. Positives come first, and with their scores the bands of
   the second reading, for the negatives.

In a block, of rows with the same vector and label only so many are looked at as an anchor can take of them (a place each, smallest ids
first, and one for the anchor itself): the others come after these wherever they come. Nothing depends on how labels are spread.

Defined cases: rows with a null label or vector, or a null, NaN or infinite component, take no part; a null vec_id is no anchor and comes last among
equal scores; rows that repeat a vec_id are rows each, an anchor is only kept from itself; missing components of a shorter vector count as
zeros; an empty table gives no rows; where 256 x is no integer below 2**31 the job fails, as products would pass 64 bits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, sweeping, unstage

#: Positives of an anchor, negatives of a positive, and the band of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: An anchor's vec_id is divisible by this; a label of a vec_id divisible by MOVED becomes the next of LABELS.
EVERY, MOVED, LABELS = 50, 7, 10
#: Vectors of a block, anchors of a pass, anchors compared with a block at a time.
BLOCK, PASS_ANCHORS, TILE = 4096, 1 << 14, 1024
#: A product of rotated vectors differs from the whole-number one by less than this share of their norms.
SLACK = 1e-9
NO_ID = (1 << 63) - 1  # ranks a null id; none tells it from the id of that value


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, with the labels to use."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    label = F.col("label").cast("long")
    moved = F.coalesce(F.col("vec_id") % MOVED == 0, F.lit(False))
    return vectors.where(F.col("label").isNotNull() & F.col(vector).isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.when(moved, (label + 1) % LABELS).otherwise(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))


def whole(rows: list, width: int) -> np.ndarray:
    """floor(256 x) of vectors, as whole numbers in doubles, padded with zeros."""
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    out = np.floor(256 * out)
    if len(out) and np.abs(out).max(initial=0) >= 1 << 31:
        raise ValueError("a component is too large for products of 64 bits")
    return out


def _moments(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in frames:
            q = whole(list(pdf["vector"]), width)
            total += q.T @ q
        yield pd.DataFrame({"i": np.arange(width * width), "v": total.ravel()})

    return run


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Orthogonal matrix of the principal axes about the origin, the strongest first; width * width sums come to the driver."""
    sums = rows.select("vector").mapInPandas(_moments(width), "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    with sweeping(rows.sparkSession):
        got = sums.toPandas()
    m = np.zeros(width * width)
    m[got["i"].to_numpy()] = got["v"].to_numpy()
    _, axes = np.linalg.eigh(m.reshape(width, width))
    return np.ascontiguousarray(axes[:, ::-1])


def _blocks(width: int, axes: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                q = whole(list(part["vector"]), width)
                row = (part["row"].to_numpy(np.int64).tobytes(), part["id"].to_numpy(np.int64).tobytes(), part["none"].to_numpy(bool).tobytes(), part["label"].to_numpy(np.int64).tobytes(), q.astype(np.int32).tobytes(), (q @ axes).tobytes())
                yield pd.DataFrame([row], columns=list(_PARTS))

    return run


_PARTS = ("rows", "ids", "none", "labels", "whole", "rotated")


class Block:
    def __init__(self, row, width: int) -> None:
        self.rows, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "labels"))
        self.none = np.frombuffer(row["none"], bool)
        self.whole = np.frombuffer(row["whole"], np.int32).reshape(-1, width)
        self.rotated = np.frombuffer(row["rotated"], np.float64).reshape(-1, width)

    def first_of_equal(self, most: int) -> Block:
        """Without those rows that have most others of the same vector and label before them, by id."""
        key = np.array([hash(v.tobytes()) for v in self.whole], dtype=np.int64)  # equal hashes are told apart below
        order = np.lexsort((self.rows, self.none, self.ids, self.labels, key))
        same = np.concatenate([[False], (key[order][1:] == key[order][:-1]) & (self.labels[order][1:] == self.labels[order][:-1]) & (self.whole[order][1:] == self.whole[order][:-1]).all(axis=1)])
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        kept = np.sort(order[np.arange(len(order)) - start < most])
        if len(kept) < len(order):
            for name in ("rows", "ids", "labels", "none", "whole", "rotated"):
                setattr(self, name, getattr(self, name)[kept])
        return self


class Best:
    """For each anchor the best rows so far, by score, then id."""

    def __init__(self, n: int, size: int) -> None:
        self.size = size
        self.score = np.full((n, size), np.iinfo(np.int64).min)
        self.id = np.full((n, size), NO_ID)
        self.none = np.ones((n, size), bool)
        self.row = np.full((n, size), -1)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray, rows: np.ndarray) -> None:
        """Rows that are new, with the place of their anchor."""
        if not len(at):
            return
        some = np.unique(at)
        place = np.searchsorted(some, at)
        held = np.repeat(np.arange(len(some)), self.size)
        place, score, ids, none, rows = (np.concatenate(x) for x in ((held, place), (self.score[some].ravel(), score), (self.id[some].ravel(), ids), (self.none[some].ravel(), none), (self.row[some].ravel(), rows)))
        order = np.lexsort((rows, none, ids, -score, rows < 0, place))
        first = np.searchsorted(place[order], np.arange(len(some)))
        kept = order[first[:, None] + np.arange(self.size)]
        self.score[some], self.id[some], self.none[some], self.row[some] = score[kept], ids[kept], none[kept], rows[kept]

    def worst(self) -> np.ndarray:
        """The score that a row has to reach to get a place."""
        return np.where(self.row[:, -1] >= 0, self.score[:, -1], -np.inf).astype(float)


def steps(width: int) -> list[int]:
    """Components after which pairs are judged."""
    return sorted({min(width, max(1, width // 8)), min(width, max(1, width // 4)), max(1, width // 2)})


class Search:
    """A tile of anchors against blocks. same: rows with the anchor's label, else those with another."""

    def __init__(self, anchors: Block, same: bool, low: np.ndarray, high: np.ndarray, places: int) -> None:
        """low and high: for each anchor and each of its positives the band of scores (whole numbers)."""
        self.anchors, self.same, self.low, self.high = anchors, same, low, high
        self.best = [Best(len(anchors.rows), places) for _ in range(low.shape[1])]
        self.norm = np.sqrt((anchors.rotated**2).sum(axis=1))
        self.rest = {m: np.sqrt((anchors.rotated[:, m:] ** 2).sum(axis=1)) for m in steps(anchors.rotated.shape[1])}

    def _reach(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores between which a row may still get a place with an anchor."""
        floor = np.min([np.where(lo <= hi, np.maximum(b.worst(), lo), np.inf) for b, lo, hi in zip(self.best, self.low.T, self.high.T)], axis=0)
        return floor, np.where(self.low <= self.high, self.high, -np.inf).max(axis=1)

    def _settle(self, i: np.ndarray, j: np.ndarray, block: Block) -> None:
        """Whole-number products of pairs (anchor i, row j), which then compete for the anchors' places."""
        for at in range(0, len(i), 1 << 17):
            a, b = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            score = np.einsum("ij,ij->i", self.anchors.whole[a].astype(np.int64), block.whole[b].astype(np.int64))
            for best, lo, hi in zip(self.best, self.low.T, self.high.T):
                fits = (score >= lo[a]) & (score <= hi[a])
                fits &= score >= best.worst()[a]
                best.add(a[fits], score[fits], block.ids[b[fits]], block.none[b[fits]], block.rows[b[fits]])

    def take(self, block: Block) -> None:
        anchors, cuts = self.anchors, steps(block.rotated.shape[1])
        norm = np.sqrt((block.rotated**2).sum(axis=1))
        first = cuts[0]
        part = anchors.rotated[:, :first] @ block.rotated[:, :first].T
        possible = (anchors.labels[:, None] == block.labels) == self.same
        if self.same:
            possible &= anchors.rows[:, None] != block.rows
        rest = np.sqrt((block.rotated[:, first:] ** 2).sum(axis=1))
        spare = self.rest[first][:, None] * rest + SLACK * (1 + self.norm[:, None] * norm)
        # the rows that look best come first, so that the others have something to reach
        fresh = np.flatnonzero(self.best[0].row[:, -1] < 0)
        if self.same and len(fresh):
            look = np.where(possible[fresh], part[fresh], -np.inf)
            n = min(look.shape[1], 2 * self.best[0].size)
            top = np.argpartition(-look, n - 1, axis=1)[:, :n]
            i, j = np.repeat(fresh, n), top.ravel()
            real = possible[i, j]
            i, j = i[real], j[real]
            possible[i, j] = False
            self._settle(i, j, block)
        for at in range(0, len(block.rows), 1024):  # places fill up from part to part
            floor, top = self._reach()
            some = slice(at, at + 1024)
            i, j = np.nonzero(possible[:, some] & (part[:, some] + spare[:, some] >= floor[:, None]) & (part[:, some] - spare[:, some] <= top[:, None]))
            j = j + at
            product, done = part[i, j], first
            for m in [*cuts[1:], block.rotated.shape[1]]:
                if not len(i):
                    break
                product = product + np.einsum("ij,ij->i", anchors.rotated[i, done:m], block.rotated[j, done:m])
                rest_i = self.rest[m][i] if m in self.rest else np.zeros(len(i))
                rest_j = np.sqrt((block.rotated[:, m:] ** 2).sum(axis=1))[j]
                slack = rest_i * rest_j + SLACK * (1 + self.norm[i] * norm[j])
                on = (product + slack >= floor[i]) & (product - slack <= top[i])
                i, j, product, done = i[on], j[on], product[on], m
            self._settle(i, j, block)

    def rows(self) -> pd.DataFrame:
        out = []
        for k, b in enumerate(self.best):
            i, j = np.nonzero(b.row >= 0)
            out.append(pd.DataFrame({"anchor": self.anchors.rows[i], "positive": k, "score": b.score[i, j], "id": b.id[i, j], "none": b.none[i, j], "row": b.row[i, j]}))
        return pd.concat(out)


FOUND = "anchor long, positive int, score long, id long, none boolean, row long"


def _search(blocks: DataFrame, shared, width: int, same: bool, places: int) -> DataFrame:
    """FOUND of each task's best rows for the anchors in shared: tiles (Block parts, low, high)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searches = [Search(Block(parts, width), same, low, high, places) for parts, low, high in shared.value]
        for pdf in frames:
            for row in pdf.to_dict("records"):
                block = Block(row, width).first_of_equal(places + 1)
                for s in searches:
                    s.take(block)
        for s in searches:
            yield s.rows()

    return blocks.mapInPandas(run, FOUND)


def _first(found: DataFrame, places: int) -> DataFrame:
    """Of all tasks' best rows each anchor's (and positive's) first places, with their rank."""
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id", "none", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= places)


def _tiles(ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, q: np.ndarray, axes: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple]:
    out = []
    for at in range(0, len(rows), TILE):
        s = slice(at, at + TILE)
        part = (rows[s].tobytes(), ids[s].tobytes(), np.zeros(len(ids[s]), bool).tobytes(), labels[s].tobytes(), q[s].astype(np.int32).tobytes(), (q[s] @ axes).tobytes())
        out.append((dict(zip(_PARTS, part)), low[s], high[s]))
    return out


def _passes(anchors: DataFrame, size: int) -> Iterator[list]:
    """The anchors in lists of at most size rows; the driver holds one at a time."""
    held = []
    for row in anchors.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def hard_negatives(vectors: DataFrame, vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchor: Column | None = None, pass_anchors: int = PASS_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: a condition on vec_id and label that says which rows are anchors (those with a vec_id divisible by EVERY).
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors, vector).withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    with sweeping(spark):
        width = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    axes = rotation(rows, width)
    blocks = stage(rows.select("row", F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), F.col("vec_id").isNull().alias("none"), "label", "vector").mapInPandas(_blocks(width, axes), ", ".join(f"{c} binary" for c in _PARTS)), "negatives-blocks", "snappy")
    anchors = rows.where(F.col("vec_id").isNotNull() & ((F.col("vec_id") % EVERY == 0) if anchor is None else anchor))

    out = None
    for held in _passes(anchors, pass_anchors):
        ids, at, labels = (np.array([getattr(r, c) for r in held], dtype=np.int64) for c in ("vec_id", "row", "label"))
        q = whole([r.vector for r in held], width)
        every = np.full((len(held), 1), np.iinfo(np.int64).max)
        shared = spark.sparkContext.broadcast(_tiles(ids, at, labels, q, axes, -every, every))
        found = stage(_first(_search(blocks, shared, width, True, positives), positives), "negatives-positives")
        shared.destroy()
        with sweeping(spark):
            near = found.select("anchor", "rank", "score").toPandas()  # positives times the anchors of a pass
        band_low, band_high = np.ones((len(held), positives), np.int64), np.zeros((len(held), positives), np.int64)
        place = np.argsort(at)[np.searchsorted(np.sort(at), near["anchor"].to_numpy(np.int64))]
        score = near["score"].to_numpy(np.int64)
        band_low[place, near["rank"].to_numpy() - 1] = -(-low * score // 100)
        band_high[place, near["rank"].to_numpy() - 1] = high * score // 100
        shared = spark.sparkContext.broadcast(_tiles(ids, at, labels, q, axes, band_low, band_high))
        worst = _first(_search(blocks, shared, width, False, negatives), negatives)
        positive = found.select("anchor", (F.col("rank") - 1).alias("positive"), F.when(~F.col("none"), F.col("id")).alias("positive_id"), F.col("score").alias("positive_score"))
        name = spark.createDataFrame(pd.DataFrame({"anchor": at, "anchor_id": ids}))
        done = stage(
            worst.join(positive, ["anchor", "positive"]).join(F.broadcast(name), "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("none"), F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score")),
            "negatives-found",
        )
        shared.destroy()
        unstage(found)
        out = done if out is None else out.unionByName(done)
    unstage(rows)
    unstage(blocks)
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


ORACLE = f"""
WITH u AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM u a JOIN u b ON a.row <> b.row WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, row) AS place FROM s WHERE same) WHERE place <= {POSITIVES}),
n AS (SELECT p.anchor, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.vec_id NULLS LAST, s.row) AS place
      FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, CAST(place AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= {NEGATIVES}
"""
