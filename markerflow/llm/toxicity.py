"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed character n-grams of its lower-cased form. For each n-gram, the log ratio of its
smoothed document counts among toxic and other training texts scales its (binary) value; logistic regression is fitted on the
scaled values. Scale and coefficient fold into one weight per hash bin, so scoring whole texts is a table look-up.

Fitting reads at most `train_rows` labelled rows (the first in the order of a hash of doc_id); scoring reads every row whole. Every
n-gram that tells the classes apart by more than chance takes part, however many there are: the training rows are bounded, and their
n-grams lie in blocks of rows.

Defined cases: a row with a null doc_id is not held out, and not learnt from, as no label is its own; of rows with one doc_id the one whose text has the least hash is learnt from; null text is the empty text and scores as the intercept alone; labels that are null, not 0 or 1, or held out are
not learnt from; with toxic labels alone every score is their smoothed rate, without any it is 0; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_training, stage

#: Lengths of the n-grams, hash bins, most labelled rows to learn from, least log-likelihood ratio between the classes from
#: which an n-gram is taken as more than chance among so many.
SIZES, BINS, TRAIN_ROWS, LEAST = (3, 4, 5), 1 << 20, 8_000, 20.0
#: Rows in a block of the design matrix, bins judged at a time.
BLOCK_ROWS, BLOCK_BINS = 256, 1 << 16
#: A score from which a text counts as toxic.
TOXIC = 0.3


class Features:
    """Distinct n-gram bins of a text, without sorting: of equal bins, the last position written wins."""

    def __init__(self) -> None:
        self.mark = np.zeros(BINS, dtype=np.int32)

    def __call__(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
        parts = []
        for n in SIZES:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : len(c) - n + 1 + i] + np.uint64(1)
            h ^= h >> np.uint64(29)
            parts.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int32))
        if not parts:
            return np.empty(0, dtype=np.int32)
        bins = np.concatenate(parts)
        at = np.arange(len(bins), dtype=np.int32)
        self.mark[bins] = at
        return bins[self.mark[bins] == at]


def labelled(docs: DataFrame, labels: DataFrame, label: str, train_rows: int) -> DataFrame:
    """At most train_rows rows (text, y) from which to learn, staged; the broadcast side has at most so many ids."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & in_training(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    return stage(rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y")), "train")


def log_count_ratios(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """By bin, the log ratio of the smoothed shares of toxic (1) and other (0) texts that have it."""
    p, q = ((counts[k] + 1.0) / (total[k] + 2.0) for k in (1, 0))
    return np.log(p / q)


def likelihood_ratios(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """By bin, the log-likelihood ratio (G) of having it against the class."""
    rate = counts.sum(axis=0) / total.sum()
    worth = np.zeros(counts.shape[1])
    for seen, expected in ((counts, rate * total[:, None]), (total[:, None] - counts, (1 - rate) * total[:, None])):
        worth += 2 * (seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300))).sum(axis=0)
    return worth


def regression(blocks: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, scale: np.ndarray, rounds: int, penalty: float) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of logistic regression on rows that have the scaled columns listed in blocks of (row, column)."""
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    v, b = np.zeros(len(scale)), prior
    sums = lambda at, by, n: np.bincount(at, weights=by, minlength=n)
    # diagonal bound of the curvature, for steps that need no line search
    size, bound = np.abs(scale), np.full(len(v), penalty * len(y) + 1e-9)
    for rows, columns in blocks:
        first = rows[0] if len(rows) else 0
        bound += 0.25 * sums(columns, size[columns] * sums(rows - first, size[columns], 0)[rows - first], len(v))
    look_v, look_b, momentum = v, b, 1.0
    for _ in range(rounds):
        z = np.full(len(y), look_b)
        steep = look_v * scale
        for rows, columns in blocks:
            if len(rows):
                part = sums(rows - rows[0], steep[columns], 0)
                z[rows[0] : rows[0] + len(part)] += part
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.zeros(len(v))
        for rows, columns in blocks:
            slope += sums(columns, error[rows], len(v))
        slope = slope * scale + penalty * len(y) * look_v
        new_v, new_b = look_v - slope / bound, look_b - error.mean()
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look_v, look_b = new_v + (momentum - 1) / faster * (new_v - v), new_b + (momentum - 1) / faster * (new_b - b)
        v, b, momentum = new_v, new_b, faster
    return v, b


#: Intercept where no text to learn from is marked: a score of 0.
NOTHING_TOXIC = -500.0


def fit(rows: DataFrame, rounds: int = 120, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weight by bin, intercept) from the bounded staged rows; they stream past twice, text by text."""
    features = Features()
    counts = np.zeros((2, BINS), dtype=np.int32)
    y: list[int] = []
    for row in rows.toLocalIterator():
        counts[row.y, features(row.text)] += 1
        y.append(row.y)
    total = np.bincount(y, minlength=2)
    prior = float(np.log((total[1] + 0.5) / (total[0] + 0.5)))
    if not total.all():
        return np.zeros(BINS, np.float32), prior if total[1] else NOTHING_TOXIC
    kept = [np.flatnonzero(likelihood_ratios(counts[:, i : i + BLOCK_BINS].astype(np.float64), total) >= LEAST) + i for i in range(0, BINS, BLOCK_BINS)]
    chosen = np.concatenate(kept)
    if not len(chosen):
        return np.zeros(BINS, np.float32), prior
    scale = log_count_ratios(counts[:, chosen], total)
    del counts
    slot = np.full(BINS, -1, dtype=np.int32)
    slot[chosen] = np.arange(len(chosen))
    blocks: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[np.ndarray] = []
    y = []
    begin = 0

    def block() -> None:
        sizes = [len(h) for h in held]
        blocks.append((np.repeat(np.arange(begin, begin + len(held), dtype=np.int32), sizes), np.concatenate([np.empty(0, np.int32), *held])))
        held.clear()

    for row in rows.toLocalIterator():
        mine = slot[features(row.text)]
        held.append(mine[mine >= 0])
        y.append(row.y)
        if len(held) == BLOCK_ROWS:
            block()
            begin = len(y)
    block()
    v, b = regression(blocks, np.array(y, dtype=np.float64), scale, rounds, penalty)
    weight = np.zeros(BINS, dtype=np.float32)
    weight[chosen] = v * scale
    return weight, float(b)


def scorer(spark, model: tuple[np.ndarray, float]):
    """A column function of texts; the broadcast has BINS weights, whatever the input."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight, b = shared.value
        features = Features()
        for batch in batches:
            z = np.fromiter((float(weight[features(t)].sum(dtype=np.float64)) + b for t in batch), dtype=np.float64, count=len(batch))
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return lambda text: score(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, column: str = "toxicity") -> DataFrame:
    """docs with a column (one of that name is replaced) of the probability of label 1."""
    return docs.withColumn(column, scorer(docs.sparkSession, fit(labelled(docs, labels, "toxic", train_rows)))(F.col("text")))


def verdict(score: str, least: float) -> list[Column]:
    return ["doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= least).cast("int").alias("predicted")]
