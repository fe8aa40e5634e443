"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are flattened into arrays (feature, threshold, left child, leaf value), all of one depth, so that a batch of
documents walks all trees level by level in numpy. Fitting reads at most `train_rows` labelled rows, of which only their
statistics reach the driver; scoring reads every row whole.

Defined cases: a row with a null doc_id is not held out, and not learnt from, as no label is its own; null text is the empty text, whose statistics are all 0; of rows with one doc_id the one whose text has the least hash is learnt
from; labels that are null, not 0 or 1, or held out are not
learnt from; with labels of one class or none, every score is their smoothed rate; other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes
from .toxicity import labelled

TRAIN_ROWS, TREES, DEPTH, BINS, RATE, LEAF = 20_000, 80, 4, 64, 0.15, 20
#: A score from which a text counts as good.
GOOD = 0.7

_CLASS = np.zeros(256, dtype=np.int64)  # 0 control, then:
for _i in range(33, 127):
    _CLASS[_i] = 5  # other signs
_CLASS[list(range(97, 123))] = 1
_CLASS[list(range(65, 91))] = 2
_CLASS[list(range(48, 58))] = 3
_CLASS[[32, 9]] = 4
_CLASS[list(b".,;:?'\"()-")] = 6
_CLASS[10] = 7
_CLASS[128:192] = 8  # continuation bytes
_CLASS[192:] = 9
_REPEAT = re.compile(rb"([^ \t-\r])\1\1")
N_STATS = 32


def statistics(text: bytes, packer) -> list[float]:
    """Lengths, shares of character classes, repetition of words, word pairs and lines, and compressibility."""
    if not text:
        return [0.0] * N_STATS
    histogram = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=histogram, minlength=10)
    n = len(text)
    chars = n - kinds[8]
    share = histogram[histogram > 0] / n
    words = text.split()
    count = len(words)
    w = max(1, count)
    seen = Counter(words)
    top = seen.most_common(2)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=count) if count else np.zeros(1, np.int64)
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x]
    many = max(1, len(lines))
    bare = Counter(x.lower().strip(b".,;:!?") for x in seen)
    signs = kinds[5] + kinds[6]
    return [
        np.log1p(chars), np.log1p(count), chars / w, float(lengths.std()), float(lengths.max()),
        kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n, (kinds[8] + kinds[9]) / n, kinds[0] / n,
        float(-(share * np.log2(share)).sum()), len(seen) / w, top[0][1] / w if top else 0.0, top[1][1] / w if len(top) > 1 else 0.0,
        pairs / w, same / w, np.log1p(len(lines)), len(set(lines)) / many, count / many,
        sum(x[-1:] in b".!?" for x in lines) / many, len(_REPEAT.findall(text)) / w, len(bare) / max(1, len(seen)),
        signs / w, sum(x[:1].isupper() for x in seen) / max(1, len(seen)), sum(not x.isalpha() for x in seen if x.isascii()) / max(1, len(seen)),
        len(packer.compress(text)) / n, histogram[33] / w, float((lengths == 1).sum()) / w,
    ]


class Trees:
    """Flattened trees: node i of tree t tests statistics[feature[t, i]] > threshold[t, i] and goes to 2 i + 1 or 2 i + 2."""

    def __init__(self, base: float) -> None:
        self.base = base
        self.feature = np.zeros((0, 2**DEPTH - 1), dtype=np.int64)
        self.threshold = np.zeros((0, 2**DEPTH - 1))
        self.leaf = np.zeros((0, 2**DEPTH))

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        tree = np.arange(len(self.feature))
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.leaf[tree, node - (2**DEPTH - 1)].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Boosting on the logistic loss; split gains come from gradient histograms over quantile bins."""
    ones = float(y.sum())
    model = Trees(float(np.log((ones + 0.5) / (len(y) - ones + 0.5))))
    if not 0 < ones < len(y):
        return vars(model)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + BINS * np.arange(x.shape[1])
    total = np.full(len(y), model.base)
    made = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p) + 1e-6
        node = np.zeros(len(y), dtype=np.int64)
        feature, threshold, leaf = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf), np.zeros(2**DEPTH)
        for level in range(DEPTH):
            for i in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == i)
                if len(rows) < 2 * LEAF:
                    continue
                at = flat[rows].ravel()
                shape = (x.shape[1], BINS)
                gs, hs, ns = (np.bincount(at, weights=None if v is None else np.repeat(v[rows], x.shape[1]), minlength=shape[0] * BINS).reshape(shape).cumsum(axis=1) for v in (g, h, None))
                g_all, h_all, n_all = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + 1) + (g_all - gs) ** 2 / (h_all - hs + 1) - g_all**2 / (h_all + 1)
                gain[(ns < LEAF) | (n_all - ns < LEAF)] = -1
                f, b = np.unravel_index(int(gain.argmax()), shape)
                if gain[f, b] > 1e-3 and b < len(edges[f]):
                    feature[i], threshold[i] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - (2**DEPTH - 1)
        leaf = -RATE * np.bincount(at, weights=g, minlength=2**DEPTH) / (np.bincount(at, weights=h, minlength=2**DEPTH) + 1)
        total += leaf[at]
        made.append((feature, threshold, leaf))
    model.feature, model.threshold, model.leaf = (np.stack(a) for a in zip(*made))
    return vars(model)


def statistics_column():
    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pd.Series([[float(v) for v in statistics(bytes(t), packer)] for t in batch])

    return stats


def scorer(spark, model: dict):
    """A column function of texts; the broadcast has TREES trees of one depth, whatever the input."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees = Trees(0)
        vars(trees).update(shared.value)
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out = []
            for i in range(0, len(batch), 512):
                x = np.array([statistics(bytes(t), packer) for t in batch.iloc[i : i + 512]], dtype=np.float64).reshape(-1, N_STATS)
                out.append(1 / (1 + np.exp(-trees.margin(x))))
            yield pd.Series(np.concatenate(out) if out else [])

    return lambda text: score(as_bytes(text))


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, column: str = "quality_score") -> DataFrame:
    """docs with a column (one of that name is replaced) of the probability of label 1."""
    rows = labelled(docs, labels, "quality", train_rows).select("y", statistics_column()(as_bytes(F.col("text"))).alias("x")).collect()  # at most train_rows rows of N_STATS numbers
    x = np.array([r.x for r in rows], dtype=np.float64).reshape(-1, N_STATS)
    return docs.withColumn(column, scorer(docs.sparkSession, fit(x, np.array([r.y for r in rows], dtype=np.float64)))(F.col("text")))
