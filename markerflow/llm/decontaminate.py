"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents inside a task, of SHARD_WORDS words or one longer document. Words that no benchmark phrase has cannot take part in a match, so a
shard's index holds the runs of phrase words between them (exactly the text in which a phrase can occur), with a separator
after each run. The index is a suffix array's Burrows-Wheeler transform in a wavelet matrix; all phrases are searched backward
together, each step being one vectorised rank in each level (bits packed in words, with counts before each word); occurrences are
located by stepping back to sampled suffix positions, which alone are kept, and the spans they cover are merged per document.
Nothing is shuffled, and a lost task is simply run again.

The benchmark is read in passes of PASS_BYTES. A pass becomes arrays on the driver (words, windows and owners as numbers, vocabulary and names as one
string each), which are broadcast and which all workers read as they are: 16 MB of text take under 150 MB. A shard searches the windows
whose words it has. One pass, as for all public benchmarks, is a column over the documents. Of several, each
is broadcast alone, what it finds is staged by a digest of the text (a row for each different contaminated text), and the results of all
are joined to the documents.

Defined cases: null or empty text has no words and no hits; a benchmark row without words is no item; repeated item_ids are
one item, a null item_id reads as the empty string; an empty benchmark hits nothing; other columns pass through untouched.
"""

from __future__ import annotations

import array
import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, stage

#: Words in a window; words after which a shard is indexed; bytes of benchmark text searched in one pass (a larger benchmark
#: takes more passes, so what is broadcast is bounded).
WINDOW, SHARD_WORDS, PASS_BYTES = 10, 1 << 21, 16 << 20
#: Windows searched at a time, and words whose numbers a task remembers.
SEARCHED, WORDS_KEPT = 1 << 18, 1 << 18
#: Every so many positions of a run keep their place in the text.
SAMPLE = 8

_WORD = bytes(i for i in range(256) if i >= 0x80 or chr(i).isalnum())
_FOLD = bytes(i if i in _WORD else 32 for i in range(256)).lower()
_AT = re.compile(rb"[^ ]+")
SPANS = "array<struct<start:int,end:int>>"
RESULT = f"n_words long, n_hit long, spans {SPANS}, cuts {SPANS}, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and cuts at ASCII bytes that are neither letter nor digit."""
    return text.translate(_FOLD).split()


class Strings:
    """Many byte strings in one, in order; those of hashed ones are found by hash, then by their bytes."""

    def __init__(self, strings: list[bytes], hashed: bool) -> None:
        hashes = [xxhash.xxh3_64_intdigest(x) for x in strings] if hashed else []
        if hashed:
            order = sorted(range(len(strings)), key=hashes.__getitem__)
            strings, hashes = [strings[i] for i in order], [hashes[i] for i in order]
        self.hashes = array.array("Q", hashes)
        self.ends = np.cumsum([0, *map(len, strings)], dtype=np.int64)
        self.data = b"".join(strings)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.ends[i] : self.ends[i + 1]]

    def find(self, string: bytes) -> int:
        """Its place, -1 if it is not there."""
        key = xxhash.xxh3_64_intdigest(string)
        i = bisect.bisect_left(self.hashes, key)
        while i < len(self.hashes) and self.hashes[i] == key:
            if self[i] == string:
                return i
            i += 1
        return -1


class Phrases:
    """Distinct windows of the benchmark items, in arrays: ids has the items' words as numbers (1 up), an item of fewer than WINDOW words with
    zeros after it; a window is the WINDOW numbers from its start on. Which items have a window is a range of owner."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        numbers: dict[bytes, int] = {}
        parts, sizes, names = [], [], []
        for name, text in items:
            words = words_of(text)
            if words:
                parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)) + 1)
                sizes.append(len(words))
                names.append(name.encode("utf-8", "surrogatepass"))
        self.vocabulary = Strings(list(numbers), True)
        place = np.zeros(len(numbers) + 1, np.int32)
        for i in range(len(self.vocabulary)):
            place[numbers[self.vocabulary[i]] + 1] = i + 1
        del numbers
        self.names = Strings(sorted(set(names)), False)
        known = {self.names[i]: i for i in range(len(self.names))}
        size = np.array(sizes, dtype=np.int64)
        room = np.maximum(size, WINDOW)
        first = np.cumsum(room) - room
        self.ids = np.zeros(int(room.sum()) + WINDOW, np.int32)
        for at, part in zip(first.tolist(), parts):
            self.ids[at : at + len(part)] = place[part]
        count = np.maximum(size - WINDOW + 1, 1)
        begin = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        owner = np.repeat(np.array([known[n] for n in names], dtype=np.int64), count)
        rank, _ = _ranked(self.ids, WINDOW)
        _, at, which = np.unique(rank[begin], return_index=True, return_inverse=True)
        self.start = begin[at].astype(np.int32)
        self.lengths = np.zeros(len(at), np.int64)
        for c in range(WINDOW):
            self.lengths += self.ids[self.start + c] > 0
        pairs = np.unique(which * max(1, len(self.names)) + owner)
        self.owner = (pairs % max(1, len(self.names))).astype(np.int32)
        self.owned = np.searchsorted(pairs // max(1, len(self.names)), np.arange(len(at) + 1)).astype(np.int32)
        self.shortest = int(self.lengths.min()) if len(at) else 0

    def number(self, word: bytes) -> int:
        """A word's number, 0 if no phrase has it."""
        return self.vocabulary.find(word) + 1

    def made_of(self, some: np.ndarray) -> np.ndarray:
        """The windows all of whose words are in some (true for numbers)."""
        good = some[self.ids] | (self.ids == 0)
        keep = np.arange(len(self.start))
        for c in range(WINDOW):
            keep = keep[good[self.start[keep] + c]]
        return keep


def _ranked(ids: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """A number for each place, equal for places from which on width numbers are equal, by doubling; what is after the end counts as 0."""
    if width == 1:
        return ids.astype(np.int64), 1
    half, step = _ranked(ids, width // 2)
    both, step = _joined(half, half, step), 2 * step
    return (_joined(both, ids.astype(np.int64), step), width) if width % 2 else (both, step)


def _joined(head: np.ndarray, tail: np.ndarray, step: int) -> np.ndarray:
    after = np.zeros(len(head), np.int64)
    after[:-step] = tail[step:]
    return np.unique(head * (int(tail.max()) + 1) + after, return_inverse=True)[1]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling. Separators (0) count as different from each other, in order of position, which ends every comparison
    at the end of a run."""
    n = len(symbols)
    key = symbols.astype(np.int64) + n
    ends = np.flatnonzero(symbols == 0)
    key[ends] = np.arange(len(ends))
    step = 1
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, dtype=np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        step *= 2


class Bits:
    """A bit vector in words of 64, with the number of ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        packed = np.packbits(bits.astype(bool), bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int32)]).astype(np.int32)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & below)


class Wavelet:
    """A wavelet matrix: rank of a symbol before a position, and the symbol at one, take a rank in each bit of the symbols."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        self.bits = max(1, int(top).bit_length())
        self.levels, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = ((values >> b) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        start = np.zeros_like(at)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> b) & 1).astype(bool)
            bits, zeros = self.levels[level], self.zeros[level]
            x, y = bits.ones(at), bits.ones(start)
            at = np.where(one, zeros + x, at - x)
            start = np.where(one, zeros + y, start - y)
        return at - start

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for bits, zeros in zip(self.levels, self.zeros):
            one, x = bits[at], bits.ones(at)
            out = 2 * out + one
            at = np.where(one, zeros + x, at - x)
        return out


class FMIndex:
    """Over runs of symbols 1.. that each end with 0; text[0] must be 0."""

    def __init__(self, text: np.ndarray) -> None:
        order = suffix_array(text)
        last = text[order - 1]  # the symbol before each suffix; before the first, which is a separator, the last separator
        self.n = len(text)
        self.tree = Wavelet(last, int(text.max()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        kept = (last == 0) | (order % SAMPLE == 0)
        self.kept = Bits(kept)
        self.place = order[kept].astype(np.int32)

    def find(self, ids: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with the width symbols of ids from each start on (0: nothing there)."""
        low = np.zeros(len(start), dtype=np.int64)
        high = np.full(len(start), self.n, dtype=np.int64)
        top = len(self.first) - 2
        for column in range(width - 1, -1, -1):
            symbol = ids[start + column].astype(np.int64)
            on = np.flatnonzero((symbol > 0) & (low < high))
            known = np.minimum(symbol[on], top)
            below = self.first[known]
            new_low, new_high = below + self.tree.rank(known, low[on]), below + self.tree.rank(known, high[on])
            new_high = np.where(symbol[on] > top, new_low, new_high)
            low[on], high[on] = new_low, new_high
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, back = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        todo = np.flatnonzero(~self.kept[at])
        while len(todo):
            symbol = self.tree.symbol(at[todo])
            at[todo] = self.first[symbol] + self.tree.rank(symbol, at[todo])
            back[todo] += 1
            todo = todo[~self.kept[at[todo]]]
        return self.place[self.kept.ones(at)] + back


def search(shard: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences in a shard of documents' word numbers: (position over all documents, window)."""
    words = np.concatenate([*(np.append(d, 0) for d in shard), [0]])  # documents are kept apart
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (words != 0).astype(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= phrases.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts) or not len(phrases.start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = ends - starts + 1
    origin = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    text = words[origin]  # each run and the 0 after it
    text, origin = np.append(0, text), np.append(-1, origin)
    here = np.zeros(len(phrases.vocabulary) + 1, dtype=bool)
    here[text] = True
    able = phrases.made_of(here)
    if not len(able):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    index = FMIndex(text)
    places, windows = [], []
    for at in range(0, len(able), SEARCHED):
        some = able[at : at + SEARCHED]
        low, high = index.find(phrases.ids, phrases.start[some], WINDOW)
        found = np.flatnonzero(high > low)
        many = (high - low)[found]
        rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64), many) + np.arange(many.sum())
        places.append(origin[index.locate(rows)])
        windows.append(np.repeat(some[found], many))
    return np.concatenate(places), np.concatenate(windows)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cuts(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of spans of words."""
    at = [m.span() for m in _AT.finditer(text.translate(_FOLD))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def _shard(texts: list[bytes], shard: list[np.ndarray], phrases: Phrases) -> list[tuple]:
    begin = np.concatenate([[0], np.cumsum([len(d) + 1 for d in shard])]).astype(np.int64)
    position, window = search(shard, phrases)
    doc = np.searchsorted(begin, position, side="right") - 1
    by: dict[int, tuple[list, set]] = {}
    for d, p, w in zip(doc.tolist(), (position - begin[doc]).tolist(), window.tolist()):
        spans, items = by.setdefault(d, ([], set()))
        spans.append((p, p + int(phrases.lengths[w])))
        items.update(phrases.owner[phrases.owned[w] : phrases.owned[w + 1]].tolist())
    out = []
    for d, ids in enumerate(shard):
        spans, items = by.get(d, ((), ()))
        merged = _merge(list(spans))
        out.append((len(ids), sum(b - a for a, b in merged), merged, _cuts(texts[d], merged) if merged else [], [phrases.names[i].decode("utf-8", "surrogatepass") for i in sorted(items)]))
    return out


class _Numbers(dict):
    """Numbers of the words met, as they are looked up once."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases = phrases

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.phrases.number(word)
        return n


def _searcher(shared):
    @F.pandas_udf(RESULT)
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        phrases: Phrases = shared.value
        numbers = _Numbers(phrases)
        number = numbers.__getitem__
        texts, shard, held = [], [], 0

        def found() -> pd.DataFrame:
            return pd.DataFrame(_shard(texts, shard, phrases), columns=["n_words", "n_hit", "spans", "cuts", "items"])

        for batch in batches:  # a shard may hold several: results come when it is full
            if len(numbers) > WORDS_KEPT:
                numbers.clear()
            for data in batch:
                text = bytes(data)
                words = words_of(text)
                texts.append(text)
                shard.append(np.fromiter(map(number, words), dtype=np.int64, count=len(words)))
                held += len(words)
                if held >= SHARD_WORDS:
                    yield found()
                    texts, shard, held = [], [], 0
        if shard:
            yield found()

    return leaks


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The items in passes of at most PASS_BYTES (a longer item is a pass of its own), of which the driver holds two at most."""
    out: list[tuple[str, bytes]] = []
    size = 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), as_bytes(F.col("text")).alias("t")).toLocalIterator():
        if size and size + len(row.t) > PASS_BYTES:
            yield out
            out, size = [], 0
        out.append((row.i, bytes(row.t)))
        size += len(row.t)
    yield out


def _merged(found: DataFrame) -> DataFrame:
    """(key, leaks) of the passes' results (key, leaks) of one text."""

    @F.pandas_udf(RESULT)
    def union(data: pd.Series, results: pd.Series) -> pd.DataFrame:
        rows = []
        for text, parts in zip(data, results):
            spans = _merge([(s["start"], s["end"]) for p in parts for s in p["spans"]])
            items = sorted({x for p in parts for x in p["items"]})
            rows.append((int(parts[0]["n_words"]), sum(b - a for a, b in spans), spans, _cuts(bytes(text), spans), items))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "spans", "cuts", "items"])

    # a text's results are one a pass
    every = found.groupBy("key").agg(F.first("data").alias("data"), F.collect_list("leaks").alias("parts"))
    return every.select("key", union("data", "parts").alias("leaks"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, column: str = "leaks") -> DataFrame:
    """docs with a struct column (one of that name is replaced): n_words, n_hit, spans (of words, merged), cuts (the same as byte ranges of the UTF-8
    text), items (ids as sorted strings)."""
    spark = docs.sparkSession
    data = as_bytes(F.col("text"))
    passes = _passes(benchmark)
    first, second = next(passes), next(passes, None)
    if second is None:
        return docs.withColumn(column, _searcher(spark.sparkContext.broadcast(Phrases(first)))(data))

    every = None
    for items in itertools.chain([first, second], passes):
        shared = spark.sparkContext.broadcast(Phrases(items))
        rows = docs.select(data.alias("data"), _searcher(shared)(data).alias("leaks")).where("leaks.n_hit > 0")
        found = stage(rows.groupBy(F.md5("data").alias("key")).agg(F.first("data").alias("data"), F.first("leaks").alias("leaks")), "leaks")
        every = found if every is None else every.unionByName(found)
        shared.destroy()
    merged = stage(_merged(every), "leaks-merged")
    names = {"key": _unused(docs, "leak_key"), "leaks": _unused(docs, "leak_found")}
    n_words = F.when(F.length(data) == 0, 0).otherwise(_count_words(data)).cast("long")
    empty = F.struct(n_words.alias("n_words"), F.lit(0).cast("long").alias("n_hit"), *[F.array().cast(t).alias(n) for n, t in (("spans", SPANS), ("cuts", SPANS), ("items", "array<string>"))])
    joined = docs.join(merged.withColumnsRenamed(names), F.md5(data) == F.col(names["key"]), "left")
    return joined.withColumn(column, F.coalesce(names["leaks"], empty)).drop(*names.values())


def _unused(docs: DataFrame, name: str) -> str:
    """The name, lengthened until no column of docs has it."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _count_words(data: Column) -> Column:
    """Words of UTF-8 bytes: runs of what is not ASCII, or is an ASCII letter or digit."""
    return F.regexp_count(data.cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what find_leaks returned."""
    return found.select(
        "doc_id",
        F.col("leaks.n_words").alias("n_words"),
        F.col("leaks.n_hit").alias("n_hit"),
        F.size("leaks.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "leaks.items").cast("binary"), 256).alias("items_sha256"),
        (F.col("leaks.n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item, least(len(ws), 10) AS l, list_slice(ws, k, k + 9) AS win
      FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
o AS (SELECT doc_id, l, k, list_slice(ws, k, k + l - 1) AS win
      FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM p) WHERE len(ws) >= l)),
h AS (SELECT DISTINCT o.doc_id, p.item, o.k, o.l FROM o JOIN p ON o.l = p.l AND o.win = p.win),
n AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS w FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
