"""Phrase collocation mining with suffix arrays over word ids.

1. A task reads texts as pieces (cut at PIECES) of words, numbered apart for each lang, in shards of SHARD_WORDS words. A shard's suffix
   array is built by prefix doubling (two rounds, as no phrase has more than four words); its LCP intervals are the shard's n-grams,
   each with its count and one place.
2. Which n-grams reach LEAST over all shards is found from hashes: sorted runs of 48-bit keys, front-coded, are exchanged by key range and
   their counts summed and sent back. Words and pairs go first; then only those of three and four words whose pairs all reach it. A hash that two
   n-grams share can only keep one more.
3. The kept n-grams leave the shards as phrases with counts, in a packed run for each part of the phrases' hashes, and are merged by
   (lang, phrase): exact from here on.
4. Each cut of a candidate looks up its two parts by joins; containment is a join with the sub-phrases of longer candidates. A lang's
   first rows are found by a histogram of its scores, then by ranks inside LANES lanes, then among the lanes' first rows, so a lang with
   most phrases is not one task.

All sums are longs and 2000000 * a is a decimal of 38 digits. Nothing but the broadcast histogram (a thousand bins a lang) is held by all.

Defined cases: null text is empty; null lang is `und`, with the rows of that lang; an empty table gives no rows; repeated rows count again;
a text of any length is read in chunks that end at a cut between pieces; other columns are ignored.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import BATCH_BITS, MANY, TASK_BITS, _counts, flags_of, front, give_back, part_starts
from .common import as_bytes, partitions, stage, unstage

#: Longest phrase; occurrences of a candidate; words of a shard; bytes of a text numbered at once; rows of a lang.
LONGEST, LEAST, SHARD_WORDS, CHUNK_BYTES, TOP = 4, 30, 3 << 19, 8 << 20, 2000
#: Lanes that a lang's rows are ranked in before the last ranking; scores are at most SCALE / 2, in bins of BIN.
LANES, SCALE, BIN = 64, 2_000_000, 1000
# What ends a piece, and what is between its words.
PIECES, BLANK = b".,;:!?\n\v\f\r", b"\t "
_TURN = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_END = b"\xff"  # in no UTF-8 text
_FOLD = bytes(10 if b in PIECES else 32 if b in BLANK else b for b in range(256)).lower()


def chunks(text: bytes) -> Iterator[bytes]:
    """Folded text in parts of CHUNK_BYTES or a little more, each up to a cut between pieces."""
    text = text.translate(_FOLD)
    at = 0
    while at < len(text):
        end = text.find(b"\n", at + CHUNK_BYTES) + 1 or len(text)
        yield text[at:end]
        at = end


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """Words of texts as numbers (0 between pieces), and the words by number with their lang's place in langs."""

    def __init__(self) -> None:
        self.langs: list[str] = []
        self.known: dict[str, dict[bytes, int]] = {}
        self.parts: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.size = 0

    def add(self, lang: str, chunk: bytes) -> None:
        if lang not in self.known:
            self.langs.append(lang)
            self.known[lang] = _Numbers({_END: 0})
        words = chunk.replace(b"\n", b" \xff ").split()
        numbers = np.fromiter(map(self.known[lang].__getitem__, words), dtype=np.int64, count=len(words))
        # numbers of a lang are 1, 2, ...; they get their place among those of all langs when the shard is full
        self.parts += [np.where(numbers > 0, numbers * 1024 + (len(self.langs) - 1 if lang == self.langs[-1] else self.langs.index(lang)), 0), np.zeros(1, np.int64)]
        self.size += len(words)

    def pack(self) -> tuple[bytes, bytes, bytes]:
        """(langs, words by number, numbers), compressed."""
        packer = zstandard.ZstdCompressor(level=1)
        first = np.cumsum([0] + [len(self.known[lang]) - 1 for lang in self.langs])
        text = np.concatenate(self.parts)
        text = np.where(text > 0, (text >> 10) + first[text & 1023], 0).astype(np.int32)
        langs = "\0".join(f"{lang}\1{n}" for lang, n in zip(self.langs, np.diff(first)))
        words = b"\0".join(w.replace(b"\0", b"\xfe") for lang in self.langs for w in list(self.known[lang])[1:])
        return langs.encode(), packer.compress(words), packer.compress(text.tobytes())


def _shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    if task >> TASK_BITS:
        raise ValueError(f"more than {1 << TASK_BITS} partitions: coalesce the documents first")
    number, shard = task << BATCH_BITS, Shard()

    def row() -> pd.DataFrame:
        langs, words, text = shard.pack()
        return pd.DataFrame([(number, langs, words, text)], columns=["batch", "langs", "words", "packed"])

    for pdf in frames:
        for lang, data in zip(pdf["lang"], pdf["data"]):
            for chunk in chunks(bytes(data)):
                shard.add(lang, chunk)
                if shard.size >= SHARD_WORDS or len(shard.langs) == 1024:
                    yield row()
                    number, shard = number + 1, Shard()
    if shard.size:
        yield row()
    del shard
    give_back()


class Grams:
    """The n-grams of a shard from the intervals of its suffix array: for n words, at[n] holds a place of each, times[n] its count, and member[n]
    says for each place which one starts there (-1: none)."""

    def __init__(self, row: pd.Series, longest: int = LONGEST) -> None:
        unpack = zstandard.ZstdDecompressor().decompress
        self.text = text = np.frombuffer(unpack(bytes(row["packed"])), np.int32)
        self.langs = [(lang, int(n)) for lang, n in (x.rsplit("\1", 1) for x in bytes(row["langs"]).decode("utf-8", "surrogatepass").split("\0"))]
        self.words = unpack(bytes(row["words"])).split(b"\0")
        self.hashes: np.ndarray | None = None
        n = len(text)
        order, step = self._sorted(text, longest)
        last = np.append(np.flatnonzero(text == 0), n)
        room = last[np.searchsorted(last, np.arange(n))] - np.arange(n)  # words up to the end of the piece
        same = np.ones(n - 1, dtype=bool)  # neighbours in the array that begin alike
        self.at, self.times, self.member = {}, {}, {}
        for k in range(1, longest + 1):
            shifted = np.append(text, np.zeros(k, np.int32))[k - 1 :][order]
            same = same & (shifted[1:] == shifted[:-1])
            heads = np.flatnonzero(np.concatenate([[True], ~same]))
            size = np.diff(np.append(heads, n))
            whole = room[order[heads]] >= k
            group = np.where(whole, np.cumsum(whole) - 1, -1)
            member = np.empty(n, np.int32)
            member[order] = np.repeat(group, size).astype(np.int32)
            self.at[k], self.times[k], self.member[k] = order[heads[whole]], size[whole], member

    @staticmethod
    def _sorted(text: np.ndarray, longest: int) -> tuple[np.ndarray, int]:
        """Places in the order of the words that follow, by prefix doubling until as many words as count are compared."""
        rank, step = text.astype(np.int64), 1
        while True:
            after = np.zeros(len(rank), dtype=np.int64)
            after[:-step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            step *= 2
            if step >= longest:
                return order, step
            ordered = key[order]
            rank = np.empty(len(key), dtype=np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])

    def keys(self, sizes: tuple[int, ...], some: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct keys, their counts, which of them each n-gram of sizes has) of all n-grams, or of those that some says."""
        if self.hashes is None:
            starts = np.cumsum([0] + [n for _, n in self.langs])
            seeds = [xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")) for lang, _ in self.langs]
            self.hashes = np.array([0, *(xxhash.xxh3_64_intdigest(w, seed) for seed, a, b in zip(seeds, starts, starts[1:]) for w in self.words[a:b])], dtype=np.uint64)
        keys, times = [], []
        for k in sizes:
            at, many = self.at[k], self.times[k]
            if some is not None:
                at, many = at[some[k]], many[some[k]]
            h = np.full(len(at), k, np.uint64)
            for j in range(k):
                h = (h ^ self.hashes[self.text[at + j]]) * _TURN[j]
                h ^= h >> np.uint64(29)
            keys.append(h & np.uint64(0xFFFFFFFFFFFF0000))
            times.append(many)
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        return distinct, np.bincount(which, weights=np.concatenate(times), minlength=len(distinct)).astype(np.int64), which

    def reaching(self, sizes: tuple[int, ...], flags, least: int, some: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
        """For each n of sizes, which n-grams may occur least times in all, by the counts of their keys."""
        _, _, which = self.keys(sizes, some)
        good = (flags_of(flags) >= least)[which]
        out, start = {}, 0
        for k in sizes:
            mine = np.ones(len(self.at[k]), bool) if some is None else some[k].copy()
            n = int(mine.sum())
            mine[mine] = good[start : start + n]
            out[k], start = mine, start + n
        return out

    def longer(self, pairs: np.ndarray) -> dict[int, np.ndarray]:
        """Which n-grams of three and four words are made of pairs that reach the count."""
        start = np.append(self.member[2] >= 0, [False, False])
        start[: len(self.text)][start[: len(self.text)]] = pairs[self.member[2][self.member[2] >= 0]]
        return {k: np.logical_and.reduce([start[self.at[k] + j] for j in range(k - 1)]) for k in range(3, LONGEST + 1)}

    def phrases(self, some: dict[int, np.ndarray]) -> Iterator[tuple[str, int]]:
        """(lang, number of words and phrase in one, n) of those n-grams, and one of no words that counts each lang's words."""
        edges = np.cumsum([0] + [n for _, n in self.langs])
        names = np.array([lang for lang, _ in self.langs], dtype=object)
        word = [b"", *(w.replace(b"\xfe", b"\0").decode("utf-8", "replace") for w in self.words)]
        for k, kept in some.items():
            at = self.at[k][kept]
            lang = np.searchsorted(edges, self.text[at] - 1, side="right") - 1
            for a, row, n in zip(lang.tolist(), self.text[at[:, None] + np.arange(k)].tolist(), self.times[k][kept].tolist()):
                yield f"{names[a]}\n{k}{' '.join([word[i] for i in row])}", n
        every = np.bincount(np.searchsorted(edges, self.text[self.text > 0] - 1, side="right") - 1, minlength=len(names))
        yield from ((f"{lang}\n0", n) for lang, n in zip(names, every.tolist()))


def _pack(rows: list[tuple[bytes, int]], packer: zstandard.ZstdCompressor) -> bytes:
    size = np.array([len(p) for p, _ in rows], np.int32)
    return packer.compress(b"".join((np.int64(len(rows)).tobytes(), size.tobytes(), np.array([n for _, n in rows], np.int64).tobytes(), *(p for p, _ in rows))))


def _unpack(run: bytes) -> Iterator[tuple[bytes, int]]:
    raw = zstandard.ZstdDecompressor().decompress(bytes(run))
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at = 8 + 12 * n
    for size, count in zip(np.frombuffer(raw, np.int32, n, 8).tolist(), np.frombuffer(raw, np.int64, n, 8 + 4 * n).tolist()):
        yield raw[at : at + size], count
        at += size


def _merge(least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums the counts of one part of the phrases, of which each shard sends one run, and keeps those that reach least. A phrase is once in a run, so
        no part is larger for a phrase that is everywhere."""
        total: dict[bytes, int] = collections.defaultdict(int)
        for r in pdf["run"]:
            for phrase, n in _unpack(r):
                total[phrase] += n
        out = []
        for phrase, n in total.items():
            lang, rest = phrase.decode("utf-8", "surrogatepass").rsplit("\n", 1)  # no word has a line's end
            if n >= least or rest == "0":
                out.append((lang, rest[1:] if rest != "0" else None, int(rest[0]), n))
        return pd.DataFrame(out, columns=["lang", "phrase", "words", "n"])

    return run


def _counted(shards: DataFrame, keys_of) -> DataFrame:
    """(batch, flags): the counts over all shards (MANY: or more) of a shard's sorted distinct keys."""
    parts = 2 * partitions(shards.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=1)
        for pdf in frames:
            for _, row in pdf.iterrows():
                keys, times = keys_of(row)
                times = np.minimum(times, MANY).astype(np.uint8)
                edges = np.append(np.searchsorted(keys, part_starts(parts), side="left"), len(keys))
                rows = [(p, int(row["batch"]), packer.compress(front(keys[edges[p] : edges[p + 1]])), packer.compress(times[edges[p] : edges[p + 1]].tobytes())) for p in range(parts) if edges[p] < edges[p + 1]]
                yield pd.DataFrame(rows, columns=["part", "batch", "run", "times"])
                del keys, times, rows
                give_back()

    back = shards.mapInPandas(run, "part int, batch long, run binary, times binary").groupBy("part").applyInPandas(_counts, "batch long, part int, flags binary")
    return back.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("part", "flags"))).alias("flags"))


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, n): all phrases of one to LONGEST words that occur least times in a lang (least is at most 255), and, with a
    null phrase and no words, how many words the lang has. The table is staged."""
    if not 0 < least <= MANY:
        raise ValueError(f"least must be from 1 to {MANY}")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), as_bytes(F.col("text")).alias("data"))
    shards = stage(rows.mapInPandas(_shards, "batch long, langs binary, words binary, packed binary"), "phrases-shards", "snappy")
    short, long = (1, 2), tuple(range(3, LONGEST + 1))

    def first_keys(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        return Grams(row, 2).keys(short)[:2]

    def next_keys(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        grams = Grams(row)
        return grams.keys(long, grams.longer(grams.reaching(short, row["flags"], least)[2]))[:2]

    parts = 2 * partitions(docs.sparkSession)

    def kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=1)
        for pdf in frames:
            for _, row in pdf.iterrows():
                grams = Grams(row)
                some = grams.reaching(short, row["flags"], least)
                some |= grams.reaching(long, row["more"], least, grams.longer(some[2]))
                runs: dict[int, list] = collections.defaultdict(list)
                for phrase, n in grams.phrases(some):
                    data = phrase.encode("utf-8", "surrogatepass")
                    runs[xxhash.xxh3_64_intdigest(data) % parts].append((data, n))
                yield pd.DataFrame([(p, _pack(r, packer)) for p, r in runs.items()], columns=["part", "run"])
                del grams, some, runs
                give_back()

    flags = stage(_counted(shards, first_keys), "phrases-short", "snappy")
    known = shards.join(flags, "batch")
    more = _counted(known, next_keys).withColumnRenamed("flags", "more")
    found = known.join(more, "batch", "left").mapInPandas(kept, "part int, run binary")
    out = stage(found.groupBy("part").applyInPandas(_merge(least), "lang string, phrase string, words int, n long"), "phrases")
    unstage(shards)
    unstage(flags)
    return out


def collocations(docs: DataFrame, least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's phrases of two words or more that are not part of a longer one that occurs nearly
    as often, the strongest first; top None gives all."""
    counts = phrase_counts(docs, least)
    known = counts.where("phrase IS NOT NULL")
    total = counts.where("phrase IS NULL").select("lang", F.col("n"))
    cands = known.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))

    split = F.split("phrase", " ")
    cuts = cands.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice(split, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail")
    )
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(38, 0)) * CAST(a AS DECIMAL(20, 0))) div CAST(l + r AS DECIMAL(20, 0))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))

    inner = cands.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    around = inner.select("lang", F.array_join(F.slice(split, F.col("at"), F.col("size")), " ").alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    scored = lowest.join(around, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * CAST(longer AS DECIMAL(20, 0)) < 80 * CAST(cut.a AS DECIMAL(20, 0))")
    scored = stage(scored.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score"), "phrases-scored")
    rows = scored if top is None else strongest(scored, top)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.join(total, "lang").withColumn("rank", F.row_number().over(order).cast("long")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def strongest(scored: DataFrame, top: int) -> DataFrame:
    """The rows of scored that may be among a lang's first top, and few others: each lang's rows from the bin of the top-th score on, of those
    the first top of each lane. A bin list is at most SCALE / BIN rows a lang."""
    bins = scored.groupBy("lang", F.floor(F.col("score") / BIN).alias("bin")).agg(F.count("*").alias("rows"))
    above = F.coalesce(F.sum("rows").over(Window.partitionBy("lang").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = bins.withColumn("above", above).where(F.col("above") < top).groupBy("lang").agg(F.min("bin").alias("least"))
    near = scored.join(F.broadcast(least), "lang").where(F.floor(F.col("score") / BIN) >= F.col("least")).drop("least")
    lane = Window.partitionBy("lang", "lane").orderBy(F.desc("score"), F.desc("a"), "phrase")
    few = near.withColumn("lane", F.pmod(F.xxhash64("phrase"), F.lit(LANES))).withColumn("place", F.row_number().over(lane)).where(F.col("place") <= top).drop("lane", "place")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("place")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, list_slice(ws, i, i + k - 1) AS ws, k FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT lang, ws, unnest([1, 2, 3, 4]) AS k FROM p) WHERE len(ws) >= k)),
t AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, ws, any_value(k) AS k, count(*) AS f FROM g GROUP BY lang, ws HAVING count(*) >= 30),
c AS (SELECT lang, ws, f AS a, k, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.ws, c.k, c.a, cut, h.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (h.f + r.f) AS BIGINT) AS score
      FROM c JOIN f h ON h.lang = c.lang AND h.ws = list_slice(c.ws, 1, cut) JOIN f r ON r.lang = c.lang AND r.ws = list_slice(c.ws, cut + 1, c.k)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) AS place FROM s) WHERE place = 1),
i AS (SELECT lang, list_slice(ws, s0, s0 + size - 1) AS ws, max(f) AS longer
      FROM (SELECT lang, ws, f, size, unnest(range(1, k - size + 2)) AS s0 FROM (SELECT lang, ws, f, k, unnest(range(2, k)) AS size FROM f WHERE k > 2)) GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, b.a, b.l, b.r, t.n, b.score FROM b JOIN t ON t.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.ws = b.ws WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o) WHERE rank <= 2000
"""
