"""Hard negatives, collocations and byte-level BPE against brute force and, for BPE, the tokenizers library."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerflow.llm import bpe, collocations, hard_negatives

from .test_ops import EXTRA, SCHEMA, bag, corpus

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<float>, label int"


# --- hard negatives ---------------------------------------------------------------------------------------------------------------


def mined(rows, low=50, high=95, positives=5, negatives=3):
    good = [(i, v, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in good), default=0)
    q = [[int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (width - len(v)) for _, v, _ in good]
    place = lambda s, i: (-s, i is None, i or 0)
    out = []
    for a, (i, _, lab) in enumerate(good):
        if i is None or i % 50:
            continue
        score = [sum(x * y for x, y in zip(q[a], q[b])) for b in range(len(good))]
        best = sorted((place(score[b], good[b][0]), b) for b in range(len(good)) if b != a and good[b][2] == lab)[:positives]
        for _, p in best:
            fits = [b for b in range(len(good)) if good[b][2] != lab and low * score[p] <= 100 * score[b] <= high * score[p]]
            for rank, (_, b) in enumerate(sorted((place(score[b], good[b][0]), b) for b in fits)[:negatives], 1):
                out.append((i, good[p][0], rank, good[b][0], score[p], score[b]))
    return out


def vectors(seed, n=300, d=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, d))
    rows = [(int(i), (base[rng.integers(6)] + rng.normal(size=d) * 0.4).astype(np.float32).tolist(), int(rng.integers(3))) for i in rng.permutation(n)]
    hot = base[0].astype(np.float32).tolist()
    rows += [(n + i, hot, 1) for i in range(n // 2)] + [(2 * n + i, hot, 2) for i in range(40)]  # a third are one vector
    rows += [(50, rows[0][1], 1), (None, hot, 1), (7, None, 1), (100, hot, None), (150, [float("nan")] * d, 1), (200, [float("inf")] * d, 1), (250, [None] + hot[1:], 1), (300, [], 1), (350, hot[:3], 2), (9_007_199_254_740_993, hot, 0)]
    return rows


@pytest.mark.parametrize("seed,block,passes", [(1, 4096, 1 << 14), (2, 16, 7), (3, 50, 1)])
def test_hard_negatives(spark, monkeypatch, seed, block, passes):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "TILE", 3)
    rows = vectors(seed, 120 if passes == 1 else 300)
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumns({"row": F.lit("x"), "score": F.lit(1), "anchor": F.lit(2), "vector": F.lit(0)})
    got = hard_negatives.hard_negatives(df, pass_anchors=passes)
    assert bag(tuple(r) for r in got.collect()) == bag(mined(rows))
    assert len(mined(rows)) > 20


def test_hard_negatives_wide_bands_and_nothing(spark):
    rows = vectors(5, 150)
    df = spark.createDataFrame(rows, VECTORS)
    got = hard_negatives.hard_negatives(df, low=-100, high=200, positives=2, negatives=9)
    assert bag(tuple(r) for r in got.collect()) == bag(mined(rows, -100, 200, 2, 9))
    for few in ([], [(50, [0.5], 1)], [(1, [0.5], 1)], [(50, [0.0, 0.0], 1), (51, [0.0, 0.0], 1), (53, [0.0, 0.0], 2)]):
        got = hard_negatives.hard_negatives(spark.createDataFrame(few, VECTORS))
        assert bag(tuple(r) for r in got.collect()) == bag(mined(few))
    with pytest.raises(Exception, match="too large"):
        hard_negatives.hard_negatives(spark.createDataFrame([(50, [1e30], 1)], VECTORS)).collect()


def test_pairs_are_discarded_before_their_whole_product():
    rng = np.random.default_rng(0)
    axes = np.eye(32)
    q = np.floor(256 * rng.normal(size=(2000, 32)) * np.geomspace(1, 0.01, 32))

    def block(s):
        n = len(q[s])
        return hard_negatives.Block(dict(zip(hard_negatives._PARTS, (np.arange(len(q))[s].tobytes(), np.arange(len(q))[s].tobytes(), np.zeros(n, bool).tobytes(), np.zeros(n, np.int64).tobytes(), q[s].astype(np.int32).tobytes(), (q[s] @ axes).tobytes()))), 32)

    top = np.full((20, 1), np.iinfo(np.int64).max)
    search = hard_negatives.Search(block(slice(0, 20)), True, -top, top, 5)
    whole, settle = [], search._settle
    search._settle = lambda i, j, b: (whole.append(len(i)), settle(i, j, b))
    search.take(block(slice(0, 2000)))
    assert sum(whole) < 0.05 * 20 * 2000
    score = (q[:20] @ q.T).astype(np.int64)
    np.fill_diagonal(score, -(1 << 62))
    assert (search.best[0].score == -np.sort(-score, axis=1)[:, :5]).all()


# --- collocations -----------------------------------------------------------------------------------------------------------------


def phrases(rows, least, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", folded):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            score, k, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            inside = any(100 * b >= 80 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return out


def texts(seed, docs=60):
    rng = random.Random(seed)
    words = ["the", "of", "New", "new", "york", "é", "ÉTÉ", "a\0b", "x", "x", "b\x1c"]
    fixed = ["new york city hall", "of the", "x x x x x"]
    rows = [(" ".join(rng.choice(words + fixed) + rng.choice(["", "", ".", ",", "\t", "\n", " ;: "]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "fr", None, "und", ""])) for _ in range(docs)]
    return rows + [rows[0]] * 3 + [(None, "en"), ("", None), ("...", "de"), ("solo", "de")]


@pytest.mark.parametrize("seed,shard,chunk", [(1, 1 << 21, 8 << 20), (2, 50, 30), (3, 7, 1)])
def test_collocations(spark, monkeypatch, seed, shard, chunk):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    rows = texts(seed)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumns({k: F.lit(1) for k in ("phrase", "n", "words", "data", "batch", "rank", "a")})
    for least, top in ((4, 2000), (2, 5)):
        got = collocations.collocations(df, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        assert bag(tuple(r) for r in got) == bag(phrases(rows, least, top))
    assert len(phrases(rows, 4)) > 30


def test_collocations_of_nothing_and_all(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    rows = texts(4, 30)
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), 3, None).count()
    assert got == len(phrases(rows, 3, 10**9))
    with pytest.raises(ValueError):
        collocations.phrase_counts(spark.createDataFrame([], "text string, lang string"), 300)


def test_first_of_a_lang_with_ties(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LANES", 4)
    rows = [("en", f"p{i:04d}", 40 + i % 3, 1, 1, 1_000_000 if i % 2 else 10 * i) for i in range(3000)] + [("fr", "p", 30, 1, 1, 0)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, score long")
    got = sorted((r.lang, r.phrase) for r in collocations.strongest(df, 100).collect())
    want = sorted(rows[:-1], key=lambda r: (-r[5], -r[2], r[1]))[:100]
    assert got == sorted([(r[0], r[1]) for r in want] + [("fr", "p")])


def test_intervals_are_the_ngrams():
    rng = np.random.default_rng(0)
    shard = collocations.Shard()
    for i in range(40):
        shard.add("en" if i % 3 else "fr", (" ".join(rng.choice(list("abc"), 30)) + "\n" + " ".join(rng.choice(list("ab"), 5))).encode())
    langs, words, packed = shard.pack()
    grams = collocations.Grams({"langs": langs, "words": words, "packed": packed})
    text = grams.text.tolist()
    for k in range(1, 5):
        want = collections.Counter(tuple(text[i : i + k]) for i in range(len(text) - k + 1) if 0 not in text[i : i + k])
        got = {tuple(text[a : a + k]): t for a, t in zip(grams.at[k].tolist(), grams.times[k].tolist())}
        assert got == dict(want)


# --- BPE --------------------------------------------------------------------------------------------------------------------------


def odd_texts(n=1500):
    rng = random.Random(7)
    alphabet = [chr(rng.randrange(0x20, 0x3000)) for _ in range(200)] + list("abc  \n\t'12ééé-----====\x1c\x85\xa0​") * 15 + ["<|endoftext|>", "'ll", "🎉", "́", "\U0003d001", "࢏", "\0"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(150))) for _ in range(n)]
    return made + ["x" * 5000, "-" * 3000, " " * 999 + "a", "ab" * 2000, "<|endoftext|><|endoftext|>", "<|endoftext", "\U0001f600" * 300]


def test_encoder_agrees_with_the_library(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    vocabulary = bpe.read_vocabulary(TOKENIZER)
    texts = odd_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = bpe.Encoder(vocabulary)
    assert [e.tolist() for e in encoder.encode(texts)] == want
    assert encoder.last[0] == -1 and len(encoder.last) - 1 == len(encoder.child)  # one token a node
    monkeypatch.setattr(bpe, "TRIE_NODES", 50)
    monkeypatch.setattr(bpe, "WORDS_KEPT", 100)
    monkeypatch.setattr(bpe, "LONG_WORD", 3)
    small = bpe.Encoder(vocabulary)
    assert [i.tolist() for t in texts[:200] for i in small.encode([t])] == want[:200]
    slow = bpe.Encoder(vocabulary)
    slow.made = None  # as of a vocabulary in which two merges make one token
    assert [i.tolist() for i in slow.encode(texts[:100])] == want[:100]


def test_every_pair_check_is_what_the_merges_give():
    encoder = bpe.Encoder(bpe.read_vocabulary(TOKENIZER))
    rng = random.Random(3)
    for _ in range(3000):
        a, b = rng.randrange(50256), rng.randrange(50256) if rng.random() < 0.5 else rng.randrange(400)
        assert encoder.may_follow(a, b) == (encoder.merged(encoder.tokens[a] + encoder.tokens[b]) == [a, b]), (a, b)


def test_classes_of_characters():
    import regex
    from tokenizers import Tokenizer

    cut, pattern = Tokenizer.from_file(TOKENIZER).pre_tokenizer, regex.compile(bpe.PATTERN, regex.V1)
    for code in [*range(0x3000), *range(0x10900, 0x11000), *range(0x1D000, 0x1F000), 0x33479, 0x3D000, 0x10FFFF]:
        if not 0xD800 <= code < 0xE000:
            text = f"a{chr(code)}1 {chr(code)}!{chr(code)}!"
            assert [s for _, s in cut.pre_tokenize_str(text)] == [m.span() for m in pattern.finditer(text)], hex(code)


def test_bpe(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3).withColumns({k: F.lit(v) for k, v in EXTRA.items()}).withColumns({"ids": F.lit("x"), "decoded": F.lit("y")})
    got = bpe.round_trip(docs, TOKENIZER, column="n").select("doc_id", "n.*", "key").drop("key").collect()
    there = bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER, column="decoded")
    assert bag((r.text or "", r.n) for r in there.selectExpr("text", "size(ids) AS n").collect()) == bag((r.decoded, r.n) for r in there.selectExpr("decoded", "size(ids) AS n").collect())
    want = []
    for i, t, *_ in corpus():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert bag(tuple(r) for r in got) == bag(want)
    assert bpe.round_trip(docs.where("false"), TOKENIZER).count() == 0
    odd = spark.createDataFrame([(1, [50256, 99, 99999, -1]), (2, None), (3, []), (4, [128, 0])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode(odd, TOKENIZER).orderBy("doc_id").collect()] == ["<|endoftext|>" + library.decode([99]), "", "", library.decode([128, 0])]
    with pytest.raises(ValueError):
        bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
