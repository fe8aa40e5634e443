"""Byte-level BPE encoding and decoding by a trie whose words share the work of their prefixes.

The encoding of a prefix of a word is fixed by its last token: what is before it is the encoding of a shorter prefix. A token may follow
another if the merges, run on the bytes of both, give back just these two; a sequence is an encoding if all its neighbours may
follow each other. Exactly one token can end each prefix, so a node of the trie holds that token and nothing else.

Distinct words of a task go into the trie in order, and a node that is new gets its token from the nodes above it, depth first; what two
words begin with alike is looked at once. Words after that are numbers, whose token ids are gathered from one array. A trie of
TRIE_NODES nodes is given up for a new one, as are the numbers of WORDS_KEPT words, so memory is bounded; a word over LONG_WORD bytes is walked without being stored.

The vocabulary is a file of the tokenizers library (byte-level BPE, added tokens that strip nothing), read on the driver and
broadcast: it does not grow with the data. Texts are encoded whole, task by task, without a shuffle; round_trip does both ways in one
pass of Python, so that a task has one worker and no ids travel.

Defined cases: null or empty text has no ids; null ids decode to the empty text; ids that no token has are left out in decoding, bytes that
are no UTF-8 become U+FFFD; added tokens in a text are taken as such, as the library does; a column of the result's name
is replaced and all others pass through; rows may repeat.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes of a trie before it is given up, words whose ids are kept (and ids in all, four a word), bytes of a word that is not stored, characters
#: of texts encoded together.
TRIE_NODES, WORDS_KEPT, LONG_WORD, GROUP_CHARS = 1 << 18, 1 << 20, 256, 4 << 20
# Letters and numbers of Unicode 17 (code points, ranges in hexadecimal), which the tokenizers library, at Unicode 16, does not
# know as such; and how its byte-level pre-tokenizer cuts a text. White space is what Unicode calls so.
NOT_YET = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9
11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168
1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD
323B0-33479 3D000-3FC3F
"""
_NEW = "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in NOT_YET.split())
_L, _N = rf"[\p{{L}}--[{_NEW}]]", rf"[\p{{N}}--[{_NEW}]]"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{_NEW}]]+|\p{{White_Space}}+(?!\P{{White_Space}})|\p{{White_Space}}+"


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: itself where it is printable Latin-1, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> dict:
    """tokens (bytes by id), merges (left id, right id, merged id, by rank) and added tokens (text by id) of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, added = data["model"], data.get("added_tokens") or []
    if model.get("type") != "BPE" or (data.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or data["pre_tokenizer"].get("add_prefix_space") or data.get("normalizer") or model.get("ignore_merges"):
        raise ValueError(f"{path}: only byte-level BPE without a normalizer, a prefix space or ignored merges")
    if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError(f"{path}: added tokens must be taken as they are")
    to_byte = byte_characters()
    ids = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    tokens: dict[int, bytes] = {i: bytes(to_byte[c] for c in t) for t, i in ids.items()}
    return {
        "tokens": [tokens.get(i, b"") for i in range(max(tokens) + 1)],
        "merges": [(ids[a], ids[b], ids[a + b]) for a, b in pairs],
        "added": {t["id"]: t["content"] for t in added},
    }


class _Numbers(dict):
    """Numbers of words in the order in which they are met; new holds those met since it was emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    def __init__(self, vocabulary: dict) -> None:
        self.tokens: list[bytes] = vocabulary["tokens"]
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        self.merges = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(vocabulary["merges"])}
        # of each token the merge that makes it, if there is one merge to a token
        self.made = {c: (rank, a, b) for (a, b), (rank, c) in self.merges.items()}
        self.made = self.made if len(self.made) == len(self.merges) else None
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.added = {text: i for i, text in vocabulary["added"].items()}
        self.cut_added = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.words = regex.compile(PATTERN, regex.V1)
        self.longest: dict[bytes, int] = {}  # the longest token by its last three bytes
        for t in self.ids:
            if len(t) > 2:
                self.longest[t[-3:]] = max(self.longest.get(t[-3:], 3), len(t))
        self.forget_trie()
        self.forget_words()

    def forget_trie(self) -> None:
        self.child: dict[int, int] = {}
        self.last: list[int] = [-1]  # the token that ends at each node
        self.follows: dict[tuple[int, int], bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})

    def forget_words(self) -> None:
        self.number = _Numbers()
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def merged(self, data: bytes) -> list[int]:
        """Token ids of a few bytes by the merges themselves: always the first of lowest rank."""
        out = [self.single[b] for b in data]
        while len(out) > 1:
            best = min(((*self.merges[p], i) for i, p in enumerate(zip(out, out[1:])) if p in self.merges), key=lambda m: (m[0], m[2]), default=None)
            if best is None:
                break
            out[best[2] : best[2] + 2] = [best[1]]
        return out

    def _spine(self, token: int, right: bool) -> list[tuple[int, int, float]]:
        """What stands at the right (or left) end of a token while the merges make it: (piece, rank that makes it, rank that takes it)."""
        known = self.spines[right].get(token)
        if known is None:
            down = [token]
            while down[-1] in self.made:
                down.append(self.made[down[-1]][2 if right else 1])
            born = [self.made[t][0] if t in self.made else -1 for t in down] + [float("inf")]
            known = self.spines[right][token] = [(t, born[i], born[i - 1]) for i, t in reversed(list(enumerate(down)))]
        return known

    def may_follow(self, before: int, token: int) -> bool:
        """Whether token may come after before (-1: at a word's start): whether no merge joins the piece at the end of the one with the piece at
        the start of the other while both are there. Of merges of one rank the left one comes first."""
        known = self.follows.get((before, token))
        if known is not None:
            return known
        if before < 0:
            known = self.merged(self.tokens[token]) == [token]
        elif not self.may_follow(-1, token):
            known = False
        elif self.made is None:
            known = self.merged(self.tokens[before] + self.tokens[token]) == [before, token]
        else:
            left, right = self._spine(before, True), self._spine(token, False)
            i = j = 0
            known = True
            while i < len(left) and j < len(right):
                (x, made_x, taken_x), (y, made_y, taken_y) = left[i], right[j]
                rank = self.merges.get((x, y), (-2, 0))[0]
                if made_x <= rank < taken_x and made_y <= rank <= taken_y:
                    known = False
                    break
                if taken_x <= taken_y:
                    i += 1
                else:
                    j += 1
        self.follows[before, token] = known
        return known

    def insert(self, word: bytes) -> list[int]:
        """Adds a word to the trie; its token ids. last holds the tokens that end its prefixes, as its path through the trie does."""
        last: list[int] = [-1]
        child, ids, follows, stored = self.child, self.ids, self.follows, len(word) <= LONG_WORD
        node = 0
        for depth, byte in enumerate(word, 1):
            if stored:
                edge = node << 8 | byte
                node = child.get(edge)
                if node is not None:
                    last.append(self.last[node])
                    continue
            longest = min(depth, self.longest.get(word[depth - 3 : depth], 2)) if depth > 2 else depth
            for n in range(longest, 0, -1):
                token = ids.get(word[depth - n : depth])
                if token is not None:
                    pair = (last[depth - n], token)
                    if follows[pair] if pair in follows else self.may_follow(*pair):
                        break
            else:
                raise ValueError("the vocabulary's merges do not make its tokens")
            last.append(token)
            if stored:
                node = child[edge] = len(self.last)
                self.last.append(token)
        out, depth = [], len(word)
        while depth:
            out.append(last[depth])
            depth -= len(self.tokens[last[depth]])
        return out[::-1]

    def _learn(self, new: list[str]) -> None:
        """Gives the new words, numbered in this order, their ids. They enter the trie in the order of their bytes, so that a branch is finished
        before the next begins."""
        data = [w.encode("utf-8", "surrogatepass") for w in new]
        found: list[list[int]] = [[]] * len(new)
        for i in sorted(range(len(new)), key=data.__getitem__):
            found[i] = [self.added[new[i]]] if new[i] in self.added else self.insert(data[i])
        size = np.array([len(f) for f in found], dtype=np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.array([i for f in found for i in f], dtype=np.int32)])

    def _words(self, text: str) -> list[str]:
        if self.cut_added is None or not self.cut_added.search(text):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.cut_added.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words.findall(text[at:])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.last) > TRIE_NODES:
            self.forget_trie()
        if len(self.number) > WORDS_KEPT or len(self.flat) > 4 * WORDS_KEPT:
            self.forget_words()
        rows = []
        for text in texts:
            words = self._words(text)
            rows.append(np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words)))
        if self.number.new:
            self._learn(self.number.new)
            self.number.new = []
        out = []
        for numbers in rows:
            size = self.size[numbers]
            ends = np.cumsum(size)
            out.append(self.flat[np.repeat(self.start[numbers] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)])
        return out


_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(vocabulary: dict) -> Encoder:
    """One for each vocabulary in a worker, whose next task finds the trie of the last one."""
    key = hashlib.blake2b(b"\0".join(vocabulary["tokens"]) + repr(vocabulary["added"]).encode()).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def _groups(texts: pd.Series) -> Iterator[list[str]]:
    out, size = [], 0
    for t in texts:
        out.append(t or "")
        size += len(out[-1])
        if size >= GROUP_CHARS:
            yield out
            out, size = [], 0
    if out:
        yield out


def encode(docs: DataFrame, tokenizer: str, text: str = "text", column: str = "ids") -> DataFrame:
    """docs with a column (array of int; one of that name is replaced) of the token ids of each whole text. tokenizer: path of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer))

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared.value)
        for batch in batches:
            yield pd.Series([i for group in _groups(batch) for i in encoder.encode(group)], dtype=object)

    return docs.withColumn(column, ids(F.coalesce(F.col(text).cast("string"), F.lit(""))))


class Decoder:
    def __init__(self, vocabulary: dict) -> None:
        self.tokens = list(vocabulary["tokens"])
        for i, text in vocabulary["added"].items():
            self.tokens += [b""] * (i + 1 - len(self.tokens))
            self.tokens[i] = text.encode()

    def text(self, ids: np.ndarray | None) -> str:
        if ids is None or not len(ids):
            return ""
        known = ids if ids.min() >= 0 and ids.max() < len(self.tokens) else ids[(ids >= 0) & (ids < len(self.tokens))]
        return b"".join(map(self.tokens.__getitem__, known.tolist())).decode("utf-8", "replace")


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", column: str = "text") -> DataFrame:
    """encoded with a column (one of that name is replaced) of the text that each array of ids stands for."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(shared.value)
        for batch in batches:
            yield pd.Series([decoder.text(row) for row in batch], dtype=object)

    return encoded.withColumn(column, text(F.col(ids)))


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", column: str = "tokens") -> DataFrame:
    """docs with a struct column (one of that name is replaced) of what encoding each whole text and decoding its ids again give: n_tokens, ids_sha256 (of the ids
    as little-endian unsigned 32-bit integers) and decoded_sha256 (of the decoded text in UTF-8), both in lowercase hex."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer))
    digest = lambda data: hashlib.sha256(data).hexdigest()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, decoder = _encoder(shared.value), Decoder(shared.value)
        for batch in batches:
            rows = [(len(i), digest(i.astype("<u4").tobytes()), digest(decoder.text(i).encode())) for group in _groups(batch) for i in encoder.encode(group)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn(column, digests(F.coalesce(F.col(text).cast("string"), F.lit(""))))
