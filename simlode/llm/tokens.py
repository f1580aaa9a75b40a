"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Two tiers. Each text is split into pre-tokens by the vocabulary's pattern. A
pre-token that is itself in the vocabulary is resolved by a minimal perfect
hash over the vocabulary, looked up for all new pre-tokens of a slice at once.
The others are merged by a heap over their linked bytes, which is
O(n log n) in the length of the pre-token, so a minified line of a million
letters costs no more than the same amount of prose. What a worker has resolved
it remembers in a table of bounded size.

The vocabulary (some hundred kilobytes, checked against ``MAX_VOCAB_BYTES``) is
read on the driver and broadcast; the texts are scanned once and never shuffled.

Defined cases: null and empty texts give an empty list; unpaired surrogates
cannot occur in Spark strings; special tokens have no meaning in a text and are
encoded as what they spell; other columns are left alone, and the result column
may be named freely (an equally named one of the input is not read).
"""

from __future__ import annotations

import base64
import heapq
import itertools
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = os.environ.get("SIMLODE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"

# Fixed value: the split pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: the code points with the Unicode property White_Space.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

MAX_VOCAB_BYTES = 64 << 20
#: A worker forgets its resolved pre-tokens beyond so many of them or characters.
MEMO_ENTRIES, MEMO_CHARS = 1 << 19, 16 << 20
#: Characters handled at once, which bounds a worker's memory.
SLICE_CHARS = 1 << 20

_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """splitmix64 of the hashes, another one for each level."""
    with np.errstate(over="ignore"):
        z = h + _GOLDEN * np.uint64(level + 1)
        z = (z ^ (z >> np.uint64(30))) * _MIX1
        z = (z ^ (z >> np.uint64(27))) * _MIX2
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit hashes: n keys onto 0..n-1.

    Levels of bit arrays: a key takes the first level where no other key that
    is left falls on its bit; its number is the count of set bits before it.
    """

    def __init__(self, hashes: np.ndarray, spread: float = 2.0):
        left = np.asarray(hashes, np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("two keys share a hash")
        self.n = len(left)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        taken = 0
        while len(left):
            size = max(64, int(spread * len(left)))
            at = (_mixed(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            self.levels.append((bits, taken + np.cumsum(bits) - 1))
            taken += int(bits.sum())
            left = left[~bits[at]]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each key; for what is no key, -1 or any number."""
        out = np.full(len(hashes), -1, np.int64)
        rest = np.arange(len(hashes))
        for level, (bits, rank) in enumerate(self.levels):
            if not len(rest):
                break
            at = (_mixed(hashes[rest], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        return out


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: always the pair of lowest rank, the leftmost of equals."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    end = list(range(1, n + 1))  # where the part that begins at i ends; 0: no part begins at i
    before = list(range(-1, n))  # where the part before the one at i begins
    rank = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two parts has been merged since
        end[i], end[middle] = stop, 0
        before[stop] = i
        if stop < n and (r := rank(word[i : end[stop]])) is not None:
            heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := rank(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _class(kind: str) -> str:
    """A character class, without brackets, of the 16-bit code points of a general category."""
    found = [c for c in range(0x10000) if unicodedata.category(chr(c))[0] == kind]
    runs = []
    for _, g in itertools.groupby(enumerate(found), lambda x: x[1] - x[0]):
        run = [c for _, c in g]
        runs.append(f"\\u{run[0]:04x}-\\u{run[-1]:04x}")
    return "".join(runs)


class Splitter:
    """The pattern, compiled twice: quick for text of 16-bit code points, general for the rest."""

    def __init__(self, pattern: str = PATTERN):
        inside = pattern.replace(r"[^\s\p{L}\p{N}]", "[^{S}{L}{N}]").replace(r"\p{L}", "[{L}]").replace(r"\p{N}", "[{N}]").replace(r"\s", "[{S}]").replace(r"\S", "[^{S}]")
        parts = {"{L}": _class("L"), "{N}": _class("N"), "{S}": SPACES}
        self.narrow = re.compile(re.sub(r"\{[LNS]\}", lambda m: parts[m[0]], inside)).findall
        self.wide = regex.compile(pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")).findall
        self.astral = re.compile("[\U00010000-\U0010ffff]").search

    def __call__(self, text: str) -> list[str]:
        return self.narrow(text) if text.isascii() or not self.astral(text) else self.wide(text)


class Codes(dict):
    """Numbers of pre-tokens; an unknown one gets the next number and waits to be resolved."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes lists of texts into flat ids and the number of ids of each text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.split = ranks, Splitter(pattern)
        keys = list(ranks)
        hashes = _hashes(keys)
        self.find = PerfectHash(hashes)
        place = self.find(hashes)
        self.keys = [b""] * len(keys)
        self.ids = np.empty(len(keys), np.int32)
        for k, p in zip(keys, place):
            self.keys[p] = k
            self.ids[p] = ranks[k]
        self._forget()

    def _forget(self) -> None:
        self.codes, self.chars = Codes(), 0
        self.starts, self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _resolve(self) -> None:
        new = self.codes.new
        if not new:
            return
        words = [w.encode("utf-8") for w in new]
        place = self.find(_hashes(words)).tolist()
        ids: list[list[int] | None] = [[int(self.ids[p])] if p >= 0 and self.keys[p] == w else merge(w, self.ranks) for w, p in zip(words, place)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))])
        self.chars += sum(map(len, new))
        self.codes.new = []

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts, at = [], [], 0
        while at < len(texts):
            if len(self.codes) > MEMO_ENTRIES or self.chars > MEMO_CHARS:
                self._forget()
            chars, codes, words = 0, [], []
            while at < len(texts) and (not words or chars < SLICE_CHARS):
                pieces = self.split(texts[at]) if texts[at] else []
                codes.append(np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces)))
                words.append(len(pieces))
                chars += len(texts[at] or "")
                at += 1
            self._resolve()
            every = np.concatenate(codes)
            sizes = self.sizes[every]
            ends = np.cumsum(sizes)
            # Position k of the output lies in the word that holds it, k - (first position of the word) further on.
            shift = self.starts[every] - (ends - sizes)
            flat.append(self.flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))])
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])]
            counts.append(np.diff(bounds))
        return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.empty(0, np.int32), np.empty(0, np.int64))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its id."""
    if os.path.getsize(path) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_ENCODERS: dict[str, Encoder] = {}


def encode_corpus(df: DataFrame, keys: list[str], text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``keys`` of each row and the token ids of its text as ``array<int>``."""
    if ids in keys:
        raise ValueError(f"{ids} is a key column")
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    quoted = [F.col(f"`{c}`") for c in keys]
    source = df.select(*[c.alias(f"k{i}") for i, c in enumerate(quoted)], F.col(f"`{text}`").cast("string").alias("t"))
    fields = [T.StructField(f"k{i}", source.schema[i].dataType) for i in range(len(keys))]
    out = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    name = f"{vocabulary} {pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS[name] = Encoder(ranks.value, pattern)
        encoder = _ENCODERS[name]
        for batch in batches:
            column = batch.column("t")
            at = 0
            while at < len(column):  # parts of the batch, so that few ids are held at once
                size = min(1024, len(column) - at)
                flat, counts = encoder(column.slice(at, size).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, size) for i in range(len(keys))), lists], names=[*(f"k{i}" for i in range(len(keys))), "ids"])
                at += size

    result = source.mapInArrow(run, out)
    return result.toDF(*keys, ids)
