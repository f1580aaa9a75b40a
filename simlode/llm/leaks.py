"""Evaluation texts that stand, whole or in part, in documents.

A document holds an item if a contiguous stretch of at least a third of the
item's words occurs in it with at most one word in eight of the stretch
differing (another word, one word more or one word less). Words are runs of
letters and digits, compared without case.

Method: template windows. Items are read for slots: numbers, names (words with
a capital inside a sentence) and units (words right after a number). Every word
of items and documents is replaced by its type if it can fill a slot (a word of
a document that no item has is a number, a name if it has a capital, or no
template word), and windows of such template words are hashed; a window of slots
alone is hashed by its words. Equal windows bring an item and a place of a
document together, whatever stands in the slots. Then the slots are checked:

* the words at both places are compared, slots included: a copy (``COPY``);
* where too many differ for that, but templates agree over a stretch of the same
  length: if each filling of a slot is replaced by one and the same word
  throughout the last such stretch, the document holds the item with other values (``OTHER_VALUES``);
  if not, it only shares the pattern.

:func:`leaks` gives copies, :func:`reparameterised` the second kind.

Windows that very many places of items share are left out of an item if so few
of its places have them that each case needs another one too; what remains is
paired in slices, so a stock opening costs no memory.

The window is as long as every case guarantees: a stretch of L words with L // 8
changes has an unchanged run of at least ceil((L - L // 8) / (L // 8 + 1)) words,
so no case is lost by it.

Documents are scanned once, whole, and nothing of them is shuffled. The items'
index is broadcast in slices of at most ``SLICE_WORDS`` item words; items beyond
that bound cost another scan each, not more memory.

Defined cases: null, empty and wordless texts or items give nothing; repeated
documents each give their own rows; an item id occurring twice gives each
document once; extra columns are not read.
"""

from __future__ import annotations

import difflib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
SHARE, DIFFER = 3, 8  # a third of the item; one word in eight
SLICE_WORDS = 1 << 21
SLICE_CHARS = 1 << 21
MEMO_WORDS = 1 << 19
NUMBER, NAME, UNIT = 1, 2, 3  # template words; 0 is a word that no item has
COPY, OTHER_VALUES = 0, 1
#: Places of items that share a window beyond which it is common; pairs of places looked at at once.
COMMON, SLICE_PAIRS = 64, 1 << 21

_BASE = 0x9E3779B97F4A7C15 | 1


def least_words(n: int) -> int:
    """Words of an item of ``n`` words that make a case."""
    return -(-n // SHARE)


def sure_run(least: int) -> int:
    """The longest unchanged run that every stretch of at least ``least`` words has."""
    return min(-(-(n - n // DIFFER) // (n // DIFFER + 1)) for n in range(least, least + 8 * DIFFER))


def sure_windows(least: int, width: int) -> int:
    """The fewest unchanged windows of such a stretch."""
    return max(1, min(n - width + 1 - width * (n // DIFFER) for n in range(least, least + 8 * DIFFER)))


def slots(text: str) -> tuple[set[str], set[str]]:
    """The words of an item that stand as names and as units, in lower case."""
    names, units, last, before = set(), set(), 0, ""
    for m in WORD.finditer(text):
        word, gap = m.group(), text[last : m.start()]
        if word[0].isupper() and before and not re.search(r"[.?!:\n\"']", gap):
            names.add(word.lower())
        if before.isdecimal() and gap.isspace() and word.isalpha():
            units.add(word.lower())
        last, before = m.end(), word
    return names, units


class Vocabulary(dict):
    """Numbers of item words, whatever their case; of other words the type by which they can fill a slot, or 0."""

    def __init__(self, words: list[str]):
        super().__init__()
        self.own = {w: i for i, w in enumerate(words, 4)}

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        kind = self.own.get(word.lower())
        if kind is None:
            kind = NUMBER if word.isdecimal() else NAME if word[0].isupper() else 0
        self[word] = kind
        return kind


def _hashed(x: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    h = np.zeros(len(place), np.uint64)
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
        for k in range(width):
            h = h * np.uint64(_BASE) + x[place + k]
    return h


def window_hashes(template: np.ndarray, ids: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows at ``place``: of template words, or of words where all are slots."""
    h = _hashed(template, place, width)
    plain = np.concatenate([[0], np.cumsum(template > UNIT)])
    slots_only = plain[place + width] == plain[place]
    h[slots_only] = _hashed(ids, place[slots_only], width) ^ np.uint64(_BASE)
    return h


class Index:
    """Template windows of a slice of items."""

    def __init__(self, items: list[tuple[int, str]]):
        names, units = set(), set()
        words = []
        for _, text in items:
            a, b = slots(text)
            names |= a
            units |= b
            words.append([w.lower() for w in WORD.findall(text)])
        keep = [k for k, w in enumerate(words) if w]
        self.ids = np.array([items[k][0] for k in keep], np.int64)
        words = [words[k] for k in keep]
        self.vocabulary = Vocabulary(sorted(set(itertools.chain.from_iterable(words))))
        kinds = [NUMBER if w.isdecimal() else NAME if w in names else UNIT if w in units else i for w, i in self.vocabulary.own.items()]
        self.template = np.array([0, NUMBER, NAME, UNIT, *kinds], np.int64)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.least = np.array([least_words(len(w)) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = np.array([self.vocabulary[x] for w in words for x in w], np.int64)
        widths = np.array([sure_run(int(x)) for x in self.least], np.int64)
        enough = np.array([sure_windows(int(x), int(w)) for x, w in zip(self.least, widths)], np.int64)
        self.widths = {}
        for width in sorted(set(widths.tolist())):
            h, item, at = [], [], []
            for k in np.flatnonzero(widths == width):
                own = self.words[self.starts[k] : self.starts[k] + self.sizes[k]]
                h.append(window_hashes(self.template[own], own, np.arange(len(own) - width + 1), width))
                item.append(np.full(len(h[-1]), k))
                at.append(np.arange(len(h[-1])))
            h, item, at = map(np.concatenate, (h, item, at))
            _, which, shared = np.unique(h, return_inverse=True, return_counts=True)
            common = shared[which] > COMMON
            few = np.bincount(item[common], minlength=len(self.ids)) < enough
            out = common & few[item]
            enough[item[out]] = 1
            h, item, at = h[~out], item[~out], at[~out]
            order = np.argsort(h, kind="stable")
            keys, first, count = np.unique(h[order], return_index=True, return_counts=True)
            self.widths[width] = keys, first, count, item[order], at[order]
        self.enough = enough  # windows by which a pair can be a case; where common ones are left out, one

    def scan(self, texts: list[str | None], kind: int = COPY) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``texts`` and item ids of the cases of one kind."""
        if not len(self.ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        parts, doc_starts, total = [], [], 0
        for t in texts:
            found = WORD.findall(t) if t else []
            doc_starts.append(total)
            parts.append(np.fromiter(map(self.vocabulary.__getitem__, found), np.int64, len(found)))
            parts.append(np.zeros(1, np.int64))  # no window reaches over it
            total += len(found) + 1
        doc_starts = np.array(doc_starts)
        ids = np.concatenate(parts)
        template = self.template[ids]
        out_doc, out_item = [], []
        for width, (keys, first, count, item, at) in self.widths.items():
            if len(ids) < width:
                continue
            void = np.concatenate([[0], np.cumsum(template == 0)])
            place = np.flatnonzero(void[width:] == void[:-width])
            h = window_hashes(template, ids, place, width)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            place, k = place[hit], k[hit]
            if not len(place):
                continue
            # Each hit window against each place of the items that has it, as document, item and diagonal.
            n = count[k]
            codes = [np.empty((3, 0), np.int64)]
            for some in np.split(np.arange(len(k)), np.flatnonzero(np.diff(np.cumsum(n) // SLICE_PAIRS)) + 1):
                m = n[some]
                which = np.repeat(first[k[some]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                doc_at = np.repeat(place[some], m)
                codes.append(np.unique(np.stack([np.searchsorted(doc_starts, doc_at, side="right") - 1, item[which], doc_at - at[which]]), axis=1))
            code = np.unique(np.concatenate(codes, axis=1), axis=1)
            d, i = self._copies(ids, doc_starts, total, code, width)
            if kind == OTHER_VALUES:
                pair = code[0] * len(self.ids) + code[1]
                d, i = self._other_values(ids, doc_starts, total, code[:, ~np.isin(pair, d * len(self.ids) + i)], texts)
            out_doc.append(d)
            out_item.append(i)
        if not out_doc:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(out_doc), self.ids[np.concatenate(out_item)]]), axis=1)
        return pairs[0], pairs[1]

    def _copies(self, ids, doc_starts, total, code, width):
        """Copies among (document, item, diagonal): by word along each diagonal, then across diagonals."""
        ends = np.append(doc_starts[1:] - 1, total - 1)
        good = np.zeros(code.shape[1], bool)
        same = np.zeros(code.shape[1], np.int64)
        for block in range(0, code.shape[1], 4096):
            d, i, s = code[:, block : block + 4096]
            longest = int(self.sizes[i].max())
            col = np.arange(longest)[None, :]
            inside = (col < self.sizes[i][:, None]) & (s[:, None] + col >= doc_starts[d][:, None]) & (s[:, None] + col < ends[d][:, None])
            a = self.words[np.minimum(self.starts[i][:, None] + col, len(self.words) - 1)]
            b = ids[np.clip(s[:, None] + col, 0, len(ids) - 1)]
            equal = inside & (a == b)
            good[block : block + 4096] = self._stretch(equal, inside, self.least[i])
            # Unchanged windows, by which a case with words left out or put in is known.
            runs = np.concatenate([np.zeros((len(d), 1), np.int64), np.cumsum(equal, axis=1)], axis=1)
            if longest >= width:
                same[block : block + 4096] = (runs[:, width:] - runs[:, :-width] == width).sum(1)
        doc_ok, item_ok = code[0][good], code[1][good]
        pair = code[0] * len(self.ids) + code[1]
        open_ = ~np.isin(pair, pair[good]) & (same > 0)
        more_doc, more_item = [], []
        keys, inverse = np.unique(pair[open_], return_inverse=True)
        if len(keys):
            windows = np.bincount(inverse, weights=same[open_])
            low = np.full(len(keys), np.iinfo(np.int64).max)
            high = np.zeros(len(keys), np.int64)
            np.minimum.at(low, inverse, code[2][open_])
            np.maximum.at(high, inverse, code[2][open_])
            # The diagonals of each pair, also of one: near the end of a stretch the other may be too short for a window.
            order = np.argsort(inverse, kind="stable")
            shifts, edges = code[2][open_][order], np.searchsorted(inverse[order], np.arange(len(keys) + 1))
            for k in range(len(keys)):
                d, i = divmod(int(keys[k]), len(self.ids))
                if windows[k] < self.enough[i]:
                    continue
                own = self.words[self.starts[i] : self.starts[i] + self.sizes[i]]
                reach = max(1, len(own) // DIFFER)
                lo, hi = max(int(doc_starts[d]), int(low[k]) - reach), min(int(ends[d]), int(high[k]) + len(own) + reach)
                if self._aligned(own, ids[lo:hi], int(self.least[i]), shifts[edges[k] : edges[k + 1]] - lo):
                    more_doc.append(d)
                    more_item.append(i)
        return np.concatenate([doc_ok, np.array(more_doc, np.int64)]), np.concatenate([item_ok, np.array(more_item, np.int64)])

    def _other_values(self, ids, doc_starts, total, code, texts):
        """Items with other values in their slots: templates agree along a diagonal, and each filling has one replacement."""
        ends = np.append(doc_starts[1:] - 1, total - 1)
        words: dict[int, list[str]] = {}
        out = []
        for d, i, shift in code.T.tolist():
            own = self.words[self.starts[i] : self.starts[i] + self.sizes[i]]
            col = np.arange(max(0, int(doc_starts[d]) - shift), min(len(own), int(ends[d]) - shift))
            a, b, least = own[col], ids[col + shift], int(self.least[i])
            kind = self.template[a]
            alike = kind == self.template[b]
            if len(col) < least or not self._stretch(alike[None, :], np.ones((1, len(col)), bool), np.array([least]))[0]:
                continue
            total_ = np.concatenate([[0], np.cumsum(np.where(alike, -1, DIFFER - 1))])
            highest = np.maximum.accumulate(total_)
            stop = least + int(np.flatnonzero(total_[least:] <= highest[: len(total_) - least])[-1])
            some = np.arange(int(np.argmax(total_[: stop - least + 1])), stop)
            some = some[alike[some] & (kind[some] <= UNIT)]
            if d not in words:
                words[d] = [w.lower() for w in WORD.findall(texts[d])]
            at = (col + shift - doc_starts[d])[some]
            filled: dict[int, set[str]] = {}
            for x, y in zip(a[some].tolist(), at.tolist()):
                filled.setdefault(x, set()).add(words[d][y])
            names = {i: w for w, i in self.vocabulary.own.items() if i in filled}
            if all(len(x) == 1 for x in filled.values()) and any(names[x] not in y for x, y in filled.items()):
                out.append((d, i))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    @staticmethod
    def _stretch(equal: np.ndarray, inside: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether a row has a stretch of ``least`` inside columns with one in eight unequal at most."""
        n = equal.shape[1]
        cost = np.where(equal, -1, np.where(inside, DIFFER - 1, 1 << 20))
        total = np.concatenate([np.zeros((len(equal), 1), np.int64), np.cumsum(cost, axis=1)], axis=1)
        highest = np.maximum.accumulate(total, axis=1)
        start = np.arange(n + 1)[None, :] - least[:, None]
        return ((start >= 0) & (total <= np.take_along_axis(highest, np.maximum(start, 0), axis=1))).any(1)

    @staticmethod
    def _aligned(item: np.ndarray, doc: np.ndarray, least: int, shifts: np.ndarray) -> bool:
        """The same with words left out or put in, along each chain of near diagonals and as far beside it as the text can shift."""
        shifts = np.unique(shifts)
        reach = max(1, len(item) // DIFFER)
        for group, beside in itertools.product(np.split(shifts, np.flatnonzero(np.diff(shifts) > reach) + 1), (0, reach)):
            lo, hi = max(0, int(group[0]) - beside), max(0, int(group[-1]) + len(item) + beside)
            a, b = item.tolist(), doc[lo:hi].tolist()
            step = np.full(len(a), DIFFER - 1, np.int64)
            ai = bi = -1
            for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
                if not m.size:
                    continue
                step[m.a : m.a + m.size] = -1
                if ai >= 0:  # words put in count where the text goes on
                    step[m.a] += DIFFER * max(0, (m.b - bi) - (m.a - ai))
                ai, bi = m.a + m.size, m.b + m.size
            total = np.concatenate([[0], np.cumsum(step)])
            highest = np.maximum.accumulate(total)
            if len(a) >= least and (total[least:] <= highest[: len(total) - least]).any():
                return True
        # The blocks above are not always the best alignment; where the words beside the diagonals could suffice, the edit distance decides.
        if len(item) < least:
            return False
        for group in np.split(shifts, np.flatnonzero(np.diff(shifts) > reach) + 1):
            at = np.arange(len(item))[:, None] + np.arange(int(group[0]) - reach, int(group[-1]) + reach + 1)[None, :]
            near = ((at >= 0) & (at < len(doc)) & (doc[np.clip(at, 0, len(doc) - 1)] == item[:, None])).any(1)
            if Index._stretch(near[None, :], np.ones((1, len(item)), bool), np.array([least]))[0]:
                lo, hi = max(0, int(group[0]) - reach), max(0, int(group[-1]) + len(item) + reach)
                if Index._within(item, doc[lo:hi], least):
                    return True
        return False

    @staticmethod
    def _within(item: np.ndarray, doc: np.ndarray, least: int) -> bool:
        """Whether a stretch of the item of ``least`` words is within its edits of a part of ``doc``: the edit distances of all starts at once, word by word."""
        n, step = len(item), np.arange(len(doc) + 1, dtype=np.int32)
        starts = np.arange(n)
        far = np.zeros((len(starts), len(doc) + 1), np.int32)
        for e in range(n):
            k = e + 1
            old, differs = far[:k], doc != item[e]
            new = old + 1
            np.minimum(new[:, 1:], old[:, :-1] + differs, out=new[:, 1:])
            far[:k] = np.minimum.accumulate(new - step, axis=1) + step
            words = e - starts[:k] + 1
            if ((words >= least) & (far[:k].min(1) * DIFFER <= words)).any():
                return True
        return False


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """``doc, item``: each document with each item of which it holds a copy."""
    return _scanned(documents, items, doc, item, text, COPY)


def reparameterised(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """``doc, item``: each document with each item that it holds with other values, and not as a copy."""
    return _scanned(documents, items, doc, item, text, OTHER_VALUES)


def _scanned(documents: DataFrame, items: DataFrame, doc: str, item: str, text: str, kind: int) -> DataFrame:
    spark = documents.sparkSession
    source = documents.select(F.col(f"`{doc}`").cast("long").alias("d"), F.col(f"`{text}`").cast("string").alias("t")).where("t IS NOT NULL AND d IS NOT NULL")
    every = items.select(F.col(f"`{item}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).where("t IS NOT NULL AND i IS NOT NULL")

    def scanned(part: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)
        held: list[Index] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not held:
                held.append(Index(shared.value))
            for batch in batches:
                d, texts = batch.column("d").to_numpy(zero_copy_only=False), batch.column("t")
                at = 0
                while at < len(texts):
                    stop, chars = at, 0
                    some = []
                    while stop < len(texts) and (not some or chars < SLICE_CHARS):
                        some.append(texts[stop].as_py())
                        chars += len(some[-1])
                        stop += 1
                    k, i = held[0].scan(some, kind)
                    yield pa.RecordBatch.from_arrays([pa.array(d[at:stop][k]), pa.array(i)], names=["d", "i"])
                    at = stop

        return source.mapInArrow(run, "d long, i long")

    out, part, words = None, [], 0
    for row in every.orderBy("i").toLocalIterator():  # items, a slice at a time
        part.append((row.i, row.t))
        words += len(row.t) // 2 + 1
        if words >= SLICE_WORDS:
            more = scanned(part)
            out, part, words = (out.unionByName(more) if out is not None else more), [], 0
    if part or out is None:
        more = scanned(part)
        out = out.unionByName(more) if out is not None else more
    return out.toDF(doc, item)
