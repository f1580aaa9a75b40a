"""Subject areas of each document: none, one or several.

Complement naive Bayes over the words of names, strings and comments, refined by
expectation-maximization over the unlabelled documents, with one calibrated
posterior for each subject.

* Features are all words of the whole text (identifiers taken apart), hashed into
  ``BUCKETS`` numbers, so the model has one size whatever the corpus. A word of
  the leading comment block is another feature than the same word elsewhere: the
  model learns by itself that the wording of licence headers, which stand before
  code of every subject, speaks for none there.
* For each subject and word, the rate of documents that have the word is held
  against its rate in the complement, all other documents. Their quotient is the
  weight of the word for the subject; below ``RATIO`` it is no evidence.
* A document may deal with several subjects, so each word occurrence is shared
  among background (weight one) and the subjects, by these weights and by the
  document's mixture of subjects, until the mixture agrees with the shares. That
  is the E-step too; labels weigh in where there are some. M-step: the rates are
  counted again.
* The posterior of a subject is logistic in its share of the document's
  subject words and in their number, fitted on labelled documents: at most
  ``CALIBRATION_ROWS`` of them, taken by hash. Everything else uses all rows.

The words are counted once and kept in the shared folder with the labels beside
them; each round reads those counts and sends on one row a word and task.

Defined cases: null, blank and wordless texts have no subject; labels are
trimmed and lower-cased, unknown ones and those of unknown documents ignored,
repeated ones count once, contradicting ones share the document; without any
label no document has a subject; documents with equal ids each get their rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlode.session import settle

BUCKETS = 1 << 17
RATIO = 3.5
ROUNDS, INNER = 5, 5
#: Less than this share of a document's subject words is a passing mention, unless it is at least ``EVEN`` times that of the document's largest subject.
SUBSTANTIAL, EVEN = 0.15, 0.5
CALIBRATION_ROWS = 50_000
MAX_SUBJECTS = 256
NONE = "none"
SMOOTH, LEVEL, LEAST, LEAST_ODDS = 0.2, 0.05, 1.0, 0.5
SLICE_CHARS = 1 << 21
MEMO_WORDS = 1 << 19

LEAD = re.compile(r"\A﻿?(?:[ \t]*(?:#|//|--|/\*|\*|%|;|<!--)[^\n]*\n|[ \t]*\r?\n)++")
PART = re.compile(r"[A-Z]?[a-zß-öø-ÿ]{2,}|[A-ZÀ-Þ]{3,}(?![a-zß-öø-ÿ])|[^\W\d_a-zA-ZÀ-ÿ]{2,}")


class Buckets(dict):
    """Feature numbers of words, of the leading comment block (``lead``) or elsewhere."""

    def __init__(self, lead: bool = False):
        super().__init__()
        self.mark = b"\0" if lead else b""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        n = self[word] = xxhash.xxh3_64_intdigest(self.mark + word.lower().encode()) % BUCKETS
        return n


def lead_end(text: str) -> int:
    """Where the leading comment block ends; 0 if nothing else follows."""
    lead = LEAD.match(text)
    return lead.end() if lead and text[lead.end() :].strip() else 0


def word_counts(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """``d, words, counts``: the distinct words of each document, by bucket."""
    source = documents.select(F.col(f"`{doc}`").cast("long").alias("d"), F.col(f"`{text}`").cast("string").alias("t")).where("t IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, bodies = Buckets(True), Buckets()
        for batch in batches:
            d, texts, at = batch.column("d"), batch.column("t"), 0
            while at < len(texts):
                parts, sizes, chars = [], [], 0
                while at + len(sizes) < len(texts) and (not sizes or chars < SLICE_CHARS):
                    t = texts[at + len(sizes)].as_py()
                    end = lead_end(t)
                    words = [heads[w] for w in PART.findall(t[:end])] + [bodies[w] for w in PART.findall(t, end)]
                    parts.append(np.array(words, np.int64))
                    sizes.append(len(words))
                    chars += len(t)
                rows = np.repeat(np.arange(len(sizes)), sizes)
                key, count = np.unique(rows * BUCKETS + np.concatenate(parts), return_counts=True)
                offsets = pa.array(np.searchsorted(key, np.arange(len(sizes) + 1) * BUCKETS).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % BUCKETS, count)]
                yield pa.RecordBatch.from_arrays([d.slice(at, len(sizes)), *lists], names=["d", "words", "counts"])
                at += len(sizes)

    return source.mapInArrow(run, "d long, words array<int>, counts array<int>")


class Model:
    """Weights of words for each subject against its complement; background, the last class, has one throughout."""

    def __init__(self, names: list[str]):
        self.names, self.k = names, len(names)
        self.weights = np.zeros((self.k + 1, BUCKETS))
        self.topical = np.zeros(BUCKETS, bool)

    def __getstate__(self) -> tuple:
        """What is broadcast: weights of the words that speak for something."""
        used = np.flatnonzero(self.topical)
        return self.names, used.astype(np.int32), self.weights[:, used].astype(np.float32)

    def __setstate__(self, state: tuple) -> None:
        names, used, weights = state
        self.__init__(names)
        self.topical[used] = True
        self.weights[:, used] = weights

    def fit(self, docs: np.ndarray, docs_all: np.ndarray, frequency: np.ndarray) -> None:
        """docs: documents of each class with the word; docs_all: documents of each class."""
        total = docs.sum(0)
        rate = (docs + SMOOTH) / (docs_all[:, None] + 2 * SMOOTH)
        complement = (total - docs + SMOOTH) / (docs_all.sum() - docs_all[:, None] + 2 * SMOOTH)
        odds = rate / complement
        speaks = (odds[: self.k] >= RATIO) & (frequency >= 2)
        # Words of a passing mention: how rare the word is in documents without a subject says how little it is one.
        self.weights = np.concatenate([np.where(speaks, odds[: self.k], 0), np.clip(odds[self.k :], LEAST_ODDS, 1)])
        self.topical = speaks.any(0)

    def expect(self, offsets: np.ndarray, words: np.ndarray, counts: np.ndarray, weight: np.ndarray | None = None):
        """Of a batch of documents: each one's occurrences by class."""
        n = len(offsets) - 1
        keep = self.topical[words]
        rows = np.repeat(np.arange(n), np.diff(offsets))
        every = np.bincount(rows, weights=counts, minlength=n)
        rows, at, x = rows[keep], words[keep], counts[keep].astype(float)
        like = self.weights[:, at].T
        background = every - np.bincount(rows, weights=x, minlength=n)
        mixture = np.full((n, self.k + 1), 0.5 / self.k)
        mixture[:, self.k] = 0.5
        mass = np.zeros((n, self.k + 1))
        first = np.flatnonzero(np.diff(rows, prepend=-1)) if len(rows) else np.empty(0, np.int64)
        for _ in range(INNER):
            share = (mixture if weight is None else mixture * weight)[rows] * like
            share *= (x / np.maximum(share.sum(1), 1e-300))[:, None]
            mass = np.zeros((n, self.k + 1))
            if len(rows):
                mass[rows[first]] = np.add.reduceat(share, first, axis=0)
            mass[:, self.k] += background
            mixture = (mass + LEVEL) / (mass.sum(1, keepdims=True) + (self.k + 1) * LEVEL)
        return mass

    def subject_shares(self, mass: np.ndarray, least: float = 2.0) -> np.ndarray:
        """Each document's class mixture for counting: its subjects by share, or background."""
        out = np.zeros_like(mass)
        total = mass[:, : self.k].sum(1)
        ok = total >= least
        out[ok, : self.k] = mass[ok, : self.k] / total[ok, None]
        out[~ok, self.k] = 1
        return out


def features(mass: np.ndarray, k: int) -> np.ndarray:
    """Of each document and subject: logit of the share, logarithm of the occurrences."""
    own = mass[:, :k]
    share = own / np.maximum(own.sum(1, keepdims=True), 1e-9)
    return np.stack([np.log((share + 0.01) / (1.01 - share)), np.log1p(own)], axis=2)


class Calibration:
    """Logistic posteriors: common slopes, an intercept for each subject."""

    def __init__(self, k: int):
        self.slopes, self.cuts = np.array([2.0, 1.0]), np.full(k, 1.2)
        self.prior = np.concatenate([self.slopes, self.cuts])
        self.missing = self.wrong = 0.0

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.slopes + self.cuts, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, asked: np.ndarray, rounds: int = 25) -> None:
        """Fit to labels of which some are missing and some are wrong.

        Whether a subject truly holds is hidden; the rates of missing and of
        wrong labels are estimated with the curve, so that wrong labels in
        clear cases do not flatten it.
        """
        if not asked.any():
            return
        missing, wrong = 0.1, 0.03
        for _ in range(rounds):
            p = self.posterior(x)
            truth = np.where(y > 0, (1 - missing) * p / ((1 - missing) * p + wrong * (1 - p)), missing * p / (missing * p + (1 - wrong) * (1 - p)))
            self._fit(x, truth, asked, 5)
            t, q, z = truth[asked], (1 - truth)[asked], y[asked]
            missing = min(0.3, max(0.005, float((t * (1 - z)).sum() / max(t.sum(), 1e-9))))
            wrong = min(0.3, max(0.005, float((q * z).sum() / max(q.sum(), 1e-9))))
        self.missing, self.wrong = missing, wrong

    def _fit(self, x: np.ndarray, y: np.ndarray, asked: np.ndarray, rounds: int) -> None:
        """Newton steps with halving, on the pairs ``asked``.

        A weak prior holds the result near the defaults, so that few labels do
        no harm.
        """
        n, k = y.shape
        prior = self.prior
        keep = np.full(k + 2, 2.0)

        def loss(w: np.ndarray) -> float:
            z = x @ w[:2] + w[2:]
            return float((np.logaddexp(0, z) - y * z)[asked].sum() + (keep * (w - prior) ** 2).sum() / 2)

        w = np.concatenate([self.slopes, self.cuts])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w[:2] + w[2:], -30, 30)))
            e, v = np.where(asked, y - p, 0), np.where(asked, p * (1 - p), 0)
            grad = np.concatenate([np.einsum("nk,nkf->f", e, x), e.sum(0)]) - keep * (w - prior)
            h = np.zeros((k + 2, k + 2))
            h[:2, :2] = np.einsum("nk,nkf,nkg->fg", v, x, x)
            h[:2, 2:] = np.einsum("nk,nkf->fk", v, x)
            h[2:, :2] = h[:2, 2:].T
            h[2:, 2:] = np.diag(v.sum(0))
            step = np.linalg.solve(h + np.diag(keep), grad)
            while np.abs(step).max() > 1e-7 and loss(w + step) > loss(w):
                step = step / 2
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.slopes, self.cuts = w[:2], w[2:]


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, counts = batch.column("words"), batch.column("counts")
    offsets = words.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], words.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts.flatten().to_numpy(zero_copy_only=False)


def _labels(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """Which classes each document is labelled with, rows of zeros for unlabelled ones."""
    out = np.zeros((batch.num_rows, k + 1))
    column = batch.column("labels")
    sizes = np.diff(column.offsets.to_numpy()) * column.is_valid().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(batch.num_rows), sizes), column.flatten().to_numpy(zero_copy_only=False)] = 1
    return out


class SubjectClassifier:
    """Trained by :meth:`train`; then ``model`` and ``calibration`` classify any word counts."""

    def __init__(self, names: list[str]):
        self.names = sorted({n.strip().lower() for n in names if n and n.strip()} - {NONE})
        if len(self.names) > MAX_SUBJECTS:
            raise ValueError(f"more than {MAX_SUBJECTS} subjects")
        self.model, self.calibration = Model(self.names), Calibration(len(self.names))
        self.labelled = 0

    def label_lists(self, labels: DataFrame, doc: str, subject: str) -> DataFrame:
        """``d, labels``: the class numbers of each labelled document."""
        numbers = F.create_map(*[F.lit(x) for pair in zip([*self.names, NONE], range(len(self.names) + 1)) for x in pair])
        clean = labels.select(F.col(f"`{doc}`").cast("long").alias("d"), numbers[F.lower(F.trim(F.col(f"`{subject}`")))].alias("c"))
        return clean.where("d IS NOT NULL AND c IS NOT NULL").groupBy("d").agg(F.collect_set("c").alias("labels"))

    def _round(self, counted: DataFrame, first: bool):
        """Class counts of all documents: from labels alone, or by the model."""
        spark, k, model = counted.sparkSession, len(self.names), self.model
        shared = None if first else spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = model if first else shared.value
            docs = np.zeros((k + 1, BUCKETS))
            per_class, frequency, labelled = np.zeros(k + 1), np.zeros(BUCKETS), 0
            for batch in batches:
                offsets, at, x = _lists(batch)
                y = _labels(batch, k)
                has = y.any(1)
                labelled += int(has.sum())
                share = y / np.maximum(y.sum(1, keepdims=True), 1)
                if first:
                    frequency += np.bincount(at, minlength=BUCKETS)
                else:
                    weight = np.where(has[:, None], np.where(y > 0, 1.0, 0.2), 1.0)
                    weight[:, k] = 1.0
                    found = own.subject_shares(own.expect(offsets, at, x, weight))
                    share = np.where(has[:, None], (found + share) / 2, found)
                per_class += share.sum(0)
                rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                for c in np.flatnonzero(share.any(0)):
                    docs[c] += np.bincount(at, weights=share[rows, c], minlength=BUCKETS)
            used = np.flatnonzero(docs.any(0) | (frequency > 0))
            columns = [*docs[:, used], frequency[used]]
            # A last row, bucket -1, carries the sums over documents.
            last = [*per_class, float(labelled)]
            arrays = [pa.array(np.append(c, z)) for c, z in zip(columns, last)]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), *arrays], names=["b", *(f"v{i}" for i in range(len(arrays)))])

        wide = k + 2
        parts = counted.mapInArrow(run, "b int, " + ", ".join(f"v{i} double" for i in range(wide)))
        # At most BUCKETS + 1 rows, whatever the corpus.
        got = parts.groupBy("b").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(wide)]).toPandas()
        b, v = got["b"].to_numpy(), got[[f"v{i}" for i in range(wide)]].to_numpy()
        if shared is not None:
            shared.destroy()
        full = np.zeros((wide, BUCKETS))
        full[:, b[b >= 0]] = v[b >= 0].T
        sums = v[b < 0].sum(0) if (b < 0).any() else np.zeros(wide)
        return full[:-1], sums[:-1], full[-1], int(sums[-1])

    def train(self, counted: DataFrame) -> None:
        """``counted`` has ``d, words, counts, labels`` and is read ``ROUNDS + 2`` times."""
        docs, per_class, frequency, self.labelled = self._round(counted, True)
        if not self.labelled or not self.names:
            return
        self.model.fit(docs, per_class, frequency)
        for _ in range(ROUNDS):
            docs, per_class, _, _ = self._round(counted, False)
            self.model.fit(docs, per_class, frequency)
        self._calibrate(counted)

    def _calibrate(self, counted: DataFrame) -> None:
        k = len(self.names)
        shared = counted.sparkSession.sparkContext.broadcast(self.model)
        sample = counted.where("labels IS NOT NULL").orderBy(F.xxhash64("d"), "d").limit(CALIBRATION_ROWS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mass = shared.value.expect(*_lists(batch))
                flat = np.concatenate([features(mass, k).reshape(batch.num_rows, -1), _labels(batch, k)[:, :k]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(list(flat), pa.list_(pa.float64()))], names=["x"])

        got = sample.mapInArrow(run, "x array<double>").toPandas()["x"]
        shared.destroy()
        flat = np.stack(got.to_list())
        x, y = flat[:, : 2 * k].reshape(-1, k, 2), flat[:, 2 * k :]
        # A subject of which a document has no word needs no posterior there.
        self.calibration.fit(x, y, x[:, :, 1] >= np.log1p(LEAST))

    def classify(self, counted: DataFrame, doc: str, subject: str) -> DataFrame:
        """``doc, subject``: the subjects with a posterior of one half or more."""
        k, names = len(self.names), np.array(self.names, object)
        trained = bool(self.labelled and k)
        shared = counted.sparkSession.sparkContext.broadcast((self.model, self.calibration))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not trained:
                    continue
                model, calibration = shared.value
                mass = model.expect(*_lists(batch))
                own = mass[:, :k]
                part = (own >= SUBSTANTIAL * own.sum(1, keepdims=True)) | (own >= EVEN * own.max(1, keepdims=True, initial=0))
                row, col = np.nonzero((calibration.posterior(features(mass, k)) >= 0.5) & part & (own >= LEAST))
                yield pa.RecordBatch.from_arrays([batch.column("d").take(pa.array(row)), pa.array(names[col], pa.string())], names=["d", "s"])

        return counted.select("d", "words", "counts").mapInArrow(run, "d long, s string").toDF(doc, subject)


def counted_with_labels(documents: DataFrame, labels: DataFrame, classifier: SubjectClassifier, doc: str = "doc_id", text: str = "text", subject: str = "subject") -> DataFrame:
    """Word counts with the labels beside them, in the shared folder."""
    lists = classifier.label_lists(labels, doc, subject)
    return settle(word_counts(documents, doc, text).join(lists, "d", "left"), "words")


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, doc: str = "doc_id", text: str = "text", subject: str = "subject") -> DataFrame:
    """``doc, subject``: each document with each of its subjects."""
    names = [r[0] for r in subjects.select(F.col(f"`{subject}`").cast("string")).distinct().limit(MAX_SUBJECTS + 2).collect()]
    classifier = SubjectClassifier(names)
    counted = counted_with_labels(documents, labels, classifier, doc, text, subject)
    classifier.train(counted)
    return classifier.classify(counted, doc, subject)
