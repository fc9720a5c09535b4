"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence's probability is a logistic function of
the features it holds, a document's is their noisy-or (with a small leak), and only the
documents' labels are learned from. The fitted sentence scores then say where it is.
"""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusplan.llm.common import labelled_sample, store_of, texts_of, with_columns

TRAIN_DOCS = 12_000  # expected labelled documents at most: they are taken by a threshold on a hash of the id
FEATURES = 4_096
MIN_DOCS = 4
L2 = 0.02
ROUNDS = 300
STEMS = (3, 4, 5)
THRESHOLD = 0.5
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence; ends at . ! ? or a line end."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def features(sentence: str) -> set[str]:
    """Its words and, marked by a hyphen, the beginnings of its words, in lower case."""
    words = set(_WORD.findall(sentence.lower()))
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in STEMS)) if words else words


class Model:
    """weights: of features; bias: of a sentence that has any; leak: of every document."""

    def __init__(self, weights: dict[str, float], bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak
        self.words = frozenset(w for w in weights if not w.endswith("-"))
        self.stems = [(n, frozenset(w[:-1] for w in weights if w.endswith("-") and len(w) == n + 1)) for n in STEMS]

    def sentence(self, text: str) -> float:
        """Probability of a sentence; 0 if it holds no feature of the model."""
        words = set(_WORD.findall(text.lower()))
        found = [w for w in words & self.words]
        for n, stems in self.stems:
            found += [s + "-" for s in {w[:n] for w in words if len(w) > n} & stems]
        if not found:
            return 0.0
        z = self.bias + math.fsum(self.weights[f] for f in found)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """(score, sentences (start, end, probability) that alone reach one half)."""
        clean, spans = 1 - self.leak, []
        for start, end in sentences(text):
            if p := self.sentence(text[start:end]):
                clean *= 1 - p
                if p >= THRESHOLD:
                    spans.append((start, end, p))
        return 1 - clean, spans


def fit_bags(rows: list[tuple[int, list[list[int]]]], n_features: int):
    """(weights, bias, leak) that maximise the likelihood of the documents' labels.

    rows: (label, feature numbers of each sentence that has any). Adam on all rows.
    """
    bags = [(d, s) for d, (_, sents) in enumerate(rows) for s in sents]
    return _fit(np.array([r[0] for r in rows], float), np.array([b[0] for b in bags], np.int64),
                np.array([len(b[1]) for b in bags], np.int64), np.array([f for b in bags for f in b[1]], np.int64), n_features)


def _fit(y: np.ndarray, doc: np.ndarray, sizes: np.ndarray, flat: np.ndarray, n_features: int):
    """y: labels; of each sentence its document and number of features; all their features, one after another."""
    bags = len(doc)
    of = np.repeat(np.arange(bags), sizes)
    x = np.zeros(n_features + 2)
    x[-2], x[-1] = -2.0, math.log(0.02)  # bias; log of the leak
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, ROUNDS + 1):
        z = x[-2] + np.bincount(of, x[flat], bags)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        leak = min(0.2, math.exp(x[-1]))
        log_clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)) + math.log1p(-leak)
        positive = np.maximum(-np.expm1(log_clean), 1e-9)
        pull = np.where(y == 1, np.exp(log_clean) / positive, -1.0)  # d logL / d(-log clean)
        by_sentence = pull[doc] * p
        grad = np.concatenate([np.bincount(flat, by_sentence[of], n_features) - L2 * x[:-2],
                               [by_sentence.sum(), (pull * leak / (1 - leak)).sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        x += 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        x[-1] = min(x[-1], math.log(0.2))
    return x[:-2], float(x[-2]), math.exp(x[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text",
          id_col: str = "doc_id", limit: int = TRAIN_DOCS) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out.

    With no label of one of the two kinds, the model scores every text by the share of label 1.
    """
    store = store_of(docs.sparkSession, "toxicity")
    sample = store(labelled_sample(docs, labels, label, text, id_col, limit), "sample",
                   rows=F.count(F.lit(1)), ones=F.sum("label"))
    rows, ones = store.measured["sample"]["rows"], store.measured["sample"]["ones"] or 0
    if not 0 < ones < rows:
        return Model({}, 0.0, min(0.99, ones / rows) if rows else 0.0)

    def present(batches):
        for batch in batches:
            names, marks = [], []
            for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found = features(t)
                names += found
                marks += [int(y)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(marks, pa.int64())], ["f", "y"])

    # keep what tells the labels apart best, by the G-test over documents
    counted = sample.mapInArrow(present, "f string, y long").groupBy("f").agg(
        F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCS)
    rate = ones / rows
    gain = sum((F.when(F.col(o) > 0, F.col(o) * F.log(F.col(o) / (F.col("n") * e))).otherwise(0.0)
                for o, e in (("a", rate), ("b", 1 - rate))), F.lit(0.0))
    chosen = (counted.withColumn("b", F.col("n") - F.col("a")).where(F.col("a") > F.col("n") * rate)
              .orderBy(gain.desc(), "f").limit(FEATURES).select("f"))
    names = sorted(r.f for r in chosen.collect())
    number = {f: i for i, f in enumerate(names)}

    def bags(batches):
        for batch in batches:
            sizes, flat = [], []
            for t in batch.column("text").to_pylist():
                found = [sorted(number[f] for f in features(t[a:b]) if f in number) for a, b in sentences(t)]
                sizes.append(np.array([len(x) for x in found if x], np.int32).tobytes())
                flat.append(np.array([f for x in found for f in x], np.int16 if FEATURES < 1 << 15 else np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("label").cast(pa.int64()),
                                              pa.array(sizes, pa.binary()), pa.array(flat, pa.binary())], ["id", "y", "sizes", "flat"])

    # packed: two bytes a feature of the sample's documents reach the driver
    rows = sample.select("id", "text", "label").mapInArrow(bags, "id long, y long, sizes binary, flat binary").collect()
    rows.sort(key=lambda r: r.id)
    sizes = [np.frombuffer(r.sizes, np.int32) for r in rows]
    flat = np.frombuffer(b"".join([r.flat for r in rows]), np.int16 if FEATURES < 1 << 15 else np.int32).astype(np.int64)
    weights, bias, leak = _fit(np.array([r.y for r in rows], float), np.repeat(np.arange(len(rows)), [len(s) for s in sizes]),
                               np.concatenate(sizes).astype(np.int64), flat, len(names))
    del rows, sizes, flat
    return Model({f: float(w) for f, w in zip(names, weights) if abs(w) > 1e-3}, bias, leak)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add `score` (0 to 1), `predicted` (1 from one half on), `n_offending` sentences and
    `offending`, their places as "start-end" (code points, end exclusive) joined by blanks.

    Null text counts as empty and scores the leak. Columns of these names are replaced.
    """
    def work():
        def step(batch):
            found = [model.document(t) for t in texts_of(batch, text)]
            return [[p for p, _ in found], [int(p >= THRESHOLD) for p, _ in found], [len(s) for _, s in found],
                    [" ".join(f"{a}-{b}" for a, b, _ in s) for _, s in found]]
        return step
    return with_columns(docs, "score double, predicted int, n_offending int, offending string", work)


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that score below one half."""
    model = train(docs, labels, text=text, id_col=id_col)

    def work():
        def step(batch):
            return [], [model.document(t)[0] < THRESHOLD for t in texts_of(batch, text)]
        return step
    return with_columns(docs, "", work)
