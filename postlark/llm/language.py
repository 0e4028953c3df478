"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of 1 to 3 characters over lower-case letters and single blanks, hashed to 2^18 places; a feature's
value is its share of the text's n-grams times its inverse document frequency. Weights are learned by
follow-the-regularised-leader (per-coordinate FTRL-proximal) with L1 and L2 penalties, which leaves most at zero. A
temperature, fitted on sampled documents that the weights haven't seen, calibrates the probabilities.

The classifier is fitted on a bounded sample: of each language about ``PER_LANGUAGE`` documents, chosen by a hash of their
id among texts of at most ``SAMPLE_CHARS`` characters; the ``LANGUAGES`` most frequent languages, and at most
``SAMPLE_ROWS`` documents in all. Weights are a table of fixed size.
Prediction reads whole texts in one pass without a shuffle, in slabs of bounded size; only the text is used.

Cases: null texts, and texts without a letter, get ``und`` with score 0; without any training row all do; training rows
with a null language are ignored; ties between languages go to the first in order; repeated rows give repeated results;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.llm.hashing import constants, mixed
from postlark.shipping import ship

PER_LANGUAGE = 600
SAMPLE_ROWS = 6000
LANGUAGES = 200
SAMPLE_CHARS = 50_000
ORDERS = (1, 2, 3)
PLACES = 18
SCALE = 30.0
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01
UNKNOWN = "und"
SLAB = 1 << 20
RESULT = "id long, lang_pred string, score double"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature places of all n-grams of some texts, and the text of each."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points, owner = np.where(letter, points, 32)[keep].astype(np.uint64), owner[keep]
    places, owners = [], []
    power = constants(7000, max(ORDERS))
    for n in ORDERS:
        count = len(points) - n + 1
        if count <= 0:
            continue
        sums = np.full(count, n, np.uint64)
        for k in range(n):
            sums += (points[k : k + count] + np.uint64(1)) * power[k]
        inside = owner[:count] == owner[n - 1 :]
        places.append((mixed(sums) >> np.uint64(64 - PLACES)).astype(np.int64)[inside])
        owners.append(owner[:count][inside])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # places x languages, with SCALE and inverse document frequency folded in
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weights over n-grams divided by their number, and that number. Long texts are added up in slabs."""
        total = np.zeros((len(texts), len(self.languages)))
        counts = np.zeros(len(texts), np.int64)
        pieces, piece_owner, size = [], [], 0

        def add():
            places, owner = features(pieces)
            if len(places):
                order = np.array(piece_owner)[owner]
                counts[:] += np.bincount(order, minlength=len(texts))
                for c in range(len(self.languages)):
                    total[:, c] += np.bincount(order, self.weights[places, c], len(texts))
            pieces.clear(), piece_owner.clear()

        for k, text in enumerate(texts):
            for a in range(0, len(text), SLAB):
                pieces.append(text[max(a - 2, 0) : a + SLAB])
                piece_owner.append(k)
                size += len(pieces[-1])
                if size >= SLAB:
                    add()
                    size = 0
        add()
        return total / np.maximum(counts, 1)[:, None] + self.bias, counts

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logits, counts = self.logits(texts)
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        known = counts > 0
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
        return names, np.where(known, p[np.arange(len(texts)), best], 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str]) -> Model:
    """FTRL-proximal on four fifths of the sample, temperature on the rest."""
    languages = sorted(set(labels))
    rows = []
    for text, label in zip(texts, labels):
        places, _ = features([text])
        if len(places):
            found, counts = np.unique(places, return_counts=True)
            rows.append((found, counts / counts.sum(), languages.index(label)))
    if not rows:
        return Model([], np.zeros((1 << PLACES, 0), np.float32), np.zeros(0))
    held = rows[4::5] or rows
    learn = [r for k, r in enumerate(rows) if k % 5 != 4] or rows
    frequency = np.zeros(1 << PLACES)
    for found, _, _ in learn:
        frequency[found] += 1
    idf = np.log((1 + len(learn)) / (1 + frequency)) + 1
    k = len(languages)
    z, n = np.zeros((1 << PLACES, k)), np.zeros((1 << PLACES, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learned(z, n, g, w):
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        return z + g - sigma * w, n + g * g

    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for r in order.permutation(len(learn)):
            found, share, label = learn[r]
            x = SCALE * share * idf[found]
            w, wb = weight(z[found], n[found], L1), weight(zb, nb, 0.0)
            error = softmax(x @ w + wb)
            error[label] -= 1
            z[found], n[found] = learned(z[found], n[found], x[:, None] * error, w)
            zb, nb = learned(zb, nb, error, wb)
    weights = weight(z, n, L1) * (SCALE * idf)[:, None]
    model = Model(languages, weights.astype(np.float32), weight(zb, nb, 0.0))
    logits = np.array([share @ model.weights[found] + model.bias for found, share, _ in held])
    truth = np.array([label for _, _, label in held])
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    model.temperature = min((math.exp(s) for s in np.linspace(-3, 3, 121)), key=loss)
    return model


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the bounded sample of the usable rows."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= SAMPLE_CHARS))
    counts = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return fit([], [])
    part = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, PER_LANGUAGE / r["count"]))])
    sample = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("order"))
    sample = sample.where(F.pmod(F.col("order"), F.lit(1 << 30)) < part[F.col("lang")] * (1 << 30))
    got = sample.orderBy("order", "lang", "text").limit(SAMPLE_ROWS).collect()
    return fit([r.text for r in got], [r.lang for r in got])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred`` and ``score`` of every whole text."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 1000) for a in range(0, batch.num_rows, 1000)):
                names, scores = sent.value.predict([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predict, RESULT)
