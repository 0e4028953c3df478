"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary text, spell words byte by byte from the ``ORDER`` - 1 bytes before, so they
know inflected and rare expressions by their parts. Long contexts back off to continuation counts of the class, and the
shortest to counts shared by both classes: an expression that is merely rare isn't taken for evidence. Beside them stands
a list of telling strings (``STRINGS`` bytes of a word and its borders): those that more toxic than ordinary documents
hold, by more than ``DOUBT`` standard errors of the log ratio.

A text is measured by the two log-likelihoods' difference divided by its number of words, by the greatest difference of
``WINDOWS`` words in a row, and by the mean and the greatest value of its words' telling strings. So a few expressions
tell in a long text too, in whatever language. A logistic calibration, fitted by two-fold cross-fitting on the same
sample, turns the measures into a probability.

The models are fitted on a bounded sample: of each class about ``SAMPLE`` labelled documents, chosen by a hash of their id,
of which texts of at most ``SAMPLE_CHARS`` characters are read. So the model, a few sorted arrays, is bounded too; it is broadcast.
Scoring reads whole texts in one pass without a shuffle; each distinct word of a batch is spelled once. Words are runs of
ASCII letters (in lower case) and bytes beyond ASCII. Only the text is used.

Cases: null and empty texts, and texts without a word, get the calibrated score of no words; labels with a null id or label are
ignored, of several labels of one id the highest counts; without both classes every score is 0; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.llm import hashing as H
from postlark.operators.spread import cut
from postlark.shipping import ship

SAMPLE = 2500
SAMPLE_CHARS = 50_000
ORDER = 5
SHARED = 2
WINDOWS = (1, 4, 16)
STRINGS = (4, 6, 8)
DOUBT = 1.5
PLAIN = 0.7
LEAST = 0.01
DOCUMENTS = 100
SLAB = 1 << 22
REMEMBERED = 500_000
RESULT = "id long, score double, predicted int"

_MARK = 0x0A
_BREAKS = np.ones(256, bool)
_BREAKS[0x80:] = False
_BREAKS[ord("a") : ord("z") + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of some texts, their letters and lengths; the distinct word and the text of each word."""
    data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    starts, ends = H.spans(data, _BREAKS)
    borders = np.cumsum([len(t) + 1 for t in texts])
    hashes, first, number = np.unique(H.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    lengths = (ends - starts)[first]
    places = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return hashes, data[places + np.repeat(starts[first], lengths)], lengths, number, np.searchsorted(borders, starts, side="right")


class _Spelled:
    """Words with ``ORDER`` - 1 marks before and one behind; a prediction is made at every byte and at the last mark."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray):
        blocks = lengths + ORDER
        begins = np.cumsum(blocks) - blocks
        self.data = np.full(int(blocks.sum()), _MARK, np.uint8)
        own = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.data[own + np.repeat(begins + ORDER - 1, lengths)] = letters
        made = lengths + 1
        self.word = np.repeat(np.arange(len(lengths)), made)
        self.at = np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made) + np.repeat(begins + ORDER - 1, made)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n bytes that end at each prediction."""
        return H.byte_windows(self.data, n)[self.at - n + 1]

    def contexts(self, n: int) -> np.ndarray:
        """Hash of the n - 1 bytes before each prediction."""
        return H.byte_windows(self.data, n - 1)[self.at - n + 1]


def _strings(letters: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-byte strings of each word with a mark before and one behind, and how many each word has."""
    blocks = lengths + 2
    begins = np.cumsum(blocks) - blocks
    data = np.full(int(blocks.sum()), _MARK, np.uint8)
    own = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    data[own + np.repeat(begins + 1, lengths)] = letters
    made = np.maximum(blocks - n + 1, 0)
    at = np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made) + np.repeat(begins, made)
    return H.byte_windows(data, n)[at], made


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return np.where(found, values[at], 0.0), found


@dataclass
class Model:
    """Log-likelihood differences (toxic minus ordinary) by order: of the strings seen, and of leaving a context."""

    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]
    strings: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    weights: tuple[float, ...] = ()
    remembered: tuple = field(default=(np.empty(0, np.uint64), np.empty(0), np.empty(0)), repr=False)

    def values(self, hashes: np.ndarray, letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Difference and telling value of each distinct word (hashes ascending); words met before in this worker are remembered."""
        keys, *old = self.remembered
        (value, known), (telling, _) = (_looked_up(keys, v, hashes) for v in old)
        if not known.all():
            new = np.repeat(~known, lengths)
            value[~known] = self.spelled(letters[new], lengths[~known])
            telling[~known] = self.told(letters[new], lengths[~known])
            if len(keys) > REMEMBERED:
                keys, old = keys[:0], [v[:0] for v in old]
            at = np.searchsorted(keys, hashes[~known])
            self.remembered = np.insert(keys, at, hashes[~known]), *(np.insert(v, at, x[~known]) for v, x in zip(old, (value, telling)))
        return value, telling

    def told(self, letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The greatest value among the telling strings of each word, or 0."""
        best = np.zeros(len(lengths))
        for n, (keys, values) in self.strings.items():
            hashes, made = _strings(letters, lengths, n)
            np.maximum.at(best, np.repeat(np.arange(len(lengths)), made), _looked_up(keys, values, hashes)[0])
        return best

    def spelled(self, letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The difference of each word."""
        words = _Spelled(letters, lengths)
        value = np.zeros(len(words.at))
        open_ = np.arange(len(words.at))
        for n in range(ORDER, SHARED, -1):
            got, found = _looked_up(*self.grams[n], words.grams(n)[open_])
            value[open_] += got
            open_ = open_[~found]
            left, _ = _looked_up(*self.contexts[n], words.contexts(n)[open_])
            value[open_] += left
        return np.bincount(words.word, value, len(lengths))

    def inputs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Length-normalised difference and length."""
        measures, count = self.measures(texts)
        return measures[:, 0], count

    def measures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The calibration's inputs, and the length; texts are added up in slabs cut at blanks."""
        n = len(texts)
        total, count, telling, above, most = np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n)
        top = np.full((len(WINDOWS), n), -np.inf)
        pieces, owners, size = [], [], 0
        tail, tail_owner = np.empty(0), -1  # the last words of a text that may go on in the next slab

        def add():
            nonlocal tail, tail_owner
            if pieces:
                hashes, letters, lengths, number, piece = words(pieces)
                if len(number):
                    value, told = (v[number] for v in self.values(hashes, letters, lengths))
                    owner = np.array(owners)[piece]
                    total[:] += np.bincount(owner, value, n)
                    count[:] += np.bincount(owner, minlength=n)
                    telling[:] += np.bincount(owner, told, n)
                    above[:] += np.bincount(owner, np.maximum(told - PLAIN, 0), n)
                    np.maximum.at(most, owner, told)
                    if owner[0] == tail_owner:
                        value, owner = np.concatenate([tail, value]), np.concatenate([np.full(len(tail), tail_owner), owner])
                    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    begin = np.repeat(starts, np.diff(np.append(starts, len(owner))))
                    sums, place = np.concatenate([[0.0], np.cumsum(value)]), np.arange(len(value))
                    for best, w in zip(top, WINDOWS):
                        # A text's first windows are shorter than the others; behind a cut they were seen with what is before.
                        won = (sums[1:] - sums[np.maximum(place - w + 1, begin)]) / w
                        if owner[0] == tail_owner:
                            won[: len(tail)] = -np.inf
                        best[owner[starts]] = np.maximum(best[owner[starts]], np.maximum.reduceat(won, starts))
                    tail, tail_owner = value[max(starts[-1], len(value) - max(WINDOWS) + 1) :], owner[-1]
            pieces.clear(), owners.clear()

        for k, text in enumerate(texts):
            raw = text.encode()
            a = 0
            while a < len(raw):
                b = len(raw) if len(raw) - a <= SLAB else raw.rfind(b" ", a, a + SLAB) + 1
                b = b if b > a else len(raw)
                pieces.append(raw[a:b])
                owners.append(k)
                size, a = size + b - a, b
                if size >= SLAB:
                    add()
                    size = 0
        add()
        long = np.maximum(count, 1)
        mean, telling, above = total / long, telling / long, above / long
        top = np.where(count > 0, top, 0.0)
        columns = [mean, mean * np.sqrt(count), *top, np.log1p(count), telling, most, np.log(LEAST + telling), above, np.log(LEAST + above)]
        return np.column_stack(columns), count

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.grams:
            return np.zeros(len(texts))
        logit = self.measures(texts)[0] @ np.array(self.weights[:-1]) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _discount(counts: np.ndarray) -> float:
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once + twice else 0.5


@dataclass
class Counted:
    """What the models need of the sample, by group: twice the fold, plus 1 if toxic."""

    letters: np.ndarray
    lengths: np.ndarray
    uses: np.ndarray  # [group, word]: how often the word stands in its texts
    strings: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: hashes, and [group, string]: the documents that hold it
    documents: np.ndarray  # [group]


GROUPS = 4


def count_words(texts: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and lengths of the distinct words, and their uses in each group."""
    _, letters, lengths, number, owner = words(texts)
    uses = np.bincount(groups[owner] * len(lengths) + number, minlength=GROUPS * len(lengths)).reshape(GROUPS, -1)
    return letters, lengths, uses


def count_strings(texts: list[bytes], groups: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length the hashes of the words' strings, and how many documents of each group hold them."""
    hashes, letters, lengths, number, owner = words(texts)
    held = np.unique(owner.astype(np.int64) * max(len(hashes), 1) + number)
    doc, word = held // max(len(hashes), 1), held % max(len(hashes), 1)
    slabs = np.searchsorted(doc, np.arange(0, len(texts) + DOCUMENTS, DOCUMENTS))
    out = {}
    for n in STRINGS:
        found, made = _strings(letters, lengths, n)
        keys, string = np.unique(found, return_inverse=True)
        first = np.cumsum(made) - made
        held_by = np.zeros((GROUPS, len(keys)), np.int64)
        for begin, a, b in zip(range(0, len(texts), DOCUMENTS), slabs[:-1], slabs[1:]):
            many = made[word[a:b]]
            at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[word[a:b]], many)
            pair = np.unique(string[at].astype(np.int64) * DOCUMENTS + np.repeat(doc[a:b] - begin, many))
            np.add.at(held_by, (groups[pair % DOCUMENTS + begin], pair // DOCUMENTS), 1)
        out[n] = keys, held_by
    return out


def fit_models(toxic: list[str], ordinary: list[str]) -> Model:
    """Two Kneser-Ney models over the strings of both classes, and their telling strings."""
    texts, groups = [t.encode() for t in (*toxic, *ordinary)], np.array([1] * len(toxic) + [0] * len(ordinary), np.int64)
    counted = Counted(*count_words(texts, groups), count_strings(texts, groups), np.bincount(groups, minlength=GROUPS))
    return models_of(counted, (0,))


def models_of(counted: Counted, folds: tuple[int, ...]) -> Model:
    """The models that these folds of the sample give."""
    uses = [counted.uses[[2 * f + toxic for f in folds]].sum(axis=0) for toxic in (1, 0)]
    there = uses[0] + uses[1] > 0
    letters, lengths = counted.letters[np.repeat(there, counted.lengths)], counted.lengths[there]
    uses = [u[there] for u in uses]
    if not len(lengths):
        return Model({}, {})
    spelled = _Spelled(letters, lengths)
    # Of each order: its strings, the number of the string without its first byte, and that of the bytes before the last.
    keys, suffix, before, context = {}, {}, {}, {}
    counts: list[dict[int, np.ndarray]] = [{}, {}]
    first = None
    for n in range(ORDER, 0, -1):
        above = first
        keys[n], first, number_of = np.unique(spelled.grams(n), return_index=True, return_inverse=True)
        if n > 1:
            before[n], all_contexts = np.unique(spelled.contexts(n), return_inverse=True)
            context[n] = all_contexts[first]
        if above is not None:
            suffix[n + 1] = number_of[above]
        for own, use in zip(counts, uses):
            if above is None:
                own[n] = np.bincount(number_of, use[spelled.word], len(keys[n]))
            else:
                own[n] = np.bincount(suffix[n + 1], own[n + 1] > 0, len(keys[n]))
    for n in range(1, SHARED + 1):
        counts[0][n] = counts[1][n] = counts[0][n] + counts[1][n]
    grams, contexts = {}, {}
    lower = []
    for own in counts:
        lower.append((own[1] + 1) / (own[1].sum() + 256))
    for n in range(2, ORDER + 1):
        size = len(before[n])
        out, leaves = [], []
        for own, low in zip(counts, lower):
            c = own[n]
            d = _discount(c[c > 0])
            total = np.bincount(context[n], c, size)
            leave = np.where(total > 0, d * np.bincount(context[n], c > 0, size) / np.maximum(total, 1), 1.0)
            out.append(np.maximum(c - d, 0) / np.maximum(total, 1)[context[n]] + leave[context[n]] * low[suffix[n]])
            leaves.append(leave)
        lower = out
        if n > SHARED:
            grams[n] = keys[n], np.log(out[0]) - np.log(out[1])
            contexts[n] = before[n], np.log(leaves[0]) - np.log(leaves[1])
    return Model(grams, contexts, telling_strings(counted, folds))


def telling_strings(counted: Counted, folds: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length the strings that more toxic documents hold: log ratio of the shares, less ``DOUBT`` standard errors."""
    groups = [[2 * f + toxic for f in folds] for toxic in (1, 0)]
    n_toxic, n_ordinary = (counted.documents[g].sum() for g in groups)
    out = {}
    for n, (keys, held_by) in counted.strings.items():
        t, o = (held_by[g].sum(axis=0) + 0.5 for g in groups)
        value = np.log(t / (n_toxic + 1)) - np.log(o / (n_ordinary + 1)) - DOUBT * np.sqrt(1 / t + 1 / o)
        out[n] = keys[value > 0], value[value > 0]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression with a little ridge, by Newton steps on standardised inputs, halved until they gain."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6]) * len(x) * 1e-2
    loss = lambda w: weight @ (np.logaddexp(0, z @ w) - y * (z @ w)) + w @ ridge @ w / 2
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge
        step, now = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge @ w), loss(w)
        part = next((part for part in 0.5 ** np.arange(30) if loss(w + part * step) <= now), 0.0)
        w = w + part * step
    scaled = w[:-1] / sd
    return (*(float(s) for s in scaled), float(w[-1] - scaled @ mean))


def fit(texts: list[str], toxic: list[int], prior: float) -> Model:
    """``train`` on texts at hand: models of all, calibrated on measures each half got from the other half's models."""
    y = np.array(toxic, np.int64)
    fold = np.zeros(len(y), np.int64)
    for label in (0, 1):
        fold[np.flatnonzero(y == label)[::2]] = 1
    raw, groups = [t.encode() for t in texts], 2 * fold + y
    counted = Counted(*count_words(raw, groups), count_strings(raw, groups), np.bincount(groups, minlength=GROUPS))
    if not _both(counted):
        return Model({}, {})
    halves = [models_of(counted, (1 - f,)) for f in (0, 1)]
    known = [(f, y[fold == f], halves[f].measures([t for t, g in zip(texts, fold) if g == f])[0]) for f in (0, 1) if _both(counted, 1 - f)]
    return calibrated(counted, np.concatenate([k[1] for k in known] or [y[:0]]), np.concatenate([k[2] for k in known]) if known else None, prior)


def _both(counted: Counted, *folds: int) -> bool:
    """Whether these folds, or else all, hold documents of both classes."""
    count = counted.documents.reshape(2, 2)[list(folds) or [0, 1]].sum(axis=0)
    return bool((count > 0).all())


def calibrated(counted: Counted, y: np.ndarray, measured: np.ndarray | None, prior: float) -> Model:
    """The models of the whole sample, with weights fitted to the measures of held-out documents."""
    model = models_of(counted, (0, 1))
    share = counted.documents[1::2].sum() / counted.documents.sum()
    if len(y) and 0 < y.mean() < 1:
        weight = np.where(y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
        model.weights = _logistic(measured, y.astype(float), weight)
    else:
        model.weights = (1.0, *[0.0] * (len(WINDOWS) + 7), float(np.log(prior / (1 - prior))))
    return model


def _sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """The bounded sample ``(text, grp)`` in a written table, and the share of toxic documents among those labelled."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & usable)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("order", F.xxhash64("id"))
    counts = {r["toxic"]: r["count"] for r in known.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    prior = counts.get(1, 0) / max(sum(counts.values()), 1)
    part = F.when(F.col("toxic") == 1, min(1.0, SAMPLE / max(counts.get(1, 0), 1))).otherwise(min(1.0, SAMPLE / max(counts.get(0, 0), 1)))
    chosen = known.where("toxic in (0, 1)").where(F.pmod(F.col("order"), F.lit(1 << 30)) < part * (1 << 30)).orderBy("order", "id").limit(3 * SAMPLE)
    rows = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= SAMPLE_CHARS)).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").withColumn("hash", F.xxhash64("text")).dropDuplicates(["id", "hash"])
    fold = F.pmod(F.shiftright("order", 30), F.lit(2))
    rows = cut(rows.select("id", "order", "hash", "text", (2 * fold + F.col("toxic")).cast("int").alias("grp")))
    kept = rows.select("order", "id", "hash").orderBy("order", "id", "hash").limit(3 * SAMPLE)
    return rows.join(F.broadcast(kept.select("id", "hash")), ["id", "hash"], "left_semi").select("text", "grp"), min(max(prior, 1e-4), 1 - 1e-4)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Texts and groups, a few megabytes at a time."""
    for batch in batches:
        held, groups, size = [], [], 0
        for text, group in zip(batch.column("text").to_pylist(), batch.column("grp").to_pylist()):
            held.append(text.encode())
            groups.append(group)
            size += len(held[-1])
            if size >= SLAB // 4:
                yield held, np.array(groups, np.int64)
                held, groups, size = [], [], 0
        if held:
            yield held, np.array(groups, np.int64)


_BY_GROUP = [f"g{g}" for g in range(GROUPS)]
_COUNTS = ", ".join(f"{g} long" for g in _BY_GROUP)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts, groups in _parts(batches):
        letters, lengths, uses = count_words(texts, groups)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        spelled = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        yield pa.RecordBatch.from_arrays([spelled, *(pa.array(u.astype(np.int64)) for u in uses)], ["word", *_BY_GROUP])


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts, groups in _parts(batches):
        for n, (keys, held_by) in count_strings(texts, groups).items():
            size = pa.array(np.full(len(keys), n, np.int32))
            yield pa.RecordBatch.from_arrays([size, pa.array(keys.view(np.int64)), *(pa.array(h) for h in held_by)], ["size", "string", *_BY_GROUP])


def _count(sample: DataFrame) -> Counted:
    """Word and document counts of the sample, added up by Spark; no text reaches the driver."""
    added = [F.sum(g).alias(g) for g in _BY_GROUP]
    documents = np.zeros(GROUPS, np.int64)
    for r in sample.groupBy("grp").count().collect():
        documents[r["grp"]] = r["count"]
    spelled = sample.mapInArrow(_word_rows, f"word binary, {_COUNTS}").groupBy("word").agg(*added).orderBy("word").toArrow()
    column = spelled.column("word").combine_chunks().cast(pa.binary())
    lengths = np.asarray(pc.binary_length(column)).astype(np.int64)
    letters = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    uses = np.array([np.asarray(spelled.column(g)) for g in _BY_GROUP]).reshape(GROUPS, -1)
    # Only strings that tell in one of the models are fetched.
    tells = F.lit(False)
    for folds in ((0,), (1,), (0, 1)):
        t, o = (sum((F.col(_BY_GROUP[2 * f + toxic]) for f in folds), F.lit(0.5)) for toxic in (1, 0))
        n_toxic, n_ordinary = (float(documents[[2 * f + toxic for f in folds]].sum()) for toxic in (1, 0))
        tells |= F.log(t / (n_toxic + 1)) - F.log(o / (n_ordinary + 1)) - DOUBT * F.sqrt(1 / t + 1 / o) > -1e-9
    told = sample.mapInArrow(_string_rows, f"size int, string long, {_COUNTS}").groupBy("size", "string").agg(*added).where(tells)
    told = told.select("size", F.col("string"), *_BY_GROUP).toArrow()
    size, string = np.asarray(told.column("size")), np.asarray(told.column("string")).astype(np.int64).view(np.uint64)
    held_by = np.array([np.asarray(told.column(g)) for g in _BY_GROUP]).reshape(GROUPS, -1)
    strings = {}
    for n in STRINGS:
        mine = np.flatnonzero(size == n)
        mine = mine[np.argsort(string[mine])]
        strings[n] = string[mine], held_by[:, mine]
    return Counted(letters, lengths, uses, strings, documents)


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the bounded sample of labelled documents whose id is usable.

    The driver gets counts of words and strings and a few measures a document, never a text: words are counted, and the
    half that a model has not seen is measured with it, by tasks over the written sample.
    """
    ship(docs.sparkSession)
    sample, prior = _sample(docs, labels, usable, id_col, text_col)
    counted = _count(sample)
    if not _both(counted):
        return Model({}, {})
    halves = [models_of(counted, (1 - f,)) if _both(counted, 1 - f) else None for f in (0, 1)]
    sent = docs.sparkSession.sparkContext.broadcast(halves)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, groups in _parts(batches):
            for fold in (0, 1):
                model, mine = sent.value[fold], np.flatnonzero(groups // 2 == fold)
                if model is not None and len(mine):
                    measured = model.measures([texts[k].decode() for k in mine])[0]
                    yield pa.RecordBatch.from_arrays([pa.array((groups[mine] % 2).astype(np.int32)), pa.array(measured.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    known = sample.mapInArrow(measure, "toxic int, x array<double>").toArrow()
    sent.unpersist()
    y, x = np.asarray(known.column("toxic")), np.array(known.column("x").to_pylist())
    order = np.lexsort((*x.T, y)) if len(y) else []
    return calibrated(counted, y[order], x[order] if len(y) else None, prior)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``score`` and ``predicted`` of every whole text."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 1000) for a in range(0, batch.num_rows, 1000)):
                score = sent.value.score([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["id", "score", "predicted"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(rate, RESULT)


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents not predicted toxic, with all their columns."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 1000) for a in range(0, batch.num_rows, 1000)):
                column = part.column(part.schema.get_field_index(text_col))
                score = sent.value.score([t or "" for t in column.to_pylist()])
                yield part.filter(pa.array(score < 0.5))

    return docs.mapInArrow(keep, docs.schema)
