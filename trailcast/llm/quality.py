"""Quality classifier: logistic regression over hashed word n-grams, fitted with
follow-the-regularised-leader updates and scored as sparse dot products (dealt operator 4).

Tokens are runs of word characters and runs of punctuation. A token counts as its lowered
self and as its shape (upper case, capitalised, lower case, with digits, or the punctuation
run itself; with a mark if it repeats the word before). Features are hashed into 2**bits
weights: word 1- and 2-grams and shape 1-, 2- and 3-grams. A text's vector holds each
feature's share of its tokens times a scale, so texts of 1 and of 20,000 words compare.

Fitting: a bounded sample of labelled rows (``per_class`` rows a class, see samples.py) goes
to one task, which makes ``epochs`` passes of FTRL-proximal updates in a fixed order. The
model is 2**bits numbers, whatever the corpus, and goes to the tasks as a broadcast.

Defined cases: a null or empty text has no features, its score is that of the bias alone; a
table without labels of both classes gives the share of the class there is (0.5 without any
label); equal texts get equal scores; only doc_id and text are read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailcast.llm import textops
from trailcast.llm.samples import held_out, labelled_sample
from trailcast.llm.scratch import prepare

BITS = 18
PER_CLASS = 3000
SCALE = 8.0
MAX_TEXT = 1000 << 10


def _tables():
    kind = np.zeros(256, np.uint8)                  # 0 white space, 1 punctuation, 2 word
    kind[0x21:0x7F] = 1
    for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        kind[lo:hi] = 2
    kind[0x27] = 2
    return kind


KIND = _tables()


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS):
    """Feature numbers of all tokens of the texts, (tokens, 5), and each text's first token."""
    kind = KIND[data]
    first = np.ones(len(kind), bool)
    if len(kind):
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first[offsets[offsets < len(kind)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(kind))[:len(starts)]
    solid = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[solid], ends[solid]
    at = np.searchsorted(starts, offsets)
    prefix, inverse = textops.prefix_hashes(textops.LOWER[data])
    word = textops.mix64(textops.span_hashes(prefix, inverse, starts, ends))

    def number(mask):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[ends] - total[starts]

    upper, low = number((data >= 0x41) & (data <= 0x5A)), number((data >= 0x61) & (data <= 0x7A))
    digits = number((data >= 0x30) & (data <= 0x39))
    is_word = kind[starts] == 2
    shape = np.where(digits > 0, 4, np.where((upper > 1) & (low == 0), 3, np.where(upper > 0, 2, 1))).astype(np.uint64)
    before = np.zeros(len(word), np.uint64)
    before[1:] = word[:-1]
    new = np.zeros(len(word) + 1, bool)
    new[at] = True
    new = new[:-1]
    shape += np.where((word == before) & ~new, np.uint64(8), np.uint64(0))
    shape = np.where(is_word, textops.mix64(shape + np.uint64(1)), word)

    def back(x, k):
        """The value k tokens before, 0 before a text's first token."""
        out = np.zeros(len(x), np.uint64)
        out[k:] = x[:len(x) - k] if k < len(x) else x[:0]
        begin = at[:-1]
        for j in range(k):
            hit = begin + j
            out[hit[hit < at[1:]]] = 0
        return out

    odd = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    s1, s2 = back(shape, 1), back(shape, 2)
    grams = [word, word * odd[0] + back(word, 1) * odd[1] + np.uint64(1), shape + np.uint64(2), shape * odd[0] + s1 * odd[1] + np.uint64(3), shape * odd[0] + s1 * odd[1] + s2 * odd[2] + np.uint64(4)]
    return np.stack([(textops.mix64(g) >> np.uint64(64 - bits)).astype(np.int32) for g in grams], 1), at


class Ftrl:
    """FTRL-proximal logistic regression over sparse vectors; the last weight is the bias."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def update(self, at: np.ndarray, x: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * weight * x
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, bits: int = BITS, epochs: int = 3) -> np.ndarray:
    """Weights (2**bits and the bias) from at most 2 * per_class labelled rows."""
    prepare(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, per_class)

    def run(batches):
        rows = []
        for batch in batches:
            data, offsets = textops.text_bytes(batch.column(0))
            for lo, hi in textops.pieces(offsets, MAX_TEXT):
                at = offsets[lo:hi + 1]
                numbers, first = features(data[at[0]:at[-1]], at - at[0], bits)
                for k in range(hi - lo):
                    own = numbers[first[k]:first[k + 1]]
                    place, count = np.unique(own, return_counts=True)
                    x = np.append(count * (SCALE / max(1, len(own))), 1.0)
                    rows.append((np.append(place, 1 << bits).astype(np.int32), x.astype(np.float32), batch.column(1)[lo + k].as_py(), batch.column(2)[lo + k].as_py()))
        model = Ftrl(1 << bits)
        if len({y for _, _, y, _ in rows}) == 1:       # one class: its share is all there is
            model.z[-1], model.n[-1] = (-1e3 if rows[0][2] else 1e3), 1.0
            rows = []
        for _ in range(epochs):
            for place, x, y, weight in rows:
                model.update(place, x.astype(np.float64), y, weight)
        w = model.weights().astype(np.float32)
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(at), pa.array(w[at])], names=["place", "w"])

    fitted = sample.repartition(1).sortWithinPartitions("order").mapInArrow(run, "place long, w float").collect()
    w = np.zeros((1 << bits) + 1, np.float32)
    for place, x in fitted:                            # 2**bits + 1 numbers at most
        w[place] = x
    return w


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score: the probability of label 1 for every whole text."""
    spark = docs.sparkSession
    prepare(spark)
    bits = (len(weights) - 1).bit_length() - 1
    shared = spark.sparkContext.broadcast(weights)
    narrow = docs.select(*keep, F.col(text_col).alias("text__"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]), "score double"])
    names = [*narrow.columns[:-1], "score"]

    def run(batches):
        w = shared.value
        for batch in batches:
            data, offsets = textops.text_bytes(batch.column(len(keep)))
            scores = np.full(batch.num_rows, float(w[-1]))
            for lo, hi in textops.pieces(offsets, MAX_TEXT):
                at = offsets[lo:hi + 1]
                numbers, first = features(data[at[0]:at[-1]], at - at[0], bits)
                total = np.zeros(len(numbers) + 1)
                np.cumsum(w[numbers].sum(1, dtype=np.float64), out=total[1:])
                scores[lo:hi] += (total[first[1:]] - total[first[:-1]]) * SCALE / np.maximum(1, np.diff(first))
            yield pa.record_batch([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(scores, -35, 35))))], names=names)

    return narrow.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = score(docs, fit(docs, labels, label, **options))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
