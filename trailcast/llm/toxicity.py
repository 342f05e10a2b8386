"""Toxicity by a weighted lexicon and Aho-Corasick (dealt operator 9).

Folding: characters are lowered and look-alikes (Cyrillic, Greek, full-width, mathematical,
accented letters) become Latin letters; digits and signs that stand for letters are read as
letters inside a word (a digit if the word has a letter, a sign if a letter follows);
combining marks and invisible characters (categories Mn, Me, Cf) are dropped; everything else
separates words.

Lexicon: entries are whole words and word beginnings. A base list comes with a fixed weight;
further entries are learned from labelled rows that aren't held out (a bounded sample, see
samples.py): log-odds of the shares of toxic and clean texts that hold the entry, for entries
whose log-likelihood ratio is significant. Exception phrases (given ones, and pairs of an
entry with a neighbouring word that the sample has in clean texts only) cancel the matches
inside them.

Scoring: one pass of the automaton over the folded text; each word counts with its heaviest
entry. The sum is divided by a power of the number of words, and a logistic curve fitted on
the same sample makes it a probability; the power is the one with the fewest
errors on the sample, then by likelihood. The lexicon is
bounded by ``max_entries``.

Defined cases: null and empty texts have sum 0 and get the curve's value there; without
labels of both classes the base list and a fixed curve serve; equal texts get equal scores;
only doc_id and text are read (remove_toxic keeps all columns)."""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailcast.llm import textops
from trailcast.llm.samples import held_out, labelled_sample
from trailcast.llm.scratch import prepare

#: Mild to strong English insults, the base list.
BASE_WORDS = ("clown", "disgusting", "dumb", "garbage", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
BASE_WEIGHT = 3.0
EXCEPTIONS = ("trash can", "trash bin", "garbage collection", "garbage collector", "garbage truck", "clown fish")
#: Letters of other scripts that look like Latin letters.
LOOK_ALIKE = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ɑ": "a", "ɡ": "g"}
#: Digits and signs read as letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "€": "e"}
PER_CLASS = 3000
MAX_ENTRIES = 5000
STEMS = (4, 5, 6, 7)
SIGNIFICANT = 20.0
POWERS = (0.25, 0.5, 0.75, 1.0)
PIECE = 1 << 20
LETTER, DIGIT, SIGN, DROPPED = 1, 2, 3, 4


@lru_cache(maxsize=1)
def _fold_table() -> tuple[np.ndarray, np.ndarray]:
    """Folded code point (or blank) and class of every code point."""
    to, kind = np.full(0x110000, 0x20, np.uint32), np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c)) in ("Mn", "Me", "Cf"):
            kind[c] = DROPPED
            continue
        low = chr(c).lower()[:1] if not 0xD800 <= c < 0xE000 else " "
        low = LOOK_ALIKE.get(low, low)
        base = low if low.isascii() else unicodedata.normalize("NFKD", low)[0].lower()
        base = LOOK_ALIKE.get(base, base)
        if base.isalpha():
            to[c], kind[c] = ord(base), LETTER
        elif chr(c) in DIGITS or base in DIGITS:
            to[c], kind[c] = ord(DIGITS.get(chr(c)) or DIGITS[base]), DIGIT
        elif chr(c) in SIGNS:
            to[c], kind[c] = ord(SIGNS[chr(c)]), SIGN
    return to, kind


def fold(text: str) -> str:
    """The folded text, character by character without the dropped ones, between two blanks."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    to, kinds = _fold_table()
    codes = codes[kinds[codes] != DROPPED]
    out, kind = to[codes], kinds[codes]
    n = len(kind)
    if (kind == SIGN).any():                          # a sign needs a letter or digit after it
        place = np.where(kind == SIGN, n - 1, np.arange(n))
        after = np.minimum.accumulate(place[::-1])[::-1]
        solid = (kind == LETTER) | (kind == DIGIT)
        sign = np.flatnonzero(kind == SIGN)
        off = sign[~solid[after[sign]]]
        out[off] = 0x20
        kind[off] = 0
    if (kind == DIGIT).any() or (kind == SIGN).any():  # a word needs a true letter
        cut = np.flatnonzero(np.append(True, (kind[1:] == 0) != (kind[:-1] == 0)))
        letters = np.add.reduceat((kind == LETTER).astype(np.int32), cut)
        lost = np.repeat(letters == 0, np.diff(np.append(cut, n)))
        out[lost] = 0x20
    return out.tobytes().decode("utf-32-le")


class Lexicon:
    """Entries with weights (whole words " x ", beginnings " x"), exception phrases, and the
    curve: power of the length, slope, offset."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: tuple[float, float, float]):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                self._automaton.add_word(entry, (len(entry), w))
            for phrase in self.exceptions:
                entry = f" {phrase} "
                self._automaton.add_word(entry, (len(entry), None))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def word_weights(self, folded: str) -> dict[int, float]:
        """Heaviest entry of each word that has one, by the place of the blank before it."""
        found, free = {}, []
        if not len(self.automaton):
            return found
        for end, (size, w) in self.automaton.iter(folded):
            start = end - size + 1
            if w is None:
                free.append((start, end))
            elif w > found.get(start, 0.0):
                found[start] = w
        if free and found:                             # places inside any exception, by sorted order
            place = np.sort(np.fromiter(found, np.int64, len(found)))
            edges = np.searchsorted(place, np.array(free, np.int64))
            inside = np.cumsum(np.bincount(edges[:, 0], minlength=len(place) + 1) - np.bincount(edges[:, 1], minlength=len(place) + 1))
            for at in place[inside[:-1] > 0].tolist():
                del found[at]
        return found

    def probability(self, total, n_words):
        power, slope, offset = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * np.log1p(100.0 * total / np.maximum(1, n_words) ** power) + offset, -35, 35)))


def _sums(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Sum of weights and number of words of each text; all texts in one pass."""
    folded = [fold(t) for t in texts]
    at = np.concatenate([[0], np.cumsum([len(f) for f in folded])])
    total, n_words = np.zeros(len(texts)), np.array([len(f.split()) for f in folded], np.int64)
    found = lexicon.word_weights("".join(folded))
    if found:
        place = np.fromiter(found, np.int64, len(found))
        np.add.at(total, np.searchsorted(at, place, "right") - 1, np.fromiter(found.values(), float, len(found)))
    return total, n_words


def _ratio(t: int, c: int, toxic: float, clean: float) -> float:
    """Log-likelihood ratio of an entry in t of toxic and c of clean texts (if over-used)."""
    share = (t + c) / (toxic + clean)
    if t / toxic <= c / clean:
        return 0.0
    part = lambda k, n, p: (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)
    same = part(t, toxic, share) + part(c, clean, share) if 0 < share < 1 else 0.0
    return 2 * (part(t, toxic, t / toxic) + part(c, clean, c / clean) - same)


def one_of_each(folded: list[str], labels: list[int], rounds: int = 4) -> list[int]:
    """Places of one text of each group of near copies (same label, and one of ``rounds``
    pairs of minimum word hashes in common): copies would make any of their words look
    typical."""
    first: dict = {}
    parent = list(range(len(folded)))

    def root(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for k, (f, y) in enumerate(zip(folded, labels)):
        words = np.array([zlib.crc32(w.encode()) for w in set(f.split())] or [0], np.uint64)
        least = [int(textops.mix64(words + np.uint64(i << 32)).min()) for i in range(2 * rounds)]
        for i in range(rounds):
            other = first.setdefault((y, i, *least[2 * i:2 * i + 2]), k)
            parent[root(k)] = root(other)
    return [k for k in range(len(folded)) if root(k) == k]


def learn(texts: list[str], labels: list[int], weights: list[float], max_entries: int = MAX_ENTRIES) -> Lexicon:
    """A lexicon and its curve from labelled texts."""
    counts = (Counter(), Counter())
    sizes = [labels.count(0), labels.count(1)]
    if not min(sizes):
        return Lexicon({f" {w} ": BASE_WEIGHT for w in BASE_WORDS}, list(EXCEPTIONS), (0.5, 2.0, -4.0))
    folded = [fold(t) for t in texts]
    kept = one_of_each(folded, labels)
    texts, labels, weights, folded = ([x[k] for k in kept] for x in (texts, labels, weights, folded))
    sizes = [labels.count(0), labels.count(1)]
    for f, y in zip(folded, labels):
        words = {w for w in f.split() if len(w) >= 3}
        entries = {f" {w} " for w in words}
        entries.update(f" {w[:k]}" for w in words for k in STEMS if len(w) > k)
        counts[y].update(entries)
    learned = {}
    for entry, t in counts[1].items():
        c = counts[0][entry]
        if t >= 3 and _ratio(t, c, sizes[1], sizes[0]) >= SIGNIFICANT:
            w = math.log((t + 0.5) / (sizes[1] + 1)) - math.log((c + 0.5) / (sizes[0] + 1))
            if w >= 1.5:
                learned[entry] = w
    best = sorted(learned.items(), key=lambda e: (-e[1], e[0]))[:max_entries]
    lexicon = Lexicon({f" {w} ": BASE_WEIGHT for w in BASE_WORDS} | dict(best), list(EXCEPTIONS), (0.5, 2.0, -4.0))
    pairs = (Counter(), Counter())
    for f, y in zip(folded, labels):
        words = f.split()
        found = lexicon.word_weights(f)
        if found:
            place = {at: k for k, at in enumerate(i for i in range(len(f) - 1) if f[i] == " " and f[i + 1] != " ")}
            for at in found:
                k = place[at]
                pairs[y].update({" ".join(words[k:k + 2]), " ".join(words[max(0, k - 1):k + 1])})
    lexicon.exceptions += sorted(p for p, n in pairs[0].items() if n >= 5 and not pairs[1][p] and " " in p)
    lexicon._automaton = None
    total, n_words = _sums(texts, lexicon)
    y, w = np.array(labels, float), np.array(weights)
    best_fit = None
    for power in POWERS:
        x = np.log1p(100.0 * total / np.maximum(1, n_words) ** power)
        design, beta = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
        for _ in range(30):                            # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
            step = np.linalg.solve(design.T @ (design * (w * p * (1 - p))[:, None]) + 0.5 * np.eye(2), design.T @ (w * (p - y)) + 0.5 * beta)
            beta -= np.clip(step, -2, 2)
        p = np.clip(1 / (1 + np.exp(-np.clip(design @ beta, -35, 35))), 1e-9, 1 - 1e-9)
        loss = -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
        key = (float((w * ((p >= 0.5) != (y == 1))).sum()), loss)      # wrong at 0.5, then likelihood
        if best_fit is None or key < best_fit[0]:
            best_fit = (key, (power, float(beta[0]), float(beta[1])))
    lexicon.curve = best_fit[1]
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, max_entries: int = MAX_ENTRIES) -> Lexicon:
    """The lexicon from at most 2 * per_class labelled rows, learned in one task."""
    prepare(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, per_class)

    def run(batches):
        texts, ys, ws = [], [], []
        for batch in batches:
            texts += [t or "" for t in batch.column(0).to_pylist()]
            ys += batch.column(1).to_pylist()
            ws += batch.column(2).to_pylist()
        lex = learn(texts, ys, ws, max_entries)
        entries = [*lex.weights.items(), *((p, 0.0) for p in lex.exceptions), *zip(("power", "slope", "offset"), lex.curve)]
        kinds = ["entry"] * len(lex.weights) + ["exception"] * len(lex.exceptions) + ["curve"] * 3
        yield pa.record_batch([pa.array(kinds), pa.array([e[0] for e in entries]), pa.array([float(e[1]) for e in entries])], names=["kind", "entry", "w"])

    rows = sample.repartition(1).sortWithinPartitions("order").mapInArrow(run, "kind string, entry string, w double").collect()
    if not rows:
        return learn([], [], [])
    curve = {e: w for k, e, w in rows if k == "curve"}
    return Lexicon({e: w for k, e, w in rows if k == "entry"}, [e for k, e, _ in rows if k == "exception"], (curve["power"], curve["slope"], curve["offset"]))


def _scores(column, lexicon: Lexicon) -> np.ndarray:
    out, texts, size, lo = [], [], 0, 0
    for text in column:
        text = text.as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= PIECE:
            out.append(lexicon.probability(*_sums(texts, lexicon)))
            texts, size = [], 0
    out.append(lexicon.probability(*_sums(texts, lexicon)) if texts else np.empty(0))
    return np.concatenate(out)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score: the probability that a whole text is toxic."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    narrow = docs.select(*keep, F.col(text_col).alias("text__"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]), "score double"])
    names = [*narrow.columns[:-1], "score"]

    def run(batches):
        for batch in batches:
            yield pa.record_batch([*batch.columns[:-1], pa.array(_scores(batch.column(len(keep)), shared.value))], names=names)

    return narrow.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = score(docs, fit(docs, labels, label, **options))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
