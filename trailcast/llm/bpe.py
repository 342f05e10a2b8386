"""BPE encoding and decoding by a contiguous rank array (dealt operator 5).

A word is held as its parts' boundaries with the merge rank of each adjacent pair beside
them, in one small array. The array is scanned for its minimum, that boundary is deleted and
the ranks of the two neighbouring pairs are refreshed, until no pair has a rank. Long words
(``HEAP_PARTS`` parts and more) keep the same order of merges with a heap, so that a word of
a million characters takes no quadratic time.

Texts are cut into words for a whole Arrow batch at once: characters are classed by their
Unicode category, word borders and two 64-bit hashes of every word come from numpy, and each
distinct word of the batch is merged once, all distinct words of a length side by side.

Defined cases: a null text is an empty text; an empty text has no ids and decodes to an
empty text; rows are independent, so repeated rows and ties give repeated results; an empty
table gives an empty table; of clashing extra columns only the named id and text columns are
read."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from trailcast.llm import textops
from trailcast.llm.scratch import prepare

NO_RANK = 1 << 60
HEAP_PARTS = 128
NO_RANK32 = np.int32((1 << 31) - 1)
SHORT_BYTES = 40
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Lower case of letters that Unicode 16 added, which str.lower() of older
#: Python versions leaves as they are.
NEW_LOWER = {0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
             **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}}
NEW_UPPER = re.compile("[" + "".join(map(chr, NEW_LOWER)) + "]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stands for
    itself, the others follow from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in keep else chr(0x100 + extra))
        extra += b not in keep
    return out


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other, by the Unicode
    version of the tokenizers library."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    place = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for _, (lo, hi) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            table[place[lo:hi]] = kind
    return table


def merge_parts(parts: list[int], merges: dict) -> list[int]:
    """Ids after all merges. ``merges``: (left, right) -> (rank, merged id)."""
    if len(parts) >= HEAP_PARTS:
        return _merge_long(parts, merges)
    none = (NO_RANK, -1)
    parts = list(parts)
    near = [merges.get(p, none) for p in zip(parts, parts[1:])]
    while near:
        least = min(near)
        if least[0] == NO_RANK:
            break
        i = near.index(least)
        parts[i:i + 2] = [least[1]]
        del near[i]
        if i:
            near[i - 1] = merges.get((parts[i - 1], parts[i]), none)
        if i < len(near):
            near[i] = merges.get((parts[i], parts[i + 1]), none)
    return parts


def _merge_long(parts: list[int], merges: dict) -> list[int]:
    n = len(parts)
    parts, left, right = list(parts), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(*m, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := merges.get((parts[i], parts[i + 1])))]
    heap = [(rank, i, a, b, new) for rank, new, i, a, b in heap]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = right[i] if parts[i] == a else n
        if j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = new, -1
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y < n and (m := merges.get((parts[x], parts[y]))):
                heapq.heappush(heap, (m[0], x, parts[x], parts[y], m[1]))
    return [p for p in parts if p >= 0]


class PairRanks:
    """Rank and merged id of adjacent ids, looked up for whole arrays at once."""

    def __init__(self, merges: dict):
        pairs = np.array(list(merges), np.int64).reshape(-1, 2)
        key = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(key)
        self.key = np.append(key[order], np.int64(-1))
        self.rank = np.append(np.array([m[0] for m in merges.values()], np.int32)[order], NO_RANK32)
        self.merged = np.zeros(1 + max((m[0] for m in merges.values()), default=0), np.int32)
        for rank, new in merges.values():
            self.merged[rank] = new

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.key[:-1], key)
        return np.where(self.key[at] == key, self.rank[at], NO_RANK32)


def merge_words(parts: np.ndarray, ranks: PairRanks):
    """Merge many short words of the same number of parts, a row each: rows hold the parts
    and beside them the ranks of adjacent pairs. Each pass scans every row for its (first)
    minimum, deletes that boundary and refreshes the ranks of the two neighbouring pairs.
    Yields (rows, their final parts) as rows come to an end."""
    rows = np.arange(len(parts))
    if parts.shape[1] > 1:
        near = ranks(parts[:, :-1], parts[:, 1:])
    while len(rows) and parts.shape[1] > 1:
        at = near.argmin(1)
        least = near[np.arange(len(rows)), at]
        ended = least == NO_RANK32
        if ended.any():
            yield rows[ended], parts[ended]
            go = ~ended
            rows, parts, near, at, least = rows[go], parts[go], near[go], at[go], least[go]
            if not len(rows):
                return
        each = np.arange(len(rows))
        parts[each, at] = ranks.merged[least]
        columns = np.arange(parts.shape[1] - 1)
        parts = np.take_along_axis(parts, columns + (columns > at[:, None]), 1)
        columns = columns[:-1]
        near = np.take_along_axis(near, columns + (columns >= at[:, None]), 1)
        left = np.flatnonzero(at > 0)
        near[left, at[left] - 1] = ranks(parts[left, at[left] - 1], parts[left, at[left]])
        right = np.flatnonzero(at < near.shape[1])
        near[right, at[right]] = ranks(parts[right, at[right]], parts[right, at[right] + 1])
    if len(rows):
        yield rows, parts


class Vocabulary:
    """Merge ranks, word rules and special tokens of a tokenizer file with a BPE model and
    byte-level symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], json.dumps(spec.get("pre_tokenizer"))
        if model["type"] != "BPE" or '"ByteLevel"' not in pre:
            raise ValueError(f"{path}: only BPE models over byte-level symbols are supported")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.normalise = "Lowercase" in json.dumps(spec.get("normalizer"))
        #: True: white space belongs to the words (a blank before a word is its first character).
        self.keeps_space = not self.suffix
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in {**self.ids, **self.special}.items():
            self.tokens[i] = token
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.ranks = PairRanks(self.merges)
        self.first = np.full((2, 256), -1, np.int32)      # of a byte inside a word, and at its end
        for b, c in enumerate(self.symbols):
            self.first[0, b], self.first[1, b] = self.ids.get(c, -1), self.ids.get(c + self.suffix, -1)

    def encode_word(self, word: str) -> tuple[int, ...]:
        chars = [self.symbols[b] for b in word.encode("utf-8")]
        if chars:
            chars[-1] += self.suffix
        parts = [i for c in chars if (i := self.ids.get(c)) is not None]
        return tuple(merge_parts(parts, self.merges))

    def normal(self, text: str) -> str:
        if not self.normalise:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if NEW_UPPER.search(text):
                text = text.translate(NEW_LOWER)
        return text.lower()

    def decode(self, ids) -> str:
        """Text of ids, special tokens included: tokens joined by a blank, or the bytes they
        stand for where the file asks for byte decoding."""
        tokens = map(self.tokens.__getitem__, ids)
        if not self.byte_decoder:
            return " ".join(tokens)
        back = {c: b for b, c in enumerate(self.symbols)}
        raw = b"".join(bytes(back[c] for c in t) if t not in self.special else t.encode() for t in tokens)
        return raw.decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def word_starts(codes: np.ndarray, offsets: np.ndarray, keeps_space: bool):
    """Starts and ends of the words of all texts (code points, n+1 offsets), contractions
    not yet cut off. With ``keeps_space`` a blank before a word is part of it and other
    white space makes words; without, white space is dropped and each number stands alone."""
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = char_classes()[codes]
    first = np.empty(len(kind), bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    borders = offsets[(offsets > 0) & (offsets < len(codes))]
    first[borders] = True
    if not keeps_space:
        if (kind == NUMBER).any():
            first |= kind == NUMBER
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(codes))
        solid = kind[starts] != SPACE
        return starts[solid], ends[solid]
    run = np.flatnonzero(first)
    blank = kind[run] == SPACE
    at_text = np.zeros(len(codes), bool)
    at_text[borders] = True
    at_text[0] = True
    # the last character of white space before a word: part of it, or a word of its own
    solid = run[~blank]
    after = solid[~at_text[solid]]
    after = after[kind[after - 1] == SPACE] - 1
    joined = after[codes[after] == 0x20] + 1
    first[after] = True
    first[joined] = False
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], len(codes))


def cut_contractions(text: str, starts: list, ends: list) -> tuple[list, list]:
    """Cut 's, 't, 're, 've, 'm, 'll and 'd off words that begin with an apostrophe."""
    out_s, out_e, skip = [], [], -1
    for s, e in zip(starts, ends):
        if s < skip:                  # its first letters went to a contraction
            s = skip
            if s >= e:
                continue
        if text[s] == "'":
            while s < e or s == e:
                hit = next((c for c in CONTRACTIONS if text.startswith(c, s)), None)
                break
            if hit and e == s + 1:    # the apostrophe alone, its letters are the next word
                out_s.append(s)
                out_e.append(s + len(hit))
                skip = s + len(hit)
                continue
        out_s.append(s)
        out_e.append(e)
    return out_s, out_e


def encode_texts(texts: list[str], vocab: Vocabulary, encoder=None):
    """Ids of all texts as one int32 array and n+1 offsets into it. ``encoder``: gives the
    ids of a list of distinct words (default: the vocabulary's own merges)."""
    plain, special = [], {}
    for k, text in enumerate(texts):
        if vocab.split_special and "<|" in text:
            parts = vocab.split_special.split(text)
            if len(parts) > 1:
                special[k] = parts
                text = ""
        plain.append(vocab.normal(text))
    ids, offsets = _encode_plain(plain, vocab, encoder)
    if not special:
        return ids, offsets
    chunks = [ids[offsets[k]:offsets[k + 1]] for k in range(len(texts))]
    for k, parts in special.items():
        own, at = _encode_plain([vocab.normal(p) if p not in vocab.special else "" for p in parts], vocab, encoder)
        chunks[k] = np.concatenate([np.array([vocab.special[p]], np.int32) if p in vocab.special else own[at[i]:at[i + 1]] for i, p in enumerate(parts)])
    sizes = np.array([len(c) for c in chunks], np.int64)
    return np.concatenate(chunks), np.concatenate([[0], np.cumsum(sizes)])


def _encode_plain(texts: list[str], vocab: Vocabulary, encoder):
    joined = "".join(texts)
    if not joined:
        return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends = word_starts(codes, chars, vocab.keeps_space)
    if "'" in joined:
        starts, ends = _with_contractions(joined, chars, starts, ends)
    distinct, kind = _distinct(codes, starts, ends)
    if encoder:
        each = encoder([joined[s:e] for s, e in zip(starts[distinct].tolist(), ends[distinct].tolist())])
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((i for ids in each for i in ids), np.int32, int(sizes.sum()))
    else:
        flat, sizes = _merge_distinct(joined, codes, starts[distinct], ends[distinct], vocab)
    at = np.cumsum(sizes) - sizes
    per_word = sizes[kind]
    out = flat[textops.ranges(at[kind], per_word)]
    total = np.concatenate([[0], np.cumsum(per_word)])
    return out, total[np.searchsorted(starts, chars)]


def _merge_distinct(joined, codes, starts, ends, vocab):
    """Ids of distinct words: short ones by length, all of a length together."""
    if joined.isascii():
        raw = codes.astype(np.uint8)
        lo, hi = starts, ends
    else:
        raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        before = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), out=before[1:])
        lo, hi = before[starts], before[ends]
    length = hi - lo
    sizes = np.zeros(len(lo), np.int64)
    rows_done, ids_done = [], []

    def done(rows, ids, size):
        sizes[rows] = size
        rows_done.append(np.repeat(rows, size))
        ids_done.append(ids)

    whole = (vocab.first >= 0).all()
    order = np.argsort(length, kind="stable")
    cuts = np.searchsorted(length[order], np.arange(1, SHORT_BYTES + 2))
    for n in range(1, SHORT_BYTES + 1) if whole else ():
        rows = order[cuts[n - 1]:cuts[n]]
        if len(rows):
            bytes_ = raw[lo[rows][:, None] + np.arange(n)]
            parts = vocab.first[0][bytes_]
            parts[:, -1] = vocab.first[1][bytes_[:, -1]]
            for own, ids in merge_words(parts, vocab.ranks):
                done(rows[own], ids.reshape(-1), ids.shape[1])
    for k in order[cuts[SHORT_BYTES] if whole else 0:].tolist():
        ids = vocab.encode_word(joined[starts[k]:ends[k]])
        done(np.array([k]), np.array(ids, np.int32), len(ids))
    if not rows_done:
        return np.empty(0, np.int32), sizes
    rows = np.concatenate(rows_done)
    return np.concatenate(ids_done)[np.argsort(rows, kind="stable")], sizes


def _with_contractions(joined, chars, starts, ends):
    """Only texts with an apostrophe are looked at word by word."""
    first = np.searchsorted(starts, chars)
    out_s, out_e, done = [], [], 0
    hits, at = set(), joined.find("'")
    while at >= 0:
        k = int(np.searchsorted(chars, at, "right")) - 1
        hits.add(k)
        at = joined.find("'", int(chars[k + 1]))
    for k in sorted(hits):
        a, b = int(first[k]), int(first[k + 1])
        lo, hi = int(chars[k]), int(chars[k + 1])
        out_s.append(starts[done:a])
        out_e.append(ends[done:a])
        s, e = cut_contractions(joined[lo:hi], (starts[a:b] - lo).tolist(), (ends[a:b] - lo).tolist())
        out_s.append(np.array(s, np.int64) + lo)
        out_e.append(np.array(e, np.int64) + lo)
        done = b
    out_s.append(starts[done:])
    out_e.append(ends[done:])
    return np.concatenate(out_s), np.concatenate(out_e)


def _distinct(codes, starts, ends):
    """Positions of one word of each kind, and the kind of every word. Words are told apart
    by two independent 64-bit hashes and their length."""
    prefix, inverse = textops.prefix_hashes(codes, 0)
    first = textops.span_hashes(prefix, inverse, starts, ends)
    prefix, inverse = textops.prefix_hashes(codes, 1)
    second = textops.span_hashes(prefix, inverse, starts, ends)
    _, distinct, kind = np.unique(first, return_index=True, return_inverse=True)
    same = (second[distinct][kind] == second) & ((ends - starts)[distinct][kind] == ends - starts)
    if not same.all():                # two words share the first hash
        both = np.stack([first, second, (ends - starts).astype(np.uint64)], 1)
        _, distinct, kind = np.unique(both, axis=0, return_index=True, return_inverse=True)
    return distinct, kind.reshape(-1)


OUT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with n_tokens and ids of every whole text. ``path``: the tokenizer
    file, which every executor must have."""
    prepare(docs.sparkSession)
    narrow = docs.select(*keep, F.col(text_col).alias("text__"))
    schema = T.StructType([*narrow.schema.fields[:-1], *OUT.fields])

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for lo, hi, ids, at in _encoded(batch.column(len(keep)), vocab):
                yield pa.record_batch([*(batch.column(c).slice(lo, hi - lo) for c in range(len(keep))), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], names=schema.names)

    return narrow.mapInArrow(run, schema)


def _encoded(column, vocab, encoder=None, limit: int = 1000 << 10):
    _, offsets = textops.text_bytes(column)
    for lo, hi in textops.pieces(offsets, limit):
        texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        yield lo, hi, *encode_texts(texts, vocab, encoder)


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns with ``decoded``: the text that the ids stand for."""
    prepare(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    at = rows.columns.index(ids_col)

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = [vocab.decode(ids or ()) for ids in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again: ``keep`` columns, n_tokens,
    ids_sha256 (decimal ids joined by a blank), decoded_sha256, and ids if asked for."""
    prepare(docs.sparkSession)
    narrow = docs.select(*keep, F.col(text_col).alias("text__"))
    extra = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    extra += [OUT.fields[1]] * with_ids
    schema = T.StructType([*narrow.schema.fields[:-1], *extra])

    def run(batches):
        vocab = vocabulary(path)
        decimal = [str(i) for i in range(len(vocab.tokens))]
        for batch in batches:
            for lo, hi, ids, at in _encoded(batch.column(len(keep)), vocab):
                flat, at_list = ids.tolist(), at.tolist()
                sums, texts = [], []
                for a, b in zip(at_list, at_list[1:]):
                    own = flat[a:b]
                    sums.append(hashlib.sha256(" ".join(map(decimal.__getitem__, own)).encode()).hexdigest())
                    texts.append(hashlib.sha256(vocab.decode(own).encode("utf-8")).hexdigest())
                cols = [*(batch.column(c).slice(lo, hi - lo) for c in range(len(keep))), pa.array(np.diff(at)), pa.array(sums, pa.string()), pa.array(texts, pa.string())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)))
                yield pa.record_batch(cols, names=schema.names)

    return narrow.mapInArrow(run, schema)


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file: in ``$TOKENIZER_DIR`` or the installed package."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)
