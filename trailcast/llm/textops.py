"""Vectorised helpers on the text buffers of Arrow batches (numpy only, no Spark)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Odd multipliers of the two polynomial hashes (modulo 2**64).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All text of an Arrow string column as one byte array, and n+1 offsets into it.
    A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int):
    """Ranges (lo, hi) of consecutive texts of about ``limit`` bytes together; a text that
    is longer alone makes a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def column(b):
        out = np.full(size, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return column(base), column(pow(base, -1, 1 << 64))


def prefix_hashes(symbols: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of sum(symbol * base**i) modulo 2**64 and the inverse powers, for
    :func:`span_hashes`."""
    n = len(symbols)
    size = 1 << max(18, n.bit_length())
    power, inverse = _powers(BASES[which], size)
    out = np.zeros(len(symbols) + 1, np.uint64)
    terms = symbols.astype(np.uint64)
    terms += np.uint64(1)
    terms *= power[:len(symbols)]
    np.cumsum(terms, out=out[1:])
    return out, inverse


def span_hashes(prefix: np.ndarray, inverse: np.ndarray, starts, ends) -> np.ndarray:
    """Hash of each span [start, end): equal spans have equal hashes wherever they are."""
    return (prefix[ends] - prefix[starts]) * inverse[starts]


def mix64(h: np.ndarray) -> np.ndarray:
    """Bit mixer, so that order and low bits of a polynomial hash look random."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _word_table() -> np.ndarray:
    """1 for the bytes of a word of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lowered."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    table[0x80:] = True
    return table


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


WORD_BYTE, LOWER = _word_table(), _lower_table()


def spans_of(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True in ``mask`` that don't cross the texts given by ``offsets``."""
    if not len(mask):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inner = offsets[(offsets > 0) & (offsets < len(mask))]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    first[inner] = mask[inner]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    last[inner - 1] = mask[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray):
    """Words of :data:`WORD_BYTE` in lowered texts: (64-bit hash of each word, index of each
    text's first word, n+1 values)."""
    starts, ends = spans_of(WORD_BYTE[data], offsets)
    prefix, inverse = prefix_hashes(LOWER[data])
    return mix64(span_hashes(prefix, inverse, starts, ends)), np.searchsorted(starts, offsets)


def word_list(text: str | None) -> list[str]:
    """The same words of one text, for small inputs."""
    raw = (text or "").encode("utf-8")
    data = LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends = spans_of(WORD_BYTE[data], np.array([0, len(data)]))
    low = data.tobytes()
    return [low[s:e].decode("utf-8") for s, e in zip(starts.tolist(), ends.tolist())]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)
