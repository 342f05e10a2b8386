"""Benchmark decontamination over a positional inverted index (dealt operator 3).

The index is cut by documents into shards of about ``shard_words`` words. A shard is one row:
for every benchmark term that occurs in its documents, the sorted list of the term's word
positions (stored as gaps). Documents are laid out one after another with a hole as long as
the longest window between them, so no match crosses a border. Phrases are found per shard:
the postings of a window's rarest term, less its offset in the window, are the candidate
starts; they are intersected with the offset-adjusted postings of the next rarest term, and
so on. Proximity search takes the same lists: all terms of a query within ``span`` words in
any order, again from the rarest term.

How rare a term is comes from the index itself, over all documents. The benchmark is a
stated query set, searched in blocks: a job cuts long items into pieces of at most ``PIECE_BYTES``
(overlapping by a window less a word, so no window is lost) and deals pieces by hash over as
many blocks as give about ``block_bytes`` each. The driver and the tasks hold one block at a
time, however large the benchmark is. The documents are read once, for one index: of
the block's own terms, or, for several blocks, of all words whose hash is set in a bit map of
fixed size that a job has made from all items. Each block then reads the index, and the blocks'
hits are united per document.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered; a term is the
64-bit hash of a word. Defined cases: null and empty texts have no words and no hits; empty
items match nothing; an item without an id marks words, but has no id to count or list;
equal items are separate items; equal rows get equal results; an empty
benchmark gives rows without hits; only the named columns are read."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailcast.llm import textops
from trailcast.llm.scratch import Scratch

WINDOW = 13
SHARD_WORDS = 400_000
BLOCK_BYTES = 3 << 20
PIECE_BYTES = 1 << 16
MAP_BITS = 24                  # the bit map of several blocks' terms: 2 MB
CANDIDATES = 1 << 20
INDEX = "rows array<long>, n_words array<int>, terms array<long>, counts array<int>, gaps array<int>"


class Windows:
    """The windows of a block of items: term numbers, and the items each window is from."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        data = [(t or "").encode("utf-8") for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        hashes, first = textops.words(np.frombuffer(b"".join(data), np.uint8), offsets)
        self.terms, numbers = np.unique(hashes, return_inverse=True)
        self.window = window
        by_words: dict[bytes, list] = {}
        for k, (item, _) in enumerate(items):
            own = numbers[first[k]:first[k + 1]].astype(np.int32)
            for at in range(max(1, len(own) - window + 1) if len(own) else 0):
                by_words.setdefault(own[at:at + window].tobytes(), []).append(item)
        self.words = [np.frombuffer(w, np.int32) for w in by_words]
        self.items = [sorted(set(x) - {None}) for x in by_words.values()]

    def by_rarity(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms and offsets of each window from the rarest on (padded with -1), lengths."""
        size = np.array([len(w) for w in self.words], np.int64)
        terms = np.full((len(size), self.window), -1, np.int64)
        offsets = np.zeros((len(size), self.window), np.int64)
        for k, w in enumerate(self.words):
            order = np.lexsort((np.arange(len(w)), counts[w]))
            terms[k, :len(w)], offsets[k, :len(w)] = w[order], order
        return terms, offsets, size


def pieces_of(text: str | None, window: int, limit: int) -> list[str]:
    """A text in pieces of at most about ``limit`` bytes (and a window of words) that hold all
    its windows: each but the first begins with the last window - 1 words of the one before."""
    if len(text or "") <= limit // 4 or len((text or "").encode("utf-8", "ignore")) <= limit:
        return [text or ""]
    words = textops.word_list(text)
    ends = np.cumsum([len(w.encode("utf-8")) + 1 for w in words])
    out, lo = [], 0
    while True:
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right"))
        hi = min(len(words), max(hi, lo + window))
        out.append(" ".join(words[lo:hi]))
        if hi == len(words):
            return out
        lo = hi - window + 1


def deal_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """The items' pieces (item, text, block) as a table, and the number of blocks."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):              # pieces of one item at a time
                out = pieces_of(batch.column(1)[row].as_py(), window, PIECE_BYTES)
                yield pa.record_batch([pa.array([batch.column(0)[row].as_py()] * len(out), batch.column(0).type), pa.array(out, pa.string())], names=["item", "text"])

    kind = dict(benchmark.dtypes)[id_col]
    narrow = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("length(text) > 0")
    pieces = scratch.write(narrow.mapInArrow(run, f"item {kind}, text string"), "pieces")
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    return pieces.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), blocks


def term_map(pieces: DataFrame) -> np.ndarray:
    """A bit for the upper bits of each term's hash, united over all pieces: fixed size."""
    size = 1 << MAP_BITS

    def run(batches):
        seen = np.zeros(size, bool)
        for batch in batches:
            data, offsets = textops.text_bytes(batch.column(0))
            seen[(textops.words(data, offsets)[0] >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True
        packed = np.packbits(seen).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(packed[at])], names=["at", "bits"])

    out = np.zeros(size // 64, np.int64)
    for at, bits in pieces.select("text").mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).collect():
        out[at] = bits                                     # at most 2 ** MAP_BITS / 64 rows
    return np.unpackbits(out.view(np.uint8)).astype(bool)


def build_index(docs: DataFrame, terms: np.ndarray | None, hole: int, scratch: Scratch, label: str, shard_words: int = SHARD_WORDS, seen: np.ndarray | None = None) -> DataFrame:
    """Store the postings of ``terms`` (sorted hashes), or of all words in the bit map ``seen``, in
    all texts: one row per shard, terms by hash. ``docs`` has columns row (long) and text."""
    if seen is None:
        near = np.zeros(1 << 16, bool)
        near[(terms >> np.uint64(48)).astype(np.int64)] = True
        shift = np.uint64(48)
    else:
        near, shift = seen, np.uint64(64 - MAP_BITS)

    def shard(rows, sizes, places, numbers):
        rows, sizes = np.concatenate(rows), np.concatenate(sizes)
        places, numbers = np.concatenate(places), np.concatenate(numbers)
        order = np.argsort(numbers, kind="stable")
        places, numbers = places[order], numbers[order]
        present, start, counts = np.unique(numbers, return_index=True, return_counts=True)
        gaps = np.diff(places, prepend=0)
        gaps[start] = places[start]
        one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
        return pa.record_batch([one(rows, pa.int64()), one(sizes, pa.int32()), one(present.view(np.int64), pa.int64()), one(counts, pa.int32()), one(gaps, pa.int32())], names=["rows", "n_words", "terms", "counts", "gaps"])

    def run(batches):
        rows, sizes, places, numbers, base = [], [], [], [], 0
        for batch in batches:
            data, offsets = textops.text_bytes(batch.column(1))
            own_rows = batch.column(0).to_numpy()
            for lo, hi in textops.pieces(offsets, 1000 << 10):
                at = offsets[lo:hi + 1]
                hashes, first = textops.words(data[at[0]:at[-1]], at - at[0])
                n = np.diff(first)
                starts = base + np.cumsum(n + hole) - (n + hole)
                base += int(n.sum()) + hole * len(n)
                word = np.flatnonzero(near[(hashes >> shift).astype(np.int64)])
                if terms is not None:
                    number = np.searchsorted(terms, hashes[word])
                    number[number == len(terms)] = 0
                    word = word[terms[number] == hashes[word]] if len(terms) else word[:0]
                doc = np.searchsorted(first, word, "right") - 1
                rows.append(own_rows[lo:hi])
                sizes.append(n.astype(np.int32))
                places.append((starts[doc] + word - first[doc]).astype(np.int64))
                numbers.append(hashes[word])
                if base >= shard_words:
                    yield shard(rows, sizes, places, numbers)
                    rows, sizes, places, numbers, base = [], [], [], [], 0
        if rows:
            yield shard(rows, sizes, places, numbers)

    return scratch.write(docs.select("row", "text").mapInArrow(run, INDEX), label)


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Occurrences of each of a block's terms over all documents."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                number, own = _known(batch.column(2)[k].values.to_numpy().view(np.uint64), terms)
                yield pa.record_batch([pa.array(number, pa.int32()), pa.array(batch.column(3)[k].values.to_numpy()[own].astype(np.int64))], names=["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for term, n in index.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def _known(hashes: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number in ``terms``, place) of the hashes that are terms; both lists are sorted."""
    if not len(terms):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    number = np.searchsorted(terms, hashes)
    number[number == len(terms)] = 0
    own = np.flatnonzero(terms[number] == hashes)
    return number[own], own


class Shard:
    """A shard's postings, for lookups of (term, position)."""

    def __init__(self, rows, n_words, terms, counts, gaps, n_terms: int, hole: int):
        self.rows, self.n_words, self.hole = rows, n_words.astype(np.int64), hole
        step = self.n_words + hole
        self.base = np.cumsum(step) - step
        self.length = int(step.sum()) + hole
        self.first = np.zeros(n_terms + 1, np.int64)
        self.first[terms.astype(np.int64) + 1] = counts
        self.first = np.cumsum(self.first)
        places = np.cumsum(gaps.astype(np.int64))
        begin = np.cumsum(counts) - counts
        before = np.where(begin > 0, places[begin - 1], 0) if len(begin) else begin
        self.places = places - np.repeat(before, counts)
        self.keys = np.repeat(terms.astype(np.int64), counts) * self.length + self.places

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        key = terms * self.length + places
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return (self.keys[at] == key) & (places >= 0) if len(self.keys) else np.zeros(len(key), bool)

    def within(self, terms: np.ndarray, places: np.ndarray, span: int) -> np.ndarray:
        """Whether a term occurs at places..places + span - 1."""
        low = np.searchsorted(self.keys, terms * self.length + np.maximum(places, 0))
        high = np.searchsorted(self.keys, terms * self.length + np.minimum(places + span, self.length))
        return high > low

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, places, "right") - 1


def _seeds(shard: Shard, terms: np.ndarray, offsets: np.ndarray, limit: int):
    """Candidate (window, start) from the rarest terms, in runs of at most about ``limit``."""
    rare = terms[:, 0]
    number = shard.first[rare + 1] - shard.first[rare]
    some = np.flatnonzero(number)
    total = np.cumsum(number[some])
    lo = 0
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limit, "right")))
        own = some[lo:hi]
        at = textops.ranges(shard.first[rare[own]], number[own])
        window = np.repeat(own, number[own])
        yield window, shard.places[at] - offsets[window, 0]
        lo = hi


def phrase_starts(shard: Shard, terms, offsets, sizes, limit: int = CANDIDATES):
    """All (window, start) whose words are exactly the window's."""
    out = []
    for window, start in _seeds(shard, terms, offsets, limit):
        for k in range(1, terms.shape[1]):
            more = sizes[window] > k
            ok = ~more
            at = np.flatnonzero(more)
            ok[at] = shard.has(terms[window[at], k], start[at] + offsets[window[at], k])
            window, start = window[ok], start[ok]
        out.append((window, start))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def near_starts(shard: Shard, terms, sizes, span: int, limit: int = CANDIDATES):
    """All (window, start) such that every term of the window occurs in the ``span`` words
    from ``start``, which is the place of one of them; in any order."""
    out = []
    for window, seed in _seeds(shard, terms, np.zeros_like(terms), limit):
        for back in range(span):
            own, start = window, seed - back
            for k in range(terms.shape[1]):
                more = sizes[own] > k
                ok = ~more
                at = np.flatnonzero(more)
                ok[at] = shard.within(terms[own[at], k], start[at], span)
                own, start = own[ok], start[ok]
            first = np.zeros(len(own), bool)
            for k in range(terms.shape[1]):
                at = np.flatnonzero(sizes[own] > k)
                first[at] |= shard.has(terms[own[at], k], start[at])
            out.append((own[first], start[first]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*out)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _shards(batches, block_terms, hole):
    """The shards of an index, with the postings of a block's terms by their numbers."""
    for batch in batches:
        for k in range(batch.num_rows):
            rows, n_words, terms, counts, gaps = (batch.column(c)[k].values.to_numpy() for c in range(5))
            number, own = _known(terms.view(np.uint64), block_terms)
            if len(own) < len(terms):
                begin = np.cumsum(counts.astype(np.int64)) - counts
                gaps = gaps[textops.ranges(begin[own], counts[own].astype(np.int64))]
                counts = counts[own]
            yield Shard(rows, n_words, number, counts, gaps, len(block_terms), hole)


HITS = "row long, n_words long, starts array<int>, ends array<int>, items array<long>"


def _document_hits(index: DataFrame, windows: Windows, counts: np.ndarray, hole: int) -> DataFrame:
    """Per document row: its words, the maximal runs of hit words and the items that hit."""
    terms, offsets, sizes = windows.by_rarity(counts)
    item_at = np.concatenate([[0], np.cumsum([len(x) for x in windows.items])]).astype(np.int64)
    item_of = np.array([i for x in windows.items for i in x], np.int64)
    block_terms = windows.terms

    def run(batches):
        for shard in _shards(batches, block_terms, hole):
            window, start = phrase_starts(shard, terms, offsets, sizes)
            cover = np.zeros(shard.length + 1, np.int32)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + sizes[window], -1)
            lo, hi = textops.spans_of(np.cumsum(cover) > 0, np.zeros(1, np.int64))
            doc = shard.doc(start)
            number = item_at[window + 1] - item_at[window]
            pairs = np.stack([np.repeat(doc, number), item_of[textops.ranges(item_at[window], number)]], 1)
            pairs = np.unique(pairs, axis=0)
            n = len(shard.rows)
            run_doc = shard.doc(lo)
            at_run = np.searchsorted(run_doc, np.arange(n + 1)).astype(np.int32)
            at_item = np.searchsorted(pairs[:, 0], np.arange(n + 1)).astype(np.int32)
            base = shard.base[run_doc]
            lists = lambda at, x, t: pa.ListArray.from_arrays(pa.array(at), pa.array(x, t))
            yield pa.record_batch([pa.array(shard.rows), pa.array(shard.n_words), lists(at_run, lo - base, pa.int32()), lists(at_run, hi - base, pa.int32()), lists(at_item, pairs[:, 1], pa.int64())], names=["row", "n_words", "starts", "ends", "items"])

    return index.mapInArrow(run, HITS)


def document_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row, n_words, starts and ends (maximal runs of words inside
    occurrences of a window, end exclusive, ascending) and items (ascending ids)."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    narrow = scratch.numbered(docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text")))
    pieces, n_blocks = deal_blocks(benchmark, item_col, item_text, window, block_bytes, scratch)
    index = build_index(narrow, None, window, scratch, "index", shard_words, term_map(pieces)) if n_blocks > 1 else None
    parts = []
    for k in range(n_blocks):
        windows = Windows([tuple(r) for r in pieces.where(F.col("block") == k).select("item", "text").collect()], window)
        if index is None:
            index = build_index(narrow, windows.terms, window, scratch, "index", shard_words)
        parts.append(scratch.write(_document_hits(index, windows, term_counts(index, windows.terms), window), f"hits-{k}"))
    scratch.drop("index", "pieces")
    names = narrow.drop("text")
    if len(parts) == 1:
        return names.join(parts[0], "row").select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_words", "starts", "ends", "items")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    one = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # runs of several blocks united: sorted by start, a run begins where the furthest end so far is left
    step = lambda acc, r: F.when((F.size(acc) > 0) & (r["starts"] <= F.element_at(acc, -1)["ends"]),
                                 F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["starts"].alias("starts"), F.greatest(F.element_at(acc, -1)["ends"], r["ends"]).alias("ends"))))).otherwise(F.concat(acc, F.array(r)))
    merged = F.aggregate(F.array_sort("runs"), F.expr("cast(array() as array<struct<starts:int,ends:int>>)"), step)
    one = one.withColumn("runs", merged)
    return names.join(one, "row").select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_words", F.col("runs.starts").alias("starts"), F.col("runs.ends").alias("ends"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """:func:`document_hits` with n_hit, n_items, items_sha256 (item ids sorted as strings,
    joined by commas) and contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    hits = document_hits(docs, benchmark, **options)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return (hits.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(ids, 256))
            .withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words")))


def matches(docs: DataFrame, queries: list[tuple[int, str]], span: int | None = None, text_col: str = "text", id_col: str = "doc_id", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every match of a short list of query phrases: (query, id, start word). ``span`` None:
    exact phrases; else all words of the query within ``span`` words, in any order."""
    scratch = Scratch(docs.sparkSession, "matches")
    longest = max([len(textops.word_list(t)) for _, t in queries] + [span or 1, 1])
    windows = Windows(queries, longest)
    narrow = scratch.numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    index = build_index(narrow, windows.terms, longest, scratch, "index", shard_words)
    terms, offsets, sizes = windows.by_rarity(term_counts(index, windows.terms))
    block_terms = windows.terms

    def run(batches):
        for shard in _shards(batches, block_terms, longest):
            window, start = phrase_starts(shard, terms, offsets, sizes) if span is None else near_starts(shard, terms, sizes, span)
            doc = shard.doc(start)
            for k, items in enumerate(windows.items):
                own = window == k
                for item in items:
                    n = int(own.sum())
                    yield pa.record_batch([pa.array(np.full(n, item)), pa.array(shard.rows[doc[own]]), pa.array((start - shard.base[doc])[own])], names=["query", "row", "start"])

    found = index.mapInArrow(run, "query long, row long, start long")
    return found.join(narrow.select("row", "id"), "row").select("query", F.col("id").alias(id_col), "start")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    key = F.xxhash64(F.col("text"))
    keyed = docs.select("doc_id", "text", key.alias("text_hash__"))
    bad = contamination(keyed, benchmark, keep=("doc_id", "text_hash__")).where("contaminated").select(F.col("doc_id").alias("bad_id__"), F.col("text_hash__").alias("bad_hash__")).distinct()
    return docs.join(bad, bad["bad_id__"].eqNullSafe(docs["doc_id"]) & (bad["bad_hash__"] == F.xxhash64(docs["text"])), "left_anti")
