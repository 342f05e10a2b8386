"""Exact removal of repeated byte strings by a hash-compared suffix sort (dealt operator 10).

A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else.

Where strings can repeat: in every window of ``length`` bytes the k-gram with the least hash
is its anchor (the leftmost, on ties), a choice of the window's content alone, so equal
windows have equal anchors at equal places. Consecutive windows with the same anchor form a
run. Runs are grouped by their anchor's hash; runs whose whole context is equal (a 128-bit
cryptographic digest) are one class, counted by an aggregate, so a passage that a third of
all documents share is a row before anything is compared.

What repeats: all windows of a class with several runs do. Where an anchor has several
classes, one run of each class brings its bytes, and the suffixes at its windows' starts are
sorted: mergesort whose comparisons find the common extension of two suffixes by binary
search over prefix polynomial hashes, so each takes log2(length) steps. Neighbours whose
common extension is ``length`` are compared byte by byte before they count (collisions are
verified, and a false extension makes the sort fall back to plain byte order). Anchors with
very many classes are cut into blocks by hash; each block is sorted by itself, and its
distinct windows are then matched across blocks by their digests.

Defined cases: a null text has no bytes; empty texts and texts shorter than ``length`` lose
nothing; equal rows (also with equal doc_id) are different places, so their bytes go; an
empty table gives no rows; only the named columns are read."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailcast.llm import textops
from trailcast.llm.scratch import Scratch

LENGTH = 400
GRAM = 40
BLOCK_CLASSES = 256
PIECE = 1000 << 10
SORT_BYTES = 1 << 20


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (block prefix and suffix minima)."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    full = np.append(values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    right = np.minimum.accumulate(full, 1).reshape(-1)
    left = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(left[:n - width + 1], right[width - 1:n])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor, over several texts: (text, first window, last window,
    anchor place, anchor hash), places from the text's start."""
    keep = [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)]
    if len(data) < length:
        return keep
    prefix, inverse = textops.prefix_hashes(data)
    n = len(data) - gram + 1
    grams = textops.mix64((prefix[gram:] - prefix[:n]) * inverse[:n])
    bits = np.uint64(max(1, int(n).bit_length()))
    order = (grams >> bits << bits) | np.arange(n, dtype=np.uint64)    # hash, then place
    least = _least(order, length - gram + 1)
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # the anchor is the least whole hash: mend the windows where its upper bits weren't alone
    for at in np.flatnonzero(grams[place] != _least(grams, length - gram + 1)):
        place[at] = at + np.argmin(grams[at:at + length - gram + 1])
    text = np.searchsorted(offsets, np.arange(len(place)), "right") - 1
    inside = np.arange(len(place)) + length <= offsets[text + 1]
    new = np.empty(len(place), bool)
    new[0] = True
    np.not_equal(place[1:], place[:-1], out=new[1:])
    new[1:] |= text[1:] != text[:-1]
    new[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    ok = inside[first]
    first, last = first[ok], last[ok]
    own = text[first]
    at = offsets[own]
    return own, first - at, last - at, place[first] - at, grams[place[first]]


RUNS = "row long, first int, last int, anchor int, gram long, d1 long, d2 long"


def find_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of all texts (columns row, text), with a digest of each run's context."""

    def run(batches):
        blake = hashlib.blake2b
        for batch in batches:
            data, offsets = textops.text_bytes(batch.column(1))
            rows = batch.column(0).to_numpy()
            for lo, hi in textops.pieces(offsets, PIECE):
                at = offsets[lo:hi + 1]
                text, first, last, anchor, grams = runs_of(data[at[0]:at[-1]], at - at[0], length, gram)
                if not len(text):
                    continue
                raw = memoryview(np.ascontiguousarray(data[at[0]:at[-1]]))
                base = at[text] - at[0]
                digests = [blake(raw[a:b], digest_size=16).digest() for a, b in zip((base + first).tolist(), (base + last + length).tolist())]
                pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                # the anchor's place in the run belongs to what is equal in a class
                yield pa.record_batch([pa.array(rows[lo:hi][text]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array((anchor - first).astype(np.int32)), pa.array(grams.view(np.int64)), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["row", "first", "last", "anchor", "gram", "d1", "d2"])

    return docs.select("row", "text").mapInArrow(run, RUNS)


class Suffixes:
    """Suffixes of one byte array compared by prefix polynomial hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix, self.inverse = textops.prefix_hashes(data, 1)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of suffixes a and b, at most ``length``, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length, np.int64)
        for _ in range(self.length.bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.prefix[a + middle] - self.prefix[a]) * self.inverse[a] == (self.prefix[b + middle] - self.prefix[b]) * self.inverse[b]
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts after suffix b."""
        n = self.extension(a, b)
        more = n < self.length
        out = np.zeros(len(a), bool)
        out[more] = self.data[a[more] + n[more]] > self.data[b[more] + n[more]]
        return out

    def sort(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within their groups (``group`` ascending): bottom-up
        mergesort, all pairs of runs of a level side by side."""
        order = np.arange(len(starts))
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else order
        size = np.diff(np.append(cut, len(starts)))
        within = order - np.repeat(cut, size)
        base, total = np.repeat(cut, size), np.repeat(size, size)
        width, most = 1, int(size.max(initial=0))
        while width < most:
            head = np.flatnonzero((within % (2 * width) == 0) & (within + width < total))
            left, right = head.copy(), head + width
            stop_l = right.copy()
            stop_r = np.minimum(head + 2 * width, base[head] + total[head])
            to, out = head.copy(), order.copy()
            live = np.arange(len(head))
            while len(live):
                l, r = left[live], right[live]
                take = self.after(starts[order[l]], starts[order[r]])
                out[to[live]] = np.where(take, order[r], order[l])
                left[live] += ~take
                right[live] += take
                to[live] += 1
                done = (left[live] == stop_l[live]) | (right[live] == stop_r[live])
                for k in (live[done] if done.any() else ()):
                    rest = order[left[k]:stop_l[k]] if left[k] < stop_l[k] else order[right[k]:stop_r[k]]
                    out[to[k]:to[k] + len(rest)] = rest
                live = live[~done]
            order = out
            width *= 2
        return order

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Byte-by-byte equality of windows of ``length``."""
        out = np.zeros(len(a), bool)
        for lo in range(0, len(a), 4096):
            x, y = a[lo:lo + 4096, None], b[lo:lo + 4096, None]
            step = np.arange(self.length)
            out[lo:lo + 4096] = (self.data[x + step] == self.data[y + step]).all(1)
        return out


def repeated_windows(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int):
    """(order, same): the windows sorted within their groups, and whether each equals the one
    before it in that order."""
    suffixes = Suffixes(data, length)
    order = suffixes.sort(starts, group)
    a, b = starts[order[:-1]], starts[order[1:]]
    near = (group[order[1:]] == group[order[:-1]])
    near[near] = suffixes.extension(a[near], b[near]) == length
    sure = near.copy()
    sure[near] = suffixes.equal(a[near], b[near])
    if (sure != near).any():          # hashes collided: sort by the bytes themselves
        raw = data.tobytes()
        order = np.array(sorted(range(len(starts)), key=lambda i: (group[i], raw[starts[i]:starts[i] + length])), np.int64)
        near = group[order[1:]] == group[order[:-1]]
        sure = near.copy()
        sure[near] = suffixes.equal(starts[order[:-1]][near], starts[order[1:]][near])
    return order, np.append(False, sure)


FOUND = "row long, start int, single boolean, many boolean, gram long, offset int, w1 long, w2 long"


def _sort_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """Sort the windows of the classes of every (gram, block). Gives the starts of windows that
    repeat in their block, for runs that are alone in their class, and for anchors of several
    blocks each distinct window's digest."""

    def solve(rows):
        data = np.frombuffer(b"".join(r[7] for r in rows), np.uint8)
        at = np.cumsum([0] + [len(r[7]) for r in rows])
        number = np.array([r[4] - r[3] + 1 for r in rows], np.int64)
        starts = textops.ranges(at[:-1], number)
        of = np.repeat(np.arange(len(rows)), number)
        ids = {}
        block = np.array([ids.setdefault((r[0], r[1]), len(ids)) for r in rows], np.int64)
        # equal windows have their anchor at the same place: an exact finer group
        offset = np.array([r[5] for r in rows], np.int64)[of] - (starts - at[of])
        group = block[of] * (length + 1) + offset
        by = np.argsort(group, kind="stable")
        starts, of, group, offset = starts[by], of[by], group[by], offset[by]
        order, same = repeated_windows(data, starts, group, length)
        repeats = same.copy()
        repeats[:-1] |= same[1:]
        single = np.array([r[6] for r in rows], bool)
        blocks = np.array([r[8] for r in rows], np.int64)
        row_of, start = of[order], (starts - at[of])[order]
        several = blocks[row_of] > 1
        out = np.flatnonzero((repeats & single[row_of]) | (several & ~same))
        raw = data.tobytes()
        ids_, grams = np.array([r[2] for r in rows], np.int64), np.array([r[0] for r in rows], np.int64)
        firsts = np.array([r[3] for r in rows], np.int64)
        cols = [[], [], []]
        for i in out.tolist():
            if several[i] and not same[i]:
                s = int(starts[order[i]])
                d = np.frombuffer(hashlib.blake2b(raw[s:s + length], digest_size=16).digest(), "<i8")
                cols[0].append(int(d[0]))
                cols[1].append(int(d[1]))
            else:
                cols[0].append(None)
                cols[1].append(None)
            # a class of several runs, or a window found again here, repeats for sure
            cols[2].append(bool(repeats[i] or not single[row_of[i]]))
        own = row_of[out]
        return pa.record_batch([pa.array(ids_[own]), pa.array((firsts[own] + start[out]).astype(np.int32)), pa.array(single[own]), pa.array(cols[2], pa.bool_()), pa.array(grams[own]), pa.array(offset[order][out].astype(np.int32)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=["row", "start", "single", "many", "gram", "offset", "w1", "w2"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SORT_BYTES and r[:2] != rows[-1][:2]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[7])
        if rows:
            yield solve(rows)

    ordered = contexts.repartition("gram", "block").sortWithinPartitions("gram", "block")
    return ordered.select("gram", "block", "row", "first", "last", "anchor", "single", "bytes", "blocks").mapInArrow(run, FOUND)


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted runs (row, first, last and further columns), from their texts."""
    per_row = wanted.groupBy("row").agg(F.collect_list(F.struct("gram", "block", "first", "last", "anchor", "single", "blocks")).alias("runs"))

    def run(batches):
        names = ["gram", "block", "row", "first", "last", "anchor", "single", "bytes", "blocks"]
        for batch in batches:
            cols = {n: [] for n in names}
            size = 0
            for row, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode("utf-8")
                for r in runs:
                    for n in names:
                        cols[n].append(row if n == "row" else raw[r["first"]:r["last"] + length] if n == "bytes" else r[n])
                    size += r["last"] + length - r["first"]
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pydict(cols, schema=schema)
                    cols, size = {n: [] for n in names}, 0
            yield pa.RecordBatch.from_pydict(cols, schema=schema)

    schema = pa.schema([("gram", pa.int64()), ("block", pa.int32()), ("row", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("anchor", pa.int32()), ("single", pa.bool_()), ("bytes", pa.binary()), ("blocks", pa.int32())])
    return docs.join(per_row, "row").select("row", "text", "runs").mapInArrow(run, "gram long, block int, row long, first int, last int, anchor int, single boolean, bytes binary, blocks int")


def repeated_ranges(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """Ranges (row, first, last) of starts of windows that occur elsewhere; ``docs`` has row
    and text."""
    runs = scratch.write(find_runs(docs, length, gram), "runs")
    key = ["gram", "d1", "d2", "anchor"]
    classes = runs.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "last")).alias("of"))
    classes = scratch.write(classes.join(runs.groupBy("gram").agg(F.count("*").alias("all")).where("all > 1"), "gram"), "classes")
    whole = runs.join(classes.where("n > 1").select(*key), key, "left_semi").select("row", "first", "last")
    # anchors with several classes, one of them a single run
    mixed = classes.groupBy("gram").agg(F.count("*").alias("classes"), F.min("n").alias("fewest")).where("classes > 1 and fewest = 1")
    blocks = F.ceil(F.col("classes") / block_classes).cast("int")
    wanted = (classes.join(mixed.select("gram", blocks.alias("blocks")), "gram")
              .select("gram", F.pmod(F.xxhash64("d1", "d2"), F.col("blocks")).cast("int").alias("block"), "of.row", "of.first", "of.last", "anchor", (F.col("n") == 1).alias("single"), "blocks"))
    found = scratch.write(_sort_contexts(_contexts(docs, wanted, length), length), "found")
    here = found.where("single and many").select("row", F.col("start").alias("first"), F.col("start").alias("last"))
    window = ["gram", "offset", "w1", "w2"]
    across = found.where("w1 is not null")
    again = across.groupBy(*window).agg(F.count("*").alias("n")).where("n > 1").select(*window)
    there = across.where("single and not many").join(again, window, "left_semi").select("row", F.col("start").alias("first"), F.col("start").alias("last"))
    return whole.union(here).union(there)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_classes: int = BLOCK_CLASSES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_bytes: bool = True) -> DataFrame:
    """``keep`` columns of every row, n_bytes, n_removed, n_spans (maximal removed runs),
    span_starts and span_ends, kept_sha256, and the kept bytes if asked for (cut characters
    leave their bytes, so it is a binary)."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    names = [f"k{i}" for i in range(len(keep))]
    narrow = scratch.numbered(docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(text_col).alias("text")))
    ranges = repeated_ranges(narrow.select("row", "text"), scratch, length, gram, block_classes)
    per_row = ranges.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges"))
    kinds = dict(narrow.dtypes)
    out = [*((c, kinds[n]) for c, n in zip(keep, names)), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("span_starts", "array<bigint>"), ("span_ends", "array<bigint>"), ("kept_sha256", "string")]
    out += [("kept", "binary")] * with_bytes
    heads = [c for c, _ in out]
    n_keep = len(keep)

    def run(batches):
        for batch in batches:
            for piece in range(0, batch.num_rows, 1024):
                part = batch.slice(piece, 1024)
                cols = [[] for _ in heads[n_keep:]]
                for text, runs in zip(part.column(n_keep), part.column(n_keep + 1)):
                    raw = (text.as_py() or "").encode("utf-8")
                    starts, ends, kept = [], [], raw
                    if runs.is_valid:
                        first = runs.values.field("first").to_numpy(zero_copy_only=False).astype(np.int64)
                        last = np.maximum.accumulate(runs.values.field("last").to_numpy(zero_copy_only=False).astype(np.int64) + length)
                        new = np.append(True, first[1:] > last[:-1])
                        starts, ends = first[new], last[np.append(new[1:], True)]
                        edges = [0, *(x for pair in zip(starts.tolist(), ends.tolist()) for x in pair), len(raw)]
                        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    values = (len(raw), len(raw) - len(kept), len(starts), starts, ends, hashlib.sha256(kept).hexdigest(), kept)
                    for c, v in zip(cols, values):
                        c.append(v)
                kind = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.binary()]
                yield pa.record_batch([*part.columns[:n_keep], *(pa.array(c, t) for c, t in zip(cols, kind))], names=heads)

    joined = narrow.join(per_row, "row", "left").select(*names, "text", "ranges")
    return joined.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in out))
