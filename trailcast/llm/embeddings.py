"""Near-duplicate vectors by cross-polytope hashing (dealt operator 1).

Hashing: a vector, padded to a power of two, is turned by three rounds of random signs and a
Walsh-Hadamard transform; the largest coordinate and its sign are one hash. ``hashes`` of
them make a key, ``tables`` keys are made. Multiprobe: in each table a vector is also stored
under the keys in which one hash is replaced by a runner-up coordinate, the ``probes`` least
costly of them. The number of hashes follows from the number of vectors (buckets stay small
whatever the size), and the number of tables from the share of random pairs, at exactly the
threshold, that the index brings together (measured on generated pairs), so that at least
``recall`` of such pairs meet.

Verification: vectors that share a bucket (and label and length) are compared by cosine in
double precision. Equal vectors are one node with a weight. A pair that meets in several
buckets is counted in the first of its shared keys alone. Large buckets: first, vectors
within half the threshold angle of their bucket's centre are a core, whose members are all
linked by the triangle inequality and need no comparison; the rest of a bucket is compared
with itself and with the bucket's core in blocks of at most ``block`` rows. Buckets give link
counts and spanning links, never pairs.

Defined cases: rows whose label is null, or whose vector is null, empty, zero or has null or
non-finite components, link with nothing; so does a null id; vectors of different lengths
never link; rows that repeat id, label and vector are linked copies; rows of one id with
different vectors count as one node; an empty table gives no rows; only the named columns
are read."""

from __future__ import annotations

import hashlib
import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailcast.llm import textops
from trailcast.llm.components import connected_components
from trailcast.llm.scratch import Scratch

THRESHOLD = 0.93
PROBES = 4
RECALL = 0.99
BLOCK = 512
MARGIN = 1e-9


@lru_cache(maxsize=64)
def _signs(size: int, table: int, which: int) -> np.ndarray:
    rng = np.random.default_rng([20_231, size, table, which])
    return rng.integers(0, 2, (3, size)) * 2.0 - 1.0


def rotate(x: np.ndarray, table: int, which: int) -> np.ndarray:
    """Three rounds of signs and Walsh-Hadamard transform of the rows of x."""
    size = x.shape[1]
    for signs in _signs(size, table, which):
        x = x * signs
        step = 1
        while step < size:
            y = x.reshape(len(x), -1, 2, step)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), size)
            step *= 2
    return x


def padded(x: np.ndarray) -> np.ndarray:
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, size - x.shape[1]))) if size > x.shape[1] else x


def keys_of(x: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """Keys of unit vectors in a table: the own key, then the probes (rows x 1 + probes)."""
    x = padded(x)
    n, size = x.shape
    codes, other, cost = np.empty((n, hashes), np.uint64), [], []
    rows = np.arange(n)
    runners = min(size - 1, -(-probes // hashes) + 1)
    for k in range(hashes):
        y = rotate(x, table, k)
        big = np.abs(y)
        top = np.argsort(-big, axis=1, kind="stable")[:, :runners + 1]
        code = (top * 2 + (np.take_along_axis(y, top, 1) < 0)).astype(np.uint64)
        codes[:, k] = code[:, 0]
        best = big[rows, top[:, 0]]
        for r in range(1, runners + 1):
            other.append((k, code[:, r]))
            cost.append((best - big[rows, top[:, r]]) / math.sqrt(size))
    place = np.uint64(2 * size)

    def key(c):
        out = np.full(n, table + 1, np.uint64)
        for k in range(hashes):
            out = textops.mix64(out * place + c[:, k] + np.uint64(1))
        return out

    keys = [key(codes)]
    cheapest = np.argsort(np.stack(cost, 1), axis=1, kind="stable")
    every = []
    for k, c in other:
        changed = codes.copy()
        changed[:, k] = c
        every.append(key(changed))
    every = np.stack(every, 1)
    keys += [every[rows, cheapest[:, p]] for p in range(min(probes, every.shape[1]))]
    return np.stack(keys, 1)


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] == b[:, None, :]).any((1, 2))


@lru_cache(maxsize=32)
def tables_needed(size: int, hashes: int, probes: int, threshold: float, recall: float, most: int = 512) -> int:
    """Tables after which ``recall`` of random pairs at the threshold's angle have met; an error
    if ``most`` tables are not enough."""
    rng = np.random.default_rng(11)
    a = rng.standard_normal((1500, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((1500, size))
    b -= (a * b).sum(1, keepdims=True) * a
    b = threshold * a + math.sqrt(1 - threshold ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = np.zeros(len(a), bool)
    for table in range(most):
        met |= _meet(keys_of(a, table, hashes, probes), keys_of(b, table, hashes, probes))
        if met.mean() >= recall:
            return table + 1
    raise ValueError(f"{most} tables of {hashes} hashes find {met.mean():.3f} of the pairs at cosine {threshold}, not {recall}: take fewer hashes or more probes")


def _clean(batch, vec_at: int):
    """Valid rows of a batch: their places and their vectors by length."""
    lists = batch.column(vec_at)
    size = np.diff(lists.offsets.to_numpy())
    size[~np.array(lists.is_valid())] = 0
    out = []
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        values = lists.take(pa.array(at)).flatten()
        x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
        ok = np.isfinite(x).all(1) & (x != 0).any(1)  # squares may overflow: see _unit
        if ok.any():
            out.append((at[ok], x[ok]))
    return out


def _digests(rows: DataFrame) -> DataFrame:
    """(id, label, vector) of valid rows with a 128-bit digest of label, length and vector."""

    def run(batches):
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for at, x in _clean(batch, 2):
                x = x + 0.0                           # -0.0 and 0.0 are one value
                d = np.frombuffer(b"".join(hashlib.blake2b(f"{labels[i]}|{x.shape[1]}|".encode() + v.tobytes(), digest_size=16).digest() for i, v in zip(at.tolist(), x)), "<i8").reshape(-1, 2)
                own = batch.take(pa.array(at))
                yield pa.record_batch([own.column(0), own.column(1), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), own.column(2)], names=["id", "label", "d1", "d2", "vec"])

    kind = dict(rows.dtypes)
    return rows.where("id is not null and label is not null").mapInArrow(run, f"id long, label {kind['label']}, d1 long, d2 long, vec {kind['vec']}")


def _space(label, size: int) -> int:
    """A number for label and length, mixed into keys so that only equals meet."""
    return int.from_bytes(hashlib.blake2b(f"{label}|{size}".encode(), digest_size=8).digest(), "little")


def _unit(batch, vec_at):
    for at, x in _clean(batch, vec_at):
        scale = np.abs(x).max(1, keepdims=True)       # no overflow or underflow of squares
        x = x / scale
        yield at, x / np.sqrt((x * x).sum(1, keepdims=True))


def _entries(nodes: DataFrame, hashes: int, tables: int, probes: int) -> DataFrame:
    """(key, node, first) of every node in every table; first: its own key in table 0."""

    def run(batches):
        for batch in batches:
            node, label = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for at, x in _unit(batch, 2):
                space = np.array([_space(label[i], x.shape[1]) for i in at.tolist()], np.uint64)
                for table in range(tables):
                    keys = textops.mix64(keys_of(x, table, hashes, probes) ^ space[:, None])
                    n, each = keys.shape
                    yield pa.record_batch([pa.array(keys.view(np.int64).reshape(-1)), pa.array(np.repeat(node[at], each)), pa.array(np.tile(np.arange(each) == 0, n) & (table == 0))], names=["key", "node", "first"])

    return nodes.select("node", "label", "vec").mapInArrow(run, "key long, node long, first boolean")


def _cores(entries: DataFrame, nodes: DataFrame, threshold: float, core: int, scratch: Scratch) -> DataFrame:
    """(node, core): nodes within half the threshold angle of the centre of their own bucket in
    table 0, where that bucket has more than ``core`` nodes. The centre is the mean of unit
    vectors, summed per component by an aggregate."""
    mine = entries.where("first").select("node", "key")
    large = mine.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > core)
    large = scratch.write(mine.join(large.select("key"), "key"), "core-candidates")
    if large.isEmpty():
        return scratch.write(large.select("node", F.col("key").alias("core")).limit(0), "cores")
    vectors = large.join(nodes.select("node", "label", "vec"), "node").select("key", "node", "vec")
    least = math.cos(math.acos(threshold) / 2) + MARGIN

    def sums(batches):
        total: dict = {}
        for batch in batches:
            key = batch.column(0).to_numpy()
            for at, x in _unit(batch, 2):
                for k in np.unique(key[at]).tolist():
                    total[k] = total.get(k, 0) + x[key[at] == k].sum(0)
        for k, v in total.items():
            yield pa.record_batch([pa.array([k] * len(v), pa.int64()), pa.array(range(len(v)), pa.int32()), pa.array(v)], names=["key", "i", "x"])

    part = vectors.mapInArrow(sums, "key long, i int, x double").groupBy("key", "i").agg(F.sum("x").alias("x"))
    centre = part.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))

    def near(batches):
        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, x in _unit(batch, 2):
                c = batch.column(3).take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                norm = np.sqrt((c * c).sum(1))
                ok = (c * x).sum(1) >= least * norm
                ok &= norm > 0
                yield pa.record_batch([pa.array(node[at[ok]]), pa.array(key[at[ok]])], names=["node", "core"])

    return scratch.write(vectors.join(centre, "key").mapInArrow(near, "node long, core long"), "cores")


TASK = ["key", "kind", "a", "b"]


def _tasks(entries: DataFrame, cores: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """Which nodes to compare with which: rows (key, kind, a, b, side, node). kind 0: the rest
    of a bucket with itself, blocks a <= b; kind 1: rest block a (side 0) with core block b."""
    marked = entries.select("key", "node").join(cores, "node", "left")
    by_core = marked.groupBy("key", "core").agg(F.count("*").alias("n"))
    stats = (by_core.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.when(F.col("core").isNotNull(), F.struct("n", "core"))).alias("most"))
             .withColumn("inside", F.coalesce("most.n", F.lit(0))).withColumn("rest", F.col("all") - F.col("inside"))
             .where("all > 1 and rest > 0")
             .select("key", F.col("most.core").alias("most"), F.ceil(F.col("rest") / block).cast("int").alias("rest_blocks"), F.ceil(F.col("inside") / block).cast("int").alias("core_blocks")))
    rows = marked.join(scratch.write(stats, "buckets"), "key")
    inside = F.coalesce(F.col("core") == F.col("most"), F.lit(False))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.pmod(F.xxhash64("node"), F.when(inside, F.col("core_blocks")).otherwise(F.col("rest_blocks"))).cast("int")
    rows = rows.withColumn("inside", inside).withColumn("mine", mine)
    with_rest = F.transform(upto("rest_blocks"), lambda j: F.struct(F.lit(0).alias("kind"), F.least("mine", j).alias("a"), F.greatest("mine", j).alias("b")))
    with_core = F.transform(upto("core_blocks"), lambda j: F.struct(F.lit(1).alias("kind"), F.col("mine").alias("a"), j.alias("b")))
    from_core = F.transform(upto("rest_blocks"), lambda j: F.struct(F.lit(1).alias("kind"), j.alias("a"), F.col("mine").alias("b")))
    tasks = F.when(F.col("inside"), from_core).otherwise(F.concat(with_rest, with_core))
    return rows.withColumn("t", F.explode(tasks)).select("key", "t.kind", "t.a", "t.b", F.when(F.col("inside"), 1).otherwise(F.col("mine")).alias("side"), F.col("inside"), "node", "core")


def _compare(tasks: DataFrame, nodes: DataFrame, threshold: float, hashes: int, tables: int, probes: int) -> DataFrame:
    """Per node of each task with links: n (weight of partners whose first shared key this is)
    and other, a node it is linked with (a spanning forest of the task's links)."""

    def solve(key, kind, two_blocks, side, inside, node, core, weight, label, x):
        order = np.lexsort((node, side))
        node, first = np.unique(node[order], return_index=True)
        at = order[first]
        side, inside, core, weight, label, x = side[at], inside[at], core[at], weight[at], label[at], x[at]
        left = np.flatnonzero(~inside) if kind else np.arange(len(node))
        right = np.flatnonzero(inside) if kind else np.arange(len(node))
        links, counts, parent = [], np.zeros(len(node), np.int64), np.arange(len(node))
        for lo in range(0, len(left), 256):
            own = left[lo:lo + 256]
            ok = x[own] @ x[right].T >= threshold
            ok &= own[:, None] < right[None, :] if not kind else True
            if not kind:                               # pairs of two blocks, or within one
                if two_blocks:
                    ok &= side[own][:, None] != side[right][None, :]
                same = (core[own][:, None] == core[right][None, :]) & (core[own] != 0)[:, None]
                ok &= ~same
            i, j = np.nonzero(ok)
            if len(i):
                links.append((own[i], right[j]))
        if not links:
            return None
        i, j = (np.concatenate(c) for c in zip(*links))
        same_space = np.array([label[a] == label[b] for a, b in zip(i.tolist(), j.tolist())]) if len(set(label.tolist())) > 1 else np.ones(len(i), bool)
        i, j = i[same_space], j[same_space]
        if not len(i):
            return None
        # counted here only if this is the first key that both have, table by table
        used = np.unique(np.concatenate([i, j]))
        place = np.zeros(len(node), np.int64)
        place[used] = np.arange(len(used))
        space = np.uint64(_space(label[used[0]], x.shape[1]))
        open_, here = np.arange(len(i)), np.zeros(len(i), bool)
        for table in range(tables):
            keys = textops.mix64(keys_of(x[used], table, hashes, probes) ^ space)
            for lo in range(0, len(open_), 20_000):
                o = open_[lo:lo + 20_000]
                a, b = keys[place[i[o]]], keys[place[j[o]]]
                shared = np.where((a[:, :, None] == b[:, None, :]).any(2), a, np.uint64(0xFFFFFFFFFFFFFFFF)).min(1)
                here[o[shared == key]] = True
                open_[lo:lo + 20_000] = np.where(shared == np.uint64(0xFFFFFFFFFFFFFFFF), o, -1)
            open_ = open_[open_ >= 0]
            if not len(open_):
                break
        np.add.at(counts, i[here], weight[j[here]])
        np.add.at(counts, j[here], weight[i[here]])
        while True:                                    # least linked place, by hooking
            low = np.minimum(parent[i], parent[j])
            before = parent.copy()
            np.minimum.at(parent, i, low)
            np.minimum.at(parent, j, low)
            parent = parent[parent]
            if (parent == before).all():
                break
        linked = np.zeros(len(node), bool)
        linked[used] = True
        return node[linked], counts[linked], node[parent[linked]]

    def run(batches):
        keep = None
        for batch in itertools.chain(batches, [None]):
            table = None
            if batch is not None:
                table = pa.Table.from_batches([batch]) if keep is None else pa.concat_tables([keep, pa.Table.from_batches([batch])])
            elif keep is not None:
                table = keep
            if table is None or not table.num_rows:
                continue
            heads = np.stack([table.column(c).to_numpy().astype(np.int64) for c in range(4)], 1)
            cut = np.flatnonzero(np.append(True, (heads[1:] != heads[:-1]).any(1)))
            ends = np.append(cut[1:], len(heads))
            if batch is not None:                      # the last task may go on
                keep = table.slice(int(cut[-1])).combine_chunks()
                cut, ends = cut[:-1], ends[:-1]
            many = ends - cut > 1
            for lo, hi in zip(cut[many].tolist(), ends[many].tolist()):
                part = table.slice(lo, hi - lo).combine_chunks().to_batches()[0]
                cols = [part.column(c).to_numpy(zero_copy_only=False) for c in (4, 5, 6)]
                core = part.column(7).fill_null(0).to_numpy(zero_copy_only=False)
                weight, label = part.column(8).to_numpy(), np.array(part.column(9).to_pylist(), object)
                for at, x in _unit(part, 10):
                    got = solve(heads[lo, 0].view(np.uint64), heads[lo, 1] == 1, heads[lo, 2] != heads[lo, 3], cols[0][at], cols[1][at], cols[2][at], core[at], weight[at], label[at], x)
                    if got:
                        yield pa.record_batch([pa.array(c) for c in got], names=["node", "n", "other"])

    rows = tasks.join(nodes, "node").select(*TASK, "side", "inside", "node", "core", "weight", "label", "vec")
    return rows.repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(run, "node long, n long, other long")


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, recall: float = RECALL, block: int = BLOCK, hashes: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``table``: the id, n_links (other vectors linked directly),
    component_id (smallest id reachable by links) and kept (id = component_id)."""
    scratch = Scratch(table.sparkSession, "embeddings")
    rows = scratch.numbered(table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec")))
    valid = _digests(rows.select("id", "label", "vec"))
    same = ["d1", "d2"]
    nodes = scratch.write(valid.groupBy(*same).agg(F.min("id").alias("node"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vec").alias("vec")), "nodes")
    n, size = nodes.agg(F.count("*"), F.max(F.size("vec"))).first()
    size = size or 2
    hashes = hashes or max(1, math.ceil(math.log(max(n, 2)) / math.log(2 * size)))
    tables = tables_needed(size, hashes, probes, threshold, recall)
    entries = scratch.write(_entries(nodes, hashes, tables, probes), "entries")
    cores = _cores(entries, nodes, threshold, block, scratch)
    tasks = _tasks(entries, cores, block, scratch)
    met = scratch.write(_compare(tasks, nodes.select("node", "weight", "label", "vec"), threshold, hashes, tables, probes), "met")
    in_core = cores.join(nodes.select("node", "weight"), "node")
    core_size = in_core.groupBy("core").agg(F.sum("weight").alias("all"), F.min("node").alias("other"))
    core_links = in_core.join(core_size, "core").select("node", (F.col("all") - F.col("weight")).alias("n"), "other")
    every = met.union(core_links)
    counts = every.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(every.select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    of = (nodes.select(*same, "node", "weight").join(counts, "node", "left").join(roots, "node", "left")
          .withColumn("root", F.coalesce("root", "node")))
    least = of.groupBy("root").agg(F.min("node").alias("component_id"))
    result = scratch.write(of.join(least, "root").select(*same, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "result")
    linked = _digests(rows.select("id", "label", "vec")).select("id", *same).join(result, same).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("id").join(linked, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("id")).alias("component_id"), (F.col("id") == F.coalesce("component_id", F.col("id"))).alias("kept"))
