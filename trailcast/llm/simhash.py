"""SimHash near-duplicates by the generalised pigeonhole principle (dealt operator 8).

Fingerprints: words of a whole text (A-Z lowered, cut at ASCII white space), shingles of
``width`` words joined by blanks, XXH64 of each; a bit is set if it is set in over half of
the hashes, repeats included.

Links: fingerprints that differ in at most ``distance`` bits. The 64 bits are grouped into m
parts so that correlated bits come together, and each part gets a threshold of its own, with
sum of thresholds = distance - m + 1: two fingerprints within ``distance`` are then within
the threshold in some part (a threshold of -1 leaves a part out). m and the thresholds come
from a dynamic programme that minimises the estimated number of candidates plus probes; the
estimate uses counts of the two halves of each part over all distinct fingerprints (at most
2**11 counters a half, whatever the corpus), combined as if the halves were independent.
Every distinct fingerprint is stored under each used part and probes the values within its
threshold; what meets in a bucket is verified by its full distance.

Only distinct fingerprints enter, copies are counted by an aggregate. A bucket of over
``BUCKET`` entries is cut by the remaining bits (distance + 1 blocks of them, one of which
agrees), and what is still large is compared in salted pairs of blocks; buckets give a
spanning forest, never all pairs.

Defined cases: null and empty texts have fingerprint zero and are linked like any other;
equal rows get equal results; rows with a null id have a component_id only if another row of
the component has an id; an empty table gives no rows; only the named columns are read."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailcast.llm.components import connected_components
from trailcast.llm.scratch import Scratch, prepare

BITS, SEED = 64, 42
BUCKET = 2048
SEGMENT = 4 << 20
#: Cost of storing or probing one key, in candidates.
PROBE_COST = 4.0


def _segments(raw: bytes, limit: int = SEGMENT):
    """The bytes of a text in pieces that end between words."""
    at, n = 0, len(raw)
    while n - at > limit:
        cut = max(raw.rfind(w, at, at + limit) for w in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if cut <= at:
            cut = min((c for w in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (c := raw.find(w, at + limit)) >= 0), default=n)
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    total = bits[whole:].sum(0, dtype=np.int64)
    return total + bits[:whole].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint of a whole text."""
    ones, total, carry = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for segment in _segments((text or "").encode("utf-8").lower()):
        words = carry + segment.split()
        n = len(words)
        if n >= width:
            joined = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, n)
            ends = np.cumsum(sizes + 1) - 1
            starts = ends - sizes
            hashes = [digest(joined[i:j], SEED) for i, j in zip(starts[:n - width + 1].tolist(), ends[width - 1:].tolist())]
            ones += _ones(np.array(hashes, np.uint64))
            total += len(hashes)
        carry = words[max(0, n - width + 1):] if width > 1 else []
    if not total:
        if not carry:
            return 0
        ones, total = _ones(np.array([digest(b" ".join(carry), SEED)], np.uint64)), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (the fingerprint's bits as a long) of every whole text."""
    prepare(docs.sparkSession)
    narrow = docs.select(*keep, F.col(text_col).alias("text__"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]), "fp long"])
    names = [*narrow.columns[:-1], "fp"]

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(len(keep)).to_pylist()], np.uint64)
            yield pa.record_batch([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=names)

    return narrow.mapInArrow(run, schema)


def _bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of distinct fingerprints, and how many have both bits i and j (64 x 64 sums)."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = _bit_matrix(batch.column(0).to_numpy()).astype(np.float64)
            total += bits.T @ bits
            n += len(bits)
        total = np.append(total.reshape(-1), n).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "n"])

    cells = distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)        # 4,097 numbers, whatever the corpus
    for cell, n in cells:
        flat[cell] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size; each group starts from the bit least
    correlated with the groups before and takes the bits most correlated with itself."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        used = [b for g in groups for b in g]
        own = [min(free, key=lambda b: (corr[b, used].sum(), b))]
        free.remove(own[0])
        while len(own) < size:
            best = max(free, key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            free.remove(best)
        groups.append(sorted(own))
    return groups


def _value(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (np.int64(1) << np.arange(len(group), dtype=np.int64))


def _halves(group: list[int]) -> list[list[int]]:
    size = -(-len(group) // -(-len(group) // 11))
    return [group[i:i + size] for i in range(0, len(group), size)]


def part_histograms(distinct: DataFrame, groups: list[list[int]]) -> list[list[np.ndarray]]:
    """Counts of the values of each group's pieces of at most 11 bits, over all fingerprints."""
    flat = [h for g in groups for h in _halves(g)]
    base = np.concatenate([[0], np.cumsum([1 << len(h) for h in flat])])

    def run(batches):
        total = np.zeros(int(base[-1]), np.int64)
        for batch in batches:
            bits = _bit_matrix(batch.column(0).to_numpy())
            for k, h in enumerate(flat):
                total[base[k]:base[k + 1]] += np.bincount(_value(bits, h), minlength=1 << len(h))
        cells = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    rows = distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(int(base[-1]), np.int64)         # at most 2**11 counters a piece
    for cell, n in rows:
        total[cell] = n
    hists = iter([total[base[k]:base[k + 1]] for k in range(len(flat))])
    return [[next(hists) for _ in _halves(g)] for g in groups]


def _distances(hist: np.ndarray) -> np.ndarray:
    """Share of ordered pairs at each Hamming distance, from value counts: the counts'
    correlation under XOR (two Walsh-Hadamard transforms)."""
    h, step = hist.astype(np.float64), 1
    def transform(x):
        step = 1
        while step < len(x):
            x = x.reshape(-1, 2, step)
            x = np.stack([x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]], 1).reshape(-1)
            step *= 2
        return x
    pairs = transform(transform(h) ** 2) / len(h)
    at = np.bitwise_count(np.arange(len(h)))
    return np.bincount(at, weights=pairs) / max(h.sum() ** 2, 1)


def estimate(hists: list[np.ndarray], n: int, most: int) -> np.ndarray:
    """Estimated candidate pairs of a part for thresholds 0..most."""
    share = np.ones(1)
    for h in hists:
        share = np.convolve(share, _distances(h))
    share = np.append(share, np.zeros(most + 1))
    return np.cumsum(share)[:most + 1] * n * n / 2


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds -1..len(costs[i])-2 of each part with the given sum and the least total
    cost, where costs[i][t + 1] is part i's cost at threshold t."""
    best = {0: (0.0, [])}
    for part in costs:
        step: dict = {}
        for done, (cost, plan) in best.items():
            for t in range(-1, len(part) - 1):
                new = (cost + part[t + 1], [*plan, t])
                if done + t not in step or new < step[done + t]:
                    step[done + t] = new
        best = step
    return best[total]


def masks(bits: int, threshold: int) -> list[int]:
    """All values of ``bits`` bits with at most ``threshold`` ones, fewest ones first."""
    return [sum(1 << b for b in c) for k in range(threshold + 1) for c in itertools.combinations(range(bits), k)]


def plan_parts(distinct: DataFrame, distance: int, choices=(2, 3, 4)) -> list[tuple[list[int], int]]:
    """The used parts: (bits, threshold), for the cheapest number of parts."""
    n, both = bit_statistics(distinct)
    best = None
    for m in choices:
        if m > distance + 1:
            continue
        groups = group_bits(n, both, m)
        costs = []
        for g, h in zip(groups, part_histograms(distinct, groups)):
            candidates = estimate(h, n, distance)
            probes = np.cumsum([len(list(itertools.combinations(range(len(g)), t))) for t in range(distance + 1)])
            costs.append([0.0, *(candidates + PROBE_COST * n * (1 + probes))])
        cost, plan = allocate(costs, distance - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, plan) if t >= 0])
    return best[1]


def _entries(distinct: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Each fingerprint under its own value of every part (own = true) and the values it
    probes."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for lo in range(0, len(fps), 4096):
                own_fps = fps[lo:lo + 4096]
                bits = _bit_matrix(own_fps)
                for k, (group, threshold) in enumerate(parts):
                    value = _value(bits, group)
                    for i in range(0, len(every := masks(len(group), threshold)), 64):
                        some = np.array(every[i:i + 64], np.int64)
                        keys = (value[:, None] ^ some).reshape(-1)
                        yield pa.record_batch([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys), pa.array(np.repeat(own_fps, len(some))), pa.array(np.tile(some == 0, len(own_fps)))], names=["part", "value", "fp", "own"])

    return distinct.select("fp").mapInArrow(run, "part int, value long, fp long, own boolean")


def _refined(entries: DataFrame, parts: list[tuple[list[int], int]], distance: int) -> DataFrame:
    """Entries of a large bucket under the values of distance + 1 blocks of the bits that
    aren't in its part: two fingerprints within the distance agree on one of the blocks."""
    blocks = []
    for group, _ in parts:
        rest = [b for b in range(BITS) if b not in group]
        size = -(-len(rest) // (distance + 1))
        blocks.append([rest[i * size:(i + 1) * size] for i in range(distance + 1)])

    def run(batches):
        for batch in batches:
            part, fps = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            bits = _bit_matrix(fps)
            for k in range(len(parts)):
                at = np.flatnonzero(part == k)
                for j, block in enumerate(blocks[k]):
                    if len(at):
                        rows = batch.take(pa.array(at))
                        yield pa.record_batch([*rows.columns, pa.array(_value(bits[at], block) * 8 + j)], names=["part", "value", "fp", "own", "sub"])

    return entries.select("part", "value", "fp", "own").mapInArrow(run, "part int, value long, fp long, own boolean, sub long")


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (fingerprint, fingerprint) that span the components of one bucket."""
    links, rest = [], np.unique(fps)
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            take, front = front[:512], front[512:]
            near = np.bitwise_count(take[:, None] ^ rest[None, :]) <= distance
            hit = near.any(0)
            if hit.any():
                found = rest[hit]
                links += zip(found.tolist(), take[near[:, hit].argmax(0)].tolist())
                rest, front = rest[~hit], np.append(front, found)
    return links


def _bucket_links(entries: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Spanning links of every bucket; a bucket's rows are brought together, sorted by key."""

    def flush(key_rows, fps, own):
        """Buckets of a sorted run of rows."""
        cut = np.flatnonzero(np.append(True, (key_rows[1:] != key_rows[:-1]).any(1)))
        size = np.diff(np.append(cut, len(fps)))
        mine = np.add.reduceat(own.astype(np.int64), cut) if len(cut) else cut
        out = []
        two = cut[(size == 2) & (mine > 0)]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance
        near &= fps[two] != fps[two + 1]
        out += zip(fps[two][near].tolist(), fps[two + 1][near].tolist())
        for i in np.flatnonzero((size > 2) & (mine > 0)).tolist():
            out += forest(fps[cut[i]:cut[i] + size[i]], distance)
        return out

    def run(batches):
        keep = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                n = len(keys)
                key_rows = np.stack([batch.column(c).to_numpy() for c in range(n)], 1).astype(np.int64)
                fps = batch.column(n).to_numpy().view(np.uint64)
                own = batch.column(n + 1).to_numpy(zero_copy_only=False)
                if keep is not None:
                    key_rows, fps, own = np.concatenate([keep[0], key_rows]), np.concatenate([keep[1], fps]), np.concatenate([keep[2], own])
                if not len(fps):
                    continue
                last = int(np.flatnonzero((key_rows != key_rows[-1]).any(1))[-1]) + 1 if (key_rows != key_rows[-1]).any() else 0
                keep = (key_rows[last:], fps[last:], own[last:])     # the last bucket may go on
                key_rows, fps, own = key_rows[:last], fps[:last], own[:last]
            elif keep is not None:
                key_rows, fps, own = keep
            else:
                return
            if len(fps):
                links = np.array(flush(key_rows, fps, own), np.uint64).reshape(-1, 2).view(np.int64)
                if len(links):
                    yield pa.record_batch([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], names=["a", "b"])

    rows = entries.select(*keys, "fp", "own")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _large(entries: DataFrame, keys: list[str], bucket: int, scratch: Scratch, label: str) -> DataFrame:
    sizes = entries.groupBy(*keys).agg(F.count("*").alias("size"))
    return scratch.write(sizes.where(F.col("size") > bucket), label)


def links_within(distinct: DataFrame, scratch: Scratch, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that span the components of fingerprints (column fp, distinct) which
    differ in at most ``distance`` bits."""
    parts = plan_parts(distinct, distance)
    entries = _entries(distinct, parts)
    keys = ["part", "value"]
    large = _large(entries, keys, bucket, scratch, "large")
    if large.isEmpty():
        return _bucket_links(entries, keys, distance)
    plain = entries.join(large.select(*keys), keys, "left_anti")
    cut = scratch.write(_refined(entries.join(large.select(*keys), keys, "left_semi"), parts, distance), "refined")
    keys = [*keys, "sub"]
    still = _large(cut, keys, bucket, scratch, "still-large")
    blocks = F.ceil(F.col("size") / bucket).cast("int")
    rows = cut.join(still, keys, "left").withColumn("blocks", F.coalesce(blocks, F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    rows = (rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
            .withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")))
    return _bucket_links(plain, ["part", "value"], distance).union(_bucket_links(rows, [*keys, "lo", "hi"], distance))


def _classes(docs: DataFrame, width: int, distance: int, text_col: str, id_col: str, keep: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """id, ``keep`` columns, fp, root (the class) and component_id of every row."""
    prints = scratch.write(fingerprints(docs, width, text_col, (id_col, *keep)), "prints")
    distinct = scratch.write(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    roots = connected_components(links_within(distinct, scratch, distance), scratch)
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(scratch.write(of.join(smallest, "root").select("fp", "root", "component_id"), "classes"), "fp")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: the id, fingerprint (16 hexadecimal digits) and component_id
    (smallest id reachable by links of at most ``distance`` bits)."""
    rows = _classes(docs.select(id_col, text_col), width, distance, text_col, id_col, (), Scratch(docs.sparkSession, "simhash"))
    return rows.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, distance: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with one of each class left, with all their columns: the least id
    (a null id comes last), and of several rows with that id the least text hash."""
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    keyed = docs.select(F.col(id_col).alias("id__"), F.col(text_col).alias("text__"), F.xxhash64(F.col(text_col)).alias("hash__"))
    rows = _classes(keyed, width, distance, "text__", "id__", ("hash__",), scratch)
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id__").isNull().alias("null__"), "id__", "hash__")).alias("of"), F.count("*").alias("n"))
    stay = best.select("of.id__", "of.hash__", F.col("n").alias("n__")).groupBy("id__", "hash__").agg(F.max("n__").alias("n__"))
    stay = scratch.write(stay, "stay")
    same = stay["id__"].eqNullSafe(docs[id_col]) & (stay["hash__"] == F.xxhash64(docs[text_col]))
    left = docs.join(stay, same)
    # only rows of classes with copies can be there twice
    once = left.where("n__ = 1").select(*docs.columns)
    copies = left.where("n__ > 1").dropDuplicates(["id__", "hash__"]).select(*docs.columns)
    return once.union(copies)
