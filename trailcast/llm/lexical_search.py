"""Ranked lexical search by bag deduplication (dealt operator 12).

All documents are ranked for each item by the tf and idf score of the contract (integers but for
the logarithm in a term's weight). The score depends only on a document's bag restricted to the
items' vocabulary and on its length factor m, so equal bags with equal m are scored once:

1. One pass over the whole texts keeps, of each document, its number of terms and the counts of
   the vocabulary's terms (numpy in tasks; words meet the vocabulary by two 64-bit hashes). The
   number of documents N, their terms L and the document frequencies come from these rows.
2. A document's m follows; documents are grouped by a hash of (m, terms, counts), and the
   vectors themselves are compared within a hash, so a collision joins nothing. A class keeps
   its k least doc_ids: more can't be among an item's k best. That cut is a ranked window, which
   Spark applies before its shuffle too, so a group of copies that holds a third of all rows
   sends at most k rows a task.
3. Each class is scored once against all items by their terms' postings (exact 64-bit sums); a
   task keeps each item's k best classes by (score, least doc_id). Any document beyond them has k
   better ones.
4. Classes are expanded to their members and ranked by (score, ascending doc_id).

The items are the stated query set. What tasks get of them is bounded: items are dealt into
groups of about ``GROUP_BYTES`` of text (an item longer than that is a group of its own), and
documents are searched once a group.

Defined cases: null and empty texts hold no terms; an item without terms has no rows; every row
of the items is an item, so a repeated one has its rows twice; every row of the documents is a
document, so repeated rows take a rank each; a null doc_id comes after all others of its score;
empty tables give no rows."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailcast.llm import textops
from trailcast.llm.scratch import Scratch

TOP, GROUP_BYTES, PIECE, CELLS = 20, 4 << 20, 1 << 20, 1 << 21
LAST = np.iinfo(np.int64).max                        # stands for a null id in comparisons


def _words(data: np.ndarray, offsets: np.ndarray):
    """Two hashes of every word, and the index of each text's first word."""
    starts, ends = textops.spans_of(textops.WORD_BYTE[data], offsets)
    low = textops.LOWER[data]
    both = [textops.mix64(textops.span_hashes(*textops.prefix_hashes(low, k), starts, ends)) for k in (0, 1)]
    return both[0], both[1], np.searchsorted(starts, offsets)


class Items:
    """A group of items as arrays: vocabulary by hash, and postings term -> (item, repeats)."""

    def __init__(self, texts: list[str | None]):
        # the lone surrogates that Python may hold are no text of Spark's
        column = pa.array([t or "" for t in texts], pa.large_string())
        h1, h2, at = _words(*textops.text_bytes(column))
        pair = np.stack([h1, h2], 1)
        vocabulary, place = np.unique(pair, axis=0, return_inverse=True)
        self.h1, self.h2 = np.ascontiguousarray(vocabulary[:, 0]), np.ascontiguousarray(vocabulary[:, 1])
        item = np.repeat(np.arange(len(texts)), np.diff(at))
        cell, repeats = np.unique(place.reshape(-1).astype(np.int64) * max(1, len(texts)) + item, return_counts=True)
        term, self.item = np.divmod(cell, max(1, len(texts)))
        self.repeats = repeats.astype(np.int64)
        self.first = np.searchsorted(term, np.arange(len(self.h1) + 1))      # postings of term t: first[t]:first[t+1]
        self.n = len(texts)
        self.most = int(np.bincount(item, minlength=1).max()) if len(item) else 0

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, or -1. Words of equal h1 are few and neighbours."""
        out = np.full(len(h1), -1, np.int64)
        if not len(self.h1):
            return out
        at = np.searchsorted(self.h1, h1)
        open_ = np.arange(len(h1))
        while len(open_):
            inside = at[open_] < len(self.h1)
            open_ = open_[inside]
            open_ = open_[self.h1[at[open_]] == h1[open_]]
            hit = self.h2[at[open_]] == h2[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
        return out


def _bags(items, data: np.ndarray, offsets: np.ndarray):
    """(terms of each text, text and vocabulary place and count of its distinct vocabulary terms)."""
    h1, h2, at = _words(data, offsets)
    place = items.find(h1, h2)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    known = place >= 0
    cell, count = np.unique(text[known] * max(1, len(items.h1)) + place[known], return_counts=True)
    text, place = np.divmod(cell, max(1, len(items.h1)))
    return np.diff(at), text, place, count


def bags(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """doc, n and the restricted bag (terms ascending, counts) of every row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    def run(batches):
        items = shared.value
        for batch in batches:
            data, offsets = textops.text_bytes(batch.column(1))
            for lo, hi in textops.pieces(offsets, PIECE):
                n, text, place, count = _bags(items, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                cuts = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)), pa.int32())
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()),
                                       pa.ListArray.from_arrays(cuts, pa.array(place, pa.int32())),
                                       pa.ListArray.from_arrays(cuts, pa.array(count, pa.int32()))], names=["doc", "n", "terms", "counts"])

    return narrow.mapInArrow(run, "doc long, n long, terms array<int>, counts array<int>")


def classes(rows: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(m, terms, counts, docs): each distinct bag with its k least documents."""
    m = F.lit(75).cast("long") + F.call_function("div", F.lit(25).cast("long") * F.col("n") * F.lit(n_docs).cast("long"), F.lit(n_terms).cast("long"))
    rows = rows.where(F.size("terms") > 0).withColumn("m", m)
    rows = rows.select(F.xxhash64("m", "terms", "counts").alias("h"), "m", "terms", "counts", "doc")
    bag = ("h", "m", "terms", "counts")                   # the hash sorts, the vectors verify
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*bag).orderBy(F.col("doc").asc_nulls_last())))
    return (ranked.where(F.col("place") <= k).groupBy(*bag)
            .agg(F.sort_array(F.collect_list(F.struct("place", "doc"))).alias("docs")).select("m", "terms", "counts", F.col("docs.doc").alias("docs")))


def _sums(cell: np.ndarray, value: np.ndarray, size: int, most: int) -> np.ndarray:
    """Exact integer sums of values by cell; ``most`` bounds every sum."""
    if most < 1 << 53:
        return np.bincount(cell, value, size).astype(np.int64)
    high = value >> 32
    return (np.bincount(cell, high, size).astype(np.int64) << 32) + np.bincount(cell, value - (high << 32), size).astype(np.int64)


class Best:
    """The k best (score, least document) classes of each item so far."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.zeros(n, np.int64)     # a score must reach least to count
        self.rows: list = []
        self.held = 0

    def add(self, scores: np.ndarray, first: np.ndarray, docs) -> None:
        """``scores``: items x classes."""
        item, column = np.nonzero((scores > 0) & (scores >= self.least[:, None]))
        if len(item):
            self.rows.append((item, scores[item, column], first[column], docs.take(pa.array(column))))
            self.held += len(item)
        if self.held > 8 * self.k * len(self.least) + CELLS // 8:
            self.cut()

    def cut(self):
        """(item, score, least document, documents) of the best classes."""
        if not self.rows:
            return None
        item, score, first = (np.concatenate([r[i] for r in self.rows]) for i in range(3))
        docs = pa.concat_arrays([r[3] for r in self.rows])
        order = np.lexsort((first, -score, item))
        start = np.searchsorted(item[order], np.arange(len(self.least)))
        place = np.arange(len(order)) - start[item[order]]
        full = order[place == self.k - 1]
        self.least[item[full]] = score[full]
        kept = order[place < self.k]
        out = item[kept], score[kept], first[kept], docs.take(pa.array(kept))
        self.rows, self.held = [out], len(kept)
        return out


def best_classes(found: DataFrame, shared, weights, k: int) -> DataFrame:
    """(item, score, docs): each task's k best classes of each item."""

    def run(batches):
        items, weight = shared.value, weights.value
        best = Best(items.n, k)
        degree = np.diff(items.first)
        most = items.most * 10 ** 6 * int(weight.max(initial=0))
        for batch in batches:
            m = batch.column(0).to_numpy()
            terms, counts, docs = (batch.column(i) for i in (1, 2, 3))
            cuts, doc_cuts = (np.asarray(x.offsets) for x in (terms, docs))
            term, tf = terms.values.to_numpy(), counts.values.to_numpy().astype(np.int64)
            first = docs.values.fill_null(LAST).to_numpy()[doc_cuts[:-1]]
            fan = np.concatenate([[0], np.cumsum(degree[term])])[cuts]
            lo = 0
            while lo < len(m):                            # parts of bounded postings and cells
                hi = int(np.searchsorted(fan, fan[lo] + CELLS, "right")) - 1
                hi = max(lo + 1, min(hi, lo + max(1, CELLS // items.n), len(m)))
                part = slice(cuts[lo], cuts[hi])
                t, row = term[part], np.repeat(np.arange(hi - lo), np.diff(cuts[lo:hi + 1]))
                value = weight[t] * ((10 ** 9 * tf[part]) // (1000 * tf[part] + 12 * m[lo:hi][row]))
                post = textops.ranges(items.first[t], degree[t])
                cell = items.item[post] * (hi - lo) + np.repeat(row, degree[t])
                scores = _sums(cell, np.repeat(value, degree[t]) * items.repeats[post], items.n * (hi - lo), most)
                best.add(scores.reshape(items.n, hi - lo), first[lo:hi], docs.slice(lo, hi - lo))
                lo = hi
        out = best.cut()
        if out is not None:
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), out[3]], names=["item", "score", "docs"])

    return found.mapInArrow(run, "item long, score long, docs array<long>")


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _group(docs: DataFrame, ids: list, texts: list, k: int, id_col: str, text_col: str, item_type: str, scratch: Scratch, label: str) -> DataFrame:
    """The ranked documents of one group of items."""
    spark = docs.sparkSession
    items = Items(texts)
    shared = spark.sparkContext.broadcast(items)          # bounded by GROUP_BYTES or one item
    rows = scratch.write(bags(docs, shared, id_col, text_col), f"bags-{label}")
    n_docs, n_terms = rows.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect()       # at most the vocabulary
    weight = np.zeros(len(items.h1), np.int64)
    for t, n in df:
        weight[t] = _weight(n_docs, n)
    weights = spark.sparkContext.broadcast(weight)
    found = scratch.write(classes(rows, n_docs, max(1, n_terms), k), f"classes-{label}")
    scratch.drop(f"bags-{label}")
    scored = best_classes(found, shared, weights, k).select("item", "score", F.explode("docs").alias("doc"))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = scratch.write(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"ranked-{label}")
    scratch.drop(f"classes-{label}")
    names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {item_type}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.col("doc").alias(id_col), "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item with a score above 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    size = F.octet_length(F.coalesce(F.col(item_text_col), F.lit(""))).cast("long")
    item_type = dict(items.dtypes)[item_col]
    rows = scratch.numbered(items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"), size.alias("size")).where("size > 0"), "items")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = max(1, -(-total // group_bytes))
    # dealt by hash, so that the driver holds one group at a time; one that got too much is cut
    groups = scratch.write(rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")), "groups")
    out = []
    for part in range(n):
        ids, texts, held = [], [], 0
        for r in groups.where(F.col("part") == part).select("id", "text", "size").toLocalIterator():
            if texts and held + r["size"] > group_bytes:
                out.append(_group(docs, ids, texts, k, id_col, text_col, item_type, scratch, str(len(out))))
                ids, texts, held = [], [], 0
            ids.append(r["id"])
            texts.append(r["text"])
            held += r["size"]
        if texts:
            out.append(_group(docs, ids, texts, k, id_col, text_col, item_type, scratch, str(len(out))))
    if not out:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, {id_col} long, score long")
    return reduce(DataFrame.unionByName, out)


def oracle_sql(k: int = TOP) -> str:
    """The same rows in DuckDB SQL."""
    terms = "list_transform(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS w FROM documents),
    i AS (SELECT row_number() OVER () AS i, item_id, {terms} AS w FROM benchmark),
    total AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM d WHERE len(w) > 0),
    q AS (SELECT i, t, count(*) AS repeats FROM (SELECT i, unnest(w) AS t FROM i) GROUP BY i, t),
    tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
    weight AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, n_docs),
    m AS (SELECT r, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM d, total WHERE len(w) > 0),
    s AS (SELECT i, tf.r, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM tf JOIN q ON tf.t = q.t JOIN weight ON tf.t = weight.t JOIN m ON tf.r = m.r GROUP BY i, tf.r),
    ranked AS (SELECT i.item_id, row_number() OVER (PARTITION BY s.i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
      FROM s JOIN d ON s.r = d.r JOIN i ON s.i = i.i WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""
