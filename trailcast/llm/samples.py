"""Bounded samples of labelled rows that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BYTES = 64 << 20           # text of a class that a classifier learns from, but for its last row


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5 (a null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(text, label, weight, order) of at most ``per_class`` labelled rows of each class that
    aren't held out, chosen by hashed id; weights restore the classes' shares among all such
    labels. An id with several labels counts as 1 if any of them is 1.

    A class's rows are taken, texts of over a sixteenth of ``max_bytes`` last, until they hold
    ``max_bytes`` of text: a sample has at most that and one more text a class."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    shares = dict(known.groupBy("label").count().collect())
    total = max(1, sum(shares.values()))
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = parts[0].union(parts[1])                      # at most 2 * per_class ids
    texts = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
             .groupBy("doc_id", "label").agg(F.min("text").alias("text"))
             .withColumn("order", F.xxhash64(F.lit(7), F.col("doc_id")))
             .withColumn("_size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")))
    each = Window.partitionBy("label")
    before = each.orderBy(F.col("_size") > max_bytes // 16, "order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    taken = texts.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).where(F.col("_before") < max_bytes)
    share = F.lit(0.0)
    for k in (0, 1):
        share = F.when(F.col("label") == k, F.lit(shares.get(k, 0) / total)).otherwise(share)
    # what is left is bounded, and every learner gathers it in one task anyway
    weight = share * F.count("*").over(Window.partitionBy()) / F.count("*").over(each)
    return taken.select("text", "label", weight.alias("weight"), "order")
