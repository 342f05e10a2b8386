"""Connected components of a link table, by contraction.

Each round every node takes the neighbour of least hashed id (or itself) as its
representative and links are rewritten to representatives; with a hashed order a chain
shrinks by a constant factor a round and a star in two. Hubs cost nothing extra: the least
neighbour is an aggregate with partial results, and the joins are by a key on one side that
is unique, which adaptive execution splits where it is skewed. Rounds are tables in the
scratch folder; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailcast.llm.scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """``links``: columns a, b (long). Returns (node, root): nodes of a component share a root,
    which is one of them; nodes without a link to another node are absent."""
    links = scratch.write(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-links-0")
    steps, k = [], 0
    while not links.isEmpty():
        ends = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        least = ends.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("id"))
        step = scratch.write(least.select("node", F.least(F.col("m"), own)["id"].alias("root")), f"{label}-step-{k}")
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = links.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        k += 1
        links = scratch.write(moved, f"{label}-links-{k}")
        scratch.drop(f"{label}-links-{k - 1}")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    final = steps[-1]
    for i in range(len(steps) - 2, -1, -1):
        later = final.select(F.col("node").alias("root"), F.col("root").alias("last"))
        final = scratch.write(steps[i].join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")), f"{label}-final-{i}")
        scratch.drop(f"{label}-step-{i + 1}", f"{label}-final-{i + 1}")
    return final
