"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm._store import Store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, store: Store, tag: str = "cc") -> DataFrame:
    """Rows (node, component) for every node with an edge; component is the smallest node reachable.

    edges: two columns of one orderable type; loops, repeats and nulls are ignored. Each step takes minima by a
    partial aggregation and joins them back, so no node's neighbours are gathered in one place; each round is
    written to the shared folder. An empty input gives an empty result.
    """
    a, b = edges.columns
    now = store.put(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), f"{tag}0")
    state, k = None, 0
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v") % 1_000_003)).first()
        if tuple(seen) == state or not seen[0]:
            break
        state, k = tuple(seen), k + 1
        now = store.put(_small_star(_large_star(now).distinct()).distinct(), f"{tag}{k}")
        store.drop(f"{tag}{k - 1}")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
