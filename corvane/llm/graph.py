"""Connected components of a large sparse graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import store


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for each node of `edges`
    (columns a, b), root itself left out.

    Alternates large-star and small-star steps, which keep components and halve
    what is left, until every edge leads to its root.  Each step is one sum by
    node and one join; both sides are tables, so that a node with very many
    edges can be dealt out."""
    e = store.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if mark == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        both = store.keep(e.union(e.select("b", "a")), "star")
        least = store.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        e = store.keep(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = store.keep(e.groupBy("a").agg(F.min("b").alias("m")), "least")
        near = e.join(least, "a")
        e = store.keep(near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct(), "small")
