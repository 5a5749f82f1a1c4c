"""Connected components by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` of every node in ``edges`` (``a``, ``b``): the smallest node it reaches.

    In each round every node points to its smallest neighbour if that is smaller, the pointers are
    followed to their ends, and the edges are drawn anew between the ends. Edges within one
    component vanish, so later rounds are small; the number of rounds grows with the logarithm of
    the nodes. Self-loops are no edges. Only emptiness reaches the driver; the rounds
    lie in the shared folder.
    """
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = staged(ordered.distinct(), "links")
    found = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("m"))
        step = _ends(staged(step.select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "hooks"))
        if found is None:
            found = step
        else:
            onward = step.select(F.col("node").alias("label"), F.col("label").alias("end"))
            found = staged(found.join(onward, "label", "left").select("node", F.coalesce("end", "label").alias("label")), "labels")
        here = step.select(F.col("node").alias("a"), F.col("label").alias("x"))
        there = step.select(F.col("node").alias("b"), F.col("label").alias("y"))
        drawn = links.join(here, "a").join(there, "b").where("x <> y")
        links = staged(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if links.isEmpty():
            return found


def _ends(step: DataFrame) -> DataFrame:
    """Follow ``label`` until it points to itself; the distance doubles each time."""
    while True:
        up = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = staged(step.join(up, "label").select("node", "label", "far"), "hooks")
        step = moved.select("node", F.col("far").alias("label"))
        if moved.where("far <> label").isEmpty():
            return step
