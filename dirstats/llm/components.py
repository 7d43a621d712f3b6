"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirstats.llm.scratch import written


def _with_least(edges: DataFrame, own: bool) -> DataFrame:
    """Edges (u, v) with the least neighbour of u, u itself included. The minimum is combined
    before the shuffle and joined back, so a node with very many neighbours is no single task."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m") if own else F.col("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the least node that can
    be reached. Null ends are ignored. Alternates two steps until nothing changes, in a number
    of rounds that grows with the logarithm of the longest chain: the large step hangs every
    larger neighbour of a node under the least neighbour, the small step does so with the
    smaller ones. Each round is written, so none is computed twice."""
    pairs = (
        edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
        .where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    nodes = pairs
    current = written(pairs, "edges")
    nodes = current
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_least(both, own=True)
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = _with_least(large, own=False)
        after = written(
            least.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "edges",
        )
        # stars: every node hangs under one centre, and no centre hangs under another
        moved = after.exceptAll(current).isEmpty() and current.exceptAll(after).isEmpty()
        current = after
        if moved:
            break
    hung = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = hung.select(F.col("component").alias("node"), "component").distinct()
    lost = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return lost.join(hung.unionByName(centres), "node")
