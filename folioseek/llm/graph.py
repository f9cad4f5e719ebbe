"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (node, component): the smallest node reachable, for each node that has an edge.

    Each round hooks every node to its least neighbour, jumps twice, and contracts the edges to the new labels, so their
    number falls until none is left; a chain halves at least. Lineage is cut by two tables a round.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        jump = hooks.alias("x").join(hooks.alias("y"), F.col("x.m") == F.col("y.u"), "left")
        hooks = written(jump.select("x.u", F.coalesce("y.m", "x.m").alias("m")), "hooks")
        end = lambda name: hooks.select(F.col("u").alias(name), F.col("m").alias(f"{name}_m"))  # noqa: B023, E731
        if labels is None:
            labels = hooks.select(F.col("u").alias("node"), F.col("m").alias("component"))
        else:
            moved = labels.join(end("component"), "component", "left")
            labels = written(moved.select("node", F.coalesce("component_m", "component").alias("component")), "labels")
        moved = edges.join(end("a"), "a").join(end("b"), "b").where("a_m <> b_m")
        edges = written(moved.select(F.least("a_m", "b_m").alias("a"), F.greatest("a_m", "b_m").alias("b")).distinct(), "edges")
    return labels
