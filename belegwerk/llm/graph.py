"""Connected components as joins and aggregates; edges and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node reachable over the undirected edges (a, b), for every node that has one.

    Each round every node hooks to its least neighbour, pointers are doubled until they rest on roots, and the edges
    are rewritten to roots; loops and repeats go, so the graph shrinks at least by half where it is connected. Nodes
    may be of any ordered type. Hubs cost a partial minimum and a join that adaptive execution can split. Every round
    is a written table."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p"))
        hooks = written(hooks.select("node", F.least("node", "p").alias("p")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("p"), F.col("p").alias("q"))
            twice = hooks.join(up, "p").select("node", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved"))
            twice = written(twice, "hooks")
            hooks = twice.select("node", "p")
            if twice.where("moved").isEmpty():
                break
        maps.append(hooks)
        a = hooks.select(F.col("node").alias("a"), F.col("p").alias("x"))
        b = hooks.select(F.col("node").alias("b"), F.col("p").alias("y"))
        moved = edges.join(a, "a").join(b, "b").where("x <> y")
        edges = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0]
    for step in maps[1:]:
        step = step.select(F.col("node").alias("p"), F.col("p").alias("q"))
        out = out.join(step, "p", "left").select("node", F.coalesce("q", "p").alias("p"))
    return written(out.select("node", F.col("p").alias("component")), "components")
