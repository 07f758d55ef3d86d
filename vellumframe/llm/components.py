"""Connected components by repeated contraction: joins and sums only, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (v, component): component is the smallest id reachable. Vertices without edges are not listed.

    Each round hooks every vertex to its smallest neighbour, follows pointers to the roots and contracts the edges
    onto them, so that the number of live vertices at least halves. Nothing is collected but one boolean a round.
    """
    live = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    maps: list[DataFrame] = []
    while True:
        if live.isEmpty():
            break
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = staged(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("p")), "roots")
        while True:
            up = roots.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            nxt = staged(roots.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "roots")
            moved = not nxt.filter("moved").isEmpty()
            drop(roots)
            roots = nxt
            if not moved:
                break
        maps.append(roots)
        to_a, to_b = roots.select(F.col("v").alias("a"), F.col("p").alias("pa")), roots.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        cut = live.join(to_a, "a").join(to_b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        nxt = staged(cut, "edges")
        drop(live)
        live = nxt
    if not maps:
        return live.select(F.col("a").alias("v"), F.col("b").alias("component"))
    out = maps[0].select("v", F.col("p").alias("component"))
    for m in maps[1:]:
        out = out.join(m.select(F.col("v").alias("component"), F.col("p").alias("further")), "component", "left").select("v", F.coalesce("further", "component").alias("component"))
    return out
