"""Connected components on DataFrames: min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) for every vertex of the undirected edges (a, b); label is the smallest id of its component.

    Each round takes the smallest label among a vertex and its neighbours, then jumps to that label's own label, so
    the rounds grow with the logarithm of the diameter. The state of each round is a written table. Self-loops make
    vertices; edges with a null end are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    both = e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    both = cut(both, "edges")
    labels = cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("n"))
        step = cut(labels.join(near, "x").select("x", F.col("l").alias("was"), F.least("l", "n").alias("l")), "labels")
        # labels that have a smaller label by now; most are roots, so this side stays small. Written, its size is known
        # to the planner, which then need not bring the rows of a large component together by their label
        own = step.select(F.col("x").alias("l"), F.col("l").alias("h")).where("l <> h")
        hop = cut(step.select("l").distinct().join(own, "l"), "hops")
        labels = step.join(hop, "l", "left").select("x", F.coalesce("h", "l").alias("l"))
        if not step.where("l <> was").limit(1).count() and not hop.limit(1).count():
            return step.select(F.col("x").alias("id"), F.col("l").alias("label"))
