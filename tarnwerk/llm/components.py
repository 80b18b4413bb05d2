"""Union-find over edges that no machine holds alone.

Each round hooks every label to its least smaller neighbour, halves the paths by pointer jumping
until they are flat, and contracts the edges. All steps are joins and aggregations with partial
sums, so a label with very many edges is reduced on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, empty


def connected(edges: DataFrame, work: Workspace) -> DataFrame:
    """``edges`` (a long, b long) -> (node long, root long) for every node that has an edge; the
    root is the smallest node reachable. Self-loops, repeated and reversed edges are harmless;
    no edges give no rows."""
    todo = work.keep(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    roots: DataFrame | None = None
    while not empty(todo):
        parents = work.keep(todo.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            flat = work.keep(parents.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
            parents = flat.select("node", "root")
            if empty(flat.where("moved")):
                break
        nodes = todo.select(F.col("a").alias("node")).union(todo.select(F.col("b").alias("node"))).distinct() if roots is None else None
        base = roots if roots is not None else nodes.select("node", F.col("node").alias("root"))
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        roots = work.keep(base.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")))
        one = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        two = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = todo.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        todo = work.keep(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if roots is None:
        return work.spark.createDataFrame([], "node long, root long")
    return roots
