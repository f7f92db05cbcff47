"""Connected components by hooking and contraction; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joulecorpus.session import as_table


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(u, v)``; the component is its smallest node.

    A round hooks every node to its smallest neighbour, shortens the resulting trees to
    their roots by pointer doubling, and contracts the graph to the roots.  At least half
    of the nodes vanish in a round.  A hub is aggregated before the shuffle and joined as
    a skewed key.  Null ends and loops are dropped; an edge may repeat.
    """
    edges = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = as_table(edges, "edges")
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("parent"))
        parents = _to_roots(as_table(parents, "parents"))
        at = {x: parents.select(F.col("node").alias(x), F.col("parent").alias(f"root_{x}")) for x in ("u", "v")}
        lifted = edges.join(at["u"], "u").join(at["v"], "v").where("root_u <> root_v")
        lifted = lifted.select(F.least("root_u", "root_v").alias("u"), F.greatest("root_u", "root_v").alias("v"))
        if found is None:
            found = parents.withColumnRenamed("parent", "component")
        else:
            step = parents.select(F.col("node").alias("component"), "parent")
            found = found.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        found, edges = as_table(found, "found"), as_table(lifted.distinct(), "edges")
    return found if found is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _to_roots(parents: DataFrame) -> DataFrame:
    """Follow ``parent`` until nothing changes; the distance doubles each time."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        moved = as_table(parents.join(above, "parent").select("node", F.col("above").alias("parent"), (F.col("above") < F.col("parent")).alias("moved")), "parents")
        parents = moved.select("node", "parent")
        if moved.where("moved").isEmpty():
            return parents
