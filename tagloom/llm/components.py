"""Connected components of an edge table, by hooking to the least neighbour and contraction.

Every step is an aggregation with map-side combine or an equi-join of written tables, which Spark may split at
run time when a node is hot. The driver sees only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import drop_stash, stash


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``u, v``): the least node that it reaches.

    Loops, repeats and either direction are fine; rows with a null end are ignored. An edge table without rows
    gives an empty result.
    """
    live = stash(edges.where("u is not null and v is not null and u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while not live.isEmpty():
        root = _roots(live)
        old, labels = labels, root if labels is None else stash(_relabel(labels, root), "labels")
        drop_stash(old)
        # of the edges that are left, those between different roots; distinct as they pass the shuffle
        a = live.join(root.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left")
        b = stash(a.select(F.coalesce("cu", "u").alias("u"), "v"), "half")
        c = b.join(root.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
        c = c.select("u", F.coalesce("cv", "v").alias("v")).where("u != v")
        old, live = live, stash(c.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        drop_stash(old, b, None if root is labels else root)
    if labels is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels


def _roots(edges: DataFrame) -> DataFrame:
    """Every node of ``edges``: those with a lesser neighbour hook to the least one; chains of hooks are cut short by doubling."""
    up = stash(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "up")
    while True:
        nxt = up.select(F.col("node").alias("at"), F.col("component").alias("further"))
        jumped = up.join(nxt, up["component"] == nxt["at"], "left")
        jumped = stash(jumped.select("node", F.coalesce("further", "component").alias("component"), F.col("further").isNotNull().alias("moved")), "up")
        drop_stash(up)
        up = jumped
        if up.where("moved").isEmpty():
            break
    # a node without a lesser neighbour stands for itself, also where no other hooks to it
    roots = edges.select(F.col("v").alias("node")).distinct().join(up, "node", "left_anti").withColumn("component", F.col("node"))
    out = stash(up.select("node", "component").unionByName(roots), "roots")
    drop_stash(up)
    return out


def _relabel(labels: DataFrame, root: DataFrame) -> DataFrame:
    """Labels of earlier rounds follow their components' new roots; the first round has labelled every node."""
    r = root.select(F.col("node").alias("at"), F.col("component").alias("new"))
    return labels.join(r, labels["component"] == r["at"], "left").select("node", F.coalesce("new", "component").alias("component"))
