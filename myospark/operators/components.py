"""Connected components: of one graph of any size by alternating stars, of many small graphs by key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, unsent


#: Places over which the edges of a node are dealt, so a node with a third of all edges is not one task's.
SALTS = 8


def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with m of their u; least has one row a node, which goes to each of the node's places."""
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(unsent(copies), ["u", "salt"]).drop("salt")


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung onto the least node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.when(F.col("m") < F.col("u"), F.col("m")).otherwise(F.col("u")))
    return with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are hung onto the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = with_least(edges, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the least node of the component.

    Nodes may be of any type with an order, structs too. Edges with a null end and loops are ignored. Each turn is two
    joins whose key is aggregated before the shuffle, is written to the shared folder, and about squares what a
    component has gathered, so chains of n nodes take about log n turns.
    """
    u, v = F.col(a), F.col(b)
    up = u > v
    now = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.when(up, u).otherwise(v).alias("u"), F.when(up, v).otherwise(u).alias("v")).distinct()
    now, seen = materialize(now, "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        now = materialize(small_star(large_star(now)), "stars")



def components_by_key(edges: DataFrame, key: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(key, node, root) for many small graphs at once: the edges of each key are one task's, so a graph must fit there;
    connected_components is for graphs of any size."""
    kinds = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in key)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate([group[a], group[b]]), return_inverse=True)
        root = np.arange(len(nodes))
        u, v = at[: len(group)], at[len(group) :]
        while True:
            low = np.minimum(root[u], root[v])
            new = root.copy()
            for side in (u, v):
                np.minimum.at(new, root[side], low)
                np.minimum.at(new, side, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({**{c: group[c].iloc[0] for c in key}, "node": nodes, "root": nodes[root]})

    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*key, a, b)
    return known.groupBy(*key).applyInPandas(solve, f"{kinds}, node long, root long")
