"""Consolidating pairwise matches into groups (problem 5): records that share values become edges, and edges components.

The components are those of operators/components.py: minimum labels travel along the edges, labels jump to the labels of their
labels, each round is written to the shared checkpoint folder, until nothing changes.

Defined cases: null nodes and loops are no edges; repeated and reversed edges count once; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagaloom.operators.components import connected_components

__all__ = ["connected_components", "star_edges"]


def star_edges(members: DataFrame, keys: list[str], node: str) -> DataFrame:
    """u, v: the members that share keys, tied in a star of two levels instead of all pairs.

    Rows are first tied to the least node of their key and salt, those to the least node of the key, so a key that holds a
    third of all rows gives neither one task nor one node with all the edges.
    """
    salted = members.select(*keys, F.col(node).alias("u"), F.pmod(F.xxhash64(node), F.lit(16)).cast("int").alias("_salt"))
    local = salted.groupBy(*keys, "_salt").agg(F.min("u").alias("v"), F.max("u").alias("_max"))
    tied = local.where("v < _max").drop("_max")
    inner = salted.join(tied, [*keys, "_salt"]).where("u > v").select("u", "v")
    top = local.groupBy(*keys).agg(F.collect_set("v").alias("us"), F.min("v").alias("v")).where(F.size("us") > 1)
    return inner.unionByName(top.select(F.explode("us").alias("u"), "v").where("u > v"))
