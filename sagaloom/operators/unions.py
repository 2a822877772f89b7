"""Grouping of names: components of a graph of names, and unions with a cap per group that depend on the order of edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagaloom.operators.components import connected_components


def name_components(edges: DataFrame, group: str) -> DataFrame:
    """group, name, root: each name of edges (group, x, y) with the least name it hangs together with."""
    node = lambda c: F.when(F.col(group).isNotNull() & F.col(c).isNotNull(), F.struct(F.col(group).alias("g"), F.col(c).alias("name")))
    found = connected_components(edges.select(node("x").alias("u"), node("y").alias("v")))
    return found.select(F.col("node.g").alias(group), F.col("node.name").alias("name"), F.col("label.name").alias("root"))


def capped_unions(edges: DataFrame, group: str, cap: int = 15) -> DataFrame:
    """group, name, root of unions of edges (group, x, y, ord) in order: a union beyond cap names is refused, the root is the
    shorter name, the left one on ties.

    Unions never cross components of the uncapped graph, so each component replays its own edges. A component is bounded by the
    names that hang together, not by their mentions, as edges are distinct with their first order.
    """
    first = edges.where("x is not null and y is not null").groupBy(group, "x", "y").agg(F.min("ord").alias("ord"))
    comp = name_components(first, group).select(group, F.col("name").alias("x"), F.col("root").alias("comp"))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[str, str] = {}
        size: dict[str, int] = {}

        def find(n: str) -> str:
            parent.setdefault(n, n)
            size.setdefault(n, 1)
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        for r in pdf.sort_values(["ord", "x", "y"]).itertuples():
            a, b = find(r.x), find(r.y)
            if a == b or size[a] + size[b] > cap:
                continue
            top, low = (a, b) if len(a) <= len(b) else (b, a)
            parent[low] = top
            size[top] += size[low]
        g = pdf[group].iloc[0]
        return pd.DataFrame([(g, n, find(n)) for n in sorted(parent)], columns=[group, "name", "root"])

    return first.join(comp, [group, "x"]).groupBy(group, "comp").applyInPandas(replay, f"{group} long, name string, root string")
