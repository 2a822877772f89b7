"""Connected components: minimum labels along edges, pointer jumping, and a smaller graph each round.

In a round every node takes the least of itself and its neighbours, then twice its label's own label; edges are redrawn between
labels, and those inside one label are dropped, so finished components leave the graph. "Least" is by a hash of the node first:
then chains of labels are short whatever the order of the keys (a path numbered in a row would give one long chain), and the
graph shrinks by a constant share each round. Labels are followed back through the rounds in the end, and each component takes
its least node. Every round is written to the shared checkpoint folder.

All aggregations have a map-side step, and all joins look up one row per node, so a node with very many edges is only large on
one side of a join, where adaptive execution splits it.

Defined cases: null nodes and loops are no edges; repeated and reversed edges count once; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagaloom.session import cut


def _ends(a: str, b: str) -> Column:
    return F.explode(F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("near")), F.struct(F.col(b).alias("node"), F.col(a).alias("near"))))


def _follow(labels: DataFrame, further: DataFrame) -> DataFrame:
    """labels (node, up) with each up replaced by its own up in further, where it has one."""
    return labels.join(further.select(F.col("node").alias("up"), F.col("up").alias("_up")), "up", "left").select("node", F.coalesce("_up", "up").alias("up"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, label: every node of edges (u, v), of any type with an order, with the least node of its component."""
    mixed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    graph = edges.where("u is not null and v is not null and u <> v").select(mixed("u").alias("u"), mixed("v").alias("v"))
    graph = cut(graph.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    rounds: list[DataFrame] = []
    while not graph.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError("components still grow after the last round")
        first = graph.select(_ends("u", "v").alias("e")).groupBy("e.node").agg(F.min("e.near").alias("near")).select("node", F.least("node", "near").alias("up"))
        second = _follow(first, first)
        labels = cut(_follow(second, second))
        rounds.append(labels)
        to = lambda c: labels.select(F.col("node").alias(c), F.col("up").alias(f"_{c}"))  # noqa: B023, E731
        drawn = graph.join(to("u"), "u").join(to("v"), "v").where("_u <> _v")
        graph = cut(drawn.select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct())
    if not rounds:
        return graph.select(F.col("u.n").alias("node"), F.col("v.n").alias("label"))
    labels = rounds.pop()
    while rounds:
        labels = _follow(rounds.pop(), labels)
    labels = cut(labels)
    least = labels.groupBy("up").agg(F.min("node.n").alias("label"))
    return labels.join(least, "up").select(F.col("node.n").alias("node"), "label")
