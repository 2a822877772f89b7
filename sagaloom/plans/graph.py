"""Queries over the graph of roles: pairs, nodes, strongest links, isolated roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagaloom.functions.rules import SQL_TYPED, STRENGTHS, event_type, lookup, sql_lookup
from sagaloom.operators.ranking import best_per, index_quantile, numbered, top_n
from sagaloom.session import cut
from sagaloom.sources.model import SQL_EVENTS, SQL_LOCATIONS, SQL_PAIRS, SQL_PEOPLE, SQL_ROLES, events, in_people, locations, pairs_of, roles


def edges(spark: SparkSession, d: str) -> DataFrame:
    """One row per book and pair: weight, units, span of progress, strength of the strongest class of shared events, score."""
    ev = events(spark, d).withColumn("event_type", event_type())
    pr = pairs_of(ev).withColumn("strength", lookup(F.col("event_type"), STRENGTHS, 1))
    e = pr.groupBy("book_id", "a", "b").agg(
        F.count(F.lit(1)).alias("weight"),
        F.countDistinct("unit").alias("n_units"),
        F.min("p0").alias("first_progress"),
        F.max("p1").alias("last_progress"),
        F.max("strength").alias("strength"),
    )
    span = F.least(F.coalesce(F.col("last_progress") - F.col("first_progress"), F.lit(0)), F.lit(24))
    return e.withColumn("edge_score", F.round(5 * F.col("weight") + 4 * F.col("strength") + 2 * F.col("n_units") + 0.35 * span, 4))


_STRENGTH = sql_lookup("event_type", STRENGTHS, 1)
_E = f"""{SQL_EVENTS}, {SQL_PEOPLE}, {SQL_TYPED}, {SQL_PAIRS}, g AS (
  SELECT pr.book_id, a, b, count(*) AS weight, count(DISTINCT pr.unit) AS n_units, min(pr.p0) AS first_progress, max(pr.p1) AS last_progress, max({_STRENGTH}) AS strength
  FROM pr JOIN typed t ON t.id = pr.id GROUP BY ALL
), edges AS (SELECT *, round(5 * weight + 4 * strength + 2 * n_units + 0.35 * least(coalesce(last_progress - first_progress, 0), 24), 4) AS edge_score FROM g)"""


def pair_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges of the graph with their scores."""
    return edges(spark, d)


def pair_edges_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 heaviest pairs with the names of both roles."""
    r = roles(spark, d).select("id", "canonical_name", "book_id")
    e = edges(spark, d).select("book_id", "a", "b", "weight")
    named = e.join(r.toDF("a", "name_a", "book_id"), ["book_id", "a"]).join(r.toDF("b", "name_b", "book_id"), ["book_id", "b"])
    return named.orderBy(F.desc("weight"), "book_id", "a", "b").limit(20)


def graph_isolated_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles that take part in no event."""
    return roles(spark, d).select("id", "book_id").join(in_people(events(spark, d)).select(F.col("role").alias("id")), "id", "left_anti")


def graph_linked_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles that share an event with another role of the registry."""
    r = roles(spark, d).select("id", "book_id")
    e = edges(spark, d).select("a", "b")
    known = e.join(r.select(F.col("id").alias("a")), "a", "left_semi").join(r.select(F.col("id").alias("b")), "b", "left_semi")
    return r.join(known.select(F.explode(F.array("a", "b")).alias("id")), "id", "left_semi")


def graph_node_importance(spark: SparkSession, d: str) -> DataFrame:
    """Importance of each role from weights, links and mentions; roles without an edge count as zero."""
    side = edges(spark, d).select("book_id", F.explode(F.array("a", "b")).alias("id"), "weight")
    n = side.groupBy("book_id", "id").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("links"))
    r = roles(spark, d).select("book_id", "id", F.coalesce("total_mentions", F.lit(0)).alias("mentions"))
    j = r.join(n, ["book_id", "id"], "left").fillna(0, ["weight", "links"])
    return j.withColumn("importance", F.round(2.6 * F.col("weight") + 4.4 * F.col("links") + 2.4 * F.log2(F.col("mentions") + 1.0), 4))


def graph_percentile_cut(spark: SparkSession, d: str) -> DataFrame:
    """Edges at or above the score at three quarters of their book's ascending scores, by index."""
    e = edges(spark, d)
    return e.join(index_quantile(e.withColumn("_pair", F.concat_ws("|", "a", "b")), ["book_id"], "edge_score", 0.75, "_pair"), "book_id").where("edge_score >= threshold").select("book_id", "a", "b", "edge_score", "threshold")


def graph_mainline(spark: SparkSession, d: str) -> DataFrame:
    """Per book: the eight strongest edges of its most mentioned role, and all edges among the roles on them."""
    star = best_per(roles(spark, d), ["book_id"], [F.desc_nulls_last("total_mentions"), "id"]).select("book_id", F.col("id").alias("spotlight"))
    e = edges(spark, d).select("book_id", "a", "b", "edge_score")
    own = top_n(e.join(star, "book_id").where("a = spotlight or b = spotlight"), ["book_id"], [F.desc("edge_score"), "a", "b"], 8)
    nodes = own.select("book_id", F.explode(F.array("a", "b")).alias("id")).distinct()
    return e.join(nodes.toDF("book_id", "a"), ["book_id", "a"], "left_semi").join(nodes.toDF("book_id", "b"), ["book_id", "b"], "left_semi")


def graph_best_edge(spark: SparkSession, d: str) -> DataFrame:
    """The strongest edge of each role."""
    both = edges(spark, d).select("book_id", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("s"), "edge_score")
    return best_per(both.select("book_id", "s.id", "s.other", "edge_score"), ["book_id", "id"], [F.desc("edge_score"), "other"])


def graph_capped_links(spark: SparkSession, d: str, density: int = 50) -> DataFrame:
    """Overview graph: each role keeps its strongest edge, further edges by score under a cap per role and in all."""
    return capped_links(edges(spark, d).select("book_id", "a", "b", "edge_score"), 0.16 + density / 300, max(2, 2 + round(density / 25)))


def capped_links(e: DataFrame, share: float, cap: int, max_rounds: int = 40) -> DataFrame:
    """Of edges (book_id, a, b, edge_score), those a fold by (score descending, a, b) keeps: first every edge that is the first of
    one of its nodes, then each whose two nodes have fewer than cap, until share of the book's edges (at least nodes - 1) is kept.

    The fold is done in rounds for all books at once: an edge that is among the first of its two nodes, as many as each may still
    take, is kept whatever happens to later edges. A round ranks edges within nodes only, up to the cap, so no book is one task.
    """
    order = [F.desc("edge_score"), "a", "b"]
    e = cut(e.where("book_id is not null"))

    def sides(edges: DataFrame) -> DataFrame:
        return edges.select("*", F.explode(F.array("a", "b")).alias("node"))

    all_edges = e.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    nodes = sides(e).groupBy("book_id").agg(F.countDistinct("node").alias("nodes"))
    limit = all_edges.join(nodes, "book_id").select("book_id", F.greatest(F.col("nodes") - 1, F.bround(F.col("n") * share)).cast("long").alias("most"))
    first = cut(best_per(sides(e), ["book_id", "node"], order).select("book_id", "a", "b", "edge_score").distinct())
    room = sides(first).groupBy("book_id", "node").agg((F.lit(cap) - F.count(F.lit(1))).alias("room"))
    left = e.join(first, ["book_id", "a", "b"], "left_anti")
    taken: list[DataFrame] = []
    for _ in range(max_rounds):
        free = room.where("room > 0")
        left = left.join(free.select("book_id", F.col("node").alias("a")), ["book_id", "a"], "left_semi").join(free.select("book_id", F.col("node").alias("b")), ["book_id", "b"], "left_semi")
        left = cut(left.select("book_id", "a", "b", "edge_score"))
        best = top_n(sides(left), ["book_id", "node"], order, cap).join(free, ["book_id", "node"]).where("rank_no <= room")
        now = cut(best.groupBy("book_id", "a", "b", "edge_score").agg(F.count(F.lit(1)).alias("ends")).where("ends = 2").drop("ends"))
        if now.isEmpty():
            break
        taken.append(now)
        used = sides(now).groupBy("book_id", "node").agg(F.count(F.lit(1)).alias("used"))
        room = cut(room.join(used, ["book_id", "node"], "left").select("book_id", "node", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")))
        left = left.join(now, ["book_id", "a", "b"], "left_anti")
    else:
        raise RuntimeError("edges are still taken after the last round")
    if not taken:
        return first
    more = reduce(DataFrame.unionByName, taken)
    have = first.groupBy("book_id").agg(F.count(F.lit(1)).alias("have"))
    placed = numbered(more, ["book_id"], -F.floor("edge_score"), order, "place").join(limit.join(have, "book_id"), "book_id")
    return first.unionByName(placed.where("place <= most - have").select("book_id", "a", "b", "edge_score"))


def role_relation_groups(spark: SparkSession, d: str) -> DataFrame:
    """Per role and counterpart: shared events, distinct units, first progress."""
    both = F.explode(F.array(F.struct(F.col("a").alias("role"), F.col("b").alias("other")), F.struct(F.col("b").alias("role"), F.col("a").alias("other"))))
    p = pairs_of(events(spark, d)).select("book_id", "unit", "p0", both.alias("s")).select("book_id", "unit", "p0", "s.*")
    return p.groupBy("book_id", "role", "other").agg(F.count(F.lit(1)).alias("weight"), F.countDistinct("unit").alias("units"), F.min("p0").alias("first_progress"))


def related_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Distinct relatives of each role, each relation counted for both sides."""
    from sagaloom.sources.model import clean_ids

    e = roles(spark, d).select(F.lower("id").alias("x"), F.explode(clean_ids("related_entities")).alias("y")).where("x <> y")
    both = e.union(e.select("y", "x")).toDF("id", "other").distinct()
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("n_related"), F.array_join(F.array_sort(F.collect_set("other")), ",").alias("related"))


def location_top_roles(spark: SparkSession, d: str) -> DataFrame:
    """The five roles most bound to each place: one for an association, one for each event there."""
    a = locations(spark, d).select("id", F.explode("people").alias("role"), F.lit(1).alias("n"))
    b = in_people(events(spark, d)).where("location is not null").select(F.col("location").alias("id"), "role", F.lit(1).alias("n"))
    known = locations(spark, d).select("id")
    s = a.union(b).groupBy("id", "role").agg(F.sum("n").alias("n")).join(known, "id", "left_semi")
    return top_n(s, ["id"], [F.desc("n"), "role"], 5)


def role_top_locations(spark: SparkSession, d: str) -> DataFrame:
    """The eight places where each role takes part in most events."""
    s = in_people(events(spark, d)).where("location is not null").groupBy("role", "location").agg(F.count(F.lit(1)).alias("n"))
    return top_n(s, ["role"], [F.desc("n"), "location"], 8)


_SIDES = "sides AS (SELECT book_id, a AS id, b AS other, weight, edge_score FROM edges UNION ALL SELECT book_id, b, a, weight, edge_score FROM edges)"
QUERIES = {
    "pair_edges": pair_edges, "pair_edges_topk": pair_edges_topk, "graph_isolated_roles": graph_isolated_roles, "graph_linked_roles": graph_linked_roles,
    "graph_node_importance": graph_node_importance, "graph_percentile_cut": graph_percentile_cut, "graph_mainline": graph_mainline, "graph_best_edge": graph_best_edge,
    "graph_capped_links": graph_capped_links, "role_relation_groups": role_relation_groups, "related_both_ways": related_both_ways,
    "location_top_roles": location_top_roles, "role_top_locations": role_top_locations,
}
SQL = {
    "pair_edges": f"WITH {_E} SELECT * FROM edges",
    "pair_edges_topk": f"""WITH {_E}, {SQL_ROLES} SELECT e.book_id, a, b, weight, x.canonical_name AS name_a, y.canonical_name AS name_b FROM edges e
        JOIN role x ON x.id = a AND x.book_id = e.book_id JOIN role y ON y.id = b AND y.book_id = e.book_id ORDER BY weight DESC, e.book_id, a, b LIMIT 20""",
    "graph_isolated_roles": f"WITH {SQL_EVENTS}, {SQL_PEOPLE}, {SQL_ROLES} SELECT id, book_id FROM role WHERE id NOT IN (SELECT role FROM ep)",
    "graph_linked_roles": f"""WITH {_E}, {SQL_ROLES}, k AS (SELECT a, b FROM edges WHERE a IN (SELECT id FROM role) AND b IN (SELECT id FROM role))
        SELECT id, book_id FROM role WHERE id IN (SELECT a FROM k) OR id IN (SELECT b FROM k)""",
    "graph_node_importance": f"""WITH {_E}, {SQL_ROLES}, {_SIDES}, n AS (SELECT book_id, id, sum(weight) AS weight, count(*) AS links FROM sides GROUP BY ALL)
        SELECT r.book_id, r.id, coalesce(total_mentions, 0) AS mentions, coalesce(weight, 0) AS weight, coalesce(links, 0) AS links,
          round(2.6 * coalesce(weight, 0) + 4.4 * coalesce(links, 0) + 2.4 * log2(coalesce(total_mentions, 0) + 1.0), 4) AS importance
        FROM role r LEFT JOIN n ON n.book_id = r.book_id AND n.id = r.id""",
    "graph_percentile_cut": f"""WITH {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY edge_score) AS pos, count(*) OVER (PARTITION BY book_id) AS n FROM edges),
        t AS (SELECT book_id, edge_score AS threshold FROM o WHERE pos - 1 = floor((n - 1) * 0.75)) SELECT e.book_id, a, b, edge_score, threshold FROM edges e JOIN t ON t.book_id = e.book_id WHERE edge_score >= threshold""",
    "graph_mainline": f"""WITH {_E}, {SQL_ROLES}, star AS (SELECT book_id, id FROM role QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY total_mentions DESC NULLS LAST, id) = 1),
        own AS (SELECT e.* FROM edges e JOIN star s ON s.book_id = e.book_id AND s.id IN (a, b) QUALIFY row_number() OVER (PARTITION BY e.book_id ORDER BY edge_score DESC, a, b) <= 8),
        nodes AS (SELECT book_id, a AS id FROM own UNION SELECT book_id, b FROM own)
        SELECT e.book_id, a, b, edge_score FROM edges e WHERE (e.book_id, a) IN (SELECT (book_id, id) FROM nodes) AND (e.book_id, b) IN (SELECT (book_id, id) FROM nodes)""",
    "graph_best_edge": f"WITH {_E}, {_SIDES} SELECT book_id, id, other, edge_score FROM sides QUALIFY row_number() OVER (PARTITION BY book_id, id ORDER BY edge_score DESC, other) = 1",
    "role_relation_groups": f"""WITH {SQL_EVENTS}, {SQL_PEOPLE} SELECT x.book_id, x.role, y.role AS other, count(*) AS weight, count(DISTINCT x.unit) AS units, min(x.p0) AS first_progress
        FROM ep x JOIN ep y ON x.id = y.id AND x.role <> y.role GROUP BY ALL""",
    "related_both_ways": f"""WITH {SQL_ROLES}, e AS (SELECT DISTINCT lower(id) AS x, lower(trim(y)) AS y FROM (SELECT id, unnest(related_entities) AS y FROM role) WHERE trim(y) <> ''), b AS (
        SELECT x, y FROM e WHERE x <> y UNION SELECT y, x FROM e WHERE x <> y) SELECT x AS id, count(*) AS n_related, string_agg(y, ',' ORDER BY y) AS related FROM b GROUP BY x""",
    "location_top_roles": f"""WITH {SQL_EVENTS}, {SQL_PEOPLE}, {SQL_LOCATIONS}, u AS (SELECT id, unnest(people) AS role FROM loc UNION ALL SELECT location, role FROM ep WHERE location IS NOT NULL),
        s AS (SELECT id, role, count(*) AS n FROM u WHERE id IN (SELECT id FROM loc) GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, role) AS rank_no FROM s) SELECT * FROM t WHERE rank_no <= 5""",
    "role_top_locations": f"""WITH {SQL_EVENTS}, {SQL_PEOPLE}, s AS (SELECT role, location, count(*) AS n FROM ep WHERE location IS NOT NULL GROUP BY ALL),
        t AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, location) AS rank_no FROM s) SELECT * FROM t WHERE rank_no <= 8""",
}
