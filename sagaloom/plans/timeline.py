"""Queries along the progress axis: range filters, timeline views, searches, views of roles and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagaloom.functions.ranges import overlap_size, overlaps, sql_overlap_size, sql_overlaps
from sagaloom.operators.ranking import best_per, numbered, top_n
from sagaloom.sources.model import SQL_EVENTS, SQL_LOCATIONS, SQL_PEOPLE, SQL_ROLES, events, in_people, locations, roles
from sagaloom.sources.tables import table

UNITS, PROGRESS = (5, 10), (40, 110)
#: Powers too general to name a role's side.
GENERIC_POWERS = ["山上", "山下", "山水", "江湖", "道家", "武道", "未归类", "灯下会"]


def events_in_range(spark: SparkSession, d: str) -> DataFrame:
    """Events whose units and progress both meet the wanted ranges."""
    u = F.array_min("source_units"), F.array_max("source_units")
    return events(spark, d).where(overlaps(*u, UNITS) & overlaps(F.col("p0"), F.col("p1"), PROGRESS)).select("id", "book_id", "name", "p0", "p1")


def unit_membership(spark: SparkSession, d: str) -> DataFrame:
    """Events with any source unit in the wanted range."""
    return events(spark, d).where(F.exists("source_units", lambda x: x.between(*UNITS))).select("id", "unit")


def overlap_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Steps each event shares with the wanted progress range."""
    return events(spark, d).select("id", overlap_size(F.col("p0"), F.col("p1"), PROGRESS).alias("shared"))


def null_progress_passes(spark: SparkSession, d: str) -> DataFrame:
    """The other null rule: spans without any end pass, others must overlap."""
    return events(spark, d).where((F.col("p0").isNull()) | overlaps(F.col("p0"), F.col("p1"), PROGRESS)).select("id", "p0", "p1")


def roles_in_range(spark: SparkSession, d: str) -> DataFrame:
    """Roles (by id) with an event in the unit range."""
    hit = in_people(events(spark, d).where(F.exists("source_units", lambda x: x.between(*UNITS)))).select(F.col("role").alias("id"))
    return roles(spark, d).select("id", "book_id").join(hit, "id", "left_semi")


def mentions_in_range(spark: SparkSession, d: str) -> DataFrame:
    """Participations per role in all and within the progress range."""
    inside = overlaps(F.col("p0"), F.col("p1"), PROGRESS)
    return in_people(events(spark, d)).groupBy("book_id", "role").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(inside, 1)).alias("n_in_range"))


def timeline_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Place of each event on its book's timeline: by progress with nulls last, unit, name, id."""
    rest = [F.asc_nulls_last("unit"), F.asc_nulls_last("name"), F.col("id")]
    return numbered(events(spark, d), ["book_id"], F.col("p0"), rest, "place").select("book_id", "id", "place")


def timeline_points(spark: SparkSession, d: str) -> DataFrame:
    """One point per book and start of progress: events and the label of the first."""
    ev = events(spark, d).where("p0 is not null")
    return ev.groupBy("book_id", "p0").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "name"))["name"].alias("label"), F.sum(F.size("people")).alias("people"))


def timeline_search(spark: SparkSession, d: str) -> DataFrame:
    """Events with the keyword in name, description, place or any participant, case folded."""
    word = "钥"
    low = lambda c: F.coalesce(F.lower(c).contains(word), F.lit(False))
    return events(spark, d).where(low("name") | low("description") | low("location") | F.exists("people", lambda p: F.lower(p).contains(word))).select("id", "name")


def timeline_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of ten of each book's timeline."""
    return timeline_sorted(spark, d).where(F.col("place").between(21, 30))


def power_members(spark: SparkSession, d: str) -> DataFrame:
    """Roles that take part in an event with their displayed power; without a power they fall under 其他."""
    named = F.filter(F.concat(F.array("primary_power"), F.coalesce("powers", F.array().cast("array<string>"))), lambda p: p.isNotNull() & (p != ""))
    shown = F.coalesce(F.get(F.filter(named, lambda p: ~p.isin(*GENERIC_POWERS)), F.lit(0)), F.get(named, F.lit(0)), F.lit("其他"))
    present = in_people(events(spark, d)).select(F.col("role").alias("id"))
    return roles(spark, d).join(present, "id", "left_semi").select("book_id", "id", shown.alias("power"))


def power_distribution(spark: SparkSession, d: str) -> DataFrame:
    """How many of these roles each displayed power of a book has; the roles themselves are power_members."""
    return power_members(spark, d).groupBy("book_id", "power").agg(F.count(F.lit(1)).alias("n"))


def entity_search(spark: SparkSession, d: str) -> DataFrame:
    """Roles and places by relevance to a word: exact name 100, part of the name 50, each alias 80 or 30, description 10."""
    word = "青"

    def score(name: str, others: str, text: str):
        alias = F.aggregate(
            F.coalesce(others, F.array().cast("array<string>")), F.lit(0), lambda s, x: s + F.when(F.lower(x) == word, 80).when(F.coalesce(F.lower(x).contains(word), F.lit(False)), 30).otherwise(0)
        )
        own = F.when(F.lower(name) == word, 100).when(F.lower(name).contains(word), 50).otherwise(0)
        return own + alias + F.when(F.col(text).contains(word), 10).otherwise(0)

    a = roles(spark, d).select(F.lit("role").alias("kind"), "id", score("canonical_name", "all_names", "description").alias("score"))
    b = locations(spark, d).select(F.lit("location").alias("kind"), "id", score("canonical_name", "all_names", "description").alias("score"))
    return a.union(b).where("score > 0")


def roles_by_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Each book's roles by mentions, with their place."""
    return numbered(roles(spark, d), ["book_id"], -F.col("total_mentions"), ["id"], "place").select("book_id", "id", "total_mentions", "place")


def locations_top(spark: SparkSession, d: str) -> DataFrame:
    """The 20 places with most events, then mentions."""
    n = events(spark, d).where("location is not null").groupBy(F.col("location").alias("id")).agg(F.count(F.lit(1)).alias("n_events"))
    loc = locations(spark, d).select("id", "canonical_name", F.coalesce("total_mentions", F.lit(0)).alias("mentions")).join(n, "id", "left").fillna(0, ["n_events"])
    return loc.orderBy(F.desc("n_events"), F.desc("mentions"), "id").limit(20)


def kb_summary(spark: SparkSession, d: str) -> DataFrame:
    """Totals of each kind of record."""
    count = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    org = table(spark, d, "organizations").select("org_key").distinct()
    return count(roles(spark, d), "roles").union(count(locations(spark, d), "locations")).union(count(events(spark, d), "events")).union(count(org, "organizations"))


def nearest_forward_anchor(spark: SparkSession, d: str) -> DataFrame:
    """For every event, the unit whose first progress is the nearest at or after its end, else the last unit of the book.

    A union with the anchors and one window instead of an inequality join.
    """
    ev = events(spark, d)
    anchors = ev.where("unit is not null and p0 is not null").groupBy("book_id", "unit").agg(F.min("p0").alias("start"))
    w = Window.partitionBy("book_id").orderBy(F.desc("at"), F.desc("is_event"), F.desc("unit")).rowsBetween(Window.unboundedPreceding, 0)
    last = anchors.groupBy("book_id").agg(F.max(F.struct("start", "unit"))["unit"].alias("last_unit"))
    both = ev.where("p1 is not null").select("book_id", F.col("p1").alias("at"), F.lit(0).alias("is_event"), F.lit(None).cast("int").alias("unit"), "id").unionByName(
        anchors.select("book_id", F.col("start").alias("at"), F.lit(1).alias("is_event"), "unit", F.lit(None).cast("string").alias("id"))
    )
    seen = both.withColumn("anchor", F.last("unit", ignorenulls=True).over(w)).where("id is not null")
    return seen.join(last, "book_id").select("id", F.coalesce("anchor", "last_unit").alias("anchor_unit"))


def latest_revision(spark: SparkSession, d: str) -> DataFrame:
    """The latest record of each role id, ties to the greater key."""
    t = table(spark, d, "unified_roles").where("id is not null").select("id", "record_id", "updated_at", "canonical_name")
    return best_per(t.distinct(), ["id"], [F.desc_nulls_last("updated_at"), F.desc("record_id")])


def alias_index(spark: SparkSession, d: str) -> DataFrame:
    """Name to role of each book; of several claims the last in the order of ids wins."""
    r = roles(spark, d).select("book_id", "id", F.explode("all_names").alias("name")).where("name is not null")
    return top_n(r, ["book_id", "name"], [F.desc("id")], 1).select("book_id", "name", "id")


_NAMED = "list_filter(list_concat([primary_power], coalesce(powers, [])), lambda p: p IS NOT NULL AND p <> '')"
_GENERIC = ", ".join(f"'{p}'" for p in GENERIC_POWERS)
_SEARCH = "CASE WHEN lower(canonical_name) = '青' THEN 100 WHEN contains(lower(canonical_name), '青') THEN 50 ELSE 0 END + coalesce(list_sum(list_transform(all_names, lambda x: CASE WHEN lower(x) = '青' THEN 80 WHEN contains(lower(x), '青') THEN 30 ELSE 0 END)), 0) + CASE WHEN contains(description, '青') THEN 10 ELSE 0 END"
_PLACED = "row_number() OVER (PARTITION BY book_id ORDER BY p0 NULLS LAST, unit NULLS LAST, name NULLS LAST, id) AS place"
QUERIES = {
    "events_in_range": events_in_range, "unit_membership": unit_membership, "overlap_sizes": overlap_sizes, "null_progress_passes": null_progress_passes, "roles_in_range": roles_in_range,
    "mentions_in_range": mentions_in_range, "timeline_sorted": timeline_sorted, "timeline_points": timeline_points, "timeline_search": timeline_search, "timeline_page": timeline_page,
    "power_distribution": power_distribution, "power_members": power_members, "entity_search": entity_search, "roles_by_mentions": roles_by_mentions, "locations_top": locations_top, "kb_summary": kb_summary,
    "nearest_forward_anchor": nearest_forward_anchor, "latest_revision": latest_revision, "alias_index": alias_index,
}
_POWERS = f"""{SQL_EVENTS}, {SQL_PEOPLE}, {SQL_ROLES}, s AS (SELECT book_id, id, coalesce(list_filter({_NAMED}, lambda p: p NOT IN ({_GENERIC}))[1], ({_NAMED})[1], '其他') AS power
  FROM role WHERE id IN (SELECT ep.role FROM ep))"""
SQL = {
    "events_in_range": f"WITH {SQL_EVENTS} SELECT id, book_id, name, p0, p1 FROM ev WHERE {sql_overlaps('list_min(source_units)', 'list_max(source_units)', UNITS)} AND {sql_overlaps('p0', 'p1', PROGRESS)}",
    "unit_membership": f"WITH {SQL_EVENTS} SELECT id, unit FROM ev WHERE len(list_filter(source_units, lambda x: x BETWEEN {UNITS[0]} AND {UNITS[1]})) > 0",
    "overlap_sizes": f"WITH {SQL_EVENTS} SELECT id, {sql_overlap_size('p0', 'p1', PROGRESS)} AS shared FROM ev",
    "null_progress_passes": f"WITH {SQL_EVENTS} SELECT id, p0, p1 FROM ev WHERE p0 IS NULL OR {sql_overlaps('p0', 'p1', PROGRESS)}",
    "roles_in_range": f"WITH {SQL_EVENTS}, {SQL_PEOPLE}, {SQL_ROLES} SELECT id, book_id FROM role WHERE id IN (SELECT ep.role FROM ep WHERE len(list_filter(source_units, lambda x: x BETWEEN {UNITS[0]} AND {UNITS[1]})) > 0)",
    "mentions_in_range": f"WITH {SQL_EVENTS}, {SQL_PEOPLE} SELECT book_id, role, count(*) AS n, count(*) FILTER ({sql_overlaps('p0', 'p1', PROGRESS)}) AS n_in_range FROM ep GROUP BY ALL",
    "timeline_sorted": f"WITH {SQL_EVENTS} SELECT book_id, id, {_PLACED} FROM ev",
    "timeline_points": f"WITH {SQL_EVENTS} SELECT book_id, p0, count(*) AS n, min_by(name, id) AS label, CAST(sum(len(people)) AS BIGINT) AS people FROM ev WHERE p0 IS NOT NULL GROUP BY ALL",
    "timeline_search": f"WITH {SQL_EVENTS} SELECT id, name FROM ev WHERE contains(lower(name), '钥') OR contains(lower(description), '钥') OR contains(lower(location), '钥') OR len(list_filter(people, lambda p: contains(p, '钥'))) > 0",
    "timeline_page": f"WITH {SQL_EVENTS}, t AS (SELECT book_id, id, {_PLACED} FROM ev) SELECT * FROM t WHERE place BETWEEN 21 AND 30",
    "power_members": f"WITH {_POWERS} SELECT book_id, id, power FROM s",
    "power_distribution": f"WITH {_POWERS} SELECT book_id, power, count(*) AS n FROM s GROUP BY ALL",
    "entity_search": f"""WITH {SQL_ROLES}, {SQL_LOCATIONS}, s AS (SELECT 'role' AS kind, id, {_SEARCH} AS score FROM role UNION ALL SELECT 'location', id, {_SEARCH} FROM loc) SELECT kind, id, CAST(score AS INT) AS score FROM s WHERE score > 0""",
    "roles_by_mentions": f"WITH {SQL_ROLES} SELECT book_id, id, total_mentions, row_number() OVER (PARTITION BY book_id ORDER BY total_mentions DESC NULLS LAST, id) AS place FROM role",
    "locations_top": f"""WITH {SQL_EVENTS}, {SQL_LOCATIONS}, n AS (SELECT location, count(*) AS n FROM ev WHERE location IS NOT NULL GROUP BY 1)
        SELECT id, canonical_name, coalesce(total_mentions, 0) AS mentions, coalesce(n, 0) AS n_events FROM loc LEFT JOIN n ON n.location = id ORDER BY n_events DESC, mentions DESC, id LIMIT 20""",
    "kb_summary": f"""WITH {SQL_EVENTS}, {SQL_ROLES}, {SQL_LOCATIONS} SELECT 'roles' AS kind, count(*) AS n FROM role UNION ALL SELECT 'locations', count(*) FROM loc
        UNION ALL SELECT 'events', count(*) FROM ev UNION ALL SELECT 'organizations', count(DISTINCT org_key) FROM organizations""",
    "nearest_forward_anchor": f"""WITH {SQL_EVENTS}, a AS (SELECT book_id, unit, min(p0) AS start FROM ev WHERE unit IS NOT NULL AND p0 IS NOT NULL GROUP BY ALL)
        SELECT id, coalesce((SELECT a.unit FROM a WHERE a.book_id = ev.book_id AND a.start >= ev.p1 ORDER BY a.start, a.unit LIMIT 1), (SELECT a.unit FROM a WHERE a.book_id = ev.book_id ORDER BY a.start DESC, a.unit DESC LIMIT 1)) AS anchor_unit FROM ev WHERE p1 IS NOT NULL""",
    "latest_revision": "SELECT DISTINCT id, record_id, updated_at, canonical_name FROM unified_roles WHERE id IS NOT NULL QUALIFY dense_rank() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, record_id DESC) = 1",
    "alias_index": f"WITH {SQL_ROLES}, n AS (SELECT book_id, id, unnest(all_names) AS name FROM role) SELECT book_id, name, max(id) AS id FROM n WHERE name IS NOT NULL GROUP BY ALL",
}
