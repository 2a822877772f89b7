"""Queries of entity resolution: name audits, routing, groups of names, building of roles, places, organizations, events, relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagaloom.functions.rules import SQL_TYPED, event_type
from sagaloom.operators.ranking import best_per, top_n
from sagaloom.operators.unions import capped_unions, name_components
from sagaloom.plans.timeline import GENERIC_POWERS
from sagaloom.sources.model import SQL_EVENTS, SQL_LOCATIONS, SQL_PEOPLE, SQL_ROLES, events, in_people, locations, pairs_of, roles
from sagaloom.sources.tables import table

#: Generic words for people, and families of names that are no names.
GENERIC_WORDS = ["少年", "少女", "道人", "老人", "老者", "女子", "男子", "书生", "和尚", "剑客", "妇人", "汉子", "姑娘", "孩子", "公子", "夫人", "客", "者", "人"]
_G = "(?:" + "|".join(GENERIC_WORDS) + ")"
NAME_RULES = [
    ("generic", f"^{_G}$"),
    ("clothing", f"^穿.{{1,6}}的{_G}$"),
    ("appearance", f"^[白青黑灰红蓝绿紫金银褐][衣袍衫裙裳袖帽冠]{_G}$"),
    ("demonstrative", f"^(?:那个|这个|那位|这位|一个|一位|一名|某个|某位){_G}$"),
    ("positional", f"^(?:身旁|身边|旁边|对面|面前|身后|左边|右边).{{0,2}}{_G}$"),
    ("modifier", f"^.{{1,6}}的{_G}$"),
    ("titled", "^(?:守夜人|上人|居士|散人|隐者)"),
    ("no word", r"^[^\p{L}]*$"),
    ("stand-in", "^(?:unknown|未知|不详|null|none)$"),
]
ROUTES = [("polity", "(?:国|朝|王朝)$"), ("school", "(?:家|书院|道观)$"), ("organization", "(?:府|军|帮|堂|司|会|庐|坊|行|局|庄)$")]


def typed_names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names of people in books: of role records and of entities in chunks."""
    a = table(spark, d, "unified_roles").select("book_id", F.col("canonical_name").alias("name"))
    b = table(spark, d, "unified_roles").select("book_id", F.explode("all_names").alias("name"))
    c = table(spark, d, "chunk_extractions").select("book_id", F.explode("entities.name").alias("name"))
    return a.union(b).union(c).where("name is not null and book_id is not null").distinct()


def role_name_audit(spark: SparkSession, d: str) -> DataFrame:
    """Reasons why a name looks like no name, joined in order; names without a reason are left out."""
    reasons = F.array_compact(F.array(*(F.when(F.col("name").rlike(p), n) for n, p in NAME_RULES)))
    return typed_names(spark, d).select("book_id", "name", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


def name_classify(spark: SparkSession, d: str) -> DataFrame:
    """keep, merge (with the canonical name) or block: a canonical name stays, an alias merges, a suspicious name is blocked, others stay."""
    r = roles(spark, d).where("canonical_name is not null")
    canon = r.select("book_id", F.col("canonical_name").alias("name")).distinct().withColumn("is_canon", F.lit(True))
    alias = r.select("book_id", F.explode("all_names").alias("name"), F.col("canonical_name").alias("target")).where("name is not null and name <> target").groupBy("book_id", "name").agg(F.min("target").alias("target"))
    bad = role_name_audit(spark, d).select("book_id", "name", "reasons")
    j = typed_names(spark, d).join(canon, ["book_id", "name"], "left").join(alias, ["book_id", "name"], "left").join(bad, ["book_id", "name"], "left")
    decision = F.when(F.col("is_canon") & F.col("reasons").isNull(), "keep").when(F.col("target").isNotNull(), "merge").when(F.col("reasons").isNotNull(), "block").otherwise("keep")
    return j.select("book_id", "name", decision.alias("decision"), F.when(decision == "merge", F.col("target")).alias("target"))


def entity_route(spark: SparkSession, d: str) -> DataFrame:
    """The kind of each organization's name by its ending, the first kind that fits, else person."""
    kind = reduce(lambda acc, r: F.when(F.col("name").rlike(r[1]) & (F.length("name") <= 6), r[0]).otherwise(acc), reversed(ROUTES), F.lit("person"))
    return table(spark, d, "organizations").where("name is not null").select("book_id", "name").distinct().select("book_id", "name", kind.alias("kind"))


def noise_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Events without participants that are no roles of the registry; events that lose all are dropped."""
    ev = events(spark, d)
    known = roles(spark, d).select(F.col("id").alias("role"))
    kept = in_people(ev).select("id", "role").join(known, "role", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("kept"))
    return ev.select("id", F.size("people").alias("before")).join(kept, "id").select("id", "before", "kept")


def kb_prune(spark: SparkSession, d: str) -> DataFrame:
    """What stays of roles, events and pairs when roles with suspicious canonical names go."""
    reasons = reduce(lambda a, b: a | b, [F.col("canonical_name").rlike(p) for _, p in NAME_RULES])
    r = roles(spark, d)
    bad = r.where(reasons).select(F.col("id").alias("role"))
    ev = in_people(events(spark, d)).select("id", "role")
    good = ev.join(bad, "role", "left_anti")
    pairs = pairs_of(events(spark, d)).select("a", "b").distinct()
    left = pairs.join(bad.toDF("a"), "a", "left_anti").join(bad.toDF("b"), "b", "left_anti")
    count = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return count(r.join(bad, r["id"] == bad["role"], "left_anti"), "roles").union(count(good.select("id").distinct(), "events")).union(count(left, "pairs"))


def _alias_edges(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "unified_roles").where("id is not null and book_id is not null").dropDuplicates(["record_id"])
    return t.select("book_id", F.col("canonical_name").alias("x"), F.explode("all_names").alias("y"), F.col("record_id").alias("ord")).where("x <> '' and y <> '' and x <> y")


def components_uncapped(spark: SparkSession, d: str) -> DataFrame:
    """Names of role records that hang together by canonical name and alias, with the least of them."""
    return name_components(_alias_edges(spark, d), "book_id")


def union_capped(spark: SparkSession, d: str) -> DataFrame:
    """The same with at most 15 names in a group, unions in the order of records."""
    return capped_unions(_alias_edges(spark, d), "book_id")


def preferred_name(spark: SparkSession, d: str) -> DataFrame:
    """The preferred name of each role: most mentions in chunks, then the shorter, then by text order."""
    n = table(spark, d, "chunk_extractions").dropDuplicates(["chunk_id"]).select("book_id", F.explode("entities.name").alias("name")).groupBy("book_id", "name").agg(F.count(F.lit(1)).alias("n"))
    a = roles(spark, d).select("book_id", "id", F.explode("all_names").alias("name")).where("name <> ''")
    j = a.join(n, ["book_id", "name"], "left").fillna(0, ["n"])
    return best_per(j, ["id"], [F.desc("n"), F.length("name"), "name"]).select("id", "name", "n")


def role_build(spark: SparkSession, d: str) -> DataFrame:
    """Roles built from all their records: names, powers, span of units, mentions of distinct records."""
    t = table(spark, d, "unified_roles").where("id is not null").dropDuplicates(["record_id"])
    base = t.groupBy("id").agg(
        F.min("first_appearance_juan").alias("first_unit"), F.max("last_appearance_juan").alias("last_unit"), F.sum(F.coalesce("total_mentions", F.lit(0))).alias("mentions"), F.count(F.lit(1)).alias("records")
    )

    def joined(c: str, name: str) -> DataFrame:
        each = t.select("id", F.explode(c).alias("x")).where("x <> ''").distinct()  # only distinct values are gathered per role
        return each.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("x")), "|").alias(name))

    return base.join(joined("all_names", "names"), "id", "left").join(joined("powers", "powers"), "id", "left").fillna("", ["names", "powers"])


def primary_power(spark: SparkSession, d: str) -> DataFrame:
    """The power of each role: the most frequent that is not generic, else the most frequent; ties to the first record."""
    t = table(spark, d, "unified_roles").where("id is not null and primary_power <> ''").dropDuplicates(["record_id"])
    g = t.groupBy("id", F.col("primary_power").alias("power")).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"))
    return best_per(g, ["id"], [F.col("power").isin(*GENERIC_POWERS).cast("int"), F.desc("n"), "first"]).select("id", "power", "n")


def location_build(spark: SparkSession, d: str) -> DataFrame:
    """Places of one name in a book: kind of most records, mentions, distinct roles."""
    loc = locations(spark, d)
    kind = best_per(loc.where("location_type <> ''").groupBy("book_id", "canonical_name", "location_type").agg(F.count(F.lit(1)).alias("n")), ["book_id", "canonical_name"], [F.desc("n"), "location_type"])
    base = loc.groupBy("book_id", "canonical_name").agg(F.sum(F.coalesce("total_mentions", F.lit(0))).alias("mentions"), F.count(F.lit(1)).alias("records"))
    who = loc.select("book_id", "canonical_name", F.explode("people").alias("role")).groupBy("book_id", "canonical_name").agg(F.countDistinct("role").alias("n_roles"))
    return base.join(who, ["book_id", "canonical_name"], "left").fillna(0, ["n_roles"]).join(kind.drop("n"), ["book_id", "canonical_name"], "left")


def organization_build(spark: SparkSession, d: str) -> DataFrame:
    """The canonical name of each organization: the shortest of its names, then by text order."""
    o = table(spark, d, "organizations").dropDuplicates(["org_key"])
    names = F.filter(F.concat(F.array("name"), F.coalesce("alias", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    return o.select("org_key", F.array_min(F.transform(names, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"].alias("canonical"), F.size(F.array_distinct(names)).alias("n_names"))


def event_merge(spark: SparkSession, d: str) -> DataFrame:
    """Events of one name in one unit merged: people, span of progress, actions, first place in the order of ids."""
    ev = events(spark, d).where("unit is not null")
    g = ev.groupBy("book_id", "name", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.min("p0").alias("p0"), F.max("p1").alias("p1"), F.sum(F.coalesce("action_count", F.lit(0))).alias("actions"),
        F.min(F.when(F.col("location").isNotNull(), F.struct("id", "location")))["location"].alias("location"),
    )
    who = in_people(ev).groupBy("book_id", "name", "unit").agg(F.countDistinct("role").alias("n_people"))
    return g.join(who, ["book_id", "name", "unit"], "left").fillna(0, ["n_people"])


def relation_merge(spark: SparkSession, d: str) -> DataFrame:
    """Relations of pairs: most frequent class of shared events, count, span, the first five events in order."""
    p = pairs_of(events(spark, d).withColumn("event_type", event_type()))
    base = p.groupBy("book_id", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("n_types"), F.min("p0").alias("p0"), F.max("p1").alias("p1"))
    kind = best_per(p.groupBy("book_id", "a", "b", "event_type").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("first")), ["book_id", "a", "b"], [F.desc("m"), "first"])
    few = top_n(p.select("book_id", "a", "b", "id"), ["book_id", "a", "b"], ["id"], 5).groupBy("book_id", "a", "b").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("first_events"))
    return base.join(kind.select("book_id", "a", "b", F.col("event_type").alias("main_type")), ["book_id", "a", "b"]).join(few, ["book_id", "a", "b"])


def canonical_references(spark: SparkSession, d: str) -> DataFrame:
    """Participants by canonical name, itself where no role has the id; events per such name."""
    r = roles(spark, d).select(F.col("id").alias("role"), "canonical_name")
    n = in_people(events(spark, d)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    return n.join(r, "role", "left").groupBy(F.coalesce("canonical_name", "role").alias("who")).agg(F.sum("n").alias("n"))


_TYPED_NAMES = """tn AS (SELECT DISTINCT book_id, name FROM (SELECT book_id, canonical_name AS name FROM unified_roles UNION ALL SELECT book_id, unnest(all_names) FROM unified_roles
  UNION ALL SELECT book_id, unnest(list_transform(entities, lambda e: e.name)) FROM chunk_extractions) WHERE name IS NOT NULL AND book_id IS NOT NULL)"""
_REASONS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(name, '{p}') THEN '{n}' END" for n, p in NAME_RULES) + "], lambda x: x IS NOT NULL), ',')"
_AUDIT = f"{_TYPED_NAMES}, au AS (SELECT book_id, name, {_REASONS} AS reasons FROM tn)"
_BAD = " OR ".join(f"regexp_matches(canonical_name, '{p}')" for _, p in NAME_RULES)
_REC = "rec AS (SELECT DISTINCT * FROM unified_roles WHERE id IS NOT NULL)"
QUERIES = {
    f.__name__: f
    for f in (
        role_name_audit, name_classify, entity_route, noise_cascade, kb_prune, components_uncapped, union_capped, preferred_name, role_build, primary_power, location_build, organization_build,
        event_merge, relation_merge, canonical_references,
    )
}
_NAMES = "list_filter(list_concat([name], coalesce(alias, [])), lambda x: x IS NOT NULL AND x <> '')"
SQL = {
    "role_name_audit": f"WITH {_AUDIT} SELECT * FROM au WHERE reasons <> ''",
    "name_classify": f"""WITH {_AUDIT}, {SQL_ROLES}, c AS (SELECT DISTINCT book_id, canonical_name AS name FROM role WHERE canonical_name IS NOT NULL),
        a AS (SELECT book_id, name, min(canonical_name) AS target FROM (SELECT book_id, canonical_name, unnest(all_names) AS name FROM role WHERE canonical_name IS NOT NULL) WHERE name <> canonical_name GROUP BY ALL),
        j AS (SELECT au.book_id, au.name, CASE WHEN c.name IS NOT NULL AND reasons = '' THEN 'keep' WHEN target IS NOT NULL THEN 'merge' WHEN reasons <> '' THEN 'block' ELSE 'keep' END AS decision, target
          FROM au LEFT JOIN c ON c.book_id = au.book_id AND c.name = au.name LEFT JOIN a ON a.book_id = au.book_id AND a.name = au.name)
        SELECT book_id, name, decision, CASE WHEN decision = 'merge' THEN target END AS target FROM j""",
    "entity_route": "SELECT DISTINCT book_id, name, CASE " + " ".join(f"WHEN regexp_matches(name, '{p}') AND length(name) <= 6 THEN '{k}'" for k, p in ROUTES) + " ELSE 'person' END AS kind FROM organizations WHERE name IS NOT NULL",
    "kb_prune": f"""WITH {SQL_EVENTS}, {SQL_PEOPLE}, {SQL_ROLES}, bad AS (SELECT id FROM role WHERE {_BAD})
        SELECT 'roles' AS kind, count(*) AS n FROM role WHERE id NOT IN (SELECT id FROM bad) UNION ALL SELECT 'events', count(DISTINCT id) FROM ep WHERE ep.role NOT IN (SELECT id FROM bad)
        UNION ALL SELECT 'pairs', count(*) FROM (SELECT DISTINCT x.role AS a, y.role AS b FROM ep x JOIN ep y ON x.id = y.id AND x.role < y.role WHERE x.role NOT IN (SELECT id FROM bad) AND y.role NOT IN (SELECT id FROM bad))""",
    "components_uncapped": """WITH RECURSIVE e AS (SELECT DISTINCT book_id, canonical_name AS x, y FROM (SELECT book_id, canonical_name, unnest(all_names) AS y FROM unified_roles WHERE id IS NOT NULL AND book_id IS NOT NULL)
        WHERE canonical_name <> '' AND y <> '' AND canonical_name <> y), s AS (SELECT book_id, x, y FROM e UNION SELECT book_id, y, x FROM e),
        r AS (SELECT book_id, x AS name, x AS seen FROM s UNION SELECT r.book_id, r.name, s.y FROM r JOIN s ON s.book_id = r.book_id AND s.x = r.seen) SELECT book_id, name, min(seen) AS root FROM r GROUP BY book_id, name""",
    "preferred_name": f"""WITH {SQL_ROLES}, c AS (SELECT DISTINCT chunk_id, book_id, list_transform(entities, lambda e: e.name) AS l FROM chunk_extractions), m AS (SELECT book_id, name, count(*) AS n FROM (SELECT book_id, unnest(l) AS name FROM c) GROUP BY ALL),
        a AS (SELECT book_id, id, unnest(all_names) AS name FROM role) SELECT id, a.name, coalesce(n, 0) AS n FROM a LEFT JOIN m ON m.book_id = a.book_id AND m.name = a.name WHERE a.name <> ''
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(n, 0) DESC, length(a.name), a.name) = 1""",
    "role_build": f"""WITH {_REC} SELECT id, array_to_string(list_sort(list_distinct(list_filter(flatten(list(coalesce(all_names, []))), lambda x: x IS NOT NULL AND x <> ''))), '|') AS names,
        array_to_string(list_sort(list_distinct(list_filter(flatten(list(coalesce(powers, []))), lambda x: x IS NOT NULL AND x <> ''))), '|') AS powers, min(first_appearance_juan) AS first_unit, max(last_appearance_juan) AS last_unit,
        CAST(sum(coalesce(total_mentions, 0)) AS BIGINT) AS mentions, count(*) AS records FROM rec GROUP BY id""",
    "primary_power": f"""WITH {_REC}, g AS (SELECT id, primary_power AS power, count(*) AS n, min(record_id) AS first FROM rec WHERE primary_power <> '' GROUP BY ALL)
        SELECT id, power, n FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY CAST(power IN ({", ".join(f"'{p}'" for p in GENERIC_POWERS)}) AS INT), n DESC, first) = 1""",
    "location_build": f"""WITH {SQL_LOCATIONS}, k AS (SELECT book_id, canonical_name, location_type, count(*) AS n FROM loc WHERE location_type <> '' GROUP BY book_id, canonical_name, location_type QUALIFY row_number() OVER (PARTITION BY book_id, canonical_name ORDER BY count(*) DESC, location_type) = 1),
        b AS (SELECT book_id, canonical_name, CAST(sum(coalesce(total_mentions, 0)) AS BIGINT) AS mentions, count(*) AS records FROM loc GROUP BY ALL), w AS (SELECT book_id, canonical_name, count(DISTINCT r) AS n_roles FROM (SELECT book_id, canonical_name, unnest(people) AS r FROM loc) GROUP BY ALL)
        SELECT b.*, coalesce(n_roles, 0) AS n_roles, location_type FROM b LEFT JOIN w USING (book_id, canonical_name) LEFT JOIN k USING (book_id, canonical_name)""",
    "organization_build": f"SELECT DISTINCT org_key, list_sort(list_transform({_NAMES}, lambda x: {{'n': length(x), 'x': x}}))[1].x AS canonical, len(list_distinct({_NAMES})) AS n_names FROM organizations",
    "event_merge": f"""WITH {SQL_EVENTS}, {SQL_PEOPLE}, g AS (SELECT book_id, name, unit, count(*) AS n, min(p0) AS p0, max(p1) AS p1, CAST(sum(coalesce(action_count, 0)) AS BIGINT) AS actions, min_by(location, id) FILTER (location IS NOT NULL) AS location FROM ev WHERE unit IS NOT NULL GROUP BY ALL),
        w AS (SELECT book_id, name, unit, count(DISTINCT role) AS n_people FROM ep GROUP BY ALL) SELECT g.*, coalesce(n_people, 0) AS n_people FROM g LEFT JOIN w USING (book_id, name, unit)""",
    "relation_merge": f"""WITH {SQL_EVENTS}, {SQL_TYPED}, tp AS (SELECT typed.*, unnest(people) AS role FROM typed), p AS (SELECT x.book_id, x.role AS a, y.role AS b, x.id, x.p0, x.p1, x.event_type FROM tp x JOIN tp y ON x.id = y.id AND x.role < y.role),
        base AS (SELECT book_id, a, b, count(*) AS n, count(DISTINCT event_type) AS n_types, min(p0) AS p0, max(p1) AS p1 FROM p GROUP BY ALL), k0 AS (SELECT book_id, a, b, event_type, count(*) AS m, min(id) AS first FROM p GROUP BY ALL),
        k AS (SELECT book_id, a, b, event_type AS main_type FROM k0 QUALIFY row_number() OVER (PARTITION BY book_id, a, b ORDER BY m DESC, first) = 1),
        f0 AS (SELECT book_id, a, b, id, row_number() OVER (PARTITION BY book_id, a, b ORDER BY id) AS r FROM p), f AS (SELECT book_id, a, b, string_agg(id, ',' ORDER BY id) AS first_events FROM f0 WHERE r <= 5 GROUP BY ALL)
        SELECT base.*, main_type, first_events FROM base JOIN k USING (book_id, a, b) JOIN f USING (book_id, a, b)""",
    "canonical_references": f"WITH {SQL_EVENTS}, {SQL_PEOPLE}, {SQL_ROLES} SELECT coalesce(canonical_name, ep.role) AS who, count(*) AS n FROM ep LEFT JOIN role r ON r.id = ep.role GROUP BY ALL",
}
SQL |= {"noise_cascade": f"WITH {SQL_EVENTS}, {SQL_PEOPLE}, {SQL_ROLES} SELECT ep.id, any_value(len(people)) AS before, count(*) AS kept FROM ep WHERE ep.role IN (SELECT id FROM role) GROUP BY ep.id"}
