"""Queries of quality audits and incremental processing."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagaloom.functions.rules import SQL_TYPED
from sagaloom.functions.text import BLANK
from sagaloom.operators.merging import best_of, content_hash, freshness, missing_keys, upsert
from sagaloom.operators.ranking import best_per, top_n
from sagaloom.plans.seasons import key_scored, scored, with_tiers
from sagaloom.sources.model import SQL_EVENTS, SQL_LOCATIONS, SQL_PEOPLE, SQL_ROLES, events, in_people, locations, pairs_of, roles
from sagaloom.sources.tables import table


def homogeneous_openings(spark: SparkSession, d: str) -> DataFrame:
    """Openings of four characters, white space left out, that five or more events share."""
    opening = F.substring(F.regexp_replace("description", BLANK + "+", ""), 1, 4)
    return events(spark, d).where("description <> ''").select(opening.alias("opening")).groupBy("opening").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


def field_rules(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of role records, one row each: lengths, missing names, spans, mentions."""
    r = table(spark, d, "unified_roles").dropDuplicates(["record_id"])
    rules = [
        ("no name", F.col("canonical_name").isNull() | (F.col("canonical_name") == "")),
        ("short description", F.length("description") < 10),
        ("long description", F.length("description") > 80),
        ("span", F.col("first_appearance_juan") > F.col("last_appearance_juan")),
        ("name not among names", ~F.array_contains("all_names", F.col("canonical_name"))),
        ("no mention", F.col("total_mentions") <= 0),
    ]
    issues = F.array_compact(F.array(*(F.when(ok, n) for n, ok in rules)))
    return r.select("record_id", F.explode(issues).alias("issue"))


def placeholder_scan(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are question marks or hold two in a row, with their path."""
    r = table(spark, d, "unified_roles").dropDuplicates(["record_id"])
    leaves = [F.struct(F.lit(c).alias("path"), F.col(c).alias("v")) for c in ("canonical_name", "description", "primary_power")]

    def elements(c: str):
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, i: F.struct(F.concat(F.lit(c + "["), i.cast("string"), F.lit("]")).alias("path"), x.alias("v")))

    lists = F.flatten(F.array(elements("all_names"), elements("original_descriptions")))
    x = r.select("record_id", F.explode(F.concat(F.array(*leaves), lists)).alias("l")).select("record_id", "l.*")
    return x.where(F.col("v").rlike(r"[?？]{2}|^[?？]+$") & ~F.col("v").startswith("http"))


def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by severity of what they lack, per book."""
    lack = F.when(F.coalesce(F.col("description"), F.lit("")) == "", 2).otherwise(0) + F.when(F.col("significance").isNull(), 1).otherwise(0) + F.when(F.size("people") == 0, 3).otherwise(0) + F.when(F.col("location").isNull(), 1).otherwise(0) + F.when(F.col("p0").isNull(), 1).otherwise(0)
    ev = events(spark, d).withColumn("lack", lack)
    return ev.groupBy("book_id", F.when(F.col("lack") >= 4, "high").when(F.col("lack") >= 2, "medium").otherwise("low").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def missing_event_ids(spark: SparkSession, d: str) -> DataFrame:
    """Event ids that places refer to and that do not exist."""
    refs = locations(spark, d).select("id", F.explode("associated_events").alias("event_id")).where("event_id <> ''").distinct()
    return refs.join(events(spark, d).select(F.col("id").alias("event_id")), "event_id", "left_anti")


def pair_endpoint_check(spark: SparkSession, d: str) -> DataFrame:
    """Match pairs with an end that is no record, and which."""
    p = table(spark, d, "match_pairs").dropDuplicates(["pair_id"])
    keys = table(spark, d, "unified_roles").select(F.lit("role").alias("kind"), F.col("record_id").alias("k")).union(table(spark, d, "organizations").select(F.lit("org"), F.col("org_key"))).distinct()
    ends = p.select("pair_id", "kind", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left_key").alias("k")), F.struct(F.lit("right").alias("side"), F.col("right_key").alias("k")))).alias("e")).select("pair_id", "kind", "e.*")
    return ends.join(keys, ["kind", "k"], "left_anti").select("pair_id", "side", "k")


def title_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of each event's description that repeats its name's last two characters."""
    ev = events(spark, d).where("description <> '' and length(name) >= 2")
    word = F.substring("name", -2, 2)
    return ev.select("id", F.round((F.length("description") - F.length(F.replace("description", word, F.lit("")))) / F.length("description"), 6).alias("share"))


def sequence_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of neighbouring events of one name that are nearly the same (ratio of matching blocks at least 0.8)."""
    w = Window.partitionBy("book_id", "name").orderBy("id")
    p = events(spark, d).where("description <> ''").withColumn("before", F.lag("description").over(w)).where("before is not null").select("id", "description", "before")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(SequenceMatcher(None, x, y, autojunk=False).ratio(), 6) for x, y in zip(a, b)])

    return p.withColumn("likeness", ratio("description", "before")).where("likeness >= 0.8").select("id", "likeness")


def packet_hash(spark: SparkSession, d: str) -> DataFrame:
    """Content hash of each event's packet."""
    return events(spark, d).select("id", content_hash("id", "name", "description", "p0", "p1").alias("hash"))


def _packets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "unified_roles").where("id is not null").dropDuplicates(["record_id"]).withColumn("hash", content_hash("canonical_name", "description"))
    new = best_per(t, ["id"], [F.desc_nulls_last("updated_at"), F.desc("record_id")])
    made = t.where("record_source is not null").select("id", "record_id", "hash", F.col("updated_at").alias("made_at"), F.when(F.lower(F.trim("record_source")) == "editor_desk", 0).otherwise(1).alias("priority"))
    return new.select("id", "hash"), made


def stale_status(spark: SparkSession, d: str) -> DataFrame:
    """For each role whether its newest content is what the editors' newest record was made from: applied, stale or missing."""
    new, made = _packets(spark, d)
    edited = best_per(made.where("priority = 0"), ["id"], [F.desc_nulls_last("made_at"), F.desc("record_id")])
    return freshness(new, edited.select("id", "hash"), "id")


def stale_counts(spark: SparkSession, d: str) -> DataFrame:
    """Roles per status."""
    return stale_status(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def best_of_two(spark: SparkSession, d: str) -> DataFrame:
    """Per role the record to take: one that fits the newest content, then the newest, then the editors'."""
    new, made = _packets(spark, d)
    return best_of(made, new, "id").select("id", "record_id", "fits")


def unprocessed_keys(spark: SparkSession, d: str) -> DataFrame:
    """Segments between a unit's first and last that no chunk covers."""
    c = table(spark, d, "chunk_extractions").select("book_id", "juan_index", "segment_index").where("book_id is not null and juan_index is not null and segment_index is not null").distinct()
    return missing_keys(c, ["book_id", "juan_index"], "segment_index")


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after all re-extractions: per natural key the one with the greatest key."""
    keys = ["book_id", "juan_index", "segment_index", "chunk_start_index"]
    c = table(spark, d, "chunk_extractions").select(*keys, "chunk_id", "total_tokens").distinct().where(" and ".join(f"{k} is not null" for k in keys))
    firsts = c.groupBy(*keys).agg(F.min(F.struct("chunk_id", "total_tokens")).alias("f")).select(*keys, "f.*")
    return upsert(firsts, c.join(firsts.select("chunk_id"), "chunk_id", "left_anti").select(firsts.columns), keys, [F.desc("chunk_id")])


def high_water_mark(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and the last position reached per book."""
    c = table(spark, d, "chunk_extractions").dropDuplicates(["chunk_id"])
    m = F.max(F.struct("juan_index", "segment_index", "chunk_start_index"))
    return c.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), m.alias("m")).select("book_id", "n", "m.juan_index", "m.segment_index", "m.chunk_start_index")


def store_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the nested lists and tokens per unit."""
    c = table(spark, d, "chunk_extractions").dropDuplicates(["chunk_id"])
    size = lambda x: F.sum(F.when(F.col(x).isNull(), 0).otherwise(F.size(x)))
    return c.groupBy("book_id", "juan_index").agg(F.count(F.lit(1)).alias("n"), size("entities").alias("entities"), size("source_sentences").alias("sentences"), F.sum("total_tokens").alias("tokens"))


def segment_scan(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of one segment in order (a filter on the key's prefix, pushed to the scan)."""
    c = table(spark, d, "chunk_extractions").where("book_id = 1 and juan_index = 3 and segment_index = 4").select("chunk_id", "chunk_start_index", "chunk_end_index").distinct()
    return c.orderBy("chunk_start_index", "chunk_id")


def flatten_entities(spark: SparkSession, d: str) -> DataFrame:
    """All entities of all chunks as rows."""
    c = table(spark, d, "chunk_extractions").dropDuplicates(["chunk_id"])
    return c.select("chunk_id", F.posexplode("entities").alias("pos", "e")).select("chunk_id", "pos", F.col("e.name").alias("name"), F.col("e.entity_type").alias("entity_type"), F.size(F.coalesce("e.alias", F.array().cast("array<string>"))).alias("n_alias"))


def pair_priority(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by priority: shared events, both among the ten most mentioned roles, the most mentioned alone; five per book."""
    r = top_n(roles(spark, d), ["book_id"], [F.desc_nulls_last("total_mentions"), "id"], 10).select("book_id", F.col("id").alias("role"), (F.col("rank_no") == 1).cast("int").alias("star"))
    p = pairs_of(events(spark, d)).groupBy("book_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    p = p.join(r.toDF("book_id", "a", "star_a"), ["book_id", "a"], "left").join(r.toDF("book_id", "b", "star_b"), ["book_id", "b"], "left")
    both = F.when(F.col("star_a").isNotNull() & F.col("star_b").isNotNull(), 10).when((F.col("star_a") == 1) | (F.col("star_b") == 1), 5)
    return top_n(p.withColumn("priority", both + F.least("n", F.lit(10))).where("priority is not null"), ["book_id"], [F.desc("priority"), "a", "b"], 5).select("book_id", "a", "b", "priority", "rank_no")


def dossier_events(spark: SparkSession, d: str) -> DataFrame:
    """Key-scored events that a list names (key events, places, the registry's first units), with their best list, the number of
    lists and a score from both. The events are read once, and the lists are marks on their rows instead of tables of their own."""
    named = table(spark, d, "unified_locations").select(F.explode("associated_events").alias("id")).where("id <> ''").distinct().withColumn("_place", F.lit(True))
    s = scored(spark, d).join(named.hint("merge"), "id", "left")  # both lie by id already, and a place may name any number of events
    lists = [(F.col("tier") == "critical", 4), (F.col("_place").isNotNull(), 3), (F.coalesce(F.col("unit") == 1, F.lit(False)), 2)]
    m = with_tiers(s, events(spark, d)).withColumn("n", sum((x.cast("long") for x, _ in lists), F.lit(0))).where("n > 0 and id <> ''")
    m = m.withColumn("best", F.greatest(*(F.when(x, no) for x, no in lists)))
    return m.withColumn("dossier_score", (F.col("best") + F.least(2 * (F.col("n") - 1), F.lit(6)) + F.col("score")).cast("long")).drop("_place")


def dossier_membership(spark: SparkSession, d: str) -> DataFrame:
    """Events by the lists that name them and a score from the lists."""
    return dossier_events(spark, d).select("id", "best", "n", "dossier_score")


def dossier_top_n(spark: SparkSession, d: str, n: int = 40) -> DataFrame:
    """The best n events of each book by that score, a name at most three times, as two window cuts. W15's quota of one
    per display name, which needs a fold in order, is not in it."""
    few = top_n(dossier_events(spark, d), ["book_id", "name"], [F.desc("dossier_score"), F.asc_nulls_last("unit"), "id"], 3)
    return top_n(few.drop("rank_no"), ["book_id"], [F.desc("dossier_score"), F.asc_nulls_last("unit"), "id"], n).select("book_id", "id", "dossier_score", "rank_no")


def chapter_packets(spark: SparkSession, d: str) -> DataFrame:
    """Per unit the ids of its key events in order and a hash of them."""
    k = key_scored(spark, d).where("unit is not null")
    t = top_n(k, ["book_id", "unit"], [F.desc("key_score"), "id"], 8).groupBy("book_id", "unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "id"))), lambda x: x["id"]), ",").alias("ids"))
    return t.withColumn("hash", content_hash("book_id", "unit", "ids"))


_H = lambda *c: "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({x} AS VARCHAR), '\\N')" for x in c) + "))"
_PK = f"""t AS (SELECT DISTINCT id, record_id, canonical_name, description, record_source, updated_at, {_H('canonical_name', 'description')} AS hash FROM unified_roles WHERE id IS NOT NULL),
  nw AS (SELECT id, hash FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, record_id DESC) = 1),
  made AS (SELECT id, record_id, hash, updated_at AS made_at, CASE WHEN lower(trim(record_source)) = 'editor_desk' THEN 0 ELSE 1 END AS priority FROM t WHERE record_source IS NOT NULL)"""
_ST = f"""{_PK}, ed AS (SELECT id, hash FROM made WHERE priority = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY made_at DESC NULLS LAST, record_id DESC) = 1),
  st AS (SELECT nw.id, CASE WHEN ed.hash IS NULL THEN 'missing' WHEN ed.hash = nw.hash THEN 'applied' ELSE 'stale' END AS status FROM nw LEFT JOIN ed ON ed.id = nw.id)"""
_KEYS = "book_id, juan_index, segment_index, chunk_start_index"
_CH = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunk_extractions)"
from sagaloom.plans.seasons import _KEY  # noqa: E402

_DM = f"""{_KEY}, {SQL_LOCATIONS}, m0 AS (SELECT id, 'key' AS src, 4 AS tier_no FROM k WHERE tier = 'critical' UNION SELECT unnest(associated_events), 'place', 3 FROM loc UNION SELECT id, 'opening', 2 FROM k WHERE unit = 1),
  m AS (SELECT id, max(tier_no) AS best, count(*) AS n FROM m0 WHERE id <> '' GROUP BY id), dm AS (SELECT k.id, best, n, CAST(best + least(2 * (n - 1), 6) + score AS BIGINT) AS dossier_score, k.book_id, k.name, k.unit FROM k JOIN m ON m.id = k.id)"""
QUERIES = {
    f.__name__: f
    for f in (
        homogeneous_openings, field_rules, placeholder_scan, severity_counts, missing_event_ids, pair_endpoint_check, title_coverage, sequence_likeness, packet_hash, stale_status, stale_counts,
        best_of_two, unprocessed_keys, upsert_latest, high_water_mark, store_totals, segment_scan, flatten_entities, pair_priority, dossier_membership, dossier_top_n, chapter_packets,
    )
}
SQL = {
    "homogeneous_openings": f"WITH {SQL_EVENTS} SELECT substring(regexp_replace(description, '{BLANK}+', '', 'g'), 1, 4) AS opening, count(*) AS n FROM ev WHERE description <> '' GROUP BY 1 HAVING count(*) >= 5",
    "field_rules": """WITH r AS (SELECT DISTINCT * FROM unified_roles) SELECT record_id, 'no name' AS issue FROM r WHERE canonical_name IS NULL OR canonical_name = '' UNION ALL SELECT record_id, 'short description' FROM r WHERE length(description) < 10
        UNION ALL SELECT record_id, 'long description' FROM r WHERE length(description) > 80 UNION ALL SELECT record_id, 'span' FROM r WHERE first_appearance_juan > last_appearance_juan
        UNION ALL SELECT record_id, 'name not among names' FROM r WHERE canonical_name IS NOT NULL AND NOT list_contains(all_names, canonical_name) UNION ALL SELECT record_id, 'no mention' FROM r WHERE total_mentions <= 0""",
    "placeholder_scan": """WITH r AS (SELECT DISTINCT * FROM unified_roles), x AS (SELECT record_id, 'canonical_name' AS path, canonical_name AS v FROM r UNION ALL SELECT record_id, 'description', description FROM r UNION ALL SELECT record_id, 'primary_power', primary_power FROM r
        UNION ALL SELECT record_id, 'all_names[' || (i - 1) || ']', all_names[i] FROM (SELECT *, unnest(range(1, len(all_names) + 1)) AS i FROM r) UNION ALL SELECT record_id, 'original_descriptions[' || (i - 1) || ']', original_descriptions[i] FROM (SELECT *, unnest(range(1, len(original_descriptions) + 1)) AS i FROM r))
        SELECT * FROM x WHERE regexp_matches(v, '[?？]{2}|^[?？]+$') AND NOT starts_with(v, 'http')""",
    "severity_counts": f"""WITH {SQL_EVENTS}, l AS (SELECT book_id, CASE WHEN coalesce(description, '') = '' THEN 2 ELSE 0 END + CASE WHEN significance IS NULL THEN 1 ELSE 0 END + CASE WHEN len(people) = 0 THEN 3 ELSE 0 END + CASE WHEN location IS NULL THEN 1 ELSE 0 END + CASE WHEN p0 IS NULL THEN 1 ELSE 0 END AS lack FROM ev)
        SELECT book_id, CASE WHEN lack >= 4 THEN 'high' WHEN lack >= 2 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM l GROUP BY 1, 2""",
    "missing_event_ids": f"WITH {SQL_EVENTS}, {SQL_LOCATIONS}, x AS (SELECT DISTINCT id, unnest(associated_events) AS event_id FROM loc) SELECT id, event_id FROM x WHERE event_id <> '' AND event_id NOT IN (SELECT id FROM ev)",
    "pair_endpoint_check": """WITH p AS (SELECT DISTINCT * FROM match_pairs), k AS (SELECT 'role' AS kind, record_id AS k FROM unified_roles UNION SELECT 'org', org_key FROM organizations),
        e AS (SELECT pair_id, kind, 'left' AS side, left_key AS k FROM p UNION ALL SELECT pair_id, kind, 'right', right_key FROM p) SELECT pair_id, side, e.k FROM e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.kind = e.kind AND k.k = e.k)""",
    "title_coverage": f"WITH {SQL_EVENTS} SELECT id, round((length(description) - length(replace(description, right(name, 2), ''))) / length(description), 6) AS share FROM ev WHERE description <> '' AND length(name) >= 2",
    "packet_hash": f"WITH {SQL_EVENTS} SELECT id, {_H('id', 'name', 'description', 'p0', 'p1')} AS hash FROM ev",
    "stale_status": f"WITH {_ST} SELECT * FROM st",
    "stale_counts": f"WITH {_ST} SELECT status, count(*) AS n FROM st GROUP BY status",
    "best_of_two": f"WITH {_PK} SELECT made.id, record_id, made.hash = nw.hash AS fits FROM made JOIN nw ON nw.id = made.id QUALIFY row_number() OVER (PARTITION BY made.id ORDER BY made.hash = nw.hash DESC, made_at DESC NULLS LAST, priority) = 1",
    "unprocessed_keys": """WITH c AS (SELECT DISTINCT book_id, juan_index, segment_index FROM chunk_extractions WHERE book_id IS NOT NULL AND juan_index IS NOT NULL AND segment_index IS NOT NULL),
        e AS (SELECT book_id, juan_index, unnest(range(lo, hi + 1)) AS segment_index FROM (SELECT book_id, juan_index, min(segment_index) AS lo, max(segment_index) AS hi FROM c GROUP BY ALL)) SELECT * FROM e EXCEPT SELECT * FROM c""",
    "upsert_latest": f"WITH c AS (SELECT DISTINCT {_KEYS}, chunk_id, total_tokens FROM chunk_extractions WHERE book_id IS NOT NULL AND juan_index IS NOT NULL AND segment_index IS NOT NULL AND chunk_start_index IS NOT NULL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY chunk_id DESC) = 1",
    "high_water_mark": f"""WITH {_CH}, m AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY juan_index DESC NULLS LAST, segment_index DESC NULLS LAST, chunk_start_index DESC NULLS LAST) AS r, count(*) OVER (PARTITION BY book_id) AS n FROM c)
        SELECT book_id, n, juan_index, segment_index, chunk_start_index FROM m WHERE r = 1""",
    "store_totals": f"WITH {_CH} SELECT book_id, juan_index, count(*) AS n, CAST(sum(coalesce(len(entities), 0)) AS BIGINT) AS entities, CAST(sum(coalesce(len(source_sentences), 0)) AS BIGINT) AS sentences, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM c GROUP BY book_id, juan_index",
    "segment_scan": "SELECT DISTINCT chunk_id, chunk_start_index, chunk_end_index FROM chunk_extractions WHERE book_id = 1 AND juan_index = 3 AND segment_index = 4",
    "flatten_entities": f"""WITH {_CH}, x AS (SELECT chunk_id, i - 1 AS pos, entities[i] AS e FROM (SELECT *, unnest(range(1, len(entities) + 1)) AS i FROM c)) SELECT chunk_id, pos, e.name AS name, e.entity_type AS entity_type, coalesce(len(e.alias), 0) AS n_alias FROM x""",
    "pair_priority": f"""WITH {SQL_EVENTS}, {SQL_PEOPLE}, {SQL_ROLES}, r AS (SELECT book_id, id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY total_mentions DESC NULLS LAST, id) AS INT) AS rk FROM role),
        p AS (SELECT x.book_id, x.role AS a, y.role AS b, count(*) AS n FROM ep x JOIN ep y ON x.id = y.id AND x.role < y.role GROUP BY ALL),
        j AS (SELECT p.*, ra.rk AS ka, rb.rk AS kb FROM p LEFT JOIN r ra ON ra.book_id = p.book_id AND ra.id = a AND ra.rk <= 10 LEFT JOIN r rb ON rb.book_id = p.book_id AND rb.id = b AND rb.rk <= 10),
        s AS (SELECT book_id, a, b, CASE WHEN ka IS NOT NULL AND kb IS NOT NULL THEN 10 WHEN ka = 1 OR kb = 1 THEN 5 END + least(n, 10) AS priority FROM j),
        t AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY priority DESC, a, b) AS rank_no FROM s WHERE priority IS NOT NULL) SELECT * FROM t WHERE rank_no <= 5""",
    "dossier_membership": f"WITH {_DM} SELECT id, best, n, dossier_score FROM dm",
    "dossier_top_n": f"""WITH {_DM}, f AS (SELECT * FROM dm QUALIFY row_number() OVER (PARTITION BY book_id, name ORDER BY dossier_score DESC, unit NULLS LAST, id) <= 3),
        t AS (SELECT book_id, id, dossier_score, row_number() OVER (PARTITION BY book_id ORDER BY dossier_score DESC, unit NULLS LAST, id) AS rank_no FROM f) SELECT * FROM t WHERE rank_no <= 40""",
    "chapter_packets": f"""WITH {_KEY}, t AS (SELECT book_id, unit, id, row_number() OVER (PARTITION BY book_id, unit ORDER BY key_score DESC, id) AS r FROM k WHERE unit IS NOT NULL), g AS (SELECT book_id, unit, string_agg(id, ',' ORDER BY r) AS ids FROM t WHERE r <= 8 GROUP BY ALL)
        SELECT *, {_H('book_id', 'unit', 'ids')} AS hash FROM g""",
}
