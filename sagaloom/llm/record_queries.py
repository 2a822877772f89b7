"""Queries over role records and organizations: problems 5, 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagaloom.llm.components import connected_components, star_edges
from sagaloom.llm.fusion import fuse_values
from sagaloom.llm.names import link_names
from sagaloom.llm.survivors import STAND_INS, is_value, squeezed, surviving_records
from sagaloom.sources.tables import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group key of every role record and organization that shares a group with another.

    Both kinds run as one graph: a key is doubled and made odd for organizations, which keeps the order within a kind.
    """
    roles = table(spark, sf_dir, "unified_roles").select(F.col("record_id") * 2, "book_id", F.col("all_names"))
    orgs = table(spark, sf_dir, "organizations").select(F.col("org_key") * 2 + 1, "book_id", F.concat(F.array("name"), F.coalesce("alias", F.array().cast("array<string>"))))
    named = roles.toDF("node", "book_id", "names").unionByName(orgs.toDF("node", "book_id", "names")).where("node is not null")
    texts = named.where("book_id is not null").select(F.pmod("node", F.lit(2)).alias("odd"), "book_id", F.explode(F.array_distinct("names")).alias("name"), "node").where("name <> ''")
    shared = star_edges(texts, ["odd", "book_id", "name"], "node")
    odd = F.when(F.col("kind") == "org", 1).when(F.col("kind") == "role", 0)
    pairs = (
        table(spark, sf_dir, "match_pairs")
        .where((F.lower(F.trim("status")) == "accepted") & odd.isNotNull())
        .select((F.col("left_key") * 2 + odd).alias("u"), (F.col("right_key") * 2 + odd).alias("v"))
        .where("u <> v")
        .distinct()
    )
    nodes = named.select("node").distinct()
    pairs = pairs.join(nodes.withColumnRenamed("node", "u"), "u", "left_semi").join(nodes.withColumnRenamed("node", "v"), "v", "left_semi")
    found = connected_components(shared.unionByName(pairs))
    kind = F.when(F.pmod("node", F.lit(2)) == 1, "org").otherwise("role")
    return found.select(kind.alias("kind"), F.shiftright("node", 1).alias("record_key"), F.shiftright("label", 1).alias("group_key"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed names with the role id they mean."""
    roles = table(spark, sf_dir, "unified_roles").select("id", "book_id", F.concat(F.array("canonical_name"), F.coalesce("all_names", F.array().cast("array<string>"))).alias("names"))
    named = roles.select("id", "book_id", F.explode(F.array_distinct("names")).alias("name")).where("name is not null")
    found = table(spark, sf_dir, "chunk_extractions").select("book_id", F.explode("entities.name").alias("name")).where("name is not null")
    typed = found.unionByName(named.where("id is null").select("book_id", "name"))
    return link_names(named.where("id is not null").select("book_id", "name", F.col("id").alias("role_id")), typed)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record whose value survives, per role id and field."""
    return surviving_records(table(spark, sf_dir, "unified_roles"), table(spark, sf_dir, "source_trust"))


def field_claims(records: DataFrame) -> DataFrame:
    """Claims of role records: canonical name, description, and each element of original_descriptions as a field of its own.

    A list may hold several true values, and a source that does not name one does not deny it. A record without source is a
    source of its own.
    """
    t = records.where("id is not null")
    source = F.coalesce(F.concat(F.lit("s:"), F.nullif(F.lower(squeezed(F.col("record_source"))), F.lit(""))), F.concat(F.lit("record:"), F.col("record_id").cast("string")))
    one = F.array(*(F.struct(F.lit(f).alias("field_name"), squeezed(F.col(f)).alias("value")) for f in ("canonical_name", "description")))
    notes = F.transform(F.coalesce("original_descriptions", F.array().cast("array<string>")), lambda x: F.struct(F.concat(F.lit("original_descriptions\x1f"), squeezed(x)).alias("field_name"), squeezed(x).alias("value")))
    claims = t.select(F.col("id").alias("object_id"), source.alias("source"), F.col("updated_at").alias("claim_order"), F.explode(F.concat(one, notes)).alias("f"))
    return claims.select("object_id", "source", "claim_order", "f.*").where(is_value(F.col("value")))


def p7_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most probable canonical name and description of each role id and the elements of its original_descriptions, each with
    its posterior, fused over sources."""
    fused = fuse_values(field_claims(table(spark, sf_dir, "unified_roles")))
    return fused.select(F.col("object_id").alias("id"), F.substring_index("field_name", "\x1f", 1).alias("field_name"), "value", F.round("posterior", 4).alias("posterior"))


_P5 = """
WITH RECURSIVE named AS (
  SELECT 'role' AS kind, record_id AS k, book_id, unnest(all_names) AS name FROM unified_roles
  UNION ALL SELECT 'org', org_key, book_id, name FROM organizations
  UNION ALL SELECT 'org', org_key, book_id, unnest(alias) FROM organizations
), tied AS (
  SELECT DISTINCT kind, k, min(k) OVER (PARTITION BY kind, book_id, name) AS o FROM named WHERE name <> '' AND book_id IS NOT NULL
), keys AS (SELECT 'role' AS kind, record_id AS k FROM unified_roles UNION SELECT 'org', org_key FROM organizations),
edges AS (
  SELECT kind, k AS a, o AS b FROM tied WHERE k <> o
  UNION SELECT p.kind, left_key, right_key FROM match_pairs p
    JOIN keys l ON l.kind = p.kind AND l.k = left_key JOIN keys r ON r.kind = p.kind AND r.k = right_key
    WHERE lower(trim(status)) = 'accepted' AND left_key <> right_key
), sym AS (SELECT kind, a, b FROM edges UNION SELECT kind, b, a FROM edges),
reach AS (SELECT kind, a AS k, a AS r FROM sym UNION SELECT reach.kind, reach.k, sym.b FROM reach JOIN sym ON sym.kind = reach.kind AND sym.a = reach.r)
SELECT kind, k AS record_key, min(r) AS group_key FROM reach GROUP BY kind, k
"""

_WORDS = ", ".join(f"'{w}'" for w in STAND_INS)
_P7 = rf"""
WITH r AS (
  SELECT DISTINCT id, record_id, updated_at, trim(regexp_replace(canonical_name, '\s+', ' ', 'g')) AS name,
    trim(regexp_replace(description, '\s+', ' ', 'g')) AS text,
    list_transform(coalesce(original_descriptions, []), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS notes,
    coalesce((SELECT min(trust_rank) FROM source_trust t WHERE lower(trim(t.record_source)) = lower(trim(u.record_source))), 2147483647) AS rank
  FROM unified_roles u WHERE id IS NOT NULL
), bare AS (
  SELECT *, regexp_replace(lower(name), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS bn,
    regexp_replace(lower(text), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS bt,
    len(list_distinct(list_filter(notes, lambda x: x IS NOT NULL AND regexp_replace(lower(x), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') NOT IN ('', {_WORDS})))) AS n,
    count(DISTINCT record_id) OVER (PARTITION BY id) AS records
  FROM r
), scored AS (
  SELECT id, 'canonical_name' AS field_name, record_id, updated_at, -rank AS m FROM bare WHERE records > 1 AND bn NOT IN ('', {_WORDS})
  UNION ALL SELECT id, 'description', record_id, updated_at, length(text) FROM bare WHERE records > 1 AND bt NOT IN ('', {_WORDS})
  UNION ALL SELECT id, 'original_descriptions', record_id, updated_at, n FROM bare WHERE records > 1 AND n > 0
)
SELECT id, field_name, record_id FROM scored
QUALIFY row_number() OVER (PARTITION BY id, field_name ORDER BY m DESC, updated_at DESC NULLS LAST, record_id) = 1
"""

QUERIES = {"p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p7_fused": p7_fused}
SQL = {"p5_found": _P5, "p7_found": _P7}
