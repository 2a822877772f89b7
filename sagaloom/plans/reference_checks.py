"""Queries of problem 3: references to records that do not exist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagaloom.operators.references import OrphanState, key_versions, orphan_references, orphan_report, reference_rows
from sagaloom.session import cut
from sagaloom.sources.tables import table


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of all three tables."""
    roles = table(spark, sf_dir, "unified_roles")
    return reduce(
        DataFrame.unionByName,
        [
            reference_rows(table(spark, sf_dir, "unified_events"), "unified_events", "id", "participants"),
            reference_rows(roles, "unified_roles", "record_id", "related_entities"),
            reference_rows(table(spark, sf_dir, "unified_locations"), "unified_locations", "id", "associated_entities"),
        ],
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record and reference to a role that is missing, deleted or late."""
    roles = table(spark, sf_dir, "unified_roles")
    return orphan_references(_references(spark, sf_dir), key_versions(roles, "id", "record_id", "updated_at", "created_at", "deleted_at"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, month and kind."""
    return orphan_report(p3_found(spark, sf_dir))


def p3_delta(spark: SparkSession, sf_dir: str, since: str = "2025-07-01") -> DataFrame:
    """The report of p3_report from a kept state: all changes before a day, then those since as a second batch.

    The first batch also holds wrong references, which the second takes back: they leave no trace.
    """
    refs = _references(spark, sf_dir)
    early = F.coalesce(F.col("created_at") < F.lit(since).cast("timestamp"), F.lit(False))
    seen = F.coalesce(F.col("updated_at") < F.lit(since).cast("timestamp"), F.lit(True))
    roles = table(spark, sf_dir, "unified_roles")
    versions = lambda rows: key_versions(rows, "id", "record_id", "updated_at", "created_at", "deleted_at")
    wrong = refs.where(~early).withColumn("ref_id", F.concat("ref_id", F.lit("?")))
    first = OrphanState.empty(spark).apply(refs.where(early).unionByName(wrong), None, versions(roles.where(seen)))
    stored = OrphanState(cut(first.keys), cut(first.slots))
    return stored.apply(refs.where(~early), wrong, versions(roles.where(~seen))).report()


_FOUND = """
WITH refs AS (
  SELECT DISTINCT 'unified_events' AS src_table, id AS src_key, lower(trim(x)) AS ref_id, created_at
  FROM (SELECT id, created_at, unnest(participants) AS x FROM unified_events) WHERE trim(x) <> ''
  UNION ALL
  SELECT DISTINCT 'unified_roles', CAST(record_id AS VARCHAR), lower(trim(x)), created_at
  FROM (SELECT record_id, created_at, unnest(related_entities) AS x FROM unified_roles) WHERE trim(x) <> ''
  UNION ALL
  SELECT DISTINCT 'unified_locations', id, lower(trim(x)), created_at
  FROM (SELECT id, created_at, unnest(associated_entities) AS x FROM unified_locations) WHERE trim(x) <> ''
), latest AS (
  SELECT lower(trim(id)) AS ref_id, deleted_at, row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY updated_at DESC NULLS LAST, record_id DESC) AS n
  FROM unified_roles WHERE id IS NOT NULL
), born AS (
  SELECT lower(trim(id)) AS ref_id, min(created_at) AS first_created FROM unified_roles WHERE id IS NOT NULL GROUP BY 1
), judged AS (
  SELECT r.src_table, r.src_key, r.ref_id,
         CASE WHEN b.ref_id IS NULL THEN 'missing' WHEN l.deleted_at IS NOT NULL THEN 'deleted'
              WHEN b.first_created > r.created_at THEN 'late' END AS kind,
         strftime(r.created_at, '%Y-%m') AS period
  FROM refs r LEFT JOIN born b ON b.ref_id = r.ref_id LEFT JOIN latest l ON l.ref_id = r.ref_id AND l.n = 1
)
SELECT DISTINCT src_table, src_key, ref_id, kind, period FROM judged WHERE kind IS NOT NULL
"""

_REPORT = f"SELECT src_table, period, kind, count(*) AS n_references, count(DISTINCT ref_id) AS n_keys FROM ({_FOUND}) GROUP BY ALL"
QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_delta": p3_delta}
SQL = {"p3_found": _FOUND, "p3_report": _REPORT, "p3_delta": _REPORT}
