"""The domain's tables in clean form: each row once, references trimmed and in lower case, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagaloom.sources.tables import table

#: Units per season; a season is a block of units of a book.
SEASON_UNITS = 7


def clean_ids(c: str) -> Column:
    """Distinct, sorted, trimmed lower-case references of an array; null gives an empty array."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, none), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))))


def season_of(unit: Column) -> Column:
    """The season of a unit, from 1; null for a null unit."""
    return (F.floor((unit - 1) / SEASON_UNITS) + 1).cast("int")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified events: id, book_id, name, location, description, significance, p0, p1, source_units, unit, action_count, people."""
    return (
        table(spark, sf_dir, "unified_events")
        .dropDuplicates(["id"])
        .select(
            "id", "book_id", "name", "location", "description", "significance", F.col("progress_start").alias("p0"), F.col("progress_end").alias("p1"),
            "source_units", F.get("source_units", F.lit(0)).alias("unit"), "action_count", "created_at", "updated_at", clean_ids("participants").alias("people"),
        )
    )


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per role id, the record with the smallest key."""
    t = table(spark, sf_dir, "unified_roles").where("id is not null")
    first = t.groupBy("id").agg(F.min(F.struct("record_id", "book_id", "canonical_name", "all_names", "description", "original_descriptions", "powers", "primary_power", "total_mentions", "units_appeared", "related_entities", "updated_at")).alias("r"))
    return first.select("id", "r.*")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified locations, each once, with clean associated roles."""
    return table(spark, sf_dir, "unified_locations").dropDuplicates(["id"]).withColumn("people", clean_ids("associated_entities"))


def in_people(ev: DataFrame) -> DataFrame:
    """One row per event and participant."""
    return ev.withColumn("role", F.explode("people"))


def pairs_of(ev: DataFrame) -> DataFrame:
    """One row per event and pair a < b of its participants, made within the row: no self-join, no shuffle."""
    combos = F.expr("flatten(transform(people, (x, i) -> transform(slice(people, i + 2, size(people)), y -> struct(x as a, y as b))))")
    return ev.withColumn("_pair", F.explode(combos)).select("*", "_pair.a", "_pair.b").drop("_pair")


_IDS = "list_sort(list_distinct(list_filter(list_transform(coalesce({0}, []), lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '')))"
SQL_EVENTS = f"""ev AS (
  SELECT DISTINCT id, book_id, name, location, description, significance, progress_start AS p0, progress_end AS p1, source_units,
    source_units[1] AS unit, action_count, created_at, updated_at, {_IDS.format('participants')} AS people FROM unified_events)"""
SQL_ROLES = """role AS (
  SELECT id, record_id, book_id, canonical_name, all_names, description, original_descriptions, powers, primary_power, total_mentions, units_appeared, related_entities, updated_at
  FROM unified_roles WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY record_id) = 1)"""
SQL_LOCATIONS = f"""loc AS (SELECT DISTINCT *, {_IDS.format('associated_entities')} AS people FROM unified_locations)"""
SQL_PEOPLE = "ep AS (SELECT ev.*, unnest(people) AS role FROM ev)"
SQL_PAIRS = "pr AS (SELECT x.*, x.role AS a, y.role AS b FROM ep x JOIN ep y ON x.id = y.id AND x.role < y.role)"
SQL_SEASON = f"CAST(floor(({{0}} - 1) / {SEASON_UNITS}.0) + 1 AS INT)"
