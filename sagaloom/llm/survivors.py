"""Best representative of each duplicate group, field by field (problem 7).

The rules of the project fix which record survives for each field, so the choice is a maximum over (measure, updated_at)
per field, all three fields in one aggregation with map-side combining: no group is ever gathered.

Defined cases: null, blank and stand-in values are no value; an id with fewer than two distinct records, or a field
without any value, gives no row; sources are compared without case and surrounding space, unlisted and null ones rank last;
null `updated_at` is the oldest; full ties go to the smallest record_id; rows delivered twice change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that stand in for a missing value, in lower case, without surrounding marks. Signs without any letter or digit need no list.
STAND_INS = (
    "unknown", "none", "null", "nil", "nan", "n/a", "na", "tbd", "tba", "todo", "tbc", "missing", "undefined", "empty", "not available", "not known",
    "to be filled in", "to be added", "to be determined", "pending", "unspecified", "未知", "不详", "不明", "暂无", "待补充", "待补", "待定", "待填", "无", "没有", "空", "缺失", "佚名", "未详",
    "未填写", "未填", "暂缺", "desconocido", "inconnu", "unbekannt", "неизвестно",
)


def squeezed(c: Column) -> Column:
    """Surrounding white space left out, any run of white space as one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def is_value(c: Column) -> Column:
    """Whether a squeezed text says something; false for null."""
    bare = F.regexp_replace(F.lower(c), r"(?U)^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.coalesce((bare != "") & ~bare.isin(*STAND_INS), F.lit(False))


def surviving_records(roles: DataFrame, trust: DataFrame) -> DataFrame:
    """id, field_name, record_id: whose canonical_name, description and original_descriptions survive."""
    ranks = trust.select(F.lower(F.trim("record_source")).alias("_source"), "trust_rank").where("_source is not null").groupBy("_source").agg(F.min("trust_rank").alias("_rank"))
    seen = roles.where(F.col("id").isNotNull() & F.col("record_id").isNotNull()).select(
        "id",
        "record_id",
        "updated_at",
        F.lower(squeezed(F.col("record_source"))).alias("_source"),
        is_value(squeezed(F.col("canonical_name"))).alias("_named"),
        squeezed(F.col("description")).alias("_text"),
        F.size(F.array_distinct(F.filter(F.transform(F.coalesce("original_descriptions", F.array().cast("array<string>")), squeezed), is_value))).alias("_count"),
    )
    seen = seen.join(ranks, "_source", "left")  # one row per known source: the planner broadcasts it after its size
    last = F.struct("updated_at", (-F.col("record_id")).alias("_first"))

    def best(measure: Column, valued: Column) -> Column:
        return F.max(F.when(valued, F.struct(measure.alias("m"), last.alias("l"))))["l"]["_first"]

    worst = F.lit(2**31 - 1)
    picked = (
        seen.groupBy("id")
        .agg(
            F.min("record_id").alias("_lo"),
            F.max("record_id").alias("_hi"),
            best(-F.coalesce(F.col("_rank"), worst).cast("long"), F.col("_named")).alias("canonical_name"),
            best(F.length("_text").cast("long"), is_value(F.col("_text"))).alias("description"),
            best(F.col("_count").cast("long"), F.col("_count") > 0).alias("original_descriptions"),
        )
        .where("_lo <> _hi")
    )
    fields = ("canonical_name", "description", "original_descriptions")
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), (-F.col(f)).alias("record_id")) for f in fields)))
    return picked.select("id", rows.alias("r")).select("id", "r.field_name", "r.record_id").where("record_id is not null")
