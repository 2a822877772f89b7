"""Incremental operators: upserts by key, freshness, best of two sources, missing keys, and the stream that feeds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagaloom.operators.ranking import best_per


def content_hash(*columns: str) -> Column:
    """SHA-256 of a row's columns in a fixed text form: parts joined by a separator that texts do not hold, null as \\N."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns)), 256)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Old rows whose key is not in new, and of new rows the first of each key by order."""
    latest = best_per(new, keys, order)
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def freshness(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """key, status: applied, stale or missing for inputs (key, hash) against outputs (key, hash)."""
    j = inputs.join(outputs.withColumnRenamed("hash", "made_from"), key, "left")
    return j.select(key, F.when(F.col("made_from").isNull(), "missing").when(F.col("made_from") == F.col("hash"), "applied").otherwise("stale").alias("status"))


def best_of(candidates: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """Of candidates (key, hash, made_at, priority, ...) the one per key whose hash fits the input's, then the newest, then the smaller priority."""
    j = candidates.join(inputs.select(key, F.col("hash").alias("_want")), key, "left").withColumn("fits", F.coalesce(F.col("hash") == F.col("_want"), F.lit(False)))
    return best_per(j, [key], [F.desc("fits"), F.desc_nulls_last("made_at"), "priority"]).drop("_want")


def missing_keys(present: DataFrame, group: list[str], number: str) -> DataFrame:
    """group and number of every whole number between a group's least and greatest that is not present."""
    span = present.groupBy(*group).agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"))
    every = span.select(*group, F.explode(F.sequence("_lo", "_hi")).alias(number))
    return every.join(present.select(*group, number), [*group, number], "left_anti")
