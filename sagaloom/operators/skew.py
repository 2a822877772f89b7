"""Joins against a table with one row per key when a few keys of the large side are very frequent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_lookup(rows: DataFrame, per_key: DataFrame, keys: list[str], spread: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """rows joined with per_key (at most one row per key) on keys.

    The rows of one key are spread over `salts` tasks by a hash of the column `spread`, and per_key is repeated that many
    times, so a key that holds a third of all rows is no longer one task. Callers keep per_key small against rows (it is
    aggregated to its keys and filtered to those that matter before). Null keys match nothing.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    wide = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(wide, [*keys, "_salt"], how).drop("_salt")


def two_step(rows: DataFrame, keys: list[str], spread: str, partial: list, final: list, salts: int = 16) -> DataFrame:
    """Aggregate in two steps, first per key and salt, for aggregates without a map-side step (collect_set and the like)."""
    first = rows.groupBy(*keys, F.pmod(F.xxhash64(spread), F.lit(salts)).alias("_salt")).agg(*partial)
    return first.groupBy(*keys).agg(*final)


def all_of(conditions: list):
    """Conjunction of columns."""
    return reduce(lambda a, b: a & b, conditions)
