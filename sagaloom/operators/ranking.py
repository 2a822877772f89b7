"""Ranking within groups with total orders, so ties never depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagaloom.operators.skew import salted_lookup


def ranked(df: DataFrame, group: list[str], order: list[Column | str], name: str = "rank_no") -> DataFrame:
    """df with the place of each row in its group; the order must be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def top_n(df: DataFrame, group: list[str], order: list[Column | str], n: int, name: str = "rank_no") -> DataFrame:
    """The first n rows of each group; Spark stops each group early (window group limit) before the shuffle and after it."""
    return ranked(df, group, order, name).where(F.col(name) <= n)


def best_per(df: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group."""
    return top_n(df, group, order, 1, "_place").drop("_place")


def numbered(df: DataFrame, group: list[str], lead: Column, rest: list[Column | str], name: str = "rank_no") -> DataFrame:
    """Place of each row in its group by (lead ascending with nulls last, rest), without sorting a whole group in one task.

    Rows are ranked only among those of equal lead (a coarse whole number); how many come before is a running sum over the
    counts per lead, one small row each. A group of any size is spread over as many tasks as it has leads.
    """
    d = df.withColumn("_lead", F.coalesce(lead.cast("long"), F.lit(1 << 60)))
    w = Window.partitionBy(*group).orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy(*group, "_lead").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    key = F.struct(*group, "_lead")  # structs with null fields are equal, so rows of null groups stay
    inner = ranked(d, [*group, "_lead"], rest, "_in").withColumn("_k", key)
    joined = inner.join(before.select(key.alias("_k"), "_before"), "_k")
    return joined.withColumn(name, (F.col("_before") + F.col("_in")).cast("int")).drop("_k", "_lead", "_before", "_in")


def with_stats(df: DataFrame, keys: list[str], stats: list[Column], spread: str) -> DataFrame:
    """df with aggregates of each row's group: aggregated with a map-side step, brought back by a salted join, so a hot group is no single task."""
    key = F.struct(*keys)  # structs with null fields are equal, so rows of null groups stay
    found = df.groupBy(key.alias("_k")).agg(*stats)
    return salted_lookup(df.withColumn("_k", key), found, ["_k"], spread).drop("_k")


def with_count(df: DataFrame, keys: list[str], spread: str, name: str, lean: DataFrame | None = None, most: int = 4096) -> DataFrame:
    """df with the number of rows that share a row's keys, counted in place: nothing is repeated beside the rows.

    Only the keys of more than `most` rows are broadcast with their counts, at most one for every `most` rows; their rows are spread
    by a hash of the column `spread`, so that none is a single task. lean: the same rows as df where they are read with less work.
    """
    heavy = (df if lean is None else lean).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    key = F.struct(*keys)  # structs with null fields are equal, so rows of null groups stay
    d = df.withColumn("_k", key).join(F.broadcast(heavy.select(key.alias("_k"), "_n")), "_k", "left").drop("_k")
    part = F.pmod(F.xxhash64(spread), F.ceil(F.col("_n") / most))  # null for all other keys
    return d.withColumn(name, F.coalesce("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, part)))).drop("_n")


def index_quantile(df: DataFrame, group: list[str], value: str, share: float, spread: str) -> DataFrame:
    """group, threshold: the value at index floor((n - 1) * share) of the ascending values of each group (no interpolation)."""
    placed = with_stats(numbered(df, group, F.floor(value), [F.col(value), F.col(spread)], "_at"), group, [F.count(F.lit(1)).alias("_n")], spread)
    return placed.where(F.col("_at") - 1 == F.floor((F.col("_n") - 1) * share)).select(*group, F.col(value).alias("threshold"))


def with_previous(df: DataFrame, group: list[str], place: str, column: str, name: str = "_last") -> DataFrame:
    """df with the column of the row one place before in its group, by an equality join on the place: no group is sorted in one task."""
    key = F.struct(*group, place)
    before = df.select(F.struct(*group, (F.col(place) + 1).alias(place)).alias("_k"), F.col(column).alias(name))
    return df.withColumn("_k", key).join(before, "_k", "left").drop("_k")
