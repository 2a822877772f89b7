"""Orphan references: signed reference and existence counts per key, summed from change deltas.

Every table that refers to keys gives +1 per distinct (record, reference), or -1 for one taken back. The referred table gives
existence deltas: the state of a key is that of its latest version, and a batch of versions changes the key's existence by
(live after) - (live before). Both sorts of deltas are rows of one form, summed per key in one aggregation with a map-side
step, so a key that holds a third of all references or versions is never one task. Keys with references and no existence are
the orphans.

`orphan_references` judges whole tables at once. `OrphanState` is kept between batches: the state of each key, and signed counts
of references per table, key and month; those older than their key's first creation (or of no known key) have their time as a
slot of their own, so a reference taken back leaves its slot and a key created earlier than known before empties the slots after
it. Both merge by sums and minima, in any grouping of batches.

Defined cases: null and blank references are none; a reference is trimmed and lower-cased; rows delivered twice count once
within a batch; a null `updated_at` is older than any other, ties fall to the greater version key; a null `created_at` of a
record gives a null period and is never late.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagaloom.operators.skew import salted_lookup


def reference_rows(df: DataFrame, table: str, key: str, refs: str, created: str = "created_at") -> DataFrame:
    """src_table, src_key, ref_id, created_at: one row per record and distinct reference in it."""
    cleaned = F.array_distinct(F.filter(F.transform(refs, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))
    return df.where(F.col(key).isNotNull()).select(
        F.lit(table).alias("src_table"),
        F.col(key).cast("string").alias("src_key"),
        F.explode(cleaned).alias("ref_id"),
        F.col(created).alias("created_at"),
    )


def key_versions(versions: DataFrame, key: str, version: str, updated: str, created: str, deleted: str) -> DataFrame:
    """ref_id, latest (at, version, live), first_created: the state of each key after the given versions."""
    v = versions.where(F.col(key).isNotNull()).select(
        F.lower(F.trim(F.col(key))).alias("ref_id"),
        F.struct(F.col(updated).alias("at"), F.col(version).alias("version"), F.col(deleted).isNull().cast("int").alias("live")).alias("latest"),
        F.col(created).alias("first_created"),
    )
    return merge_versions(v)


def merge_versions(states: DataFrame) -> DataFrame:
    """States of one key merged; merging is associative, so old state and new batches may be merged in any grouping."""
    return states.groupBy("ref_id").agg(F.max("latest").alias("latest"), F.min("first_created").alias("first_created"))


def existence_deltas(after: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """ref_id, refs, existence, known, first_created: the change of each key's existence from one state to a later one."""
    if before is None:
        return after.select("ref_id", F.lit(0).alias("refs"), F.col("latest.live").alias("existence"), F.lit(1).alias("known"), "first_created")
    j = after.join(before.select("ref_id", F.col("latest.live").alias("_was")), "ref_id", "left")
    return j.select("ref_id", F.lit(0).alias("refs"), (F.col("latest.live") - F.coalesce("_was", F.lit(0))).alias("existence"), F.when(F.col("_was").isNull(), 1).otherwise(0).alias("known"), "first_created")


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """The same form for references that came (+1) or were taken back (-1)."""
    never = F.lit(None).cast("timestamp").alias("first_created")
    return refs.select("ref_id", F.lit(sign).alias("refs"), F.lit(0).alias("existence"), F.lit(0).alias("known"), never)


def key_counts(deltas: DataFrame) -> DataFrame:
    """Signed counts per key: references, existence, whether it was ever known, first creation."""
    return deltas.groupBy("ref_id").agg(F.sum("refs").alias("refs"), F.sum("existence").alias("existence"), F.sum("known").alias("known"), F.min("first_created").alias("first_created"))


def orphan_keys(counts: DataFrame) -> DataFrame:
    """ref_id, kind of referenced keys that are missing or deleted."""
    kind = F.when(F.col("known") == 0, "missing").when(F.col("existence") <= 0, "deleted")
    return counts.where("refs > 0").select("ref_id", kind.alias("kind")).where("kind is not null")


@dataclass(frozen=True)
class OrphanState:
    """keys: ref_id, latest, first_created; slots: src_table, ref_id, period, slot, n (signed counts of references)."""

    keys: DataFrame
    slots: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> OrphanState:
        """The state before any batch."""
        keys = spark.createDataFrame([], "ref_id string, latest struct<at: timestamp, version: bigint, live: int>, first_created timestamp")
        return OrphanState(keys, spark.createDataFrame([], "src_table string, ref_id string, period string, slot timestamp, n bigint"))

    @staticmethod
    def read(spark: SparkSession, path: str) -> OrphanState:
        """A stored state."""
        return OrphanState(spark.read.parquet(f"{path}/keys"), spark.read.parquet(f"{path}/slots"))

    def write(self, path: str) -> None:
        """Store the state in a new folder."""
        self.keys.write.parquet(f"{path}/keys")
        self.slots.write.parquet(f"{path}/slots")

    def apply(self, came: DataFrame | None = None, gone: DataFrame | None = None, versions: DataFrame | None = None) -> OrphanState:
        """The state after a batch: references that came and were taken back (reference_rows) and new key_versions."""
        keys = self.keys if versions is None else merge_versions(self.keys.unionByName(versions))
        period = F.date_format("created_at", "yyyy-MM").alias("period")
        slots = self.slots
        for refs, sign in ((came, 1), (gone, -1)):
            if refs is not None:
                slots = slots.unionByName(refs.distinct().select("src_table", "ref_id", period, F.col("created_at").alias("slot"), F.lit(sign).cast("long").alias("n")))
        summed = slots.groupBy("src_table", "ref_id", "period", "slot").agg(F.sum("n").alias("n"))
        born = salted_lookup(summed, keys.select("ref_id", "first_created"), ["ref_id"], "slot", how="left")
        slot = F.when(F.col("first_created").isNull() | (F.col("slot") < F.col("first_created")), F.col("slot")).alias("slot")
        kept = born.select("src_table", "ref_id", "period", slot, "n").groupBy("src_table", "ref_id", "period", "slot").agg(F.sum("n").alias("n"))
        return OrphanState(keys, kept.where("n <> 0"))

    def report(self) -> DataFrame:
        """src_table, period, kind, n_references, n_keys of the current orphans."""
        known = F.col("latest").isNotNull()
        kind = F.when(~known, "missing").when(F.col("latest.live") == 0, "deleted").when(F.col("slot") < F.col("first_created"), "late")
        judged = salted_lookup(self.slots, self.keys, ["ref_id"], "slot", how="left").select("src_table", "period", "ref_id", kind.alias("kind"), "n").where("kind is not null")
        per_key = judged.groupBy("src_table", "period", "kind", "ref_id").agg(F.sum("n").alias("n")).where("n > 0")
        return per_key.groupBy("src_table", "period", "kind").agg(F.sum("n").alias("n_references"), F.count(F.lit(1)).alias("n_keys"))


def orphan_references(refs: DataFrame, state: DataFrame) -> DataFrame:
    """src_table, src_key, ref_id, kind, period of every reference without a usable key.

    Only the keys that give cases go back to the reference rows, spread by salt, so neither a hot key nor the mass of good
    references is shuffled as rows. Keys that may give late references are those with a reference older than their creation.
    """
    never = F.lit(None).cast("timestamp")
    came = refs.select("ref_id", *(F.lit(x).alias(n) for n, x in (("refs", 1), ("existence", 0), ("known", 0))), never.alias("first_created"), F.col("created_at").alias("oldest"))
    both = came.unionByName(existence_deltas(state).withColumn("oldest", never))
    counts = both.groupBy("ref_id").agg(*(F.sum(c).alias(c) for c in ("refs", "existence", "known")), F.min("first_created").alias("first_created"), F.min("oldest").alias("oldest"))
    kind = F.when(F.col("known") == 0, "missing").when(F.col("existence") <= 0, "deleted").when(F.col("first_created") > F.col("oldest"), "late")
    judged = counts.where("refs > 0").select("ref_id", kind.alias("kind"), "first_created").where("kind is not null")
    hit = salted_lookup(refs, judged, ["ref_id"], "src_key")
    return (
        hit.where((F.col("kind") != "late") | (F.col("first_created") > F.col("created_at")))
        .select("src_table", "src_key", "ref_id", "kind", F.date_format("created_at", "yyyy-MM").alias("period"))
        .distinct()
    )


def orphan_report(cases: DataFrame) -> DataFrame:
    """Orphans per table, month and kind: references and distinct keys."""
    return cases.groupBy("src_table", "period", "kind").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("ref_id").alias("n_keys"))
