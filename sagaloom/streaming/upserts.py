"""A Structured Streaming file source that keeps the latest record per key in a Parquet table partitioned by a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sagaloom.operators.ranking import best_per


def upsert_stream(spark: SparkSession, source: str, schema: StructType, store: str, checkpoint: str, keys: list[str], order: str, partition: str) -> StreamingQuery:
    """Start reading new Parquet files of source; each batch rewrites only the partitions of the store that it touches.

    Within a key the row with the greatest order wins, so batches may come late, twice or out of order: the result is the same.
    The new partitions are written aside first and then put in place by a dynamic partition overwrite.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        touched = batch.select(partition).distinct()
        both = batch
        if _exists(session, store):
            old = session.read.parquet(store)
            both = old.select(*batch.columns).join(touched, partition, "left_semi").unionByName(batch)
        kept = best_per(both, keys, [F.desc_nulls_last(order), *[F.col(c) for c in keys]])
        aside = f"{store}__next"
        kept.write.mode("overwrite").parquet(aside)
        session.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(store)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(session: SparkSession, path: str) -> bool:
    p = session._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(session._jsc.hadoopConfiguration()).exists(p)


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per event-time window and kind, with rows later than the watermark left out when streamed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")
