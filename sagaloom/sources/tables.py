"""Reading the project's Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sagaloom.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder; column pruning and filters reach the scan as nothing is cached here."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Offer tables to spark.sql under their names."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
