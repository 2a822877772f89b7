"""Sinks and stores: the chunk store, JSON with sets as lists, Markdown chapters, JSON inside other text."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_store(chunks: DataFrame, path: str, partition: str = "juan_index") -> None:
    """Write chunks partitioned by unit in place of what is there."""
    chunks.write.mode("overwrite").partitionBy(partition).parquet(path)


def read_units(spark: SparkSession, path: str, units: list[int], partition: str = "juan_index") -> DataFrame:
    """Chunks of some units; only their folders are read."""
    return spark.read.parquet(path).where(F.col(partition).isin(*units))


def delete_keys(chunks: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks without those whose key is in gone."""
    return chunks.join(gone.select(*keys).distinct(), keys, "left_anti")


def write_json(df: DataFrame, path: str, sets: list[str]) -> None:
    """Rows as JSON lines, the arrays named in sets sorted and without repeats so that files are the same for the same data."""
    df.select(*(F.array_sort(F.array_distinct(c)).alias(c) if c in sets else F.col(c) for c in df.columns)).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a fixed schema; broken lines give nulls instead of failing."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def safe_name(c: Column) -> Column:
    """A title as a file name."""
    return F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|]', "_"), r"\s+", " ")


def markdown_chapters(book: DataFrame) -> DataFrame:
    """season_name, unit_index, file_name, markdown of each unit: front matter, a heading, an anchor per segment."""
    seg = F.transform(F.array_sort(F.collect_list(F.struct("segment_index", F.array_join("sentences", "").alias("t")))), lambda x: F.concat(F.lit('<a id="seg-'), F.lpad(x["segment_index"].cast("string"), 3, "0"), F.lit('"></a>\n\n'), x["t"]))
    head = F.concat(F.lit("---\ntitle: "), F.col("unit_title"), F.lit("\nunit: "), F.col("unit_index").cast("string"), F.lit("\n---\n\n# "), F.col("unit_title"), F.lit("\n\n"))
    g = book.groupBy("season_name", "unit_index", "unit_title").agg(seg.alias("_s"))
    return g.select("season_name", "unit_index", F.concat(F.lpad(F.col("unit_index").cast("string"), 3, "0"), F.lit("-"), safe_name(F.col("unit_title")), F.lit(".md")).alias("file_name"), F.concat(head, F.array_join("_s", "\n\n"), F.lit("\n")).alias("markdown"))


def write_chapters(chapters: DataFrame, path: str) -> None:
    """One text file folder per unit, below its season."""
    chapters.select("season_name", "unit_index", "markdown").repartition("season_name", "unit_index").write.mode("overwrite").partitionBy("season_name", "unit_index").text(path)


_FENCE = re.compile(r"`{3}(?:json)?\s*(.*?)`{3}", re.S)


def json_in_text(content: str):
    """The JSON value in an answer: a fenced block first, then from the first to the last brace, then all; else an error."""
    if not content or not content.strip():
        raise ValueError("empty answer")
    tries = _FENCE.findall(content)
    a, z = content.find("{"), content.rfind("}")
    if 0 <= a < z:
        tries.append(content[a : z + 1])
    for t in [*tries, content]:
        try:
            return json.loads(t)
        except ValueError:
            continue
    raise ValueError("no JSON value found")
