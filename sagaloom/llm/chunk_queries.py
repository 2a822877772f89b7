"""Queries over extracted chunks: problems 1, 2 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagaloom.llm.lookalikes import same_look_pairs, trimmed
from sagaloom.llm.sentences import split_sentences, train_tagger
from sagaloom.llm.splitting import split_oversized
from sagaloom.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every chunk's joined text."""
    chunks = table(spark, sf_dir, "chunk_extractions")
    return split_sentences(chunks, train_tagger(chunks))


def p1_unmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the long stretches without marks cut too, where the model of mark-stripped text finds boundaries."""
    chunks = table(spark, sf_dir, "chunk_extractions")
    return split_sentences(chunks, train_tagger(chunks, unmarked=True))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 600 characters, 60 shared, of every larger chunk."""
    return split_oversized(table(spark, sf_dir, "chunk_extractions"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of texts of one book that look the same: sentences of at least four characters, and entity names."""
    chunks = table(spark, sf_dir, "chunk_extractions").where("book_id is not null")
    sentences = chunks.select(F.lit("sentence").alias("field_name"), "book_id", F.explode("source_sentences").alias("text"))
    names = chunks.select(F.lit("entity_name").alias("field_name"), "book_id", F.explode("entities.name").alias("text"))
    sentences = sentences.withColumn("text", trimmed(F.col("text"))).where(F.length("text") >= 4)
    names = names.withColumn("text", trimmed(F.col("text"))).where("text <> ''")
    return same_look_pairs(sentences.unionByName(names), ["field_name", "book_id"])


QUERIES = {"p1_found": p1_found, "p1_unmarked": p1_unmarked, "p2_found": p2_found, "p4_found": p4_found}
_P2 = """
WITH RECURSIVE c AS (
  SELECT DISTINCT chunk_id, chunk_start_index AS f, list_transform(source_sentences, lambda y: coalesce(y, '')) AS e FROM chunk_extractions WHERE source_sentences IS NOT NULL
), t AS (
  SELECT chunk_id, f, array_to_string(e, '') AS x, list_transform(range(1, len(e) + 1), lambda i: CAST(list_sum(list_transform(e[1:i], lambda y: length(y))) AS BIGINT)) AS ends FROM c
), big AS (
  SELECT *, length(x) AS n, list_filter(range(1, length(x) + 1), lambda i: contains('。！？；，、：.!?;,: ' || chr(10), substring(x, i, 1))) AS seps FROM t WHERE length(x) > 600
), r AS (
  SELECT chunk_id, 0 AS piece_no, CAST(0 AS BIGINT) AS s, coalesce(list_max(list_filter(ends, lambda p: p > 60 AND p <= 600)), list_max(list_filter(seps, lambda p: p > 60 AND p <= 600)), 600) AS z FROM big
  UNION ALL
  SELECT r.chunk_id, piece_no + 1, z - 60, CASE WHEN n - (z - 60) <= 600 THEN n ELSE
    coalesce(list_max(list_filter(ends, lambda p: p > z AND p <= z + 540)), list_max(list_filter(seps, lambda p: p > z AND p <= z + 540)), z + 540) END
  FROM r JOIN big ON big.chunk_id = r.chunk_id WHERE z < n
)
SELECT r.chunk_id, CAST(piece_no AS INT) AS piece_no, CAST(s AS INT) AS start_char, CAST(z AS INT) AS end_char,
  CAST(f + len(list_filter(ends, lambda p: p <= s)) AS INT) AS piece_start_index, CAST(f + len(list_filter(ends, lambda p: p <= z - 1)) + 1 AS INT) AS piece_end_index
FROM r JOIN big ON big.chunk_id = r.chunk_id
"""

SQL: dict[str, str] = {"p2_found": _P2}
