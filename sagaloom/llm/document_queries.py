"""Queries over documents: problems 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sagaloom.llm.abuse import fit_reviewed, flag_documents, rates_by_source
from sagaloom.llm.bpe import encode_corpus
from sagaloom.llm.leakage import find_leaks
from sagaloom.sources.tables import table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry a passage of an evaluation item, with the item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an abusive, hateful or sexually explicit sentence, by category."""
    docs = table(spark, sf_dir, "documents")
    return flag_documents(docs, fit_reviewed(docs, table(spark, sf_dir, "review_labels"))).select("doc_id", "category")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of such documents per source."""
    docs = table(spark, sf_dir, "documents")
    return rates_by_source(docs, flag_documents(docs, fit_reviewed(docs, table(spark, sf_dir, "review_labels"))))


QUERIES: dict = {"p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_rates": p10_rates}
SQL: dict[str, str] = {}
