"""Books from document files: paragraphs, titles, units, segments, and the progress axis over them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagaloom.functions.text import chinese_number, pack_sentences, plain_sentences, strip

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(content: bytes) -> list[str]:
    """The paragraphs of a DOCX file that are not blank."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    texts = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p"))
    return [t for t in texts if t]


def text_paragraphs(content: bytes) -> list[str]:
    """The lines of a text file that are not blank."""
    return [x.strip() for x in content.decode("utf-8", "replace").splitlines() if x.strip()]


READERS = {".docx": docx_paragraphs, ".txt": text_paragraphs}


def read_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """file, pos, text of the documents of a folder; a file of another kind raises."""
    files = spark.read.format("binaryFile").load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content):
                kind = next((k for k in READERS if path.lower().endswith(k)), None)
                if kind is None:
                    raise ValueError(f"no reader for {path}")
                rows += [(path.rsplit("/", 1)[-1], i, t) for i, t in enumerate(READERS[kind](content))]
            yield pd.DataFrame(rows, columns=["file", "pos", "text"])

    return files.select("path", "content").mapInPandas(run, "file string, pos int, text string")


def season_files(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with their file's season: the number in its name, files without one last (10000)."""
    part = F.regexp_extract("file", "第([一二三四五六七八九十百千万两0-9]+)季", 1)
    return paragraphs.withColumn("season_index", F.when(part == "", 10_000).otherwise(chinese_number(part))).withColumn("season_name", F.when(part == "", F.regexp_replace("file", r"\.[^.]*$", "")).otherwise(F.concat(F.lit("第"), part, F.lit("季"))))


def build_book(paragraphs: DataFrame, book_title: str = "", most: int = 6, chars: int = 600) -> DataFrame:
    """unit_index, unit_title, season_index, season_name, segment_index, progress_index, sentences.

    A title opens a unit; what stands before a file's first title is left out, as are units without sentences. Titles are
    counted per file by a window, so a file is the largest group that is sorted in one task; units and segments are then
    numbered over one small row each.
    """
    p = season_files(paragraphs).where(F.col("text") != book_title)
    title = F.col("text").startswith("第") & F.substring("text", 1, 40).rlike("[章回]")
    w = Window.partitionBy("file").orderBy("pos")
    p = p.withColumn("_t", title).withColumn("_u", F.sum(F.col("_t").cast("int")).over(w)).where("_u > 0")
    body = p.where("not _t").select("file", "_u", "pos", plain_sentences(F.col("text")).alias("s"))
    units = body.groupBy("file", "_u").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"])).alias("s")).where(F.size("s") > 0)
    heads = p.where("_t").select("file", "_u", strip(F.col("text")).alias("unit_title"), "season_index", "season_name")
    units = units.join(heads, ["file", "_u"]).withColumn("segments", pack_sentences(F.col("s"), most, chars))
    order = Window.orderBy("season_index", "file", "_u")  # one small row per unit, without its text
    numbers = units.select("file", "_u", "season_index", F.size("segments").alias("n")).withColumn("unit_index", F.row_number().over(order)).withColumn("_before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    flat = units.join(numbers.select("file", "_u", "unit_index", "_before"), ["file", "_u"]).select("unit_index", "unit_title", "season_index", "season_name", "_before", F.posexplode("segments").alias("i", "sentences"))
    return flat.select("unit_index", "unit_title", "season_index", "season_name", (F.col("i") + 1).alias("segment_index"), (F.col("_before") + F.col("i") + 1).cast("int").alias("progress_index"), "sentences")
