"""Revision pairs derived from the driver's tables.

A document is a block of a `source`, a page is a row of `documents`: the ids of a block
are BLOCK neighbouring ones, so a document has at most BLOCK pages however large the table
or a source is, and documents are what everything here is grouped by. The newer revision
drops, edits, moves and inserts pages by fixed integer rules, so any engine derives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: page size in points, and the font grid on which words are laid out
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
CHAR_WIDTH, LINE_HEIGHT, FONT_SIZE = 6.0, 14.0, 10.0
#: Neighbouring ids that make up one document of a source.
BLOCK = 1000
#: An item of text: up to four words with what stands between them.
PHRASE = "[^ ]+( +[^ ]+){0,3} *"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def revision_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, side, page_number, text): both revisions of every document.

    Numbering pages needs a document's rows together: at most BLOCK rows and what is
    inserted into them.
    """
    docs = table(spark, sf_dir, "documents").where("source is not null and doc_id is not null")
    docs = docs.withColumn("pair_id", F.expr(f"concat(source, '/', doc_id div {BLOCK})"))
    text = F.expr("case when doc_id % 29 = 11 then repeat(char(1), 40) else coalesce(text, '') end")
    earlier = docs.select(
        "pair_id",
        F.lit("earlier").alias("side"),
        F.row_number().over(Window.partitionBy("pair_id").orderBy("doc_id")).alias("page_number"),
        text.alias("text"),
    )
    edited = F.expr(
        "case when doc_id % 29 = 11 then repeat(char(1), 40)"
        " when doc_id % 13 = 5 then 'amended ' || coalesce(text, '') || ' revision clause'"
        " else coalesce(text, '') end"
    )
    kept = docs.where("doc_id % 17 != 3").select(
        "pair_id",
        edited.alias("text"),
        F.expr("doc_id + case when doc_id % 19 = 7 then 1000000000 else 0 end").alias("sort_key"),
        F.lit(0).alias("inserted"),
    )
    inserted = (
        table(spark, sf_dir, "benchmark")
        .where("item_id % 2 = 0")
        .select(
            F.expr(f"concat('src', item_id % 20, '/', item_id div {BLOCK})").alias("pair_id"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.col("item_id").alias("sort_key"),
            F.lit(1).alias("inserted"),
        )
    )
    order = Window.partitionBy("pair_id").orderBy("sort_key", "inserted")
    newer = kept.unionByName(inserted).select(
        "pair_id", F.lit("newer").alias("side"), F.row_number().over(order).alias("page_number"), "text"
    )
    return earlier.unionByName(newer)


def text_items(pages: DataFrame) -> DataFrame:
    """One positioned item for each phrase: one at column c of line r stands at (6c, 14r).

    Every 31st item is rotated: its quad runs down the page.
    """
    lines = pages.select(
        "pair_id", "side", "page_number", F.posexplode(F.split("text", "\n")).alias("line", "words")
    )
    words = F.regexp_extract_all("words", F.lit(PHRASE), F.lit(0))
    lead = F.length("words") - F.length(F.ltrim("words"))
    parted = lines.select("pair_id", "side", "page_number", "line", lead.alias("lead"), F.posexplode(words).alias("k", "w"))
    before = Window.partitionBy("pair_id", "side", "page_number", "line").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    column = F.col("lead") + F.coalesce(F.sum(F.length("w")).over(before), F.lit(0))
    placed = parted.select("pair_id", "side", "page_number", "line", "k", "w", column.alias("c"))
    order = Window.partitionBy("pair_id", "side", "page_number").orderBy("line", "k")
    numbered = placed.select(
        "pair_id", "side", "page_number", "line",
        (F.row_number().over(order) - 1).alias("item_index"),
        F.rtrim("w").alias("str"),
        (F.col("c") * CHAR_WIDTH).alias("x"),
        (F.col("line") * LINE_HEIGHT).alias("y"),
    )
    rotated = F.col("item_index") % 31 == 7
    along = F.length("str") * CHAR_WIDTH
    return numbered.select(
        "*",
        F.when(rotated, F.lit(FONT_SIZE)).otherwise(along).alias("width"),
        F.when(rotated, along).otherwise(F.lit(FONT_SIZE)).alias("height"),
        F.lit(FONT_SIZE).alias("font_size"),
        rotated.alias("rotated"),
    )
