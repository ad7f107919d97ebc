"""Comparison rows by fixed rules over position-paired revisions.

They stand in for the results of a whole comparison where a query is about reporting,
review or scoring, so that it does not depend on the order-sensitive operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revdelta.functions import text as X
from revdelta.operators import alignment
from revdelta.sources.revisions import revision_pages

#: The rules, in SQL that any engine reads. `e` and `n` are the page numbers, 0 if absent.
RULES = {
    "e": "coalesce(earlier_page, 0)",
    "n": "coalesce(newer_page, 0)",
    "alignment": "case when kind = 'matched' and idx % 11 = 4 then 'moved' else kind end",
    "status": "case when kind != 'matched' then kind when similarity = 1 and idx % 5 != 2 then 'same' else 'changed' end",
    "changed_percent": "case when idx % 7 = 6 then null else (idx * 37 % 1000) / 8.0 end",
    "noticeable": "idx % 3 != 1",
    "content": "idx % 4",
    "reflow": "idx % 3",
    "formatting": "idx % 2",
    "graphic": "(idx + 1) % 3",
    "n_changes": "case when kind = 'matched' and similarity = 1 and idx % 5 != 2 then 0 else idx % 4 end",
}


def comparison_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, idx, earlier_page, newer_page, alignment, status, similarity, ...)."""
    pages = revision_pages(spark, sf_dir)
    paired = alignment.by_position(alignment.fingerprints(pages))
    readable = pages.select(
        "pair_id", "side", "page_number", (F.length("text") > 0).alias("has_text"), X.is_decodable(F.col("text")).alias("ok")
    )
    side = lambda s, page: readable.where(F.col("side") == s).select(
        "pair_id", F.col("page_number").alias(page), F.col("has_text").alias(f"{s}_text"), F.col("ok").alias(f"{s}_ok")
    )
    rows = paired.join(side("earlier", "earlier_page"), ["pair_id", "earlier_page"], "left")
    rows = rows.join(side("newer", "newer_page"), ["pair_id", "newer_page"], "left")
    ok = F.coalesce("earlier_ok", F.lit(True)) & F.coalesce("newer_ok", F.lit(True))
    text = F.coalesce("earlier_text", F.lit(False)) | F.coalesce("newer_text", F.lit(False))
    return rows.select(
        "pair_id", "idx", "earlier_page", "newer_page", "kind", "similarity",
        *[F.expr(sql).alias(name) for name, sql in RULES.items() if name not in ("e", "n")],
        (text & ok).alias("has_text"), (~ok).alias("text_unreadable"),
    )


#: The rule for a row's text changes, numbered from 1.
CHANGE_RULES = {
    "kind": "case (idx + seq) % 3 when 0 then 'added' when 1 then 'removed' else 'changed' end",
    "before": "case (idx + seq) % 3 when 0 then '' when 1 then 'old, ' || idx else 'say \"' || seq || '\"' end",
    "after": "case (idx + seq) % 3 when 0 then 'new ' || idx when 1 then '' else 'told\n' || seq end",
}


def change_rows(rows: DataFrame) -> DataFrame:
    """(pair_id, idx, seq, kind, before, after): the text changes of comparison rows."""
    seqs = F.explode(F.when(F.col("n_changes") > 0, F.sequence(F.lit(1), F.col("n_changes").cast("int"))))
    numbered = rows.select("pair_id", "idx", seqs.alias("seq"))
    return numbered.select("pair_id", "idx", "seq", *[F.expr(sql).alias(name) for name, sql in CHANGE_RULES.items()])
