"""Texts that contain given passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Words of an anchor: the passage's words from the second on, which a text that holds the passage holds whole.
ANCHOR = 5


def _words(text: Column) -> Column:
    return F.split(text, "[ \\t\\n\\r]+")


def containing(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (item_id, doc_id) of passages (item_id, text) that stand in texts (doc_id, text), character by character.

    Pairs that share the passage's anchor are met by an equality join on its hash
    and then tested.  Passages of fewer than ``ANCHOR + 2`` words have no anchor
    and are tested against each text.
    """
    items = passages.select("item_id", F.col("text").alias("passage"), _words(F.col("text")).alias("w")).where("passage is not null")
    long = items.where(F.size("w") >= ANCHOR + 2).select("item_id", "passage", F.xxhash64(F.slice("w", 2, ANCHOR)).alias("anchor"))
    short = items.where(F.size("w") < ANCHOR + 2).select("item_id", "passage")
    words = texts.select("doc_id", "text", _words(F.col("text")).alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - ANCHOR + 1), lambda i: F.xxhash64(F.slice("w", i, F.lit(ANCHOR))))
    met = words.where(F.size("w") >= ANCHOR).select("doc_id", F.explode(F.array_distinct(grams)).alias("anchor")).join(long.select("item_id", "anchor"), "anchor").select("item_id", "doc_id").distinct()
    tested = met.join(long.select("item_id", "passage"), "item_id").join(texts.select("doc_id", "text"), "doc_id")
    rest = short.join(texts.select("doc_id", "text"), F.contains(F.col("text"), F.col("passage")))
    return tested.where(F.contains(F.col("text"), F.col("passage"))).select("item_id", "doc_id").union(rest.select("item_id", "doc_id")).distinct()
