"""Exact dedup by skew-safe combining, in DataFrame operations only.

Equal texts are found in three steps that each compare the whole normalised
text, never a digest alone:

1. *local*: rows of one input partition share a salt, so the map side of the
   first aggregation merges equal texts before anything moves;
2. *salted*: the shuffle deals by (digest, salt, text), so a text that holds a
   third of all rows is merged in many tasks;
3. *global*: one row per text and salt is left, and these winners are combined.

Documents then look their group up.  The largest groups are broadcast (a fixed
number of them), which leaves no key with many rows for the shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.operators.skew import column_of, hot_cold_join, numbered, renamed
from quillspark.scratch import materialize

WHITE_SPACE = " \t\n\x0b\x0c\r"
SALTS = 64
#: Room for an inverted 64-bit id below the number of code points.
_ID_ROOM = 2**65


def normalised(text: Column) -> Column:
    """The text without the characters 0x20 and 0x09 to 0x0D; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _order(n_chars: Column, doc_id: Column) -> Column:
    """Larger for more code points, then for smaller ids; null ids come last."""
    inverted = F.when(doc_id.isNull(), F.lit(0).cast("decimal(20,0)")).otherwise(F.lit(str(2**63)).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"))
    return (n_chars.cast("decimal(10,0)") * F.lit(str(_ID_ROOM)).cast("decimal(20,0)")).cast("decimal(38,0)") + inverted.cast("decimal(38,0)")


def _id_of(order: Column) -> Column:
    low = order % F.lit(str(_ID_ROOM)).cast("decimal(38,0)")
    return F.when(low > 0, (F.lit(str(2**63)).cast("decimal(38,0)") - low).cast("long"))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", salts: int = SALTS, digest=sha256_digest) -> DataFrame:
    """Every row of ``docs`` with its group of equal texts.

    Adds ``dd_digest`` (of the normalised text), ``dd_keep_id``,
    ``dd_group_size`` and ``dd_kept``.  Of equal texts the row with the most code
    points in its original text stays, then the one with the smallest id.

    Null texts count as empty, and all empty texts are one group.  Null ids lose
    ties; where all rows of a group have one, its ``dd_keep_id`` is null and they
    are kept.  Rows repeated with the same id and text share one verdict.  An
    empty table gives an empty result.  Other columns pass through, whatever
    their names; ``dd_`` columns of the input are replaced.
    """
    docs, names = numbered(docs, ("dd_digest", "dd_keep_id", "dd_group_size", "dd_kept"))
    text, doc_id = column_of(names, text_col), column_of(names, id_col)
    norm = normalised(text)
    keys = docs.select(norm.alias("norm"), doc_id.alias("id"), F.length(F.coalesce(text, F.lit(""))).alias("n_chars"))
    # The second digest only tells texts of one group key apart when rows look their group up.
    keys = keys.select("norm", digest(F.col("norm")).alias("d"), F.sha2("norm", 512).alias("w"), _order(F.col("n_chars"), F.col("id")).alias("o"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = keys.groupBy("d", "w", "norm", "salt").agg(F.count(F.lit(1)).alias("n"), F.max("o").alias("o"))
    # Dealt by digest, so that the next aggregations need no further exchange.
    merged = salted.repartition(F.col("d")).groupBy("d", "w", "norm").agg(F.sum("n").alias("n"), F.max("o").alias("o"))
    groups = merged.groupBy("d", "w").agg(F.sum("n").alias("n"), F.max("o").alias("o"), F.count(F.lit(1)).alias("texts"))
    # Groups of one row need no lookup: they keep themselves.
    groups = groups.where((F.col("n") > 1) | (F.col("texts") > 1)).select("d", "w", F.when(F.col("texts") == 1, _id_of(F.col("o"))).otherwise(F.raise_error(F.lit("two texts share SHA-256 and SHA-512"))).alias("keep"), "n")
    groups = materialize(groups, "exact-dedup")
    rows = docs.withColumn("norm", norm).withColumns({"d": digest(F.col("norm")), "w": F.sha2("norm", 512)}).drop("norm")
    found = hot_cold_join(rows, groups, ["d", "w"], "n", doc_id)
    alone = F.col("n").isNull()
    return found.select(
        *renamed(names),
        F.col("d").alias("dd_digest"),
        F.when(alone, doc_id).otherwise(F.col("keep")).alias("dd_keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("dd_group_size"),
        (alone | doc_id.eqNullSafe(F.col("keep"))).alias("dd_kept"),
    )
