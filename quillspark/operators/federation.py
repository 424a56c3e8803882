"""Fusing ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillspark.operators.ranking import ranked


class FederationError(ValueError):
    """Lists that must not be merged."""


def validate_lists(hits: DataFrame) -> None:
    """Every source has one generation, and hits are of their list's source (list_no, source_id, generation_id, hit_source)."""
    if hits.groupBy("source_id").agg(F.count_distinct("generation_id").alias("g")).where("g > 1").limit(1).count():
        raise FederationError("one source with several generations")
    if hits.where("source_id <> hit_source").limit(1).count():
        raise FederationError("a hit of another source")


def priority_concat(hits: DataFrame, group: str = "id", limit: int | None = None) -> DataFrame:
    """Groups in order of their first hit, by list and then rank: group, position, hits; the first ``limit``, or all."""
    groups = hits.groupBy(group).agg(F.min(F.struct("list_no", "rank")).alias("first"), F.count(F.lit(1)).alias("hits"))
    if limit is None:
        return ranked(groups, [F.col("first"), F.col(group)], "position").select(group, F.col("position").cast("int").alias("position"), "hits")
    first = groups.orderBy("first", group).limit(limit)
    return first.select(group, F.row_number().over(Window.orderBy("first", group)).cast("int").alias("position"), "hits")


def reciprocal_rank_fusion(hits: DataFrame, k: int = 60, weights: dict[int, float] | None = None, limit: int | None = None) -> DataFrame:
    """id, score, position: sum of weight / (k + rank), one hit a list for each id."""
    best = hits.groupBy("id", "list_no").agg(F.min("rank").alias("rank"))
    weight = F.lit(1.0)
    for number, value in (weights or {}).items():
        weight = F.when(F.col("list_no") == number, F.lit(float(value))).otherwise(weight)
    scored = best.groupBy("id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"))
    if limit is not None:
        scored = scored.orderBy(F.col("score").desc(), "id").limit(limit)
        return scored.withColumn("position", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).cast("int"))
    return ranked(scored, [F.col("score").desc(), F.col("id")], "position").withColumn("position", F.col("position").cast("int"))


def associations(evidence: DataFrame) -> DataFrame:
    """local, association, logical from ``evidence`` (local, logical, state).

    Any conflict, or more than one resolved logical identity, is a conflict.
    """
    resolved = F.collect_set(F.when(F.col("state") == "Resolved", F.col("logical")))
    grouped = evidence.groupBy("local").agg(F.bool_or(F.col("state") == "Conflict").alias("conflict"), resolved.alias("resolved"))
    state = F.when(F.col("conflict") | (F.size("resolved") > 1), "Conflict").when(F.size("resolved") == 1, "Unique").otherwise("None")
    return grouped.select("local", state.alias("association"), F.when(state == "Unique", F.element_at("resolved", 1)).alias("logical"))
