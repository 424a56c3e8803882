"""Positions and neighbours in a total order, without a window over a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.scratch import materialize

_PART, _ROW = "rk_part", "rk_row"


def _ordered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` dealt into ranges of ``order``, sorted in each, written with the range's number and the row's place in it.

    The table is written before places are counted, so a task that runs again
    after its executor was lost can't shift them.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    return materialize(dealt.select("*", F.shiftright(number, 33).alias(_PART), number.bitwiseAND(F.lit((1 << 33) - 1)).alias(_ROW)), "ordered")


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's position (long, from 1) in ``order``; rows that ``order`` ties stand in any order.

    Only one count for each range is brought together in one task.  Columns named
    ``name``, ``rk_part`` or ``rk_row`` are replaced or lost.
    """
    rows = _ordered(df.drop(name, _PART, _ROW), order)
    counts = rows.groupBy(_PART).agg(F.count(F.lit(1)).alias("rk_n"))
    before = F.sum("rk_n").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(_PART), F.coalesce(before, F.lit(0)).alias("rk_before"))
    return rows.join(F.broadcast(offsets), _PART).select(*[c for c in rows.columns if c not in (_PART, _ROW)], (F.col("rk_before") + F.col(_ROW) + 1).alias(name))


def previous(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """``df`` with ``value`` of the row before, in ``order``; null for the first row.

    A range's first row takes the last value of the range before, of which there
    is one for each range.
    """
    rows = _ordered(df.drop(name, _PART, _ROW), order)
    lasts = rows.groupBy(_PART).agg(F.max_by(F.struct(value), _ROW).alias("rk_last"))
    edges = lasts.select(F.col(_PART), F.lag("rk_last").over(Window.orderBy(_PART)).alias("rk_edge"))
    inside = F.lag(F.struct(value)).over(Window.partitionBy(_PART).orderBy(_ROW))
    both = rows.withColumn("rk_inside", inside).join(F.broadcast(edges), _PART)
    found = F.when(F.col(_ROW) == 0, F.col("rk_edge")).otherwise(F.col("rk_inside"))[value]
    return both.select(*[c for c in rows.columns if c not in (_PART, _ROW)], found.alias(name))


def order_statistics(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """group, mean, and for each name in ``shares`` the value at place floor(share * n), at most n - 1, of the group's n values in order.

    Values are ranked in ranges of (group, value), so no group is gathered in one task.
    """
    rows = ranked(df.select(F.col(group).alias("g"), F.col(value).alias("v")).where("v is not null"), [F.col("g"), F.col("v")], "at")
    sizes = rows.groupBy("g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    picks = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col("first") + F.least(F.col("n") - 1, F.floor(F.lit(s) * F.col("n")).cast("long"))).alias("at")) for k, s in shares.items())))
    wanted = sizes.select("g", "mean", picks.alias("p")).select("g", "mean", "p.k", "p.at")
    found = rows.select("at", "v").join(wanted, "at")
    return found.groupBy(F.col("g").alias(group)).agg(F.max("mean").alias("mean"), *(F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in shares))
