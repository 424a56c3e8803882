"""Joins that stay even when one key holds a large part of the rows, and columns of any name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

HOT_KEYS = 1000
SALTS = 4096
#: Words of 64 bits that ``possible`` broadcasts at most.
WORDS = 1 << 19


def numbered(df: DataFrame, replaced: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, … and the names they stand for, without those in ``replaced``.

    Operators work on numbered columns, so no name of their own can clash with one of the input's, whatever
    characters it holds.  Names are compared as Spark does, in either case.
    """
    drop = {name.lower() for name in replaced}
    names = {f"c{i}": name for i, name in enumerate(df.columns) if name.lower() not in drop}
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*names), names


def column_of(names: dict[str, str], name: str) -> Column:
    """The numbered column that stands for ``name``; an exact match comes before one in another case."""
    found = [c for c, n in names.items() if n == name] or [c for c, n in names.items() if n.lower() == name.lower()]
    if not found:
        raise ValueError(f"no column {name!r} among {list(names.values())}")
    return F.col(found[0])


def renamed(names: dict[str, str]) -> list[Column]:
    """Numbered columns under their own names again."""
    return [F.col(c).alias(name) for c, name in names.items()]


def hot_cold_join(left: DataFrame, dim: DataFrame, keys: list[str], weight: str, spread: Column, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Left join of ``left`` with ``dim``, which has one row per key.

    ``weight`` is a column of ``dim``: how many rows of ``left`` have the key.
    The ``hot_keys`` keys of largest weight are broadcast, a bound that holds at
    every size; any other key then has fewer than 1 / ``hot_keys`` of the rows,
    so the shuffle join that looks the rest up is even.  Rows found in the first
    step go through the second spread by ``spread`` under a key that matches
    nothing.  ``dim`` should be a written table: it is read twice.  Columns may
    have any names; a value of ``dim`` that has a name of ``left`` comes after it.
    """
    values = [c for c in dim.columns if c not in keys]
    at = {c: f"l{i}" for i, c in enumerate(left.columns)}
    rows = left.select("*", F.pmod(F.xxhash64(spread), F.lit(SALTS)).alias("spread")).toDF(*(f"l{i}" for i in range(len(left.columns))), "l_spread")
    dim = dim.select(*keys, weight, *values).toDF(*(f"k{i}" for i in range(len(keys))), "weight", *(f"v{i}" for i in range(len(values))))
    hot = dim.orderBy(F.col("weight").desc(), *(f"k{i}" for i in range(len(keys)))).limit(hot_keys)
    hot = hot.select(*(F.col(f"k{i}").alias(f"h{i}") for i in range(len(keys))), *(F.col(f"v{i}").alias(f"hv{i}") for i in range(len(values))), F.lit(True).alias("hot"))
    on = reduce(lambda a, b: a & b, (F.col(at[k]).eqNullSafe(F.col(f"h{i}")) for i, k in enumerate(keys)))
    step = rows.join(F.broadcast(hot), on, "left")
    step = step.withColumns({f"s{i}": F.when(F.col("hot").isNull(), F.col(at[k])) for i, k in enumerate(keys)} | {"salt": F.when(F.col("hot"), F.col("l_spread") + 1).otherwise(F.lit(0).cast("long"))})
    cold = dim.drop("weight").withColumn("no_salt", F.lit(0).cast("long"))
    on = reduce(lambda a, b: a & b, (F.col(f"s{i}") == F.col(f"k{i}") for i in range(len(keys)))) & (F.col("salt") == F.col("no_salt"))
    out = step.join(cold, on, "left")
    return out.select(*(F.col(f"l{i}").alias(c) for i, c in enumerate(left.columns)), *(F.when(F.col("hot"), F.col(f"hv{i}")).otherwise(F.col(f"v{i}")).alias(v) for i, v in enumerate(values)))


def distinct_not_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """``SELECT DISTINCT key FROM left WHERE key NOT IN (SELECT key FROM right)``, for tables of one column.

    Spark broadcasts all of ``right`` for NOT IN, as a null decides over every
    row.  Here distinct keys are joined, and one row of counts says what nulls
    do: any in ``right`` leaves nothing, and a null of ``left`` stays only where
    ``right`` is empty.
    """
    left, right = left.toDF("key").distinct(), right.toDF("key")
    nulls = right.agg(F.count(F.lit(1)).alias("n"), F.count("key").alias("n_known"))
    kept = left.join(right.distinct(), "key", "left_anti").crossJoin(F.broadcast(nulls))
    return kept.where((F.col("n") == 0) | ((F.col("n") == F.col("n_known")) & F.col("key").isNotNull())).select("key")


def possible(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``names`` are not among ``keys``; none that is among them goes.

    One bit for each key's hash is broadcast, in ``WORDS`` words at most however
    many keys there are; an exact join has to follow.  As a semi-join it moves
    below unions and DISTINCT, so what is left out is neither moved nor sorted.
    ``keys`` should be a written table: it is read once more.
    """
    mark = F.xxhash64(*(F.col(name).cast("string") for name in names))
    word, bit = F.shiftrightunsigned(mark, 6).bitwiseAND(F.lit(WORDS - 1)), mark.bitwiseAND(F.lit(63)).cast("int")
    words = keys.select(word.alias("possible_word"), bit.alias("bit")).groupBy("possible_word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("possible_bits"))
    return rows.join(F.broadcast(words), (word == F.col("possible_word")) & (F.getbit("possible_bits", bit) == 1), "left_semi")
