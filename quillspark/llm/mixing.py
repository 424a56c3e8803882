"""Mixing sources to target weights by temperature, in DataFrame operations only.

A source's weight is its share of tokens to the power of an exponent, and the
exponent is bisected: the flattest mix that keeps within a repetition limit or
reaches a target entropy.  The weights times a budget are realised in passes.
A document belongs to one block of its source for good.  A whole pass takes all
blocks of the source in a permutation of their numbers, another one each pass;
the last pass stops where the source's budget ends, between groups of blocks
first, then between blocks and then inside one block.  What decides about a
document is one row a source, so no source, however large, is ordered as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.operators.skew import column_of, hot_cold_join, numbered, renamed
from quillspark.scratch import materialize

MAX_REPEATS, BLOCK_ROWS, STEPS, SEED = 2.0, 1000, 1024, "mix"
#: Blocks of a permutation that are summed up before they are ordered.
GROUP_BLOCKS = 1000
#: Primes over any number of blocks: a multiple of one deals block numbers out anew without two meeting.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
#: A table of no more sources than this is broadcast; more are looked up by a skew-safe join.
FEW_SOURCES = 10_000


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def document_key(seed: str, doc_id: Column) -> Column:
    """Where a document stands in its source: its block and its place in that."""
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _number(key: Column, n_blocks: Column) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), n_blocks)


def permuted(seed: str, number: Column, source: Column, block: Column, n_blocks: Column) -> Column:
    """Place of ``block`` among the ``n_blocks`` of its source in pass ``number``: a bijection of block numbers."""
    def factor(which: Column) -> Column:
        return F.pmod(F.element_at(F.array(*(F.lit(p).cast("long") for p in PRIMES)), (F.pmod(which, F.lit(len(PRIMES))) + 1).cast("int")), n_blocks)

    by = F.pmod(factor(number) * factor(F.floor(number / len(PRIMES))), n_blocks)
    start = _number(F.md5(F.concat(F.lit(seed + "|"), number.cast("string"), F.lit("|"), source)), n_blocks)
    return F.pmod(block * by + start, n_blocks)


def _outcome(sources: DataFrame, exponent: float, budget: float | None):
    """(repeats of the most repeated source, entropy, sum of powers, budget) at ``exponent``."""
    power = F.pow("share", F.lit(exponent))
    r = sources.agg(F.sum(power).alias("z"), F.max(F.col("tokens") / power).alias("whole"), F.max(power / F.col("tokens")).alias("most"), F.sum(power * F.log(power)).alias("plogp")).first()
    total = budget if budget is not None else r["whole"] * r["z"]
    return r["most"] / r["z"] * total, math.log(r["z"]) - r["plogp"] / r["z"], r["z"], total


def choose_exponent(sources: DataFrame, budget: float | None, max_repeats: float | None, entropy: float | None, steps: int = STEPS) -> float:
    """A multiple of 1 / ``steps`` in [0, 1], by bisection: each try is one aggregate over the sources.

    With ``max_repeats`` the least exponent whose sources repeat no more often,
    with ``entropy`` (nats) the greatest that is as even; 1, the shares
    themselves, where the limit cannot be met, 0 where the entropy cannot.
    """
    low, high = 0, steps
    while low < high:
        at = (low + high) // 2 if max_repeats is not None else (low + high + 1) // 2
        repeats, even, _, _ = _outcome(sources, at / steps, budget)
        if max_repeats is not None:
            low, high = (low, at) if repeats <= max_repeats + 1e-9 else (at + 1, high)
        else:
            low, high = (at, high) if even >= entropy - 1e-9 else (low, at - 1)
    return low / steps


def temperature_mix(docs: DataFrame, source_col: str = "source", budget: float | None = None, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, block_rows: int = BLOCK_ROWS, seed: str = SEED) -> DataFrame:
    """Rows of ``docs`` (with doc_id and text) as often as the mix has them.

    Adds ``mx_pass`` (from 0), ``mx_block`` (in that pass's permutation) and
    ``mx_position`` (0 to 1, by which the sources interleave).  ``budget`` is in
    words; without one it is the least that gives every source a whole pass, so
    no document is lost.  A null source is a source of its own.  Sources without
    words have one pass.  Rows repeated with one id stand at one place, in or
    out together; null ids share a place.  Empty tables give empty results;
    other columns pass through; ``mx_`` columns of the input are replaced.
    """
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give max_repeats or entropy")
    docs, names = numbered(docs, ("mx_pass", "mx_block", "mx_position"))
    doc_id, text = column_of(names, "doc_id"), column_of(names, "text")
    source = F.coalesce(F.concat(F.lit("="), column_of(names, source_col).cast("string")), F.lit("null"))
    rows = materialize(docs.select(source.alias("mx_source"), document_key(seed, doc_id).alias("key"), n_words(text).alias("tokens")), "mix-rows")
    sources = rows.groupBy("mx_source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("mx_rows"))
    sources = materialize(sources, "mix-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    spoken = sources.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(total or 1)))
    if total:
        exponent = choose_exponent(spoken, budget, max_repeats, entropy)
        _, _, z, full = _outcome(spoken, exponent, budget)
    else:
        exponent, z, full = 1.0, 1.0, 0.0
    quota = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(exponent)) / F.lit(float(z)) * F.lit(float(full))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens") + 1e-9)).otherwise(F.lit(1))
    plan = sources.withColumn("quota", quota).withColumn("mx_passes", passes.cast("long"))
    plan = plan.withColumn("rest", F.when(F.col("tokens") > 0, F.greatest(F.lit(0).cast("long"), F.floor(F.col("quota") - F.col("mx_passes") * F.col("tokens") + 1e-6))).otherwise(F.lit(0).cast("long")))
    plan = plan.select("mx_source", "tokens", "mx_rows", "mx_passes", "rest", F.ceil(F.col("mx_rows") / block_rows).cast("long").alias("mx_blocks"))
    plan = materialize(plan, "mix-plan")
    # The last, partial pass: whole groups of blocks in order, then whole blocks, then documents of the block where the budget ends.
    last = _with_plan(rows, plan).where("rest > 0").withColumn("place", permuted(seed, F.col("mx_passes"), F.col("mx_source"), _number(F.col("key"), F.col("mx_blocks")), F.col("mx_blocks")))
    blocks = materialize(last.groupBy("mx_source", "place").agg(F.sum("tokens").alias("b"), F.max("rest").alias("rest")).withColumn("group", F.floor(F.col("place") / GROUP_BLOCKS)), "mix-blocks")
    groups = blocks.groupBy("mx_source", "group").agg(F.sum("b").alias("g"), F.max("rest").alias("rest"))
    groups = groups.withColumn("after", F.sum("g").over(Window.partitionBy("mx_source").orderBy("group")))
    groups = groups.where("after > rest").groupBy("mx_source").agg(F.min("group").alias("group"), F.min(F.col("after") - F.col("g")).alias("before"))
    # No more than ``GROUP_BLOCKS`` blocks a source.
    ordered = blocks.join(groups, ["mx_source", "group"]).withColumn("after", F.col("before") + F.sum("b").over(Window.partitionBy("mx_source").orderBy("place")))
    cut = ordered.where("after > rest").groupBy("mx_source").agg(F.min("place").alias("mx_cut"), F.min(F.col("after") - F.col("b")).alias("whole"))
    cut = materialize(plan.join(cut, "mx_source", "left"), "mix-cuts")
    inside = _with_plan(rows, cut.drop("tokens")).where(permuted(seed, F.col("mx_passes"), F.col("mx_source"), _number(F.col("key"), F.col("mx_blocks")), F.col("mx_blocks")) == F.col("mx_cut"))
    # About ``block_rows`` keys a source; documents at one place come together.
    inside = inside.groupBy("mx_source", "key").agg(F.sum("tokens").alias("tokens"), F.max("whole").alias("whole"), F.max("rest").alias("rest"))
    inside = inside.withColumn("after", F.sum("tokens").over(Window.partitionBy("mx_source").orderBy("key")))
    ends = inside.where(F.col("whole") + F.col("after") <= F.col("rest")).groupBy("mx_source").agg(F.max("key").alias("mx_until"))
    decided = materialize(cut.join(ends, "mx_source", "left").select("mx_source", "mx_rows", "mx_passes", "mx_blocks", "mx_cut", "mx_until", (F.col("mx_passes") + F.when(F.col("tokens") > 0, F.col("rest") / F.col("tokens")).otherwise(F.lit(0.0))).alias("mx_repeats")), "mix-decided")
    out = _with_plan(docs.withColumns({"mx_source": source, "mx_key": document_key(seed, doc_id)}), decided).withColumn("mx_own", _number(F.col("mx_key"), F.col("mx_blocks")))
    at = permuted(seed, F.col("mx_passes"), F.col("mx_source"), F.col("mx_own"), F.col("mx_blocks"))
    more = (at < F.col("mx_cut")) | ((at == F.col("mx_cut")) & (F.col("mx_key") <= F.col("mx_until")))
    times = F.col("mx_passes") + F.when(F.coalesce(more, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    out = out.withColumn("mx_times", times).where("mx_times > 0").withColumn("mx_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mx_times") - 1)))
    out = out.withColumn("mx_block", permuted(seed, F.col("mx_pass"), F.col("mx_source"), F.col("mx_own"), F.col("mx_blocks")))
    out = out.withColumn("mx_position", (F.col("mx_pass") + (F.col("mx_block") + 0.5) / F.col("mx_blocks")) / F.ceil(F.col("mx_repeats")))
    return out.select(*renamed(names), "mx_pass", "mx_block", "mx_position")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row with its source's decisions; ``plan`` is a written table with one row a source."""
    values = [c for c in plan.columns if c not in ("mx_source", "tokens")]
    plan = plan.select("mx_source", *values)
    if plan.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        return rows.join(F.broadcast(plan), "mx_source")
    return hot_cold_join(rows, plan, ["mx_source"], "mx_rows", F.monotonically_increasing_id())
