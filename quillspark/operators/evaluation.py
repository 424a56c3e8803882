"""Evaluation statistics whose work stays near-linear where a plain expression's grows with a square."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F


def sign_test(wins: int, n: int) -> float:
    """Two-sided p of ``wins`` of ``n`` under even odds.

    Each term of the binomial tail is the one above it times a ratio, so one
    logarithm of a binomial and one pass over the tail give the whole sum.
    """
    low, tail = min(wins, n - wins), 1.0
    for k in range(1, low + 1):
        tail = 1.0 + tail * k / (n - k + 1)
    top = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) - n * math.log(2)
    return min(1.0, 2 * math.exp(top + math.log(tail)))


def sign_tests(counts: DataFrame, group: str) -> DataFrame:
    """``counts`` (``group``, wins, n: long) with p, rounded to six places."""
    def run(batches: Iterable):
        import pyarrow as pa

        for batch in batches:
            values = [sign_test(w, n) for w, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, "p"])

    counts = counts.select(group, "wins", "n")
    out = counts.mapInArrow(run, f"`{group}` {counts.schema[group].dataType.simpleString()}, wins long, n long, p double")
    return out.withColumn("p", F.round("p", 6))
