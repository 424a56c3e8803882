"""How queries reach the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.tables import NAMES, table

Query = Callable[[SparkSession, str], DataFrame]


def sql_query(text: str) -> Query:
    """A Spark SQL query over the tables as views."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in NAMES:
            if name in text:
                table(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(text)

    return run


class Family:
    """Collects queries and their SQL."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def same(self, name: str, text: str, duck: str | None = None) -> None:
        """A query in Spark SQL; DuckDB runs the same text or ``duck``."""
        self.queries[name], self.oracles[name] = sql_query(text), duck or text

    def frame(self, name: str, run: Query, duck: str | None = None) -> None:
        """A query of DataFrame operators, and its SQL where there is one."""
        self.queries[name] = run
        if duck:
            self.oracles[name] = duck
