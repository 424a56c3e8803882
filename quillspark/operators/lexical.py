"""Tiered lexical retrieval, and body retrieval over units from an index or without one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions.text import normalize_exact, normalize_newlines, tokenize
from quillspark.scratch import materialize, scratch_path
from quillspark.tables import spread

K1, B = 1.2, 0.75


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per non-empty line: doc_id, line (from 0), text."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(normalize_newlines(F.col(text_col)), "\n", -1)).alias("line", "text"))
    return lines.where(F.length("text") > 0)


def required_tokens(n: int) -> int:
    """All of up to two tokens, three fifths of more, rounded up."""
    return n if n <= 2 else (3 * n + 4) // 5


def query_tokens(spark, query: str) -> list[str]:
    """Distinct tokens of a query, as the analyzer cuts it."""
    return list(dict.fromkeys(spark.range(1).select(tokenize(F.lit(query)).alias("t")).first()["t"]))


def _times(tokens: str, token: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == token))


def body_search(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """Documents by their best unit: unit with the literal query first, then BM25, then the earlier unit.

    A unit matches with at least ``required_tokens`` distinct query tokens.
    Texts are tokenised in one pass, which writes each unit's length and counts of
    the query's tokens; statistics and scores are taken from these, and nothing
    but matching units is shuffled.
    Columns: doc_id, line, literal, score, rank.  A query without tokens finds nothing.
    """
    spark = docs.sparkSession
    tokens = query_tokens(spark, query)
    if not tokens:
        return docs.sparkSession.createDataFrame([], "doc_id long, line int, literal boolean, score double, rank int")
    cut = units(docs).withColumn("tokens", tokenize(F.col("text")))
    counts = [_times("tokens", q).alias(f"tf{i}") for i, q in enumerate(tokens)]
    rows = cut.select("doc_id", "line", F.contains(F.col("text"), F.lit(query)).alias("literal"), F.size("tokens").alias("n"), *counts)
    rows = materialize(rows, "unit-counts")
    stats = rows.agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("total"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(tokens))))
    s = stats.first()  # one row
    dfs = [s[f"df{i}"] for i in range(len(tokens))]
    found = _matching(rows, s["units"], s["total"], dfs).select("doc_id", "line", "literal", "score")
    return _best_documents(found, limit)


def _matching(rows: DataFrame, units: int, total: int | None, dfs: list[int]) -> DataFrame:
    """Rows (n, tf0, tf1, ...) with enough of the query's tokens, and their BM25 score."""
    average = (total or 0) / max(1, units)
    score: Column = F.lit(0.0)
    for i, df in enumerate(dfs):
        idf = F.log(F.lit(1 + (units - df + 0.5) / (df + 0.5)))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.lit(average)))
    share = sum((F.when(F.col(f"tf{i}") > 0, 1).otherwise(0) for i in range(len(dfs))), F.lit(0))
    return rows.where(share >= required_tokens(len(dfs))).withColumn("score", F.round(score, 6))


def _best_documents(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` documents by their best unit (doc_id, line, literal, score)."""
    order = [F.col("literal").desc(), F.col("score").desc(), "line"]
    best = found.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where("rn = 1").drop("rn")
    top = best.orderBy(F.col("literal").desc(), F.col("score").desc(), "doc_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("literal").desc(), F.col("score").desc(), "doc_id")).cast("int"))


@dataclass(frozen=True)
class Index:
    """A generation of the index: units (unit, doc_id, line, text, n), postings (token, unit, tf, n) and totals (units, total) below ``path``.

    Postings are written in ranges of (token, unit), so that a query's tokens are
    found by the row groups' bounds and a frequent token spreads over many files.
    """

    path: str


def build_index(docs: DataFrame, path: str | None = None) -> Index:
    """Cut all texts into tokens once; ``path`` is a new folder, by default in the scratch folder."""
    path = path or scratch_path(docs.sparkSession, "lexical-index")
    spark = docs.sparkSession
    cut = units(spread(docs)).withColumn("tokens", tokenize(F.col("text")))
    cut.select(F.monotonically_increasing_id().alias("unit"), "doc_id", "line", "text", "tokens", F.size("tokens").alias("n")).write.parquet(f"{path}/units")
    rows = spark.read.parquet(f"{path}/units")
    postings = rows.select("unit", "n", F.explode("tokens").alias("token")).groupBy("token", "unit").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("n").alias("n"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings.repartitionByRange(ranges, "token", "unit").sortWithinPartitions("token", "unit").write.option("parquet.block.size", 16 << 20).parquet(f"{path}/postings")
    rows.agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("total")).write.parquet(f"{path}/totals")
    return Index(path)


def search_index(spark, index: Index, query: str, limit: int) -> DataFrame:
    """The rows of :func:`body_search`, from the postings of the query's tokens and the texts of units that match."""
    tokens = query_tokens(spark, query)
    if not tokens:
        return spark.createDataFrame([], "doc_id long, line int, literal boolean, score double, rank int")
    postings = spark.read.parquet(f"{index.path}/postings").where(F.col("token").isin(tokens))
    totals = spark.read.parquet(f"{index.path}/totals").first()  # one row
    known = {r["token"]: r["count"] for r in postings.groupBy("token").count().collect()}  # a row for each token of the query
    counts = [F.coalesce(F.max(F.when(F.col("token") == q, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, q in enumerate(tokens)]
    rows = postings.groupBy("unit").agg(F.first("n").alias("n"), *counts)
    matching = _matching(rows, totals["units"], totals["total"], [known.get(q, 0) for q in tokens]).select("unit", "score")
    texts = spark.read.parquet(f"{index.path}/units").select("unit", "doc_id", "line", F.contains(F.col("text"), F.lit(query)).alias("literal"))
    return _best_documents(matching.join(texts, "unit").select("doc_id", "line", "literal", "score"), limit)


#: Signals in order: field, and whether the whole field must equal the query.
TIERS = [("canonical_name", True), ("aliases", True), ("title", True), ("canonical_name", False), ("aliases", False), ("title", False), ("high_signal", False), ("body", False)]


def tiered_search(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """Documents by the first tier that matches: id, tier (from 1), rank.

    ``docs`` has id and any of the fields of ``TIERS``; a phrase matches where
    the query's tokens stand next to each other in the field's tokens.
    """
    spark = docs.sparkSession
    tokens = query_tokens(spark, query)
    phrase = " " + " ".join(tokens) + " "
    exact = normalize_exact(F.lit(query))
    tests = []
    for tier, (field, whole) in enumerate(TIERS, 1):
        if field in docs.columns:
            hit = normalize_exact(F.col(field)) == exact if whole else F.lit(bool(tokens)) & F.contains(F.concat(F.lit(" "), F.array_join(tokenize(F.col(field)), " "), F.lit(" ")), F.lit(phrase))
            tests.append(F.when(hit, F.lit(tier)))
    found = docs.select("id", F.coalesce(*tests).alias("tier")).where("tier is not null")
    top = found.orderBy("tier", "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("tier", "id")).cast("int"))
