"""Queries over whole tables, against counts by plain Python."""

from collections import Counter

import duckdb
import numpy as np
import pytest

from quillspark import catalog
from quillspark.operators import graph
from quillspark.plans import documents
from quillspark.tables import table


def _supplies(lines: set) -> Counter:
    of_part: dict = {}
    for _, part, supplier in lines:
        of_part.setdefault(part, []).append(supplier)
    return Counter((f"s{a}", f"s{b}") for _, part, a in lines if a in (1, 2) for b in of_part[part])


def test_traversal_follows_every_line_item(spark, small):
    items = table(spark, small, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").collect()
    want = _supplies({tuple(r)[:3] for r in items})
    fewer = _supplies({tuple(r)[:3] for r in items if r.l_linenumber == 1 and r.l_orderkey % 5 == 0})
    got = Counter((r.start, r.resource) for r in catalog.queries()["grf01_traversal"](spark, small).collect())
    assert got == want and sum(want.values()) > sum(fewer.values())


def test_diffed_tables_hold_every_customer(spark, small):
    larger = small.replace("0.001", "0.01")
    rows = documents._tables(spark, larger).collect()
    assert sum(len(r.base.split("\n")) for r in rows) == table(spark, larger, "customer").count() > 500


def test_locators_are_resolved_in_all_items(spark, small):
    got = {r.item for r in catalog.queries()["src12_resolve_locators"](spark, small).collect()}
    assert max(got) >= 20 and got == {r.doc_id for r in table(spark, small, "documents").collect() if r.text.split("\n")[0]}


def test_bootstrap_draws_all_documents(spark, small):
    larger = small.replace("0.001", "0.01")
    diffs = [r.n_chars % 7 - 3 for r in table(spark, larger, "documents").select("n_chars").collect()]
    low, high = catalog.queries()["evl05_paired_bootstrap"](spark, larger).first()
    error = np.std(diffs) / len(diffs) ** 0.5
    assert documents.RESAMPLES == 10_000 and abs((low + high) / 2 - np.mean(diffs)) < 0.2 * error and abs((high - low) / (2 * 1.96 * error) - 1) < 0.1


def test_evaluation_counts_grow_with_the_input(spark, small):
    larger = small.replace("0.001", "0.01")
    signs, summary = (catalog.queries()[name](spark, larger) for name in ("evl06_sign_test", "evl02_summarize"))
    assert sum(r.n for r in signs.collect()) == table(spark, larger, "documents").count()
    assert [r.questions for r in summary.collect() if r.split == -1] == [table(spark, larger, "embeddings").where("vec_id % 20 = 0").count()]


def test_scores_of_all_documents_against_sql(spark, small):
    larger = small.replace("0.001", "0.01")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{larger}/documents.parquet'")
    query = catalog.queries()["lex08_scoring"](spark, larger)
    got = [tuple(r) for r in query.orderBy("rank").collect()]
    want = con.execute(catalog.oracle_sql()["lex08_scoring"]).fetchall()
    assert got == [(doc, line, pytest.approx(score, abs=2e-6), rank) for doc, line, score, rank in want] and max(r[0] for r in got) >= 400


def test_damaged_paths_are_reported(spark):
    participants = spark.createDataFrame([("r", "a", "x"), ("r", "b", "y"), ("q", "a", "x"), ("q", "b", "y"), ("lone", "a", "x")], "relation_id string, role string, resource string")
    relations = spark.createDataFrame([("r", "t"), ("q", "other"), ("lone", "t")], "relation_id string, relation_type string")
    paths = [("x", "y", ["x", "r", "y"]), ("x", "y", ["x", "r"]), ("y", "y", ["y", "r", "y"]), ("x", "z", ["x", "r", "y"]), ("x", "y", ["x", "q", "y"]), ("x", "z", ["x", "r", "z"]), ("x", "x", ["x", "lone", "x"])]
    seeds, plan = spark.createDataFrame([("x",)], "resource string"), [graph.Hop("t", "a", "b")]
    table_of = spark.createDataFrame(paths, "start string, resource string, path array<string>")
    got = {(r.start, r.resource, *r.path): r.problem for r in graph.check_paths(table_of, participants, relations, seeds, plan).collect()}
    assert [got[(s, r, *p)] for s, r, p in paths] == [None, "shape", "seed", "endpoint", "relation", "participants", "participants"]
    with pytest.raises(graph.BudgetExceeded):
        graph.check_paths(table_of, participants, relations, seeds, plan, max_paths=6)


def test_unequal_multisets_appear(spark, small):
    assert {r.same for r in catalog.queries()["arr03_multiset_equality"](spark, small).collect()} == {True, False}
