"""What larger inputs asked for: no table in one process's memory, no work that grows with a square without need."""

import math
import time
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillspark import catalog
from quillspark.operators import evaluation, graph, neighbours
from quillspark.operators.skew import distinct_not_in, possible
from quillspark.scratch import materialize


def test_not_in_moves_no_whole_table_to_the_driver(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()["set07_left_anti_chain"](spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftAnti" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("left", [[], [1, 1, 2, 3], [1, None]])
@pytest.mark.parametrize("right", [[], [2, 2], [None], [1, None]])
def test_not_in_treats_nulls_as_sql_does(spark, left, right):
    tables = [spark.createDataFrame([(x,) for x in rows], "k long") for rows in (left, right)]
    for name, table in zip(("a", "b"), tables):
        table.createOrReplaceTempView(f"not_in_{name}")
    want = spark.sql("SELECT DISTINCT k FROM not_in_a WHERE k NOT IN (SELECT k FROM not_in_b)")
    assert sorted(map(str, distinct_not_in(*tables).collect())) == sorted(f"Row(key={r.k})" for r in want.collect())


@pytest.mark.parametrize("wins, n", [(0, 1), (1, 1), (3, 10), (5, 10), (31, 77), (460, 1000)])
def test_sign_test_is_the_binomial_tail(wins, n):
    tail = Fraction(sum(math.comb(n, k) for k in range(min(wins, n - wins) + 1)), 2**n)
    assert evaluation.sign_test(wins, n) == pytest.approx(min(1.0, 2 * float(tail)), rel=1e-9)


def test_sign_test_takes_one_pass_over_the_tail(spark, tmp_path):
    spark.range(2_000_000).selectExpr("id AS doc_id", "'en' AS lang", "IF(id % 1000 = 0, 1, id) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.monotonic()
    [row] = catalog.queries()["evl06_sign_test"](spark, str(tmp_path)).collect()
    # The normal tail with n / 4 as variance; p = 0.0047.
    assert (row.lang, row.wins, row.n) == ("en", 998_000, 2_000_000)
    assert row.p == pytest.approx(math.erfc(1999.5 / math.sqrt(500_000) / math.sqrt(2)), abs=1e-4) and time.monotonic() - began < 60


def test_question_scores_make_no_rows_of_pairs(spark, small):
    for name in ("evl01_question_scores", "evl02_summarize"):
        plan = catalog.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Window" not in plan


def test_question_scores_of_odd_vectors_in_many_units(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(900, 64)).astype(np.float32)
    values[100:200] = values[100]  # copies: ties go by id
    values[200:210] = -values[200:210]
    rows = [(7 * i - 700, v.tolist(), int(rng.integers(0, 40)) if i % 9 else None) for i, v in enumerate(values)]
    rows += [(20_000, None, 1), (20_001, None, 1), (20_020, values[0, :50].tolist(), 2), (20_040, [None, *values[1, 1:].tolist()], 3), (20_060, values[2].tolist(), 99), (None, values[3].tolist(), 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name, value in (("QUERY_BLOCK", 20), ("PART", 200), ("LEAST_PART", 200)):
        monkeypatch.setattr(neighbours, name, value)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("evl01_question_scores", "evl02_summarize"):
        got = catalog.queries()[name](spark, str(tmp_path))
        want = con.execute(catalog.oracle_sql()[name])
        assert got.columns == [c[0] for c in want.description]
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_tiles_agree_with_one_ranking(monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", (3, 16))
    rng = np.random.default_rng(2)
    values, labels = rng.integers(-2, 3, (120, 4)).astype(np.float32), rng.integers(0, 30, 120)
    table = lambda at: pa.table({"unit": at * 0, "kind": at * 0, "id": at, "label": labels[at], "values": pa.array(values[at].tolist(), pa.list_(pa.float32()))})
    q, top, equal = neighbours._rows(table(np.arange(0, 120, 10)), 4), neighbours._Best(12, neighbours.TOP), neighbours._Best(12, 1)
    for low in (0, 50, 90):
        neighbours._nearest(q, neighbours._rows(table(np.arange(low, {0: 50, 50: 90, 90: 120}[low])), 4), top, equal)
    for k, own in enumerate(q.id.tolist()):
        order = sorted((-float(values[own] @ values[i]), i) for i in range(120) if i != own)
        assert top.id[k].tolist() == [i for _, i in order[: neighbours.TOP]]
        assert equal.id[k, 0] == next((i for _, i in order if labels[i] == labels[own]), np.iinfo(np.int64).max)


def test_traversal_moves_only_what_it_meets(spark, monkeypatch):
    """Written and shuffled rows follow the frontier, not the tables."""
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, label: written.append((label, df.count())) or materialize(df, label))
    n = 20_000
    ends = spark.range(n).selectExpr("concat('r', id) AS relation_id", "concat('s', id % 2000) AS supplier", "concat('p', id % 5000) AS part")
    participants = ends.selectExpr("relation_id", "'supplier' AS role", "supplier AS resource").union(ends.selectExpr("relation_id", "'part' AS role", "part AS resource"))
    relations = participants.select("relation_id").distinct().selectExpr("relation_id", "IF(relation_id = 'r1', 'other', 'supply') AS relation_type")
    visible = participants.select("resource").distinct().where("resource not like 'p%01'")
    seeds = spark.createDataFrame([("s1",), ("s6",), ("unknown",)], "resource string")
    plan = [graph.Hop("supply", "supplier", "part"), graph.Hop("supply", "part", "supplier")]
    got = sorted((r.start, r.resource, *r.path) for r in graph.traverse(participants, relations, seeds, plan, visible).collect())
    known = [(i, f"s{i % 2000}", f"p{i % 5000}") for i in range(n) if i != 1 and not f"p{i % 5000}".endswith("01")]
    by_part = {}
    for i, s, p in known:
        by_part.setdefault(p, []).append((i, s))
    want = sorted((s, t, s, f"r{i}", p, f"r{k}", t) for i, s, p in known if s in ("s1", "s6") for k, t in by_part[p])
    assert got == want and want
    assert {label for label, _ in written} >= {"members", "hop"} and max(rows for _, rows in written) < n / 50


@pytest.mark.parametrize("n_keys", [0, 1, 3000])
def test_possible_keeps_every_key(spark, n_keys):
    rows, keys = spark.range(-5000, 5000), spark.range(n_keys).selectExpr("id - 1000 AS id")
    left = possible(rows, keys, ["id"])
    assert left.join(keys, "id", "left_semi").count() == n_keys and left.count() <= n_keys + 20
