import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import audit, federation, graph, lexical, resolve
from quillspark.operators.skew import hot_cold_join


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, tokens", [("東京都", ["東京", "京都"]), ("F1（エフ・ワン）", ["f1", "エフ", "ワン"]), ("法第2条", ["法第", "2", "条"]), ("Hello, World", ["hello", "world"]), ("", []), ("x" * 41, [])])
def test_tokenize(value, text, tokens):
    assert value(tx.tokenize(F.lit(text))) == tokens


def test_text_functions(value):
    assert value(tx.normalize_exact(F.lit("　 AbC\t"))) == "abc"
    assert value(tx.longest_query_part(F.lit("xx abcd"), "zabc q")) == "abc"
    assert value(tx.excerpt_around(F.lit(" \n "), F.lit(1), F.lit(1))) is None
    assert value(tx.pointer_escape(F.lit("a~/b"))) == "a~0~1b"
    assert value(tx.literal_escape(F.lit('a\\"'))) == 'a\\\\\\"'


def test_genesis(value):
    assert value(F.sha2(F.lit(audit.GENESIS), 256)) == "9ae4e1d7942ce318770de897b2a336edc2a9e700f8733f658dcdc2e563aff344"


def test_chain_verifies_and_finds_damage(spark):
    events = spark.createDataFrame([(log, i, f"{i:032x}", f"body {i}") for log in ("a", "b") for i in range(1, 6)], "log string, seq long, event string, envelope string")
    chain = audit.build_chain(events).join(events.select("log", "seq", "envelope"), ["log", "seq"])
    rows = sorted(chain.collect(), key=lambda r: (r.log, r.seq))
    genesis, out = "9ae4e1d7942ce318770de897b2a336edc2a9e700f8733f658dcdc2e563aff344", []
    for r in rows:
        prev = genesis if r.seq == 1 else out[-1][5]
        out.append((r.log, r.seq, r.event, "changed" if (r.log, r.seq) == ("b", 4) else r.envelope, prev, r.chain))
    table = spark.createDataFrame(out, "log string, seq long, event string, envelope string, prev_chain string, chain string")
    assert {(r.log, r.rows, r.first_bad) for r in audit.verify_chain(table).collect()} == {("a", 5, None), ("b", 5, 4)}


def test_authority(spark):
    rows = [(1, "p", "x", "Inferred"), (1, "p", "y", "Authoritative"), (2, "p", "x", "Observed"), (2, "p", "y", "Observed"), (3, "p", "x", "Inferred")]
    policy = spark.createDataFrame([("Authoritative", 3), ("Observed", 2), ("Inferred", 9)], "origin string, rank int")
    got = {r.subject: (r.state, r.value) for r in resolve.resolve_assertions(spark.createDataFrame(rows, "subject int, predicate string, value string, origin string"), policy).collect()}
    assert got == {1: ("Resolved", "y"), 2: ("Conflict", None), 3: ("Resolved", "x")}


def test_identity(spark):
    rows = [(1, "NameSimilarity", True), (2, "IntegrityDigest", True), (2, "CanonicalUri", False), (3, "IntegrityDigest", True), (4, "IntegrityDigest", False)]
    got = {r.pair: r.state for r in resolve.resolve_identity(spark.createDataFrame(rows, "pair int, kind string, supports boolean")).collect()}
    assert got == {1: "Provisional", 2: "Conflict", 3: "Resolved", 4: "Unresolved"}


def test_federation(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "b"), (2, 2, "c")], "list_no int, rank int, id string")
    assert [(r.id, r.hits) for r in federation.priority_concat(hits).orderBy("position").collect()] == [("a", 1), ("b", 2), ("c", 1)]
    assert federation.reciprocal_rank_fusion(hits).orderBy("position").first().id == "b"
    lists = spark.createDataFrame([("s", "g1", "s"), ("s", "g2", "s")], "source_id string, generation_id string, hit_source string")
    with pytest.raises(federation.FederationError):
        federation.validate_lists(lists)


def test_graph_keeps_relations_apart_and_budgets(spark):
    participants = spark.createDataFrame([("r1", "b", "x"), ("r1", "p", "y"), ("r2", "b", "z"), ("r2", "p", "w")], "relation_id string, role string, resource string")
    relations = spark.createDataFrame([("r1", "loan"), ("r2", "loan")], "relation_id string, relation_type string")
    seeds = spark.createDataFrame([("x",)], "resource string")
    hop = [graph.Hop("loan", "b", "p")]
    assert [r.resource for r in graph.traverse(participants, relations, seeds, hop).collect()] == ["y"]
    hidden = spark.createDataFrame([("x",), ("z",), ("w",)], "resource string")
    assert graph.traverse(participants, relations, seeds, hop, hidden).count() == 0
    with pytest.raises(graph.BudgetExceeded):
        graph.traverse(participants, relations, seeds, hop, max_relations=0)


def test_body_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta\nnothing"), (2, "beta x alpha"), (3, "gamma"), (4, None), (5, "alpha beta")], "doc_id long, text string")
    assert [(r.doc_id, r.literal) for r in lexical.body_search(docs, "alpha beta", 10).orderBy("rank").collect()] == [(1, True), (5, True), (2, False)]
    assert lexical.body_search(docs, "!!", 10).count() == 0


def test_hot_cold_join(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate(["h"] * 50 + ["a", "b", None, "z"])], "k string, i long")
    dim = spark.createDataFrame([("h", 50, "H"), ("a", 1, "A"), ("b", 1, "B")], "k string, n long, v string")
    for hot in (0, 1, 10):
        got = {r.i: (r.k, r.v) for r in hot_cold_join(left, dim, ["k"], "n", F.col("i"), hot_keys=hot).collect()}
        assert len(got) == 54 and all(got[i] == ("h", "H") for i in range(50)) and [got[i][1] for i in range(50, 54)] == ["A", "B", None, None]


def test_tokens_of_the_longest_length(spark):
    from quillspark.functions.text import tokenize

    rows = spark.createDataFrame([(n, "x" * n + " Aé ΑΣ'Β İz 東京都a") for n in (38, 39, 40, 41)], "n long, s string").select("n", tokenize(F.col("s")).alias("t")).collect()
    assert {r.n: len(r.t[0]) if r.t[0][0] == "x" else 0 for r in rows} == {38: 38, 39: 39, 40: 0, 41: 0}
    fast = spark.createDataFrame([("It's AÉ 12b ﬁx",)], "s string").select(tokenize(F.col("s")).alias("t")).first().t
    assert fast == ["it", "s", "aé", "12b", "ﬁx"]


def test_digests_without_a_version_do_not_conflict(spark):
    from quillspark.operators.resolve import effective_state

    rows = [("a", 1, 1, "Present", "CompleteEnumeration", None, "x"), ("a", 2, 2, "Present", "CompleteEnumeration", None, "y"), ("b", 1, 1, "Present", "CompleteEnumeration", "v", "x"), ("b", 2, 2, "Present", "CompleteEnumeration", "v", "y")]
    out = effective_state(spark.createDataFrame(rows, "resource string, seq int, observed_at int, presence string, coverage string, version string, digest string")).collect()
    assert {r.resource: r.integrity_conflict for r in out} == {"a": False, "b": True}
