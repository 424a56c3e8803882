"""Positions in a total order, order statistics, the lexical index, containment and audit chains against brute force."""

import hashlib
import random

from pyspark.sql import functions as F

from quillspark.operators import audit, containment, lexical, ranking
from quillspark.tables import spread


def test_ranked_and_previous(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 1, 1, 2, 7])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(7)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    got = ranking.ranked(df, [F.col("v"), F.col("id")], "at").orderBy("at").collect()
    assert [(r["at"], r["id"]) for r in got] == [(i, r[0]) for i, r in enumerate(want, 1)]
    before = {r["id"]: r["b"] for r in ranking.previous(df, [F.col("v"), F.col("id")], "id", "b").collect()}
    assert before == {r[0]: (want[i - 1][0] if i else None) for i, r in enumerate(want)}
    assert ranking.ranked(df.where("false"), [F.col("id")]).count() == 0


def test_order_statistics_of_one_large_group(spark):
    rows = [("hot", float(i % 97)) for i in range(900)] + [("one", 5.0), ("gap", None), ("gap", 2.0)]
    got = {r["g"]: (round(r["mean"], 6), r["p50"], r["p95"]) for r in ranking.order_statistics(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    hot = sorted(v for g, v in rows if g == "hot")
    assert got == {"hot": (round(sum(hot) / 900, 6), hot[450], hot[855]), "one": (5.0, 5.0, 5.0), "gap": (2.0, 2.0, 2.0)}


def test_index_gives_what_body_search_gives(spark, tmp_path):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Ünit", "数据库", "x" * 60]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 6))) for _ in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[7]), (500, None), (None, "alpha beta"), (501, "")], "doc_id long, text string")
    index = lexical.build_index(docs, f"file://{tmp_path}/index")
    for query in ["alpha beta", "gamma", "alpha beta gamma delta", "数据库 Ünit", "nowhere", "alpha alpha"]:
        assert sorted(map(str, lexical.search_index(spark, index, query, 15).collect())) == sorted(map(str, lexical.body_search(docs, query, 15).collect())), query
    assert lexical.search_index(spark, index, "!!", 5).count() == 0
    empty = lexical.build_index(docs.where("false"), f"file://{tmp_path}/none")
    assert lexical.search_index(spark, empty, "alpha", 5).count() == 0


def test_index_reads_the_querys_tokens_only(spark, tmp_path):
    index = lexical.build_index(spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string"), f"file://{tmp_path}/index")
    plan = lexical.search_index(spark, index, "alpha beta", 5)._jdf.queryExecution().toString()
    assert "In(token, [alpha,beta])" in plan


def test_containing(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcdefg", k=40)).replace("a b", "a\n b") for _ in range(60)]
    passages = [t[i : i + n] for t in texts[:20] for i, n in [(3, 25), (10, 4), (7, 13), (0, 30)]] + ["nothing of this is in any text here", "", "a\n b"]
    items = spark.createDataFrame([*enumerate(passages), (900, None)], "item_id long, text string")
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (800, None), (801, "")], "doc_id long, text string")
    want = {(i, d) for i, p in enumerate(passages) for d, t in [*enumerate(texts), (801, "")] if p in t}
    got = [(r.item_id, r.doc_id) for r in containment.containing(items, docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_chain_of_long_and_broken_logs(spark):
    rows = [("long", i, f"{i:032x}", f"e{i}") for i in range(1, 3001)] + [("broken", 1, "0" * 32, "a"), ("broken", 2, None, "b"), ("broken", 3, "1" * 32, "c"), (None, 1, "2" * 32, "d")]
    got = {(r["log"], r["seq"]): r["chain"] for r in audit.build_chain(spark.createDataFrame(rows, "log string, seq long, event string, envelope string")).collect()}
    links = {}
    for log in ("long", "broken", None):
        last = hashlib.sha256(audit.GENESIS.encode()).digest()
        for _, seq, event, envelope in (r for r in rows if r[0] == log):
            if last is not None:
                last = None if event is None else hashlib.sha256(audit.STEP.encode() + last + seq.to_bytes(8, "big") + bytes.fromhex(event) + hashlib.sha256(envelope.encode()).digest()).digest()
            links[log, seq] = last.hex() if last else None
    assert got == links


def test_small_tables_are_spread_and_large_ones_stay(spark, tmp_path):
    path = f"file://{tmp_path}/one"
    spark.range(100).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(df).count() == 100
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        assert "Repartition" not in spread(spark.read.parquet(path))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
