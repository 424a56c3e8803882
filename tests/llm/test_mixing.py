import math
from collections import Counter, defaultdict

import pytest

from quillspark.llm.mixing import temperature_mix


@pytest.fixture
def docs(spark):
    rows = [(i, "w " * (5 + i % 7), "big") for i in range(300)] + [(1000 + i, "w " * 9, "small") for i in range(30)] + [(2000 + i, "w w w", None) for i in range(12)] + [(3000, "", "silent"), (3001, None, "silent"), (5, "w " * 10, "big"), (None, "w w", "small")]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, mx_pass string")


def tokens(rows):
    out = defaultdict(int)
    for r in rows:
        out[r.source] += len((r.text or "").split())
    return out


def test_no_document_is_lost_and_none_over_the_limit(docs):
    out = temperature_mix(docs, max_repeats=3.0).collect()
    before, after = Counter((r.doc_id, r.text, r.source) for r in docs.collect()), Counter((r.doc_id, r.text, r.source) for r in out)
    assert before.keys() == after.keys()
    assert all(before[k] <= n <= 3 * before[k] for k, n in after.items())
    assert all(0 <= r.mx_position <= 1 for r in out)


def test_budget_is_met(docs):
    before = tokens(docs.collect())
    total = sum(before.values())
    after = tokens(temperature_mix(docs, budget=total / 2, max_repeats=4.0).collect())
    assert 0.9 * total / 2 <= sum(after.values()) <= total / 2 + 1


def test_entropy(docs):
    before, after = tokens(docs.collect()), None
    even = math.log(3) * 0.95
    after = tokens(temperature_mix(docs, max_repeats=None, entropy=even).collect())
    share = [n / sum(after.values()) for n in after.values() if n]
    assert -sum(p * math.log(p) for p in share) > -sum(n / sum(before.values()) * math.log(n / sum(before.values())) for n in before.values() if n)


def test_passes_permute_fixed_blocks(docs):
    out = temperature_mix(docs, max_repeats=3.0, block_rows=2).where("source = 'small' and mx_pass < 2 and doc_id is not null").collect()
    blocks = defaultdict(dict)
    for r in out:
        blocks[r.mx_pass][r.doc_id] = r.mx_block
    moved = {(blocks[0][k], blocks[1][k]) for k in blocks[0].keys() & blocks[1].keys()}
    assert len(blocks[0]) == 30
    # Documents of one block move together, and no two blocks meet.
    assert len(moved) == len({a for a, _ in moved}) == len({b for _, b in moved}) and any(a != b for a, b in moved)


@pytest.mark.parametrize("n", [1, 2, 7, 12, 1000])
def test_permutations_are_bijections(spark, n):
    from pyspark.sql import functions as F

    from quillspark.llm.mixing import permuted

    rows = spark.range(n).crossJoin(spark.range(6).withColumnRenamed("id", "p")).select("p", permuted("x", F.col("p"), F.lit("s"), F.col("id"), F.lit(n).cast("long")).alias("at")).collect()
    for p in range(6):
        assert sorted(r["at"] for r in rows if r.p == p) == list(range(n))


def test_names_that_clash(spark, docs):
    names = ["doc_id", "text", "source", "mx_rows", "mx_source", "a.b", "key", "l0", "c1"]
    odd = docs.select("doc_id", "text", "source", *(docs.mx_pass.alias("x") for _ in names[3:])).toDF(*names)
    out = temperature_mix(odd)
    assert out.columns == [*names, "mx_pass", "mx_block", "mx_position"]
    assert {tuple(r[3:9]) for r in out.collect()} == {("x",) * 6}


def test_empty_and_arguments(docs):
    assert temperature_mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        temperature_mix(docs, entropy=1.0)
