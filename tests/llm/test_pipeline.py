"""Each stage against a brute-force version of it, on what its predecessor kept."""

import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quillspark.scratch import materialize  # noqa: E402
from quillspark.tables import table  # noqa: E402

from .test_ngram_join import brute as classes  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark, small):
    docs, out = table(spark, small, "documents"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), name)
        out[name] = docs
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_in_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "packing"]
    for name in ("toxicity", "exact_dedup", "ngram_join", "mixing"):
        assert steps[name].columns == steps["documents"].columns


def test_toxicity_removes_by_score(spark, small, steps):
    from quillspark.llm.toxicity import toxicity

    verdict = {r.doc_id: r.predicted for r in toxicity(steps["documents"], table(spark, small, "labels")).collect()}
    assert {i for i, _ in rows(steps["toxicity"])} == {i for i, p in verdict.items() if not p}


def test_exact_dedup_keeps_one(steps):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for i, t in rows(steps["toxicity"]):
        best.setdefault(norm(t), []).append((-len(t or ""), i))
    assert sorted(i for i, _ in rows(steps["exact_dedup"])) == sorted(min(g)[1] for g in best.values())


def test_ngram_join_keeps_one_of_each_class(steps):
    before = rows(steps["exact_dedup"])
    assert {i for i, _ in rows(steps["ngram_join"])} == {c for _, c, _, _ in classes(before)}


def test_mixing_keeps_every_document(steps):
    before, after = Counter(rows(steps["ngram_join"])), Counter(rows(steps["mixing"]))
    assert before.keys() == after.keys() and max(after.values()) <= 2


def test_packing_holds_all(steps):
    pieces = steps["packing"].collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(i for i, _ in rows(steps["mixing"]))
    places = Counter((r.sequence_id, r.offset) for r in pieces)
    assert max(places.values()) == 1 and max(r.offset + r.length for r in pieces) <= 2048


def test_run(spark, small, steps):
    assert corpus_pipeline.run(spark, small).count() == steps["packing"].count()
