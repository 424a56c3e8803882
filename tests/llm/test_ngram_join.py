import random
import time
from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm.ngram_join import choose_bands, intersections, ngram_join, one_per_class
from quillspark.llm.shingles import shingle_set
from quillspark.scratch import materialize

WHITE = " \t\n\x0b\x0c\r"


def grams(text):
    words = [w for w in "".join(" " if c in WHITE else c for c in text or "").split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows, threshold=0.8):
    """class, links and copies of each row."""
    sets = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        if grams(t):
            sets[grams(t)].append(k)
    keys = list(sets)
    root, links = list(range(len(keys))), [0] * len(keys)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(keys)):
        for b in range(a):
            if len(keys[a] & keys[b]) >= threshold * len(keys[a] | keys[b]):
                links[a], links[b] = links[a] + 1, links[b] + 1
                root[find(a)] = find(b)
    members = defaultdict(list)
    for a in range(len(keys)):
        members[find(a)] += sets[keys[a]]
    out = [(i, i, 0, 1) for i, _ in rows]
    for a, key in enumerate(keys):
        ids = [rows[k][0] for k in members[find(a)] if rows[k][0] is not None]
        for k in sets[key]:
            out[k] = (rows[k][0], min(ids) if ids else None, links[a], len(sets[key]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [500, 4])
def test_brute_force(make_docs, corpus, block):
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join(make_docs(corpus), block=block).collect()), key=repr)
    assert got == brute(corpus)


def near_copies(n, seed, every=1):
    """Texts that differ from one base in a word, or (every so often) in several."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    out = []
    for k in range(n):
        words = list(base)
        for at in rng.sample(range(150), 1 if k % every else rng.randrange(1, 6)):
            words[at] = f"x{rng.randrange(9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block, every", [(20, 150), (7, 2)])
def test_dense_groups(make_docs, corpus, block, every):
    rows = [(1000 + i, t) for i, t in enumerate(near_copies(150, 1, every) + near_copies(60, 2, every))] + corpus[:20]
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join(make_docs(rows), block=block).collect()), key=repr)
    want = brute(rows)
    # The bands find a pair with probability 0.9999 or more.
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    assert [a[:2] for a in got] == [b[:2] for b in want] and len(wrong) <= 2


def test_classes_of_one_leader_meet_no_more(spark):
    from quillspark.llm.ngram_join import _dense_units

    rows = [(bytes([i]), 0, 7, 100, b"L" if i < 90 else None) for i in range(100)]
    dense = spark.createDataFrame(rows, "key binary, band int, bucket long, size long, leader binary")
    units = _dense_units(dense, 10).collect()
    assert len(units) <= 100 + 10 * 9 + 10 and all(u.high >= 0 for u in units)
    pairs = {(a.key, b.key) for a in units for b in units if (a.low, a.high) == (b.low, b.high) and (a.block != b.block or a.low == a.high) and a.key != b.key}
    assert {(x[0], y[0]) for x in rows for y in rows if x[0] != y[0] and not (x[4] and y[4])} <= pairs
    only = spark.createDataFrame([r for r in rows if r[4]], dense.schema).replace(100, 90, ["size"])
    assert _dense_units(only, 10).count() == 0


def test_names_that_clash(spark):
    names = ["doc_id", "text", "nj_row", "row", "a.b", "id"]
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3, 4), (2, "a b c d e f", 1, 2, 3, 4)], "a long, b string, c int, d int, e int, f int").toDF(*names)
    kept = one_per_class(docs)
    assert kept.columns == names and [tuple(r) for r in kept.collect()] == [(1, "a b c d e f", 1, 2, 3, 4)]


def test_hubs_and_long_chains(spark):
    from quillspark.llm.components import connected_components

    star, chain = [(0, i) for i in range(1, 300)], [(1000 + i, 1001 + i) for i in range(200)]
    got = {r.v: r.root for r in connected_components(spark.createDataFrame(star + chain + [(5, 5)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(300)} | {1000 + i: 1000 for i in range(201)}


def test_one_per_class(make_docs, corpus):
    docs = make_docs(corpus)
    kept = one_per_class(docs)
    assert kept.columns == docs.columns
    classes = {c for i, c, _, _ in brute(corpus) if c is not None}
    assert {r.doc_id for r in kept.where("doc_id is not null").collect()} == classes


def test_what_meets_nothing_is_not_dealt(spark, make_docs):
    """Texts without a partner and buckets of one class are not shuffled, whatever size joins broadcast."""
    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        time.sleep(0.3)  # figures are renewed every 0.1 s, when a task ends
        spark.range(1).collect()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(300))) for i in range(2000)]
    near = [(5000 + i, t) for i, t in enumerate(near_copies(10, 3))]
    docs = materialize(make_docs(rows + near), "docs")
    before, limit = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join(docs).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == [(i, i, 0, 1) for i, _ in rows] + brute(near)
    # Bytes of the texts without a partner against all that was shuffled: signatures, hashes of buckets, and ten texts.
    assert shuffled() - before < 0.4 * sum(len(t) for _, t in rows)


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = choose_bands(threshold, 0.999, 128)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999


def test_intersections():
    rng = random.Random(3)
    for n in (2, 3, 40):
        sets = [np.array(sorted(rng.sample(range(300), rng.randrange(1, 200))), np.uint64) for _ in range(n)]
        assert (intersections(sets) == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]).all()


def test_shingles():
    assert len(shingle_set("")) == 0 and len(shingle_set("a b")) == 1 and len(shingle_set("a b c d e f")) == 2
    assert shingle_set("a b").tolist() != shingle_set("b a").tolist()


def test_empty(make_docs):
    assert ngram_join(make_docs([])).count() == 0
