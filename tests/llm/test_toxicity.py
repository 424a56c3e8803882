import random
import zlib

import numpy as np

from quillspark.llm.toxicity import guess_language, toxicity, train

CLEAN, TOXIC = [f"word{i}" for i in range(300)] + ["the", "of", "and"] * 20, ["scum", "moron", "trash", "worthless"]


def text(rng, bad):
    words = [rng.choice(CLEAN) for _ in range(rng.randrange(20, 120))]
    for _ in range(3 * bad):
        words.insert(rng.randrange(len(words)), rng.choice(TOXIC))
    return " ".join(words)


def table(n=500):
    rng = random.Random(6)
    return [(i, text(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(n)]


def test_held_out_accuracy(spark, make_docs):
    rows = table()
    docs = make_docs([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (None, "scum moron trash")])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9000, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == len(rows) + 3
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and sum(r.held_out for r in got.values()) >= len(held)
    truth = {i: y for i, _, y in rows}
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert got[9000].score == got[9001].score and got[9000].predicted == 0 and got[None].predicted == 1 and not got[None].held_out


def test_held_out_labels_are_never_read(spark, make_docs):
    rows = table(240)
    docs = make_docs([(i, t) for i, t, _ in rows])
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    one, two = (spark.createDataFrame([(i, 1 - y if flip and held(i) else y) for i, _, y in rows], "doc_id long, toxic int") for flip in (False, True))
    scores = [sorted((r.doc_id, r.score) for r in toxicity(docs, x).collect()) for x in (one, two)]
    assert scores[0] == scores[1]


def test_without_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity(make_docs([(1, "scum")]), none).collect()] == [0]
    assert toxicity(make_docs([]), none).count() == 0


def test_training_is_deterministic():
    rows = table(120)
    models = [train([t for _, t, _ in rows], np.array([y for _, _, y in rows])) for _ in range(2)]
    assert models[0].score("some scum here") == models[1].score("some scum here")


def test_language_is_guessed_from_all_words():
    for n in (1000, 3999, 4000, 20_000):
        assert guess_language((["x", "the"] * n)[:n]) == "en"
