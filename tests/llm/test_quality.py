import random
from collections import Counter

import numpy as np

from quillspark.llm.quality import COMMON_WORDS, js_distance, quality_rules, repeated_words

WHITE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = [w for w in "".join(" " if c in WHITE else c for c in text).split(" ") if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {k for i, g in enumerate(grams) if seen[g] > 1 for k in range(i, i + 5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


def test_base_counts(make_docs, corpus):
    corpus = corpus + [(200, "a b c d e\na b c d e\n\na b\x85c"), (201, "x" + " # | <a>\n" * 5)]
    rows = quality_rules(make_docs(corpus)).collect()
    assert len(rows) == len(corpus)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == Counter((i, *brute(t)) for i, t in corpus)
    assert not any(r.kept and r.base_failed for r in rows)


def test_repeated_words_overlap():
    assert repeated_words([b"a"] * 6) == 6 and repeated_words([b"a"] * 5) == 0


def test_distance():
    p, q = np.array([[1.0, 0.0]]), np.array([[0.0, 1.0]])
    assert js_distance(p, p)[0] == 0 and abs(js_distance(p, q)[0] - 1) < 1e-12


def test_junk_goes_and_prose_stays(spark, small):
    docs, labels = (spark.read.parquet(f"{small.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules(docs).join(labels, "doc_id").where("not base_failed and n_words >= 60").collect()
    clean, junk = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(clean) > 0.95 and np.mean(junk) < 0.35


def test_text_without_common_words_goes(make_docs):
    rng = random.Random(9)
    other = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n, share: " ".join(rng.choice(COMMON_WORDS["en"] if rng.random() < share else other) for _ in range(n))
    lengths = [60, 80, 100, 150, 200, 300, 400]
    rows = [(i, prose(rng.randrange(60, 600), 0.28)) for i in range(200)]
    rows += [(1000 + n, prose(n, 0)) for n in lengths]
    got = {r.doc_id: r for r in quality_rules(make_docs(rows)).collect()}
    assert not any(got[1000 + n].kept or got[1000 + n].base_failed for n in lengths)
    assert np.mean([got[i].kept for i in range(200)]) > 0.95


def test_empty(make_docs):
    assert quality_rules(make_docs([])).count() == 0
    assert [r.kept for r in quality_rules(make_docs([(1, None)])).collect()] == [False]
