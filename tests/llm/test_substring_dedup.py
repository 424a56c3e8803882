import hashlib
import random

import numpy as np
import pytest

from quillspark.llm.parsing import corpus_order
from quillspark.llm.substring_dedup import GRAM, WIDTH, segments, string_hashes, substring_dedup


def brute(rows, width=WIDTH):
    """Rows by id and start; rows that share an id are not earlier than each other."""
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: float("inf") if i is None else i
    for i, t in texts:
        for s in range(len(t) - width + 1):
            key = t[s : s + width]
            first[key] = min(first.get(key, (rank(i), s)), (rank(i), s))
    out = []
    for i, t in texts:
        covered = bytearray(len(t))
        for s in range(len(t) - width + 1):
            if first[t[s : s + width]] < (rank(i), s):
                covered[s : s + width] = b"\1" * width
        runs = sum(1 for k in range(len(t)) if covered[k] and not (k and covered[k - 1]))
        out.append((i, len(t), sum(covered), runs, hashlib.sha256(bytes(b for b, c in zip(t, covered) if not c)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [200_000, 3])
def test_brute_force(make_docs, corpus, hot):
    corpus = [r for r in corpus if r[0] != 103] + [(300, "ab" * 300 + "é" * 60), (301, "ab" * 120)]
    assert sorted(map(tuple, substring_dedup(make_docs(corpus), hot=hot).collect()), key=repr) == brute(corpus)


def test_levels_of_hot_minimizers(make_docs, monkeypatch):
    """A line that many texts share among others of their own, and a text that repeats itself."""
    import quillspark.llm.substring_dedup as module

    rng = random.Random(6)
    line = "".join(rng.choice("abcdefgh ") for _ in range(180))
    rows = [(i, "".join(rng.choice("uvwxyz ") for _ in range(130)) + line + "".join(rng.choice("uvwxyz ") for _ in range(130))) for i in range(40)]
    rows += [(100, line * 4), (101, (line[:60] + "-") * 9), (102, rows[5][1][40:])]
    for levels in (1, 6):
        monkeypatch.setattr(module, "LEVELS", levels)
        assert sorted(map(tuple, substring_dedup(make_docs(rows), hot=8).collect()), key=repr) == brute(rows)


def test_segments_cover_every_string():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab ") for _ in range(n)) for n in (0, 99, 100, 500, 1000)]
    for level in (0, 1, 5):
        check_cover(texts, *segments(texts, level=level))


def check_cover(texts, owner, at, count, _, times):
    for i, t in enumerate(texts):
        found = [k for o, a, n in zip(owner, at, count) if o == i for k in range(a, a + n)]
        assert found == list(range(max(0, len(t) - WIDTH + 1)))
    assert (times >= 1).all() and GRAM % 8 == 0


def test_string_hashes_are_of_content():
    data = np.frombuffer(b"x" + bytes(range(150)) + b"yz" + bytes(range(150)), np.uint8)
    h = string_hashes(data, 100)
    assert len(h) == len(data) - 99 and h[1] == h[153] and len(set(h.tolist())) == len(h) - 51


def test_corpus_order_is_lexicographic():
    rng = random.Random(8)
    unit = bytes(rng.choice(b"abc") for _ in range(40))
    parts = [unit * 4, b"abc" * 50, unit[:30] + unit, bytes(rng.choice(b"ab") for _ in range(300))]
    text = b"".join(p + b"\xff" * 8 for p in parts)
    ends = np.cumsum([len(p) + 8 for p in parts]) - 8
    want = np.concatenate([np.arange(e - len(p), e) for e, p in zip(ends, parts)])
    got = [text[i:] for i in corpus_order(np.frombuffer(text, np.uint8), ends, want)]
    stop = [g.index(b"\xff") for g in got]
    assert all(a[:m] <= b[:m] for a, b, m in zip(got, got[1:], map(min, stop, stop[1:])))


def test_empty(make_docs):
    assert substring_dedup(make_docs([])).count() == 0
