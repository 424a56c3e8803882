import random

import pytest

WORDS = "the of and to in is thanedble onion eriner attion ndsting hewh ouldle reer blean tistsh".split()


@pytest.fixture
def make_docs(spark):
    """Rows (doc_id, text) as a table with a column whose name clashes with an operator's."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s1", 7) for i, t in rows], "doc_id long, text string, lang string, source string, dd_kept int")

    return make


@pytest.fixture
def corpus():
    """Short prose with exact and near copies, shared passages, empty, blank, null and very long texts."""
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    base, passage = prose(120), prose(60)
    rows = [(i, prose(rng.randrange(1, 150))) for i in range(40)]
    rows += [(50 + i, base) for i in range(8)] + [(60, base + " "), (61, base.replace(" ", "\n", 3)), (62, base + "!")]
    rows += [(70 + i, " ".join(w for k, w in enumerate(base.split()) if k != 7 * i + 3)) for i in range(12)]
    rows += [(90 + i, prose(20) + "\n" + passage + "\n" + prose(20)) for i in range(6)]
    rows += [(100, ""), (101, None), (102, " \n\t"), (103, prose(15000)), (104, "x" * 3000), (105, "ab " * 900), (106, "zwölf Bücher 東京都 ½"), (None, "null id here"), (None, None), (3, rows[3][1])]
    return rows
