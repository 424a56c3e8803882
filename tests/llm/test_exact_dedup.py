import hashlib
import re

from quillspark.llm.exact_dedup import exact_dedup


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((i, t or ""))
    out = []
    for i, t in rows:
        group = groups[norm(t)]
        most = max(len(x) for _, x in group)
        ids = [k for k, x in group if len(x) == most and k is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(group), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.dd_keep_id, r.dd_group_size, r.dd_kept, r.dd_digest) for r in df.collect()), key=repr)


def test_brute_force(make_docs, corpus):
    assert result(exact_dedup(make_docs(corpus))) == brute(corpus)


def test_one_salt_gives_the_same(make_docs, corpus):
    assert result(exact_dedup(make_docs(corpus), salts=1)) == brute(corpus)


def test_content_decides_where_digests_collide(make_docs, corpus):
    from pyspark.sql import functions as F

    out = exact_dedup(make_docs(corpus), digest=lambda t: F.substring(F.sha2(t, 256), 1, 1))
    assert [x[:4] for x in result(out)] == [x[:4] for x in brute(corpus)]


def test_empty_table_and_other_columns(make_docs):
    out = exact_dedup(make_docs([]))
    assert out.count() == 0 and {"lang", "source", "dd_kept"} <= set(out.columns)


def test_names_that_clash(spark, corpus):
    names = ["doc_id", "text", "dd_n", "dd_keep", "dd_id", "__hot", "a.b", "n", "d", "c0", "Dd_W", "x`y"]
    docs = spark.createDataFrame([(i, t, *range(10)) for i, t in corpus], ", ".join(f"c{k} {'long' if k != 1 else 'string'}" for k in range(12))).toDF(*names)
    out = exact_dedup(docs)
    assert out.columns == [*names, "dd_digest", "dd_keep_id", "dd_group_size", "dd_kept"]
    assert result(out) == brute(corpus) and {tuple(r[2:12]) for r in out.collect()} == {tuple(range(10))}
