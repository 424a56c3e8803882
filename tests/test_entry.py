import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from quillspark import catalog
from quillspark.tables import NAMES


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "line", "literal", "score", "rank"] and df.count() > 0


@pytest.mark.parametrize("gone", [["quillspark/llm"], ["quillspark/llm", "corpus_pipeline.py"]])
def test_works_without_the_training_data_operators(tmp_path, gone):
    root = os.path.dirname(__spark_entry__.__file__)
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    for name in gone:
        path = tmp_path / "copy" / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, timeout=120, env=os.environ | {"PYTHONPATH": os.environ.get("PYTHONPATH", "").replace(root, "")})


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(catalog.queries()) > 200


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"create view {name} as select * from '{os.path.join(small, name)}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return "~" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, small, duck, name):
    df = catalog.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    out = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall())
    assert got == want
