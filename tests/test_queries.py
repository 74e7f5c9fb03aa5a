"""Every query against its SQL in DuckDB, and the entry module without the training-data folders."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidemark.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parents[1]


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return [shown(x) for x in v]
    return str(float(v)) if type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(str([shown(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    found = duck.sql(ORACLE_SQL[name])
    at = [list(found.columns).index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert got == sorted(str([shown(r[i]) for i in at]) for r in found.fetchall())


def test_entry_without_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)


def test_entry_where_a_library_is_missing():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_them():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text()


def test_whole_tables_and_arrays(spark, duck, sf_dir):
    count = lambda sql: duck.sql(sql).fetchall()[0][0]
    assert QUERIES["addfields_chain_whole"](spark, sf_dir).count() == count("SELECT count(*) FROM lineitem")
    assert QUERIES["unwind_whole"](spark, sf_dir).count() == count("SELECT sum(len(embedding)) FROM embeddings")
    pairs = QUERIES["zip_sum_arrays_whole"](spark, sf_dir).selectExpr("sum(size(s))").first()[0]
    assert pairs == count("SELECT sum(len(embedding) - 1) FROM embeddings")
