"""Every query that the engine registers against its SQL in DuckDB, and the driver's contract."""

import os
import subprocess
import sys

import duckdb
import pytest

from cellbasis.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


SF_DIR = "/root/testdata/sf0.01"  # the size at which there are voids, and at which the driver compares


@pytest.fixture
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.schema.names)
    return names, sorted(map(repr, zip(*[table.column(c).to_pylist() for c in names], strict=True)))


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toArrow()
    if name not in SQL:
        assert got.num_columns
        return
    assert rows(got) == rows(duck.sql(SQL[name]).to_arrow_table())


def test_entry_works_without_the_corpus_operators(tmp_path):
    """The entry module imports and lists its queries where cellbasis/llm and corpus_pipeline.py are gone."""
    import shutil

    there = tmp_path / "repo"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cell_stats' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=there, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "cellbasis")):
        if f"{os.sep}llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as h:
                    assert "cellbasis.llm" not in h.read(), f
