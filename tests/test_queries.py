"""Every query against its SQL on the smallest driver tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not there")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, sql, name):
    found = entry_point.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = sorted((tuple(map(plain, r)) for r in found.select(*columns).collect()), key=repr)
    text = entry_point.oracle_sql().get(name)
    if text is None:
        assert rows
        return
    result = sql.execute(text)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[k]) for k in order) for r in result.fetchall()), key=repr)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0 and set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_import_needs_no_session_and_no_llm(tmp_path):
    """The registry can be read in a process without Spark, and where the folders of llm are gone."""
    import pathlib
    import shutil
    import subprocess
    import sys

    here = pathlib.Path(entry_point.__file__).parent
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    shutil.copytree(here / "loomline", tmp_path / "loomline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for folder in (here, tmp_path):
        done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=folder, capture_output=True, text=True, timeout=120, check=False)
        names = done.stdout.split()
        assert done.returncode == 0, done.stderr
        assert "season_page" in names and (folder == here or not any(n.startswith("op1_") or n == "pipeline" for n in names))
