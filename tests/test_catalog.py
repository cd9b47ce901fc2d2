"""Every registered query of the engine against its SQL oracle in DuckDB."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from lanternql import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = (*catalog.TABLES, "embeddings", "labels")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_oracle(name, spark, duck):
    df = catalog.queries()[name](spark, FOLDER)
    relation = duck.sql(catalog.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(relation.columns)
    mine = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    at = [relation.columns.index(c) for c in order]
    assert mine == sorted(([plain(r[i]) for i in at] for r in relation.fetchall()), key=repr)


def test_entry_imports():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_llm_import():
    """Nothing outside the subpackage imports it."""
    import lanternql

    root = Path(lanternql.__file__).parent
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "lanternql.llm" not in file.read_text(), file


def test_import_without_session():
    """The driver reads the names before it has a session."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, check=True).stdout.split()
