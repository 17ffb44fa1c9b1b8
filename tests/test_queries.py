"""Every query with SQL gives the SQL's rows on the smallest data."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.4f}".rstrip("0").rstrip(".").replace("-0", "0") if abs(float(v)) < 1e-9 else f"{float(v):.4f}".rstrip("0").rstrip(".")
    return "[" + ",".join(map(value, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def own(names):
    return sorted(n for n in names if not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", own(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    got = sorted(tuple(value(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(value(r[cols.index(c)]) for c in order) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_subpackage(tmp_path):
    """The rest imports and lists its queries when the training-data folders are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "tradeflow", tmp_path / "tradeflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q), len(q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
