"""Every query of the catalogue equals its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from millrace.plans import catalogue


@pytest.fixture(scope="module")
def sql(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in Path(data).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, data, sql, name):
    df = catalogue.queries()[name](spark, data)
    names = sorted(df.columns)
    rows = sorted(repr([plain(v) for v in r]) for r in df.select(*names).collect())
    if name in catalogue.oracle_sql():
        result = sql.execute(catalogue.oracle_sql()[name])
        at = [c[0] for c in result.description]
        assert sorted(at) == names
        assert rows == sorted(repr([plain(r[at.index(n)]) for n in names]) for r in result.fetchall())


def test_entry(spark, data):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["lang", "n_chunks", "n_docs", "avg_len"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_subpackage():
    root = Path(catalogue.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if root / "llm" not in path.parents:
            assert "llm" not in [w for line in path.read_text().splitlines() if line.lstrip().startswith(("import ", "from ")) for w in line.replace(".", " ").split()]
