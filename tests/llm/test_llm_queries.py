"""The queries have the columns that their results are compared by, and equal their SQL."""

from __future__ import annotations

from pathlib import Path

import pytest

from millrace.llm import queries as q

COLUMNS = {
    "p1_found": ["item_kind", "item_id"], "p2_found": ["plan_id", "disaster_type", "q_type"], "p3_found": ["qa_id", "item_id"],
    "p4_found": ["result_id", "field_name", "defect"], "p5_found": ["id_a", "id_b"], "p6_found": ["result_id", "field_name"],
    "p8_found": ["passage_id", "doc_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", q.queries())
def test_query(spark, data, name):
    df = q.queries()[name](spark, data)
    rows = [tuple(map(repr, r)) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]


@pytest.mark.parametrize("name", q.oracle_sql())
def test_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    df = q.queries()[name](spark, data)
    result = con.execute(q.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*names).collect())
