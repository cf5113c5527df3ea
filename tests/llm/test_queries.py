"""The queries of this subpackage, against their SQL where SQL can express them."""

import os

import pytest

from lodestack.llm import registry
from tests.conftest import DATA

duckdb = pytest.importorskip("duckdb")
COLUMNS = {
    "p1_found": ["path_a", "path_b"], "p4_found": ["tab", "rec_key"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "kind", "start_pos"],
}


@pytest.fixture(scope="module")
def base():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(DATA):
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    return db


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, base, name):
    frame = registry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    assert len(set(columns)) == len(columns) and frame.columns == COLUMNS.get(name, frame.columns)
    got = sorted(repr(tuple(r)) for r in frame.select(*columns).collect())
    sql = registry.oracles().get(name)
    if sql is None:
        assert got or name == "p6_similar"  # this small corpus may have no leak
        return
    result = base.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
