"""Every core query against its SQL on the smallest data."""

import os

import pytest

import __spark_entry__
from lodestack.queries import registry
from tests.conftest import DATA

duckdb = pytest.importorskip("duckdb")


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
    got = sorted(repr(tuple(r)) for r in frame.select(*columns).collect())
    sql = registry.oracles().get(name)
    if sql is None:
        assert len(got) > 0
        return
    result = base.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    columns = {
        "p2_found": ["volume", "file_reference_number", "parent_file_reference_number", "file_name", "file_attributes"],
        "p3_found": ["tab", "volume", "frn", "status", "top_frn", "node_depth"], "p5_found": ["snapshot_ts", "full_path_lower", "change_kind"],
    }
    for name, wanted in columns.items():
        assert __spark_entry__.queries()[name](spark, DATA).columns == wanted
