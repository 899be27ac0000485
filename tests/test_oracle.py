"""Every registered query against its SQL on the given tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def _own(names) -> list[str]:
    """The library's own queries; those of the optional subpackage have their own tests."""
    return sorted(n for n in names if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _kind(name: str) -> str:
    groups = {
        "bigint": "int64", "int64": "int64", "integer": "int32", "int32": "int32", "int": "int32",
        "varchar": "string", "string": "string", "boolean": "bool", "timestamp_ntz": "timestamp",
        "timestamp": "timestamp", "double": "double",
    }
    return groups[name.lower()]


@pytest.mark.parametrize("name", _own(contract.queries()))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF)
    want = duck.execute(contract.oracle_sql()[name])
    want_types = {d[0]: _kind(str(d[1])) for d in want.description}
    assert {n: _kind(t) for n, t in got.dtypes} == want_types
    columns = sorted(want_types)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    want_rows = sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
    got_rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert len(got_rows) == len(want_rows)
    assert got_rows == want_rows
    assert got_rows


def test_names_agree():
    assert _own(contract.queries()) == _own(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
