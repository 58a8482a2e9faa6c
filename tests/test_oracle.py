"""Oracle parity: every registered query with SQL matches DuckDB at sf0.01."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from kerbside.plans import registry
from tests.conftest import SF001, SF0001
from tests.oracle_compare import compare, duck

# Spark simple type → DuckDB type name
DUCK_TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE", "boolean": "BOOLEAN",
}

# the library's own queries; those of optional subpackages have their own tests
QUERIES = {n: q for n, q in entry.queries().items() if n in registry.QUERIES}
ORACLES = {n: q for n, q in entry.oracle_sql().items() if n in QUERIES}


def test_every_query_has_a_callable():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 40


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    df = QUERIES[name](spark, SF001)
    s, d, *_ = compare(df, ORACLES[name], SF001)
    assert s[1] == d[1], f"columns differ: {s[1]} vs {d[1]}"
    assert s[0] == d[0], f"row counts differ: {s[0]} vs {d[0]}"
    assert s[2] == d[2], "values differ"
    spark_types = {f.name: DUCK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    duck_types = {r[0]: r[1] for r in duck(SF001).execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    assert spark_types == duck_types


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_smoke(spark):
    """The flagship on sf0.001: every premises' JSON document as line rows."""
    df = entry.entry(spark)
    assert df.columns == ["premises_id", "part", "seq", "sub", "line"]
    s, d, *_ = compare(df, ORACLES["snk8_json_feed_lines"], SF0001)
    assert s == d and s[0] > 0
