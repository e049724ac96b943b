"""Each registered query against its DuckDB SQL."""

import duckdb
import pytest

from terraloom.plans import registry

from .conftest import SF_TEST

TABLES = ("nation", "lineitem", "events", "part", "orders", "customer")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_TEST}/{t}.parquet'")
    return con


def _plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, int | float):
        return round(float(value), 6)
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF_TEST)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    got = _rows(found.columns, [tuple(r) for r in found.collect()])
    assert got == _rows(columns, want.fetchall())
    assert got


def test_every_query_is_listed():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"stream_debounce"}


def test_stream_fires_what_the_batch_finds(spark):
    batch = {tuple(r) for r in registry.queries()["debounce"](spark, SF_TEST).collect()}
    stream = [tuple(r) for r in registry.queries()["stream_debounce"](spark, SF_TEST).collect()]
    assert len(stream) == len(set(stream)) > 0.9 * len(batch)
    assert set(stream) <= batch
