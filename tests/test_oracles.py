"""Every registered query against its SQL in DuckDB, on whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = entry_module.queries()[name](spark, sf_dir)
    rows, cols = df.collect(), df.columns
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = duck.execute(sql)
    sql_types = {d[0]: str(d[1]) for d in cur.description}
    sql_cols = list(sql_types)
    want = cur.fetchall()
    assert sorted(cols) == sorted(sql_cols)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == sql_types
    got = sorted((tuple(plain(r[c]) for c in sorted(cols)) for r in rows), key=repr)
    assert got == sorted((tuple(plain(r[sql_cols.index(c)]) for c in sorted(cols)) for r in want), key=repr)


def test_entry_gives_rows(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
