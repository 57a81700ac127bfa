"""Every query that has SQL gives the same rows in DuckDB over the same files."""

import math

import duckdb
import pytest

from codestrata import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EMPTY_HERE = {"search_record_detail", "search_filter_only"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in duck.description]
    assert sorted(names) == columns
    wanted = ordered([tuple(plain(r[names.index(c)]) for c in columns) for r in duck.fetchall()])
    assert found == wanted


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    df = catalog.queries()[name](spark, DATA)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()
