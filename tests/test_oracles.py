"""Each query against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from cairn.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted(str([repr(float(v)) if type(v).__name__ == "Decimal" else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = plain([r[c] for c in columns] for r in df.collect())
    done = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    want = plain([r[names.index(c)] for c in columns] for r in done.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
