"""Queries against their SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from cairn.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    done = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[names.index(c)] for c in columns]) for r in done.fetchall())
