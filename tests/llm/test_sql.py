"""What SQL can say of the operators, against DuckDB."""

import duckdb
import pytest

from cairn.llm import catalog


def rows(table):
    names = sorted(table.column_names)
    return sorted(tuple(map(repr, r)) for r in zip(*(table[n].to_pylist() for n in names), strict=True)), names


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, small, name):
    assert rows(catalog.queries()[name](spark, small).toArrow()) == rows(duck.sql(catalog.oracle_sql()[name]).to_arrow_table())
