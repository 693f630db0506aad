import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from cairn.functions import codec
from cairn.operators import store
from cairn.plans.files import files
from cairn.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return sorted(tuple(map(repr, r)) for r in zip(*(table[n].to_pylist() for n in names), strict=True)), names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, small, name):
    assert rows(QUERIES[name](spark, small).toArrow()) == rows(duck.sql(ORACLES[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, small, name):
    df = QUERIES[name](spark, small)
    out = df.collect()
    if name == "r_blake3":
        rows = files(spark, small, content=True).filter("text IS NOT NULL").select("doc_id", "delta", "cid", "len", F.encode("text", "UTF-8").alias("content"))
        raw = {}
        for r in store.archive_parts(store.layout(rows, "delta", "doc_id")).collect():
            raw.setdefault(r["delta"], {})[r["no"]] = bytes(r["raw"])
        assert {r["delta"]: r["digest"] for r in out} == {d: codec.blake3(b"".join(p[i] for i in sorted(p))).hex().upper() for d, p in raw.items()}
    assert out and all(r["same"] for r in out if "same" in df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
