"""Every catalogue query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from orrery.catalog import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, tmp_path, name):
    out = tmp_path / name
    QUERIES[name](spark, str(SF)).write.parquet(str(out))
    want = duck.execute(f"DESCRIBE {ORACLES[name]}").fetchall()
    columns = ", ".join(f'"{r[0]}"' for r in want)
    for a, b in ((f"({ORACLES[name]})", f"'{out}/*.parquet'"), (f"'{out}/*.parquet'", f"({ORACLES[name]})")):
        assert duck.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
