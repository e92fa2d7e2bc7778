"""The opN_ queries that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from orrery.llm.queries import QUERIES
from orrery.llm.sql import ORACLES

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, tmp_path, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    QUERIES[name](spark, str(SF)).write.parquet(str(tmp_path / "out"))
    con.execute(f"CREATE TABLE want AS {ORACLES[name]}")
    columns = ", ".join(f'"{r[0]}"' for r in con.execute("DESCRIBE want").fetchall())
    got = f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'"
    assert con.execute(f"SELECT {columns} FROM want EXCEPT ALL {got}").fetchall() == []
    assert con.execute(f"{got} EXCEPT ALL SELECT {columns} FROM want").fetchall() == []
