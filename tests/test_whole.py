"""Queries over all rows of tables that are larger than the oracles' smallest ones."""

from __future__ import annotations

from pathlib import Path

import pytest

from orrery.catalog import QUERIES
from orrery.operators.dealers import distinct_dealers
from orrery.relations import relation

BASE = Path("/root/testdata")
SF = str(BASE / "sf0.1")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_every_supplier_is_there(spark):
    n = spark.read.parquet(f"{SF}/supplier.parquet").count()
    s = relation(spark, SF, "supplier")
    assert s.count() == s.select("domain").distinct().count() == n > 100
    assert QUERIES["supplier_detail"](spark, SF).count() == n
    assert QUERIES["catalog_stats"](spark, SF).first().active == s.filter("status = 'active'").count() == sum(k % 7 != 0 for k in range(n))
    assert {r.n for r in QUERIES["coverage_report"](spark, SF).groupBy("facet").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {n}


def test_dealers_differ_by_name(spark):
    n = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert QUERIES["store_dealers"](spark, SF).count() == n  # no two customers have one name
    rows = [(1, "d", "A", "x", None), (2, "d", "B", "x", None), (3, "d", " <b>A</b> ", "x", ""), (4, "d", "A", "x", "1"), (5, "d", "A", None, None), (6, "d", None, "x", "1"), (7, "e", "A", "x", None)]
    got = distinct_dealers(spark.createDataFrame(rows, "id long, supplier_domain string, name string, city string, pincode string"))
    assert sorted(r.id for r in got.collect()) == [1, 2, 4, 7]


def test_similar_items_grow_with_the_table(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = QUERIES["similar_items_by_hundred"](spark, SF).groupBy("id").count().collect()
    assert {r.id for r in got} == {r.vec_id for r in e.filter("vec_id % 100 = 0").select("vec_id").collect()} and {r["count"] for r in got} == {6}
