"""The planner pass: where its work is done, and its groups on awkward rows."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

import pytest

from orrery.operators.resolve import with_group
from orrery.plans.flywheel import pass_over, prepared
from orrery.relations import NOW, relation

SF = Path("/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("fill", [False, True])
def test_patterns_wait_until_rows_are_dealt(spark, fill):
    """A small file is one split: rules and keys come behind the join, the filling behind a deal; prices are aggregated once."""
    text = plan(prepared(relation(spark, str(SF), "product"), relation(spark, str(SF), "price"), NOW, fill=fill))
    late, early = text.split("RoundRobinPartitioning" if fill else "Join", 1)
    assert "mattress" in late and "sha1" in late
    assert not any(x in early for x in ("mattress", "sha1", "regexp"))
    assert text.count("l_shipdate#") and text.count("FileScan parquet [l_") == 1


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_group_keys_wait_until_rows_are_dealt(spark):
    for early in plan(with_group(relation(spark, str(SF), "product"))).split("RoundRobinPartitioning")[1:]:
        assert "sha1" not in early.split("Exchange")[0] and "regexp" not in early.split("Exchange")[0]


def test_groups_of_the_pass(spark):
    """Nulls, titles of one word, groups of one, equal times, products without a price and prices without a product."""
    columns = "id long, supplier_domain string, brand string, title string, category string, size_mm string, finish string, price_unit string, coverage_sqft_per_box double, image_url string, source_url string"
    rows = [(1, "Acme", "Dual Comfort", "sofas"), (2, "acme", "dual-comfort!", None), (3, "Acme", "Alone here", "sofas"), (4, "Acme", "Lone", "sofas"), (5, "Acme", "Lone", "tile"), (6, None, None, None), (7, None, "two words", "tile"), (8, None, "two words 20 mm", "paint"), (None, "Acme", "dual comfort", "sofas")]
    products = spark.createDataFrame([(i, "a.com", b, t, c, None, None, None, None, None, "https://a.com") for i, b, t, c in rows], columns)
    old, new = datetime(2001, 1, 1), datetime(2001, 11, 1)
    seen = [(1, 9.0, old, 1), (1, 5.0, new, 1), (1, 6.0, new, 0), (2, 300.0, new, 1), (7, None, new, 1), (7, 2.0, None, 1), (8, 3.0, old, 1), (99, 1.0, new, 1)]
    prices = spark.createDataFrame([(*r, "A", None, 1, 1) for r in seen], "product_id long, price_inr double, observed_at timestamp_ntz, supplier long, basis string, source_url string, order_key long, line int")
    done = pass_over(products, prices, NOW)
    told = {r.key: r.value for r in done.metrics.collect()}
    assert (told["total"], told["groups"], told["grouped_products"], told["suspect_variant_groups"]) == (9, 2, 5, 2)
    got = {r.id: r for r in done.products.collect()}
    assert {i: got[i].last_price for i in got} == {1: 6.0, 2: 300.0, 8: 3.0} | dict.fromkeys([3, 4, 5, 6, 7, None])
    gid = {i: got[i].variant_group_id for i in got}
    assert gid[1] == gid[2] == gid[None] != gid[7] == gid[8] and None not in (gid[1], gid[7]) and not any(gid[i] for i in (3, 4, 5, 6))
    assert sorted((r.ncat, r.mn, r.mx, r.n) for r in done.groups.collect()) == [(1, 6.0, 300.0, 3), (2, 3.0, 3.0, 2)]
