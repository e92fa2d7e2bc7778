"""Model answers of every shape, and the table function over feeds."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from orrery.operators import sanitize
from orrery.sources import feeds
from orrery.sources.variants import feed_variants, variants_of_feeds


def test_only_what_the_text_shows_stays(spark):
    answer = {
        "style_tags": [{"tag": "rustic", "sources": []}, {"tag": "coastal"}, {"tag": "luxury", "sources": ["f1", "img1"]}, {"tag": "modern", "sources": "img1"}, {"tag": "classic", "sources": ["img1"]}, {"tag": 5}, "rustic", None],
        "feature_bullets": [" Frost-resistant ", "Waterproof", "As of IS 15622", "Lasts 12 years", "Guaranteed", "a", "b", "c", "d", "e", None, {"x": 1}],
        "search_keywords": ["Tile", "TILE ", "", 4, None, *"abcdefgh"],
        "vision": {"pattern": {"value": "GEOMETRIC"}, "surface_look": {"value": 3}, "material_appearance": "wood"},
    }
    rows = [(1, json.dumps(answer), "An antique slab, frost proof, IS15622, 12 mm"), (2, "not json", "x"), (3, None, None), (4, "[1]", "x"), (5, '{"vision": 1, "style_tags": {"tag": "modern"}}', "so sleek")]
    got = {r.id: r for r in sanitize.sanitized(spark.createDataFrame(rows, "id int, answer string, text string")).collect()}
    assert [tuple(t) for t in got[1].style_tags] == [("rustic", "evidence"), ("luxury", "img1"), ("modern", "img1")]
    assert got[1].feature_bullets == ["Frost-resistant", "As of IS 15622", "Lasts 12 years", "a", "b"] or got[1].feature_bullets == ["Frost-resistant", "Lasts 12 years", "a", "b", "c"]
    assert got[1].search_keywords == ["tile", *"abcdefg"]
    assert (got[1].pattern, got[1].surface_look, got[1].material_appearance) == ("GEOMETRIC", None, None)
    for k in (2, 3, 4):
        assert (got[k].style_tags, got[k].feature_bullets, got[k].search_keywords, got[k].pattern) == ([], [], [], None)
    assert [tuple(t) for t in got[5].style_tags] == [("modern", "evidence")]


def test_table_function_gives_the_feeds_rows(spark):
    body = {"products": [{"id": 1, "title": "Oak", "handle": "oak", "product_type": "wood", "images": [{"src": "p.jpg"}], "variants": [{"id": 11, "title": "Default Title", "sku": "", "price": "1,010.50"}, {"id": 12, "title": "Large", "sku": "L", "price": "20", "featured_image": {"src": "v.jpg"}}, {"id": 13, "title": "Free", "sku": "F", "price": "0.00"}, {"id": 14, "price": "n/a"}]}, {"id": 2, "title": "Bare"}]}
    pages = spark.createDataFrame([("a.com", json.dumps(body)), ("b.com", "not json"), ("c.com", None), ("d.com", "[1]"), ("e.com", '{"products": 3}')], "domain string, body string")
    names = ("sku", "title", "category", "price_inr", "image_url")
    got = variants_of_feeds(pages, *names)
    assert got.columns == ["domain", *names] and sorted(map(tuple, got.collect())) == sorted(map(tuple, feeds.shopify_variants(pages).select("domain", *names).collect()))
    spark.udtf.register("feed_variants", feed_variants)
    assert spark.sql("SELECT * FROM feed_variants('{}')").columns[-1] == "position"
    with pytest.raises(ValueError, match="colour"):
        variants_of_feeds(pages, "colour")
    with pytest.raises(Exception, match="no field"):
        spark.sql("SELECT * FROM feed_variants('x', 'colour')").collect()
    assert pages.select(F.count("*")).first()[0] == 5
