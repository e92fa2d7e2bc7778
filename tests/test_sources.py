"""Feeds on tiny bodies."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from orrery.operators.dealers import company_record
from orrery.operators.prices import first_observations, upsert
from orrery.sources import feeds


def test_shopify(spark):
    body = {"products": [{"id": 1, "title": "Oak", "handle": "oak", "product_type": "wood", "images": [{"src": "p.jpg"}], "variants": [{"id": 11, "title": "Default Title", "sku": "", "price": "10.50"}, {"id": 12, "title": "Large", "sku": "L", "price": "20", "featured_image": {"src": "v.jpg"}}, {"id": 13, "title": "Free", "sku": "F", "price": "0.00"}]}]}
    rows = feeds.shopify_variants(spark.createDataFrame([("a.com", json.dumps(body)), ("b.com", "not json"), ("c.com", None)], "domain string, body string")).orderBy("sku").collect()
    assert [(r.sku, r.title, r.price_inr, r.image_url) for r in rows] == [("L", "Oak - Large", 20.0, "v.jpg"), ("shopify-11", "Oak", 10.5, "p.jpg")]


def test_woo(spark):
    body = [{"id": 5, "name": "Lamp", "sku": "X", "permalink": "u", "prices": {"price": "129900", "currency_minor_unit": 2}, "images": []}, {"id": 6, "name": "Fan", "sku": "", "prices": {"price": "0", "currency_minor_unit": 0}}]
    rows = feeds.woo_products(spark.createDataFrame([("a.com", json.dumps(body))], "domain string, body string")).orderBy("sku").collect()
    assert [(r.sku, r.price_inr) for r in rows] == [("X", 1299.0), ("woo-6", None)]


def test_json_ld(spark):
    ld = json.dumps({"@graph": [{"@type": "WebPage"}, {"@type": "Product", "name": "Tile", "sku": "T1", "offers": {"lowPrice": "45"}}]})
    pages = [("https://a.com/p/1", f'<script type="application/ld+json">{ld}</script>'), ("https://a.com/p/two", "<h1>Plain</h1>"), ("https://a.com/p/3", None)]
    rows = {r.url: r for r in feeds.json_ld_products(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert (rows["https://a.com/p/1"].title, rows["https://a.com/p/1"].price_inr, rows["https://a.com/p/1"].structured) == ("Tile", 45.0, True)
    assert (rows["https://a.com/p/two"].title, rows["https://a.com/p/two"].sku, rows["https://a.com/p/two"].structured) == ("Plain", "two", False)


def test_sitemap(spark):
    xml = '<urlset xmlns="x">' + "".join(f"<url><loc> https://a.com/product/{i} </loc></url>" for i in range(10)) + "<url><loc>https://a.com/about</loc></url><url><loc>https://a.com/product/x.jpg</loc></url></urlset>"
    assert feeds.sitemap_pages(spark.createDataFrame([("a.com", xml), ("b.com", "<loc>https://b.com/product/1</loc><loc>https://b.com/x</loc>")], "domain string, xml string")).groupBy("domain").count().orderBy("domain").collect() == [("a.com", 10), ("b.com", 2)]


def test_seeds(spark):
    a = spark.createDataFrame([("a.com", "A", "one")], "domain string, brand string, notes string")
    b = spark.createDataFrame([("a.com", "B", "two"), ("a.com", "B", "one"), ("b.com", "C", None)], "domain string, brand string, notes string")
    assert [tuple(r) for r in feeds.merge_seeds(a, b).orderBy("domain").collect()] == [("a.com", "A", "one; two"), ("b.com", "C", "")]


def test_registry_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("brand,domain,categories,price_published,scrape_tier,domain_confidence,status,notes\nA,https://www.A.com/,tile,yes,,high,active,n\nB,,x,no,t,low,active,\n")
    assert [(r.domain, r.notes) for r in feeds.registry_csv(spark, str(tmp_path / "r.csv")).collect()] == [("a.com", "n [seed hint: price_published=yes]")]


def test_quarantine(spark):
    good, bad = feeds.quarantine_split(spark.createDataFrame([(1, 5.0), (2, 0.0), (3, None)], "id int, price double"), F.col("price") > 0, "harvest", "price")
    assert [r.id for r in good.collect()] == [1] and bad.count() == 2


def test_upsert_overwrites_by_null_but_keeps_images(spark):
    old = spark.createDataFrame([("a", "t", "i"), ("b", "u", "j")], "sku string, title string, image string")
    new = spark.createDataFrame([("a", None, None), ("c", "w", None)], "sku string, title string, image string")
    assert [tuple(r) for r in upsert(old, new, ["sku"], ["title"], ["image"]).orderBy("sku").collect()] == [("a", None, "i"), ("b", "u", "j"), ("c", "w", None)]


def test_observations_with_null_url_stay(spark):
    rows = [(1, "u", 5.0, "mrp", "2024-01-02", 1, 1), (1, "u", 5.0, "mrp", "2024-01-01", 2, 1), (1, None, 5.0, "mrp", "2024-01-01", 3, 1), (1, None, 5.0, "mrp", "2024-01-01", 3, 1)]
    out = first_observations(spark.createDataFrame(rows, "product_id int, source_url string, price_inr double, basis string, observed_at string, order_key int, line int")).collect()
    assert len(out) == 3 and min(r.observed_at for r in out if r.source_url) == "2024-01-01"


def test_company(spark):
    html = "GSTIN 27ABCDE1234F1Z5 call 9876543210 <script>9876500000</script> Sales@acme.in"
    r = company_record(spark.createDataFrame([("https://acme.in/a", html), ("https://acme.in/b", "info@acme.in")], "url string, html string")).first()
    assert (r.gstin, r.mobiles, r.emails) == ("27ABCDE1234F1Z5", ["9876543210"], ["info@acme.in", "sales@acme.in"])
