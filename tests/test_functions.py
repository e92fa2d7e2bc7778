"""Facts about attribute, contact, url and page functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.functions import web
from orrery.operators.attributes import boxes
from orrery.operators.quality import classify


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "size"),
    [("600x600 mm tile", "600x600"), ("60 x 30 cm", "600x300"), ("8x4 ft sheet", "2438x1219"), ("24x24 inch", "610x610"), ("tile 600x1200", "600x1200"), ("set of 2 x 3", None), ("8x4", None), ("600x600x10mm", "600x600"), ("", None), (None, None)],
)
def test_size(spark, text, size):
    assert one(spark, T.size_mm(F.col("t")), t=text) == size


@pytest.mark.parametrize(("text", "mm"), [("ply 18 mm", 18.0), ("600x600 mm", None), ("tile 600x600 mm, 9.5 mm thick", 9.5), ("500 mm wide", None)])
def test_thickness(spark, text, mm):
    assert one(spark, T.thickness_mm(F.col("t")), t=text) == mm


@pytest.mark.parametrize(("text", "finish"), [("High-Gloss white", "High Gloss"), ("glossy", "Glossy"), ("matt black", "Matte"), ("mattress", None), ("lappato gloss", "Lapato")])
def test_finish(spark, text, finish):
    assert one(spark, T.finish(F.col("t")), t=text) == finish


@pytest.mark.parametrize(("text", "colour"), [("Teak on snow", "Teak"), ("snow teak", "Snow White"), ("GRAY wall", "Grey"), ("tangent", None)])
def test_colour_is_leftmost(spark, text, colour):
    assert one(spark, T.colour(F.col("t"))[0], t=text) == colour


@pytest.mark.parametrize(
    ("category", "title", "node"),
    [("laminates|acrylic|cladding", "", "Laminates"), ("sofas|phone booths|recliners", "", "Sofas & Lounge"), ("office plants|planters", "", "Plants & Planters"), ("misc", "oak table", "Desks & Tables"), ("", None, "Unclassified"), ("textile", "", "Tiles")],
)
def test_classify(spark, category, title, node):
    assert one(spark, classify(F.col("c"), F.col("t"))["category_std"], c=category, t=title) == node


@pytest.mark.parametrize(("area", "cover", "waste", "n"), [(100.0, 15.0, 0.1, 8), (50.0, 11.0, 0.1, 5), (100.0, 15.0, 0.0, 7), (10.0, 0.0, 0.1, None), (-1.0, 5.0, 0.1, None)])
def test_boxes(spark, area, cover, waste, n):
    assert one(spark, boxes(F.col("a"), F.col("c"), F.col("w")), a=area, c=cover, w=waste) == n


def test_title_case(spark):
    assert one(spark, T.title_case(F.col("t")), t="new-delhi o'neil 2nd") == "New-Delhi O'Neil 2Nd"


def test_sanitize(spark):
    assert one(spark, T.sanitize(F.col("t")), t=" <b>A &amp;  B</b> ") == "A & B"
    assert one(spark, T.sanitize(F.col("t")), t="<br>") is None


def test_contacts(spark):
    text = "Mail SALES@Acme.in or x@example.com, logo@2x.png; call +91 9876543210 or 98765432101"
    assert one(spark, F.array_join(T.emails(F.col("t")), "|"), t=text) == "sales@acme.in"
    assert one(spark, F.array_join(T.mobiles(F.col("t")), "|"), t=text) == "9876543210"


def test_positive_price(spark):
    assert [one(spark, T.positive_price(F.col("t")), t=x) for x in ("1,200.50", "0", "0.00", "", "n/a", None)] == [1200.5, None, None, None, None, None]


def test_urls(spark):
    url = "https://user@WWW.Acme.com:8080/products/Oak-Table/?a=/b#c"
    assert one(spark, web.domain(F.col("u")), u=url) == "acme.com"
    assert one(spark, web.url_slug(F.col("u")), u=url) == "Oak-Table"
    assert one(spark, web.url_slug(F.col("u")), u="https://acme.com") is None


def test_page(spark):
    html = '<html><meta content="T" property="og:title"><style>x{}</style><h1> A <b>B</b></h1><a class=k href="/x">x</a></html>'
    assert one(spark, web.tag_text(F.col("h"), "h1"), h=html) == "A B"
    assert one(spark, web.meta(F.col("h"), "og:title"), h=html) == "T"
    assert one(spark, F.array_join(web.links(F.col("h")), "|"), h=html) == "/x"
    assert one(spark, web.strip_tags(F.col("h")), h=html) == "A B x"


def test_tags(spark):
    evidence = {"bath": ("bathroom",), "outdoor": ("garden", "terrace"), "wall": ("wall",)}
    assert one(spark, F.array_join(T.tags(F.col("t"), evidence, 2), "|"), t="Wall tile for terrace and BATHROOM") == "bath|outdoor"
    assert one(spark, F.array_join(T.tags(F.col("t"), evidence), "|"), t=None) == ""
