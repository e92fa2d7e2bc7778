"""A table function over product feeds whose columns are named by the caller: SELECT ... FROM pages, LATERAL feed_variants(body, 'sku', 'price_inr')."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Fields that can be asked for, and their types.
FIELDS: dict[str, T.DataType] = {"sku": T.StringType(), "title": T.StringType(), "category": T.StringType(), "price_inr": T.DoubleType(), "image_url": T.StringType(), "handle": T.StringType(), "position": T.IntegerType()}


def _price(raw: Any) -> float | None:
    try:
        value = float(str(raw).replace(",", ""))
    except ValueError:
        return None
    return value if 0 < value < float("inf") else None


class _Variants:
    """One row per priced variant of a /products.json body, with the fields asked for; a body that is no feed has none."""

    def __init__(self, result: AnalyzeResult | None = None):
        self.names = result.schema.names if result is not None else list(FIELDS)

    @staticmethod
    def analyze(body: AnalyzeArgument, *fields: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(body.dataType, T.StringType):
            raise ValueError("feed_variants: the first argument is a feed's body as text")
        names = [f.value for f in fields] or list(FIELDS)
        if unknown := [n for n in names if n not in FIELDS]:
            raise ValueError(f"feed_variants: no field {unknown[0]!r}; there are {', '.join(FIELDS)}")
        return AnalyzeResult(T.StructType([T.StructField(n, FIELDS[n]) for n in names]))

    def eval(self, body: str | None, *_: str) -> Iterator[tuple]:
        try:
            products = json.loads(body or "").get("products")
        except (ValueError, AttributeError):
            return
        for product in products if isinstance(products, list) else ():
            images = product.get("images") or [{}]
            for at, v in enumerate(product.get("variants") or ()):
                price = _price(v.get("price"))
                if price is None:
                    continue
                plain = v.get("title") in (None, "Default Title")
                row = {
                    "sku": v.get("sku") or f"shopify-{v.get('id')}", "title": product.get("title") if plain else f"{product.get('title')} - {v['title']}", "category": product.get("product_type"), "price_inr": price,
                    "image_url": (v.get("featured_image") or {}).get("src") or images[0].get("src"), "handle": product.get("handle"), "position": at,
                }
                yield tuple(row[n] for n in self.names)


feed_variants = udtf(_Variants)


def variants_of_feeds(pages: DataFrame, *fields: str) -> DataFrame:
    """domain and the fields of every priced variant of pages (domain, body)."""
    spark: SparkSession = pages.sparkSession
    spark.udtf.register("feed_variants", feed_variants)
    asked = "".join(f", '{f}'" for f in fields if f in FIELDS or _refuse(f))
    return spark.sql(f"SELECT p.domain, v.* FROM {{pages}} p, LATERAL feed_variants(p.body{asked}) v", pages=pages)


def _refuse(field: str) -> bool:
    raise ValueError(f"no field {field!r}")
