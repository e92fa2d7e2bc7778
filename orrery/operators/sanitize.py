"""What is kept of a model's answer besides its checked sentences: tags with evidence, bullets that invent nothing, known words.

The answer is read as VARIANT, so that a field of the wrong kind is only missing and never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import jsonld as J
from orrery.operators.enrichment import BANNED, NORM, NUMBER
from orrery.registry import query
from orrery.relations import oracle, relation

# Style tags with the words that show them, and the words that pictures are described by
STYLES = {
    "modern": ("modern", "sleek", "clean line", "clean-line"),
    "contemporary": ("contemporary",),
    "traditional": ("traditional", "ethnic", "heritage", "mughal"),
    "rustic": ("rustic", "distressed", "weathered", "farmhouse", "aged", "antique"),
    "industrial": ("industrial", "concrete look", "concrete-look", "raw ", "loft"),
    "minimalist": ("minimalist", "minimal", "understated", "pared"),
    "scandinavian": ("scandinavian", "nordic", "scandi"),
    "bohemian": ("bohemian", "boho", "eclectic"),
    "coastal": ("coastal", "nautical", "mediterranean"),
    "mid-century": ("mid-century", "mid century", "retro"),
    "art-deco": ("art deco", "art-deco", "deco"),
    "transitional": ("transitional",),
    "classic": ("classic", "timeless", "elegant", "refined"),
    "luxury": ("luxury", "luxe", "premium", "opulent", "royal", "regal", "marble look", "marble-look"),
}
SEEN = {
    "pattern": ("marble", "wood", "stone", "concrete", "terrazzo", "geometric", "floral", "solid", "plain", "abstract", "mosaic", "textile", "metallic", "cement"),
    "surface_look": ("glossy", "matte", "satin", "textured", "structured", "polished", "rustic", "sugar", "lappato", "carving", "honed", "brushed"),
    "material_appearance": ("marble", "granite", "wood", "stone", "concrete", "terrazzo", "metal", "ceramic", "porcelain", "glass", "fabric", "leather", "laminate", "quartz"),
}
TAGS, BULLETS, KEYWORDS = 3, 5, 8


def _string(v: Column) -> Column:
    """A JSON string, trimmed; null for anything else and for blanks."""
    return F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit("")))


def style_tags(answer: Column, text: Column) -> Column:
    """array<struct<tag, source>>: known tags that the text shows ('evidence') or that cite the image ('img1')."""
    low = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    shown = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(tag)) for tag, words in STYLES.items()]))
    items = F.transform(J.listed(J.at(answer, "style_tags")), lambda i: F.struct(_string(J.at(i, "tag")).alias("tag"), F.exists(J.listed(J.at(i, "sources")), lambda s: F.coalesce(_string(s) == "img1", F.lit(False))).alias("image")))
    known = F.filter(items, lambda i: i["tag"].isin(*STYLES) & (F.array_contains(shown, i["tag"]) | i["image"]))
    return F.slice(F.transform(known, lambda i: F.struct(i["tag"].alias("tag"), F.when(F.array_contains(shown, i["tag"]), "evidence").otherwise("img1").alias("source"))), 1, TAGS)


def bullets(answer: Column, text: Column) -> Column:
    """Bullets whose numbers, standards and claims the text has too."""
    said, low = F.coalesce(text, F.lit("")), F.lower(F.coalesce(text, F.lit("")))
    tight = lambda x: F.lower(F.replace(x, F.lit(" "), F.lit("")))

    def honest(b: Column) -> Column:
        numbers = F.forall(F.regexp_extract_all(b, F.lit(NUMBER), F.lit(0)), lambda n: F.contains(said, n))
        norms = F.forall(F.regexp_extract_all(b, F.lit(NORM), F.lit(0)), lambda n: F.contains(tight(said), tight(n)))
        claims = F.lit(True)
        for phrase, need in BANNED.items():
            claims &= ~F.contains(F.lower(b), F.lit(phrase)) | (F.contains(low, F.lit(need)) if need else F.lit(False))
        return numbers & norms & claims

    return F.slice(F.filter(F.transform(J.listed(J.at(answer, "feature_bullets")), _string), lambda b: b.isNotNull() & honest(b)), 1, BULLETS)


def keywords(answer: Column) -> Column:
    """Keywords in lower case, each once, in order."""
    return F.slice(F.array_distinct(F.array_compact(F.transform(J.listed(J.at(answer, "search_keywords")), lambda k: F.lower(_string(k))))), 1, KEYWORDS)


def seen(answer: Column, name: str) -> Column:
    """A word for what the picture shows, 'unknown' if it is not one of SEEN, null if the answer says nothing."""
    value = _string(J.at(J.at(J.at(answer, "vision"), name), "value"))
    return F.when(F.lower(value).isin(*SEEN[name]), value).when(value.isNotNull(), "unknown")


def sanitized(answers: DataFrame, answer: str = "answer", text: str = "text") -> DataFrame:
    """Adds style_tags, feature_bullets, search_keywords, pattern, surface_look, material_appearance to (answer as JSON, text).

    An answer that is no JSON object gives empty lists and nulls.
    """
    read = answers.withColumn("_answer", F.try_parse_json(F.col(answer)))
    v, t = F.col("_answer"), F.col(text)
    return read.select(*answers.columns, style_tags(v, t).alias("style_tags"), bullets(v, t).alias("feature_bullets"), keywords(v).alias("search_keywords"), *[seen(v, n).alias(n) for n in SEEN])


@query(oracle("product", """SELECT id, CASE id % 6 WHEN 0 THEN CASE WHEN id % 4 = 0 THEN 'modern:evidence|rustic:img1' ELSE 'rustic:img1' END ELSE '' END AS style, CASE id % 6 WHEN 1 THEN concat('Sturdy build|Made in batch ', CAST(id AS VARCHAR)) ELSE '' END AS bullets,
  CASE id % 6 WHEN 1 THEN 'none' WHEN 2 THEN 'tile|wood|a|b|c|d|e|f' ELSE '' END AS keywords, CASE id % 6 WHEN 3 THEN 'Marble' END AS pattern, CASE id % 6 WHEN 3 THEN 'unknown' END AS surface_look, CASE id % 6 WHEN 3 THEN 'wood' END AS material_appearance FROM product"""))
def sanitize_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per product, in six shapes: tags, bullets, keywords, vision, broken, a list."""
    i = F.col("id")
    shapes = (
        F.lit('{"style_tags":[{"tag":"modern","sources":["f1"]},{"tag":"rustic","sources":["img1"]},{"tag":"weird","sources":["img1"]},{"tag":"bohemian","sources":["f2"]},"coastal"]}'),
        F.concat(F.lit('{"feature_bullets":["  Lasts 98765432 years ","Sturdy build","",7,"World-class look","Waterproof","By ISO 99999999","Made in batch '), i.cast("string"), F.lit('"],"search_keywords":"none"}')),
        F.lit('{"search_keywords":[" Tile ","tile","",5,"Wood","a","b","c","d","e","f","g"]}'),
        F.lit('{"vision":{"pattern":{"value":"Marble"},"surface_look":{"value":"shiny"},"material_appearance":{"value":"wood"}}}'),
        F.lit("{broken"),
    )
    answer = F.lit('["style_tags"]')
    for k, body in enumerate(shapes):
        answer = F.when(i % 6 == k, body).otherwise(answer)
    text = F.concat(F.lit("Panel number "), i.cast("string"), F.when(i % 4 == 0, " in a MODERN way").otherwise(""))
    out = sanitized(relation(spark, sf_dir, "product").select("id", answer.alias("answer"), text.alias("text")))
    tags = F.array_join(F.transform("style_tags", lambda t: F.concat(t["tag"], F.lit(":"), t["source"])), "|")
    return out.select("id", tags.alias("style"), F.array_join("feature_bullets", "|").alias("bullets"), F.array_join("search_keywords", "|").alias("keywords"), "pattern", "surface_look", "material_appearance")
