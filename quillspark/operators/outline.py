"""Slide outlines: normalising a model's JSON, and slide rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.quality import is_rtl
from quillspark.functions.text import strip, strip_fences

# What stands for a missing heading and title.
HEADING, TITLE = "Untitled", "Untitled Presentation"


def normalise(raw: Column) -> Column:
    """Struct (title, subtitle, slides of heading and bullets), null if no slide is left.

    Slides that are no objects go; headings and bullets are stripped, a JSON null heading reads ``None``; a slide stays if
    it has a heading or a bullet.
    """
    doc = F.try_parse_json(strip_fences(raw))
    slides = F.try_variant_get(doc, "$.slides", "array<variant>")

    def slide(v: Column) -> Column:
        found = F.try_variant_get(v, "$.heading", "variant")
        heading = F.when(found.isNull(), F.lit("")).when(F.is_variant_null(found), F.lit("None")).otherwise(F.coalesce(F.try_variant_get(found, "$", "string"), F.to_json(found)))
        items = F.coalesce(F.try_variant_get(v, "$.bullets", "array<variant>"), F.array().cast("array<variant>"))
        bullets = F.transform(items, lambda b: strip(F.when(F.is_variant_null(b), F.lit("None")).otherwise(F.coalesce(F.try_variant_get(b, "$", "string"), F.to_json(b)))))
        return F.struct(strip(heading).alias("heading"), F.filter(bullets, lambda b: b != "").alias("bullets"))

    objects = F.filter(slides, lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    kept = F.filter(F.transform(objects, slide), lambda s: (s["heading"] != "") | (F.size(s["bullets"]) > 0))
    filled = F.transform(kept, lambda s: F.struct(F.when(s["heading"] == "", F.lit(HEADING)).otherwise(s["heading"]).alias("heading"), s["bullets"].alias("bullets")))
    text = lambda path, default: F.coalesce(F.nullif(strip(F.try_variant_get(doc, path, "string")), F.lit("")), F.lit(default))
    return F.when(F.size(filled) > 0, F.struct(text("$.title", TITLE).alias("title"), text("$.subtitle", "").alias("subtitle"), filled.alias("slides")))


def slide_rows(outlines: DataFrame, key: str, outline: str) -> DataFrame:
    """K4: (key, slide_no, line_no, text, is_rtl): the title slide, then headings and bullets in order."""
    title = outlines.where(F.col(outline).isNotNull()).select(key, F.lit(0).alias("slide_no"), F.posexplode(F.filter(F.array(F.col(f"{outline}.title"), F.col(f"{outline}.subtitle")), lambda x: x != "")).alias("line_no", "text"))
    body = outlines.select(key, F.posexplode(f"{outline}.slides").alias("at", "slide")).select(key, (F.col("at") + 1).alias("slide_no"), F.posexplode(F.concat(F.array("slide.heading"), F.col("slide.bullets"))).alias("line_no", "text"))
    return title.unionByName(body).withColumn("is_rtl", is_rtl(F.col("text")))
