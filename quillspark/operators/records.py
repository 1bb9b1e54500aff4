"""Keyed records: longest per id, first per key, upsert, lookups of a small dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of a record that go with its vector.
CANON_METADATA = ("canon_number", "libro", "parte", "sezione", "titolo", "capitolo", "articolo", "hierarchy_path", "source_url", "in_force_note")


def canon_id() -> Column:
    """chunk_id, or one made of canon_number (``None`` where that is missing too)."""
    return F.coalesce(F.nullif("chunk_id", F.lit("")), F.concat(F.lit("CIC-it-"), F.coalesce("canon_number", F.lit("None"))))


def text_to_embed() -> Column:
    """embed_text, or text, or the empty string."""
    return F.coalesce(F.nullif("embed_text", F.lit("")), F.col("text"), F.lit(""))


def sanitise(df: DataFrame, fields: Sequence[str] = CANON_METADATA) -> DataFrame:
    """P10: nulls of ``fields`` as empty strings."""
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in fields})


def keep_longest(df: DataFrame, key: Column, size: Column, position: str) -> DataFrame:
    """Per key the row of the greatest size, the first of equals; with ``first_seen``, the key's least position,
    and ``n_records``. A max over structs, combined before the shuffle, so a hot key is one row per task."""
    row = F.struct(*(F.col(c) for c in df.columns))
    best = df.select(key.alias("__key"), F.struct(size.alias("size"), (-F.col(position)).alias("place")).alias("__rank"), row.alias("__row"), F.col(position).alias("__at"))
    won = best.groupBy("__key").agg(F.max_by("__row", "__rank").alias("row"), F.min("__at").alias("first_seen"), F.count("*").alias("n_records"))
    return won.select(F.col("__key").alias("key"), "row.*", "first_seen", "n_records")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the first row by ``order`` (ties by all columns); combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    tie = [c for c in rest if c not in order]
    won = df.groupBy(*keys).agg(F.min(F.struct(*order, *tie)).alias("first"))
    return won.select(*keys, *(F.col("first")[c].alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K1: rows of ``new`` replace those of ``old`` with their key; other rows of ``old`` stay. Of repeated keys in
    ``new`` the greatest row wins."""
    return keep_one(new, key).unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def keep_one(df: DataFrame, key: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(*rest)).alias("row")).select(key, *(F.col("row")[c].alias(c) for c in rest))


def lookup_code(df: DataFrame, languages: DataFrame, name: str, strict: bool = True) -> DataFrame:
    """``code`` of a language's name, whatever its case; unknown names fail (or give null, if not ``strict``).

    The dimension has a row per language, so its side is broadcast.
    """
    small = languages.select(F.lower("name").alias("__name"), F.col("code").alias("__code")).dropDuplicates(["__name"])
    joined = df.join(F.broadcast(small), F.lower(F.trim(name)) == F.col("__name"), "left").drop("__name")
    code = F.col("__code")
    if strict:
        code = F.when(F.col(name).isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(code, F.raise_error(F.concat(F.lit("unknown language: "), F.col(name))).cast("string")))
    return joined.withColumn("code", code).drop("__code")
