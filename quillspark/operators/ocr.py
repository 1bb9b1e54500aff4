"""Words of character recognition to page and document text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: words below this confidence are dropped.
LEAST_CONFIDENCE = 40.0


def regroup(words: DataFrame, page_keys: list[str]) -> DataFrame:
    """(page_keys, text): words of enough confidence by line, paragraph and block, in order.

    Words join by spaces, lines by line feeds, paragraphs by blank lines. Confidence that is no number counts as -1.
    One shuffle, by page: a page's words are bounded by the page, and come from one sorted array, in which each word knows
    by the one before whether a line or paragraph begins.
    """
    kept = words.select(*page_keys, "block_num", "par_num", "line_num", "pos", F.regexp_replace("text", r"^[\s\x{A0}]+|[\s\x{A0}]+$", "").alias("text"), F.coalesce(F.expr("try_cast(conf AS double)"), F.lit(-1.0)).alias("conf"))
    kept = kept.where((F.col("text") != "") & (F.col("conf") >= LEAST_CONFIDENCE))
    place = ("block_num", "par_num", "line_num")
    page = kept.groupBy(*page_keys).agg(F.array_sort(F.collect_list(F.struct(*place, "pos", "text"))).alias("w"))

    def joined(word: Column, at: Column) -> Column:
        before = F.get(F.col("w"), at - 1)
        paragraph = (before["block_num"] == word["block_num"]) & (before["par_num"] == word["par_num"])
        between = F.when(at == 0, "").when(paragraph & (before["line_num"] == word["line_num"]), " ").when(paragraph, "\n").otherwise("\n\n")
        return F.concat(between, word["text"])

    return page.select(*page_keys, F.array_join(F.transform("w", joined), "").alias("text"))


def join_pages(pages: DataFrame, key: str, page_no: str, text: str) -> DataFrame:
    """A2: (key, text): a document's pages in order, empty ones left out, joined by blank lines."""
    full = pages.where(F.coalesce(F.col(text), F.lit("")) != "")
    return full.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page_no, text))), lambda x: x[text]), "\n\n").alias("text"))
