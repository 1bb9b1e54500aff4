"""Quality gates over text columns: degeneration, script, direction, language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import strip, words

# Thresholds of the gates.
LEAST_WORDS, LEAST_UNIQUE, LONGEST_RUN, PREFIX = 40, 0.3, 5, 3
LANGUAGE_WORDS, HEBREW_SHARE, RTL_SHARE = 6, 0.15, 0.30
# Languages that detectors take for one another.
EQUIVALENT = {"he": ("he", "yi"), "ar": ("ar", "fa", "ur", "ps")}
# Suffixes that character recognition reads, and those that are shown as images.
OCR_SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp")


def unique_ratio(text: Column, words_of: Column | None = None) -> Column:
    """Different words / words; null without words. ``words_of``: the words, where a column has them already."""
    w = words(text) if words_of is None else words_of
    return F.size(F.array_distinct(w)) / F.nullif(F.size(w), F.lit(0))


def prefix_run(text: Column) -> Column:
    """Longest run of words (of three characters at least) that begin with the same three."""
    heads = F.transform(F.filter(F.split(text, r"[\s.\x{A0}]+"), lambda t: F.length(t) >= PREFIX), lambda t: F.left(t, F.lit(PREFIX)))
    start = F.struct(F.lit("").alias("head"), F.lit(0).alias("run"), F.lit(1).alias("best"))

    def step(state: Column, head: Column) -> Column:
        run = F.when(state["head"] == head, state["run"] + 1).otherwise(1)
        return F.struct(head.alias("head"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(heads, start, step, lambda s: s["best"])


def is_degenerate(text: Column, words_of: Column | None = None, run: Column | None = None) -> Column:
    """At least 40 words, and few different ones or a long run of like beginnings."""
    w, run = words(text) if words_of is None else words_of, prefix_run(text) if run is None else run
    return F.coalesce(F.when(F.size(w) < LEAST_WORDS, False).otherwise((unique_ratio(text, w) < LEAST_UNIQUE) | (run >= LONGEST_RUN)), F.lit(False))


def _share(text: Column, block: str) -> Column:
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return F.length(F.regexp_replace(letters, f"[^{block}]", "")) / F.nullif(F.length(letters), F.lit(0))


def hebrew_ratio(text: Column) -> Column:
    """Share of the letters that are Hebrew; null without letters."""
    return _share(text, r"\x{0590}-\x{05FF}")


def is_rtl(text: Column) -> Column:
    """Whether at least 30 % of the letters run from right to left."""
    return F.coalesce(_share(text, r"\x{0590}-\x{06FF}") >= RTL_SHARE, F.lit(False))


def first_pages(pages: Column, most: int = 5) -> Column:
    """The first pages of an array, one after another without a separator: what a script is told by."""
    return F.array_join(F.slice(pages, 1, most), "")


def native_pages(pages: Column, is_hebrew: Column) -> Column:
    """S3: the text layer of a document's pages, joined by blank lines and stripped; null where it can't stand instead of
    character recognition."""
    text = strip(F.array_join(pages, "\n\n"))
    return F.when(native_text_serves(text, is_hebrew), text)


def hebrew_from_language(name: Column) -> Column:
    """Whether the chosen source language asks for Hebrew character recognition."""
    return F.coalesce(F.lower(F.trim(name)) == "hebrew", F.lit(False))


def takes_ocr(suffix: Column) -> Column:
    """P1."""
    return suffix.isin(*OCR_SUFFIXES)


def resolve_hebrew(flag: Column, suffix: Column, ratio: Column, image_says: Column) -> Column:
    """An explicit flag wins; else suffix, text layer and image tell, and FALSE is the default."""
    return (
        F.when(F.coalesce(flag, F.lit(False)), True).when(~takes_ocr(suffix), False).when(ratio >= HEBREW_SHARE, True).otherwise(F.coalesce(image_says, F.lit(False)))
    )


def native_text_serves(text: Column, is_hebrew: Column) -> Column:
    """S3: whether a text layer stands instead of character recognition: 200 characters, letters, Hebrew ones if wanted."""
    ratio = hebrew_ratio(text)
    return F.coalesce((F.length(text) >= 200) & ratio.isNotNull() & (~is_hebrew | (ratio >= HEBREW_SHARE)), F.lit(False))


def preview_route(suffix: Column, length: Column, text: Column) -> Column:
    """How a file is shown: image, inline, too large, its text, or a placeholder."""
    return (
        F.when(suffix.isin(*IMAGE_SUFFIXES), "image")
        .when(suffix == ".pdf", F.when(length > 20 * 1024 * 1024, "too_large").otherwise("inline"))
        .when(F.trim(F.coalesce(text, F.lit(""))) == "", "placeholder")
        .otherwise("text")
    )


def wrong_language(text: Column, detected: Column, expected: Column) -> Column:
    """At least 6 words in another language than expected, equivalents accepted."""
    fits = detected == expected
    for language, others in EQUIVALENT.items():
        fits = fits | ((expected == language) & detected.isin(*others))
    return F.coalesce((F.size(words(text)) >= LANGUAGE_WORDS) & ~F.coalesce(fits, F.lit(False)), F.lit(False))


def is_rtl_language(name: Column) -> Column:
    """P18."""
    return F.lower(F.trim(name)).isin("arabic", "hebrew")
