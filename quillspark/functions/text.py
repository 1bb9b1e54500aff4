"""Text columns: cleaning, sentences, chunks, citations, prompts. Built-in functions unless stated otherwise."""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space, invisible marks and matter that OCR leaves, as regular-expression classes.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
MARKS = r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}"
OCR_MATTER = r"\x{FFFC}\x{FFFD}\x{E000}-\x{F8FF}"
# Ranges that a sentence may begin with (Latin, Cyrillic, Hebrew, Arabic, CJK).
SENTENCE_START = r"A-Z0-9\x{00C0}-\x{024F}\x{0400}-\x{04FF}\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{4E00}-\x{9FFF}"
# How legal citations read in Hebrew and English.
CITATION = (
    r"(?iu)(סעיף\s*\d+|תקנה\s*\d+|חוק\s+\S+|פסק\s*דין|בג\"?ץ|ע\"?א\s*\d+|"
    r"\bsection\s+\d+|\bregulation\s+\d+|\barticle\s+\d+|\blaw\s*(\(|,)?\s*(19|20|5[6-9])\d{2}\b|"
    r"\bhcj\b|\bbasic\s+law\b)"
)
# A request names a presentation and a verb of making.
SLIDES_NOUN = r"(?i)\b(power ?point|pptx|slide ?deck|slides?|presentation)\b"
SLIDES_VERB = r"(?i)\b(make|create|generate|build|write|prepare|put together|draft|produce)\b"
# Notes that stand for a missing answer and a missing citation.
NO_ANSWER = "_(The model ran out of space while reasoning and never reached an answer. Try a shorter question or a smaller attached document.)_"
NO_CITATION = (
    "\n\n---\n⚠️ *This answer doesn't appear to cite a specific law, regulation, or case. Treat it as general information only "
    "and verify against the actual legislation or with a licensed attorney before relying on it.*"
)
# The kinds of page that hold a law, and what stands for it after a title.
LAW_KINDS = "חוק|תקנות|חקיקה"


def strip(text: Column) -> Column:
    """Without white space at both ends, as Unicode defines it."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def strip_marks(text: Column) -> Column:
    """Without direction and other invisible marks."""
    return F.regexp_replace(text, f"[{MARKS}]", "")


def strip_ocr_matter(text: Column) -> Column:
    """Without replacement, object and private-use characters."""
    return F.regexp_replace(text, f"[{OCR_MATTER}]", "")


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities resolved. An Arrow function, as the table of entities has no built-in."""
    return text.map(html.unescape, na_action="ignore")


def sentences(text: Column) -> Column:
    """T4: split after . ! ? and white space in front of what may begin a sentence; blank ones are left out."""
    parts = F.split(text, rf"(?<=[.!?])[{SPACE}]+(?=[{SENTENCE_START}])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def hard_split(unit: Column, most: int) -> Column:
    """T5: units of at most ``most`` characters as they are, longer ones packed from their words.

    A single longer word stays whole.
    """
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(state: Column, word: Column) -> Column:
        joined = F.concat(state["now"], F.lit(" "), word)
        return (
            F.when(state["now"] == "", F.struct(state["done"].alias("done"), word.alias("now")))
            .when(F.length(joined) <= most, F.struct(state["done"].alias("done"), joined.alias("now")))
            .otherwise(F.struct(F.concat(state["done"], F.array(state["now"])).alias("done"), word.alias("now")))
        )

    packed = F.aggregate(words(unit), empty, add, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))
    return F.when(F.length(unit) <= most, F.array(unit)).otherwise(packed)


def chunks(text: Column, most: int = 400) -> Column:
    """Paragraphs (split at blank lines), long ones by sentence and word, packed to at most ``most`` characters.

    Inside a chunk the pieces are joined by single spaces. Blank texts have none; null stays null. One Arrow function: a
    fold in built-in functions is interpreted piece by piece, and copies what it has at each chunk.
    """

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t, most), na_action="ignore")

    return run(text)


@lru_cache(maxsize=1)
def _patterns() -> tuple[str, re.Pattern, re.Pattern]:
    plain = lambda c: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), c)
    space, start = plain(SPACE), plain(SENTENCE_START)
    stripped = "".join(chr(c) for c in range(0x10000) if re.match(f"[{space}]", chr(c)))
    return stripped, re.compile(f"[{space}]+"), re.compile(f"(?<=[.!?])[{space}]+(?=[{start}])")


def chunk_text(text: str, most: int) -> list[str]:
    """The chunks of one text, in time that grows with its length alone."""
    space, gap, boundary = _patterns()
    out: list[str] = []
    now: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal now, size
        if done := " ".join(now).strip(space):
            out.append(done)
        now, size = [], 0

    for paragraph in (p.strip(space) for p in text.split("\n\n")):
        units = [] if not paragraph else [paragraph] if len(paragraph) <= most else [u for x in boundary.split(paragraph) if (u := x.strip(space))]
        for unit in units:
            for piece in [unit] if len(unit) <= most else packed([w for w in gap.split(unit) if w], most):
                if now and size + len(piece) > most:
                    flush()
                now.append(piece)
                size += len(piece) + 1
    flush()
    return out


def packed(words: list[str], most: int) -> list[str]:
    """Words joined by spaces to lines of at most ``most`` characters; a longer word is a line of its own."""
    lines: list[list[str]] = []
    size = most + 1
    for word in words:
        if size + 1 + len(word) > most:
            lines.append([])
            size = -1
        lines[-1].append(word)
        size += 1 + len(word)
    return [" ".join(line) for line in lines]


def anchor_lines(text: Column) -> Column:
    """Each line that isn't blank begins with a right-to-left mark."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(strip(x) != "", F.concat(F.lit("‏"), x)).otherwise(x)), "\n")


def strip_thinking(text: Column) -> Column:
    """Without reasoning blocks; an unclosed one takes all that follows, and a note stands for nothing left."""
    closed = strip(F.regexp_replace(text, "(?is)<think>.*?</think>", ""))
    cut = strip(F.regexp_replace(closed, "(?is)<think>.*", ""))
    return F.when(~F.contains(F.lower(closed), F.lit("<think>")), closed).otherwise(F.when(cut == "", F.lit(NO_ANSWER)).otherwise(cut))


def strip_fences(text: Column) -> Column:
    """Without a code fence around the text."""
    bare = strip(text)
    return F.when(F.startswith(bare, F.lit("```")), strip(F.regexp_replace(F.regexp_replace(bare, "^```[a-zA-Z]*\n?", ""), rf"```[{SPACE}]*$", ""))).otherwise(bare)


def citations(text: Column) -> Column:
    """The sentences or lines that cite a law, each once, in order."""
    parts = F.split(text, rf"(?<=[.!?])[{SPACE}]+|\n+")
    clean = F.transform(parts, lambda s: F.regexp_replace(s, "^[ \\-•\\t\\n]+|[ \\-•\\t\\n]+$", ""))
    return F.array_distinct(F.filter(clean, lambda s: (s != "") & s.rlike(CITATION)))


def warn_uncited(text: Column) -> Column:
    """With a warning where nothing is cited."""
    return F.when(F.size(citations(text)) == 0, F.concat(text, F.lit(NO_CITATION))).otherwise(text)


def safe_filename(name: Column, most: int = 150) -> Column:
    """Characters that file systems refuse become spaces; single spaces, at most ``most`` characters."""
    clean = F.regexp_replace(strip(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', " ")), f"[{SPACE}]+", " ")
    return F.coalesce(F.nullif(F.left(clean, F.lit(most)), F.lit("")), F.lit("document"))


def drop_title_suffix(title: Column, site: str) -> Column:
    """A title without the kind of page and the name of the ``site`` at its end."""
    return F.regexp_replace(title, rf"[{SPACE}]*\((?:{LAW_KINDS})\)[{SPACE}]*[-–][{SPACE}]*{site}[{SPACE}]*$", "")


def is_law_title(title: Column, site: str) -> Column:
    """Whether a page's title tells that it holds a law."""
    return title.rlike(rf"\((?:{LAW_KINDS})\)[{SPACE}]*[-–][{SPACE}]*{site}")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_host(url: Column) -> Column:
    """Host in lower case, without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_basename(url: Column) -> Column:
    """Last part of the path, ``document.pdf`` if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(url_path(url), "([^/]+)/*$", 1), F.lit("")), F.lit("document.pdf"))


def in_domain(url: Column, domain: str) -> Column:
    """Whether the host is the domain or below it (an address that only ends alike is not)."""
    host = url_host(url)
    return (host == domain) | host.endswith("." + domain)


def data_uri(content: Column, kind: str = "application/pdf") -> Column:
    """Binary content as an address; the line breaks that the built-in sets every 76 characters are taken out."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))


def asks_for_slides(text: Column) -> Column:
    """Whether a message asks to make a presentation."""
    text = F.coalesce(text, F.lit(""))
    return text.rlike(SLIDES_NOUN) & text.rlike(SLIDES_VERB)


def window_tokens(requested: Column, predict: Column) -> Column:
    """P20: context window: at least predict + 2048, 8192 where none is requested (null or 0)."""
    return F.greatest(F.coalesce(F.nullif(requested, F.lit(0)), F.lit(8192)), predict + 2048)


def truncate(text: Column, most: int, suffix: str = "") -> Column:
    """L3: at most ``most`` characters, ``suffix`` marking a cut."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(suffix))).otherwise(text)


def suffix_of(path: Column) -> Column:
    """Extension in lower case with its dot."""
    return F.lower(F.regexp_extract(path, r"[^./]*(\.[^./]+)$", 1))
