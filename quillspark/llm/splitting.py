"""Splitting oversized paragraphs at natural boundaries, with overlap, by dynamic programming.

A paragraph is normalised (invisible characters removed, each run of white space one space, none at the
ends). A cut is the first position that a piece takes new text from; the piece itself begins an overlap of
``overlap_min`` to ``overlap_max`` characters earlier, at the most natural start in that span. Over the
possible cuts, the programme minimises

    sum of cut penalties + balance * sum over pieces of (new characters / ideal - 1)^2

subject to every piece being at most ``max_chars`` long, where penalties rank sentence ends, clause ends,
word ends and, last, positions inside a word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.marks import JAVA_INVISIBLE, JAVA_SPACE
from quillspark.util import spread

#: Penalty of a cut after: a sentence, a clause, a word, and inside a word.
SENTENCE, CLAUSE, WORD, INSIDE = 0.0, 0.6, 1.5, 12.0
BALANCE = 2.0
# What ends sentences and clauses in the languages of the texts.
_SENTENCE = re.compile("[.!?…。！？؟۔।][\"'”’»)\\]]*(?: |(?=[^\\x00-\\u2fff]))")
_CLAUSE = re.compile("[,;:،؛，；：、–—|][\"'”’»)\\]]*(?: |(?=[^\\x00-\\u2fff]))")
#: Words longer than this may be cut inside, at every so many characters.
LONG_WORD, STEP = 40, 8
#: Up to so many cuts, layers of whole tables are faster than a pass.
SMALL = 260
_LONG = re.compile(rf"[^ ]{{{LONG_WORD + 1},}}")


def cut_candidates(text: str) -> tuple[list[int], list[float]]:
    """Positions at which a piece's new text may begin or end, in order, from 0 to len, and their penalties."""
    cost: dict[int, float] = dict.fromkeys(np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32) == 32) + 1, WORD)
    cost = {int(k): v for k, v in cost.items()}
    for pattern, value in ((_CLAUSE, CLAUSE), (_SENTENCE, SENTENCE)):
        for m in pattern.finditer(text):
            cost[m.end()] = value
    for m in _LONG.finditer(text):
        for at in range(m.start() + STEP, m.end(), STEP):
            while at < m.end() and unicodedata.combining(text[at]):  # not between a letter and its marks
                at += 1
            cost.setdefault(at, INSIDE)
    cost[0] = cost[len(text)] = 0.0
    places = sorted(cost)
    return places, [cost[p] for p in places]


def split_text(text: str, max_chars: int = 400, overlap_min: int = 40, overlap_max: int = 80) -> list[tuple[int, int, int]]:
    """(start, new_start, end) of the pieces of ``text``; pieces after the first start in front of new_start."""
    n = len(text)
    if n <= max_chars:
        return [(0, 0, n)] if n else []
    places, costs = cut_candidates(text)
    spot, cost = np.array(places), np.array(costs)
    last = len(places) - 1
    first = np.searchsorted(spot, spot - overlap_max)
    after = np.searchsorted(spot, spot - overlap_min, side="right")
    # the most natural start of each overlap, nearest the least overlap
    reach = first[:, None] + np.arange(max(1, int((after - first).max())))
    key = np.where(reach < after[:, None], cost[np.minimum(reach, last)] - 1e-6 * reach, np.inf)
    pick = key.argmin(axis=1)
    starts = np.where(after > first, spot[np.minimum(first + pick, last)], np.maximum(spot - overlap_min, 0))
    new_max = max_chars - overlap_min
    ideal = (n - max_chars) / -(-(n - max_chars) // new_max) if n - max_chars >= new_max // 2 else n / 2
    lowest = int(np.searchsorted(spot, overlap_max))  # an overlap needs that much text in front
    ends = np.searchsorted(spot, starts + max_chars, side="right")
    head = int(np.searchsorted(spot, max_chars, side="right"))
    begin = np.full(last + 1, np.inf)
    begin[1:head] = cost[1:head] + BALANCE * (spot[1:head] / max_chars - 1) ** 2
    cuts = _by_pieces(spot, cost, begin, ends, lowest, ideal) if last <= SMALL else _by_cuts(spot, cost, begin, ends, lowest, ideal)
    stops = [*(places[k] for k in cuts[1:]), n]
    return [(int(starts[k]) if k else 0, places[k], end) for k, end in zip(cuts, stops)]


def _by_pieces(spot: np.ndarray, cost: np.ndarray, begin: np.ndarray, ends: np.ndarray, lowest: int, ideal: float) -> list[int]:
    """Least cost over all cuts by layers of one more piece each; ends when no further layer can cost less."""
    at = np.arange(len(spot))
    ahead = (at[None, :] > at[:, None]) & (at[None, :] < ends[:, None]) & (at[:, None] >= max(1, lowest))
    step = np.where(ahead, cost[None, :] + BALANCE * ((spot[None, :] - spot[:, None]) / ideal - 1) ** 2, np.inf)
    layer, backs = begin, []
    best, chosen = layer[-1], 0
    while np.isfinite(low := layer[:-1].min()) and low < best:
        through = layer[:, None] + step
        back = through.argmin(axis=0)
        layer = through[back, at]
        backs.append(back)
        if layer[-1] < best:
            best, chosen = layer[-1], len(backs)
    cuts, k = [], len(spot) - 1
    for back in reversed(backs[:chosen]):
        k = int(back[k])
        cuts.append(k)
    return [0, *reversed(cuts)]


def _by_cuts(spot: np.ndarray, cost: np.ndarray, begin: np.ndarray, ends: np.ndarray, lowest: int, ideal: float) -> list[int]:
    """The same over a long text: one pass over its cuts, each looking only as far ahead as a piece reaches."""
    best, back = begin.copy(), np.zeros(len(spot), dtype=np.int64)
    for k in range(max(1, lowest), len(spot) - 1):
        stop = int(ends[k])
        if stop <= k + 1 or best[k] == np.inf:
            continue
        total = best[k] + cost[k + 1 : stop] + BALANCE * ((spot[k + 1 : stop] - spot[k]) / ideal - 1) ** 2
        better = total < best[k + 1 : stop]
        best[k + 1 : stop][better] = total[better]
        back[k + 1 : stop][better] = k
    cuts, at = [], len(spot) - 1
    while at > 0:
        at = int(back[at])
        cuts.append(at)
    return cuts[::-1]


def paragraphs(files: DataFrame, id_col: str = "file_id", text_col: str = "markdown") -> DataFrame:
    """One row (id_col, para_no, body) per paragraph: a longest run of lines that aren't blank, normalised.

    Null and blank texts have none. Only built-in functions: blank lines become one separator, which splits.
    """
    body = F.regexp_replace(F.col(text_col), JAVA_INVISIBLE, "")
    # U+0000 separates paragraphs, so one that is in the text becomes a space first
    body = F.regexp_replace(F.regexp_replace(body, r"\x{0}", " "), rf"\n(?:[{JAVA_SPACE[1:-1]}&&[^\n]]*\n)+", "\u0000")
    return (
        files.select(F.col(id_col), body.alias("body"))
        .select(id_col, F.posexplode(F.filter(F.transform(F.split("body", "\u0000"), lambda p: F.regexp_replace(F.regexp_replace(p, f"{JAVA_SPACE}+", " "), "^ | $", "")), lambda p: p != "")).alias("at", "body"))
        .select(id_col, (F.col("at") + 1).cast("bigint").alias("para_no"), "body")
    )


def split_paragraphs(files: DataFrame, id_col: str = "file_id", text_col: str = "markdown", max_chars: int = 400, overlap_min: int = 40, overlap_max: int = 80) -> DataFrame:
    """One row (id_col, para_no, n_chars, piece_no, n_pieces, overlap, piece) per piece of each paragraph
    longer than ``max_chars``.

    Pieces are in order and at most ``max_chars`` long; each after the first repeats the last ``overlap``
    characters (``overlap_min`` to ``overlap_max``) of the one before. Null, blank and short texts give no row;
    words longer than a piece are cut inside. Repeated rows give their pieces again. One pass, no shuffle
    beyond the spreading of an input with too few splits.
    """
    if not 0 < overlap_min <= overlap_max < max_chars // 2:
        raise ValueError("need 0 < overlap_min <= overlap_max < max_chars / 2")
    picked = spread(files.select(F.col(id_col), F.col(text_col).cast("string").alias("markdown_")), id_col)
    kind = files.schema[id_col].dataType.simpleString()
    long = paragraphs(picked, id_col, "markdown_").where(F.length("body") > max_chars).withColumnRenamed(id_col, "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), 512):
                rows = []
                for key, para, text in frame.iloc[first : first + 512].itertuples(index=False, name=None):
                    cuts = split_text(text, max_chars, overlap_min, overlap_max)
                    rows += [(key, para, len(text), k, len(cuts), new - start, text[start:end]) for k, (start, new, end) in enumerate(cuts, 1)]
                yield pd.DataFrame(rows, columns=["id", "para_no", "n_chars", "piece_no", "n_pieces", "overlap", "piece"])

    return long.mapInPandas(run, f"id {kind}, para_no bigint, n_chars bigint, piece_no int, n_pieces int, overlap int, piece string").withColumnRenamed("id", id_col)


def oversized(files: DataFrame, id_col: str = "file_id", text_col: str = "markdown", max_chars: int = 400) -> DataFrame:
    """(id_col, para_no) of each paragraph that :func:`split_paragraphs` cuts: the first piece stands for it."""
    return split_paragraphs(files, id_col, text_col, max_chars).where("piece_no = 1 AND n_pieces > 1").select(id_col, "para_no")
