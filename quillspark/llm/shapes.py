"""Text quality statistics per document, and its shape (prose, list, table, junk) by a hidden Markov model over lines.

A line shows discrete statistics: an enumerator, columns, final punctuation, how it continues, its length, its
share of letters, and how familiar its words and neighbouring words are to the whole corpus. Each state gives
each statistic a probability; neighbouring lines tend to share a state. The probabilities start from stated ones and are
fitted to all lines of the corpus (Baum and Welch's method, held towards the start). Viterbi labels the lines, and the
shares of the labels give the shape. What the corpus is familiar with is counted over all documents: the word pairs
that make up a least share of all pairs, whose number that share bounds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.marks import drop_invisible, is_blank
from quillspark.util import cut, spread

#: A word or pair is familiar at this share of all; at most 1 / share of them can be, which bounds the broadcast.
LEAST_SHARE, LEAST_COUNT = 2e-6, 5
#: Common words are a small fixed list, and go into the plan.
MOST_COMMON = 20_000
STATES = ("prose", "list", "table", "junk")

_WORD = re.compile("[一-鿿㐀-䶿]|[^\\W\\d_]+")
# What marks an item of an enumeration.
_ITEM = re.compile(
    r"\s*(?:[-–—•*·▪◦‣●○■□☐☑☒✓✔➤►>+]\s+\S|\[[ xX✓]?\]\s|\(?(?:\d{1,3}|[A-Za-zא-תа-яء-ي]|[ivxlcdmIVXLCDM]{1,7})[.)\]]\)?\s+\S|\d{1,3}(?:\.\d{1,3})+\.?\s+\S|[①-⑳⒈-⒛㈠-㈩]|[一二三四五六七八九十]{1,3}[、．.]|第[一二三四五六七八九十\d]+[、条])"
)
_CELLS = re.compile(r"\||│|┃|\t|;(?=\S)|(?<=\S);$|\"\s*,\s*\"|</t[dh]>|(?<=\S)(?: {3,}|\xa0{2,})(?=\S)|(?<=\S),(?=[^\s\d])|(?<=[^\d\s]),(?=\S)|(?<=\d),(?=\d{1,2}[/.]\d)|(?<=\S)\s*(?:=>|::|~|¦)\s*(?=\S)")
_RULE = re.compile(r"\s*[|+:\-=─━┼╪│┌┐└┘├┤┬┴═ ]{3,}\s*$")
_INSIDE = re.compile("[.,;!?،؛。，；](?:\\s|$)")
_HTML_TABLE = re.compile(r"\s*</?(?:table|thead|tbody|tr)\b", re.I)
# What ends a sentence, and what may close after it.
_STOPS, _CLOSERS = frozenset(".!?…。！？؟۔:;；："), "\"'”’»)]"
_CELL_MARKS = ("|", "│", "┃", "\t", '"', "<", "   ", "\xa0\xa0", "=>", "::", "~", "¦")
_TIGHT = re.compile(r"[,;]\S|;$")
_RULED = re.compile("[|+─━┼═]|---")
_ASIDE = re.compile(r"<[^>]{1,40}>|https?://\S+|\(§[^)]{1,40}\)")
_TOKEN, _HAN = re.compile("[一-鿿㐀-䶿]|[^\\W\\d_]+|[.!?;。！？；]"), re.compile("[一-鿿㐀-䶿]")
_ENDERS, _SENTENCE = frozenset(".!?;。！？；"), re.compile("[.!?;。！？；]")
_BREAK = re.compile("[.,;:!?،؛。，；：()«»“”\"|]")
_LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_NUMBER_CELL = re.compile(r"(?<![^\s|│;,\"\t>])[-+]?\d[\d.,/%:-]*(?![^\s|│;,\"\t<%])")
# Endless repetition, data and code.
_REPEATED, _SOLID, _ESCAPED = re.compile(r"(\S)\1{9,}"), re.compile("[A-Za-z0-9+/=_%-]{41,}"), re.compile("(?:%[0-9A-F]{2}){4,}")
_HEX_PAIRS, _HEX_DUMP, _FILE_PARTS = re.compile(r"(?:\b[0-9a-f]{2}\s+){8,}"), re.compile(r"\b[0-9a-f]{8}\b \d"), re.compile(r"\b(?:endobj|endstream|xref)\b")


_NO_LETTER = {code: " " for code in range(128) if not chr(code).isalpha()}


def words_of(text: str) -> list[str]:
    low = text.lower()
    return low.translate(_NO_LETTER).split() if low.isascii() else _WORD.findall(low)


def count_pairs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pair, n): pairs of neighbouring words over all texts; a single word counts as ``word`` with a line feed after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                n: Counter[str] = Counter()
                for text in batch.column(0).slice(start, 2000).to_pylist():
                    if text:
                        words = words_of(text)
                        n.update(map(" ".join, zip(words, words[1:])))
                        n.update([w + "\n" for w in words])
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["pair", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def familiar_pairs(docs: DataFrame, text_col: str = "text") -> frozenset[str]:
    """Words and pairs that make up at least ``LEAST_SHARE`` of all, and occur ``LEAST_COUNT`` times."""
    counts = count_pairs(docs, text_col).persist(StorageLevel.DISK_ONLY)  # read twice; a lost part is counted again
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COUNT, int(total * LEAST_SHARE))
    found = frozenset(r["pair"] for r in counts.where(F.col("n") >= least).select("pair").collect())
    counts.unpersist()
    return found


def _table(**rows: tuple[float, ...]) -> np.ndarray:
    return np.array([rows[s] for s in STATES])


# What each state is taken to show before the corpus is looked at (probability of each value of a statistic).
PRIOR = {
    "item": _table(prose=(0.985, 0.015), list=(0.3, 0.7), table=(0.97, 0.03), junk=(0.95, 0.05)),  # no, yes
    "cells": _table(prose=(0.965, 0.03, 0.005), list=(0.94, 0.05, 0.01), table=(0.03, 0.2, 0.77), junk=(0.75, 0.15, 0.1)),  # 0, 1, more
    "run": _table(prose=(0.3, 0.7), list=(0.9, 0.1), table=(0.95, 0.05), junk=(0.85, 0.15)),  # goes on in the next line or goes on the last
    "end": _table(prose=(0.25, 0.75), list=(0.93, 0.07), table=(0.985, 0.015), junk=(0.85, 0.15)),  # no, yes
    "long": _table(prose=(0.2, 0.3, 0.5), list=(0.62, 0.35, 0.03), table=(0.6, 0.37, 0.03), junk=(0.35, 0.35, 0.3)),  # < 50, < 125, more
    "sign": _table(prose=(0.93, 0.065, 0.005), list=(0.85, 0.13, 0.02), table=(0.08, 0.47, 0.45), junk=(0.45, 0.2, 0.35)),  # other than letters
    "known": _table(prose=(0.01, 0.12, 0.87), list=(0.04, 0.26, 0.7), table=(0.2, 0.4, 0.4), junk=(0.9, 0.085, 0.015)),  # familiarity
    "odd": _table(prose=(0.998, 0.002), list=(0.99, 0.01), table=(0.98, 0.02), junk=(0.3, 0.7)),  # repeats itself, or matter that isn't language
}
# The first line's states, how likely a state goes on, and what many words without any sentence say.
FIRST, _STAY, _UNBROKEN = np.array([0.4, 0.2, 0.2, 0.2]), 0.88, np.array([0.02, 0.02, 0.02, 0.94])
#: How much what the states are taken to show weighs in fitting, as a multiple of what the corpus shows; rounds of fitting.
PRIOR_WEIGHT, ROUNDS = 3.0, 3

NAMES = tuple(PRIOR)
_SIZES = [PRIOR[name].shape[1] for name in NAMES]
# a line's code has a digit per statistic (one value more: not looked at) and one for words without sentences
_BASES = [n + 1 for n in _SIZES]
_STEPS = [int(np.prod(_BASES[k + 1 :], initial=1)) * 2 for k in range(len(_BASES))]
CODES = int(np.prod(_BASES)) * 2
_DIGITS = [(np.arange(CODES) // step) % base for step, base in zip(_STEPS, _BASES)]


class Shapes:
    """Probabilities of the hidden Markov model: ``first``, ``move`` and a table (state, value) per statistic."""

    def __init__(self, first: np.ndarray = FIRST, move: np.ndarray | None = None, tables: dict[str, np.ndarray] | None = None) -> None:
        self.first, self.tables = first, tables or PRIOR
        self.move = np.where(np.eye(4, dtype=bool), _STAY, (1 - _STAY) / 3) if move is None else move
        self.emit = np.zeros((CODES, 4))
        for name, digit, n in zip(NAMES, _DIGITS, _SIZES):
            self.emit += np.vstack([np.log(self.tables[name]).T, np.zeros((1, 4))])[np.minimum(digit, n)]
        self.emit[1::2] += np.log(_UNBROKEN)

    def refit(self, seen: np.ndarray) -> Shapes:
        """The model that expected counts (see :meth:`expect`) and the prior, weighted by ``PRIOR_WEIGHT``, make most likely."""

        def mix(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
            total = counts.sum(axis=-1, keepdims=True)
            share = np.divide(counts, total, out=prior.copy(), where=total > 0)
            return np.round(np.maximum((share + PRIOR_WEIGHT * prior) / (1 + PRIOR_WEIGHT), 1e-4), 9)

        tables, at = {}, 20
        for name, n in zip(NAMES, _SIZES):
            tables[name] = mix(seen[at : at + 4 * n].reshape(4, n), PRIOR[name])
            at += 4 * n
        prior = Shapes()
        return Shapes(mix(seen[:4], prior.first), mix(seen[4:20].reshape(4, 4), prior.move), tables)

    @staticmethod
    def _columns(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first line of each text, texts from the longest, how many have a t-th line)."""
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        order = np.argsort(-lengths, kind="stable")
        return starts, order, np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")

    def label(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Most likely state of each line; ``codes`` of all texts one after another, ``lengths`` their numbers of lines (none 0)."""
        starts, order, active = self._columns(lengths)
        emit, move = self.emit[codes], np.log(self.move)
        came, labels = np.zeros((len(codes), 4), dtype=np.int8), np.zeros(len(codes), dtype=np.int8)
        value = np.log(self.first) + emit[starts[order]]
        best = value.argmax(axis=1)
        for t, n in enumerate(active[1:].tolist(), 1):
            through = value[:n, :, None] + move
            at = starts[order[:n]] + t
            came[at] = through.argmax(axis=1)
            value = through.max(axis=1) + emit[at]
            best[:n] = value.argmax(axis=1)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            at = starts[order[:n]] + t
            labels[at] = best[:n]
            best[:n] = came[at, best[:n]]
        return labels

    def expect(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected counts over texts: first states (4), moves (16), and (state, value) of each statistic. Forward and backward."""
        starts, order, active = self._columns(lengths)
        chance = self.emit[codes]
        chance = np.exp(chance - chance.max(axis=1, keepdims=True))
        ahead = np.empty((len(codes), 4))
        at = starts[order]
        ahead[at] = self.first * chance[at]
        ahead[at] /= ahead[at].sum(axis=1, keepdims=True)
        for t, n in enumerate(active[1:].tolist(), 1):
            at = starts[order[:n]] + t
            now = (ahead[at - 1] @ self.move) * chance[at]
            ahead[at] = now / now.sum(axis=1, keepdims=True)
        behind, moves, both = np.ones((len(order), 4)), np.zeros((4, 4)), np.empty((len(codes), 4))
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            at = starts[order[:n]] + t
            now = ahead[at] * behind[:n]
            both[at] = now / now.sum(axis=1, keepdims=True)
            if t:
                on = chance[at] * behind[:n]
                pair = ahead[at - 1][:, :, None] * self.move * on[:, None, :]
                moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                back = on @ self.move.T
                behind[:n] = back / back.sum(axis=1, keepdims=True)
        by_code = np.stack([np.bincount(codes, weights=both[:, s], minlength=CODES) for s in range(4)])
        values = [np.stack([np.bincount(digit, weights=by_code[s], minlength=n + 1)[:n] for s in range(4)]).ravel() for digit, n in zip(_DIGITS, _SIZES)]
        return np.concatenate([both[starts].sum(axis=0), moves.ravel(), *values])


def _familiarity(words: list[str], known: frozenset[str]) -> float:
    if len(words) < 2:
        return float(words[0] + "\n" in known) if words else 0.0
    pairs = sum(map(known.__contains__, map(" ".join, zip(words, words[1:])))) / (len(words) - 1)
    if len(words) >= 8:
        return pairs
    single = sum(w + "\n" in known for w in words) / len(words)
    return max(pairs, 0.8 * single)


def ends(line: str) -> bool:
    """Whether the line ends as a sentence does, closing quotes and brackets aside."""
    tail = line.rstrip().rstrip(_CLOSERS)
    return bool(tail) and tail[-1] in _STOPS


def cells(line: str) -> int:
    """How many marks between columns the line has. The pattern runs only where one of its marks is."""
    if any(map(line.__contains__, _CELL_MARKS)) or ("," in line or ";" in line) and _TIGHT.search(line):
        return len(_CELLS.findall(line))
    return 0


def is_junky(body: str, sizes: list[int], digits: int, runs: bool) -> bool:
    """Endless repetition, data or code. Each pattern runs only where the tokens' sizes allow it to match, and that for
    repetition where some character of the text comes ten times in a row."""
    longest = max(sizes, default=0)
    return bool(
        runs and longest >= 10 and _REPEATED.search(body) or longest >= 41 and _SOLID.search(body)
        or "%" in body and longest >= 12 and _ESCAPED.search(body) or len(sizes) >= 8 and sizes.count(2) >= 7 and _HEX_PAIRS.search(body) or digits and longest >= 8 and _HEX_DUMP.search(body)
        or ("endobj" in body or "endstream" in body or "xref" in body) and _FILE_PARTS.search(body)
    )


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """1 for letters and their marks, 2^32 for digits, 0 for all other code points: sums of both in one number."""
    kinds = np.zeros(0x110000, dtype=np.int64)
    for code in range(0x32000):  # beyond, no letters or digits are assigned
        c = chr(code)
        if c.isdecimal():
            kinds[code] = 1 << 32
        elif c.isalnum():
            kinds[code] = 1
    kinds[0x591:0x5C8] = kinds[0x64B:0x653] = 1
    return kinds


def letters_and_digits(bodies: list[str]) -> tuple[list[int], list[int], bool]:
    """How many letters and how many digits each line has, and whether any character comes ten times in a row."""
    joined = "\n".join(bodies) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    turns = np.flatnonzero(codes[1:] != codes[:-1])
    runs = len(turns) == 0 or bool(turns[0] >= 9 or (turns[1:] - turns[:-1]).max(initial=0) >= 10)  # the last character is a line feed of its own
    starts = [0, *accumulate(len(x) + 1 for x in bodies[:-1])]
    sums = np.add.reduceat(_kinds()[codes], starts).tolist()
    return [n & 0xFFFFFFFF for n in sums], [n >> 32 for n in sums], runs


def words_and_sentences(low: str) -> tuple[list[str], list[str]]:
    """The words of a line in lower case, and those of its sentences that have over 12 characters of words."""
    if low.isascii():
        parts = [part.translate(_NO_LETTER).split() for part in _SENTENCE.split(low)]
        return parts[0] if len(parts) == 1 else [w for part in parts for w in part], [s for part in parts if len(s := " ".join(part)) > 12]
    tokens = _TOKEN.findall(low)
    han = bool(_HAN.search(low))
    parts = map(str.strip, _SENTENCE.split(" ".join(tokens)))
    return [t for t in tokens if t not in _ENDERS], [s for s in parts if len(s) > 12 and (not han or not _HAN.search(s) or len(s.replace(" ", "")) > 12)]


def line_codes(lines: list[str], known: frozenset[str]) -> list[int]:
    """What each line shows, as a code of its statistics. Lines aren't blank, but for "" between paragraphs."""
    text = [line for line in lines if line]
    bodies, sentences = [], []
    for line in text:
        words, parts = words_and_sentences(line.lower())
        bodies.append(words)
        sentences += parts
    width = max(map(len, text))
    everything = [w for words in bodies for w in words]
    looping = len(sentences) >= 4 and len(set(sentences)) <= 0.4 * len(sentences) or len(everything) >= 20 and len(set(everything)) <= 0.12 * len(everything) + 2
    running = sum(bool(_INSIDE.search(line)) for line in text) >= 0.25 * len(text)  # sentences, so lines may break them anywhere
    ended = [ends(line) for line in text]
    items = [bool(_ITEM.match(line)) for line in text]
    follows = [False] * len(text)
    if 25 <= width <= 140:
        k = -1
        for line, after in zip(lines, [*lines[1:], ""]):
            if not line:
                continue
            k += 1
            if after and not ended[k] and not items[k + 1]:
                full = len(line) + 1 + len(after.split(None, 1)[0]) > width and len(line) >= 0.6 * width
                follows[k] = full or running and bool(bodies[k] and bodies[k + 1] and f"{bodies[k][-1]} {bodies[k + 1][0]}" in known)
    plain = [_ASIDE.sub("", line) if "<" in line or "://" in line or "(§" in line else line for line in text]
    letters_of, digits_of, runs = letters_and_digits(plain)
    step = _STEPS
    out = []
    for k, line in enumerate(text):
        rule = bool(_RULE.match(line) and _RULED.search(line))
        n_cells = cells(line)
        html = "<" in line and bool(_HTML_TABLE.match(line))
        body, letters, digits = plain[k], letters_of[k], digits_of[k]
        sizes = list(map(len, body.split()))
        dense = sum(sizes)
        signs = 1 - letters / dense if dense else 1.0
        noise = dense >= 8 and not rule and not html and letters + digits < 0.3 * dense
        level = 2 if html or rule or n_cells >= 3 else 1 if n_cells else 0
        if n_cells >= 2 and not html and not rule:
            numbers = len(_NUMBER_CELL.findall(body))
            level = 2 if numbers or n_cells >= 3 else 1
            if level == 2 and len(line) > 160 and numbers <= 1 and ended[k]:
                level = 1
        if noise:
            level = 0
        wrapped = follows[k] or k > 0 and follows[k - 1]
        words = bodies[k] if not html else words_of(body)
        familiar = 3
        if level < 2 and not (level and len(words) < 6):
            share = _familiarity(words, known) if words else 0.0
            familiar = 0 if share < 0.22 else 1 if share < 0.45 else 2
        odd = (not html and not rule and level < 2 or looping and level == 0) and (
            noise or looping or is_junky(body, sizes, digits, runs) or not words and not rule and not html or len(words) >= 12 and len(set(words)) <= 0.25 * len(words)
        )
        end = (ended[k] or follows[k]) if not wrapped or ended[k] else 2
        size = 3 if wrapped else 0 if len(line) < 50 else 1 if len(line) < 125 else 2
        sign = 0 if signs < 0.22 else 1 if signs < 0.5 else 2
        code = (items[k] and not rule) * step[0] + level * step[1] + bool(wrapped) * step[2] + end * step[3] + size * step[4] + sign * step[5] + familiar * step[6] + bool(odd) * step[7]
        out.append(code + (len(words) >= 25 and not _BREAK.search(line)))
    return out


def text_codes(text: str | None, known: frozenset[str]) -> tuple[list[int], list[int]] | None:
    """(code, characters) of each line that isn't blank, or None for null and blank texts."""
    if not text or is_blank(text):
        return None
    lines = ["" if is_blank(x) else x.rstrip() for x in _LINE.split(drop_invisible(text))]
    return line_codes(lines, known), [len(x) for x in lines if x]


def shape_of(shares: list[float], size: list[int]) -> str:
    """Shape by the share of each state's lines and its characters."""
    if shares[1] > 0.5:
        return "list"
    if shares[2] > 0.5:
        return "table"
    if shares[3] > 0.5 or size[3] > 0.5 * sum(size):
        return "junk"
    if shares[0] >= 0.5 or size[0] >= 0.5 * sum(size):
        return "prose"
    return STATES[max(range(4), key=lambda s: (shares[s], size[s]))]


def coded_lines(docs: DataFrame, id_col: str, text_col: str, known: frozenset[str]) -> DataFrame:
    """(id, codes, sizes) per row whose text isn't null or blank: two and four bytes a line."""
    picked = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")), "id")
    shared = docs.sparkSession.sparkContext.broadcast(known)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                got = [(k, *found) for k, text in enumerate(part.column(1).to_pylist()) if (found := text_codes(text, pairs))]
                columns = [part.column(0).take(pa.array([g[0] for g in got], pa.int64())), pa.array([np.array(g[1], np.uint16).tobytes() for g in got], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([np.array(g[2], np.uint32).tobytes() for g in got], pa.binary())], names=["id", "codes", "sizes"])

    return picked.mapInArrow(run, f"id {kind}, codes binary, sizes binary")


def _unpack(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=kind), np.array([len(x) for x in raw], dtype=np.int64) // np.dtype(kind).itemsize


def fit_shapes(coded: DataFrame, rounds: int = ROUNDS) -> Shapes:
    """The model fitted to all lines by Baum and Welch's method, from and towards ``PRIOR``; some 120 sums a round reach the driver."""
    model = Shapes()
    for _ in range(rounds):
        now = model

        def run(batches: Iterator[pa.RecordBatch], now: Shapes = now) -> Iterator[pa.RecordBatch]:
            seen: np.ndarray | float = 0.0
            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    codes, lengths = _unpack(batch.column(0).slice(start, 4096), np.uint16)
                    seen = seen + now.expect(codes, lengths)
            if isinstance(seen, np.ndarray):
                yield pa.RecordBatch.from_arrays([pa.array(range(len(seen)), pa.int32()), pa.array(seen, pa.float64())], names=["at", "n"])

        sums = {r["at"]: r["n"] for r in coded.select("codes").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()}
        if not sums:
            break
        model = model.refit(np.array([sums[k] for k in range(len(sums))]))
    return model


def document_shapes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: frozenset[str] | None = None) -> DataFrame:
    """One row (id_col, n_lines, prose, list, table, junk, shape) per row whose text isn't null or blank.

    The four columns are shares of its lines, blank ones not counted. Repeated rows are labelled alike; other columns
    are ignored. The familiar pairs (bounded by ``LEAST_SHARE``) go by broadcast. Texts are read twice, for the pairs and
    for the statistics of lines; these are written to the checkpoint folder, where fitting and labelling read them.
    """
    coded = cut(coded_lines(docs, id_col, text_col, familiar_pairs(docs, text_col) if known is None else known))
    model = fit_shapes(coded)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                if not part.num_rows:
                    continue
                codes, lengths = _unpack(part.column(1), np.uint16)
                sizes, _ = _unpack(part.column(2), np.uint32)
                labels, starts = model.label(codes, lengths), np.concatenate(([0], np.cumsum(lengths)[:-1]))
                shares = np.stack([np.add.reduceat(labels == s, starts, dtype=np.int64) for s in range(4)], axis=1) / lengths[:, None]
                chars = np.stack([np.add.reduceat(np.where(labels == s, sizes, 0), starts, dtype=np.int64) for s in range(4)], axis=1)
                shapes = [shape_of(a, b) for a, b in zip(shares.tolist(), chars.tolist())]
                columns = [part.column(0), pa.array(lengths, pa.int32()), *(pa.array(shares[:, s], pa.float64()) for s in range(4)), pa.array(shapes, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_lines", *STATES, "shape"])

    return coded.mapInArrow(run, f"id {kind}, n_lines int, prose double, list double, table double, junk double, shape string").withColumnRenamed("id", id_col)


def text_statistics(docs: DataFrame, common: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, n_words, mean_word_length, symbol_ratio, punctuated_lines, common_words) per row of ``docs``.

    Words are runs of letters in lower case; symbol_ratio is the share of characters other than letters, digits and
    white space; punctuated_lines the share of non-blank lines that end in . ! ? or their like; common_words the share
    of words in ``common`` (a fixed list of a few hundred words, of any language). Null and blank texts have 0 words
    and null shares. Only built-in functions.
    """
    listed = [r["word"] for r in common.select(F.lower("word").alias("word")).where("word IS NOT NULL").distinct().orderBy("word").limit(MOST_COMMON + 1).collect()]
    if len(listed) > MOST_COMMON:
        raise ValueError("the list of common words is too long to be a part of the plan")
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"[\s\x{A0}]+", "") != "")
    size = lambda c: F.size(c).cast("bigint")
    base = docs.select(F.col(id_col), words.alias("w"), lines.alias("l"), text.alias("t"))
    common_set = F.array(*(F.lit(w) for w in listed)) if listed else F.array().cast("array<string>")
    return base.select(
        id_col,
        size("w").alias("n_words"),
        F.round(F.aggregate("w", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)) / F.nullif(size("w"), F.lit(0)), 6).alias("mean_word_length"),
        F.round(F.length(F.regexp_replace("t", r"[\p{L}\p{N}\s\x{A0}]", "")) / F.nullif(F.length("t"), F.lit(0)), 6).alias("symbol_ratio"),
        F.round(size(F.filter("l", lambda x: x.rlike("[.!?…。！？؟][\"'”’»)]*[\\s\\x{A0}]*$"))) / F.nullif(size("l"), F.lit(0)), 6).alias("punctuated_lines"),
        F.round(size(F.filter("w", lambda w: F.array_contains(common_set, w))) / F.nullif(size("w"), F.lit(0)), 6).alias("common_words"),
    )
