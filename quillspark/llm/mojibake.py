"""Text that was decoded with the wrong character encoding: found and restored by a hidden Markov model.

States are one clean state and one per encoding pair (read as W, though written in T). The clean state emits
characters by a bigram model of the corpus' own trustworthy lines; a pair's state emits what those same
bigrams look like after encoding by T and decoding by W, so no labelled data are needed. Viterbi labels the
characters of a line; each labelled span gets its pair's inverse transform, and stands if the transform
succeeds and the result is likelier under the clean model.

Two passes over the texts, no shuffle but of bigram counts. Lines without a character outside ASCII can't be
affected; of the others only those whose best possible gain over the clean state exceeds the cost of leaving it
are decoded, which is a bound on the Viterbi score and so drops nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.marks import is_blank
from quillspark.util import spread

#: A bigram is in the model at this share of its script's (block of 256 code points, Han as one): at most 1 / share of
#: them can be, and a script that is rare in the corpus keeps its own.
LEAST_SHARE = 5e-6
#: Log probabilities of entering and leaving a pair's state.
ENTER, LEAVE = -7.0, -2.0
#: Smoothing: weight of the unigram in a bigram, and least probabilities.
SMOOTH, FLOOR = 20.0, 1e-9
#: Rows and columns of the table that bounds gains. Beyond, rare characters share the last ``SHARED`` of them, each of
#: which bounds all that share it; so lines are never lost, but more of them are decoded.
DENSE, SHARED = 3072, 512
#: So many letters in a row, of one script that the clean state hasn't seen, are text of that script, unless they are UTF-8.
UNSEEN_RUN = 3
#: A script (block of 128 code points) is seen if it makes up this share of clean text; less may be noise.
LEAST_SCRIPT = 1e-4
#: Cost of entering a state that explains other lines of the same text.
AGAIN = -2.5
#: By how much (in log probability) a restored line must be likelier than the line as found.
MARGIN = 2.0
#: A pair is taken to have touched a text if its restored spans gain this much together.
STRONG = 12.0
#: Texts that a worker repairs together.
TOGETHER = 128
LOSS = "�"
#: Encodings of two bytes a character, whose spans must begin at a character.
WIDE = ("gbk", "big5")

# Encoding pairs, as (read as, written in); a>b: what was read as a was written in UTF-8 and read as b.
PAIRS = (
    ("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"),
    ("cp1250", "utf-8"), ("cp1251", "utf-8"), ("cp1253", "utf-8"), ("cp1255", "utf-8"), ("cp1256", "utf-8"), ("koi8-r", "utf-8"),
    ("cp866", "utf-8"), ("cp862", "utf-8"), ("gbk", "utf-8"), ("cp1252>cp1252", "utf-8"), ("latin-1>latin-1", "utf-8"),
    ("latin-1>cp1252", "utf-8"), ("cp1252>latin-1", "utf-8"),
    ("cp1252", "cp1251"), ("cp1252", "cp1255"), ("cp1252", "cp1256"), ("cp1252", "gbk"), ("cp1252", "mac_roman"),
    ("cp1252", "cp862"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "cp1250"),
    ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("koi8-r", "cp1251"), ("cp866", "cp1251"),
    ("mac_roman", "cp1252"), ("mac_roman", "cp1251"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1250", "cp1252"),
    ("cp1255", "cp1252"), ("cp1256", "cp1252"), ("cp862", "cp1255"), ("cp1255", "cp862"), ("cp1253", "cp1252"),
    ("cp1251", "cp1255"), ("cp1251", "cp1256"), ("cp1255", "cp1251"), ("cp1256", "cp1251"), ("cp1252", "cp1253"), ("cp1252", "big5"),
    ("utf-8", "one byte"),
)


@lru_cache(maxsize=64)
def _table(name: str) -> tuple[str, ...]:
    """The 256 characters of a one-byte encoding; bytes it doesn't define read as in latin-1."""
    return tuple(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))


@lru_cache(maxsize=64)
def _bytes_of(name: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_table(name))))}


def _write(text: str, true: str) -> bytes | None:
    try:
        return text.encode(true)
    except UnicodeEncodeError:
        return None


def misread(text: str, wrong: str, true: str, lose: bool = False) -> str | None:
    """``text`` as it comes out if written in ``true`` and read as ``wrong``; None if it can't be written so.

    ``lose``: bytes that ``wrong`` doesn't define become replacement characters.
    """
    if true == "one byte":
        return re.sub(r"[^\x00-\x7f]", LOSS, text)
    if true != "utf-8" and not text.isascii() and is_blank(text):
        return None  # spaces and marks that a one-byte encoding holds tell nothing
    raw = _write(text, true)
    if raw is None:
        return None
    for name in wrong.split(">"):
        if name == "gbk":
            text = raw.decode("gbk", "replace")
        elif lose:
            text = raw.decode(name, "replace")
        else:
            text = "".join(_table(name)[b] for b in raw)
        raw = text.encode("utf-8")
    return text


def restore(text: str, wrong: str, true: str) -> str | None:
    """The inverse of :func:`misread` as far as the characters allow; lost ones stay replacement characters.

    None if a character of ``text`` can't have come from the pair.
    """
    if true == "one byte":
        return text
    for name in reversed(wrong.split(">")):
        if name == "gbk":
            raw = b"".join(b"\xff" if c == LOSS else c.encode("gbk", "ignore") or b"\xff" for c in text)
        else:
            codes, out = _bytes_of(name), bytearray()
            for c in text:
                code = 255 if c == LOSS and true == "utf-8" else 63 if c == LOSS else codes.get(c)
                if code is None:
                    return None
                out.append(code)
            raw = bytes(out)
        text = re.sub(LOSS + "+", LOSS, raw.decode("utf-8", "replace")) if true == "utf-8" else ""
    if true == "utf-8":
        return text
    if true in WIDE:
        return raw.decode(true, "replace")
    return "".join(_table(true)[b] for b in raw)


# Letters that the texts' languages use beyond ASCII, and pairs of them that occur side by side.
_LATIN = "àáâãäçèéêëìíîïñòóôõöùúûüßœæÀÁÂÃÄÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜŒÆ"
_SIDE_BY_SIDE = re.compile("[ñÑ][áéíóúÁÉÍÓÚ]|[çÇ][ãõáéóÃÕÁÉÓ]|[äöüÄÖÜ]ß|éé|ïé|ÉÉ")
_SYMBOLS = "„“”‘•…€§°«»¡¿·"
# Scripts beside those of the texts' languages, as blocks; a word of theirs has no letter of another.
_OTHER = "\u0370-\u03ff\u0530-\u058f\u0900-\u0e7f\u10a0-\u10ff\u1f00-\u1fff\u3040-\u30ff\uac00-\ud7af"
_RARE = "ÅåØøÐðÞþÝýÿ"
_EXTENDED = _RARE + "\u0100-\u024f\u1e00-\u1eff"
_EXTENDED_UPPER = "".join(c for k in (*range(0x100, 0x250), *range(0x1E00, 0x1F00)) if (c := chr(k)).isupper())
_FOREIGN_CLASS = (
    f"[^\\x00-\\x7f{_LATIN}{_EXTENDED}{_OTHER}א-תА-яЁёء-غـ-ْ"
    "一-鿿　-〕，-；！？（）؟،؛"
    "«»°§·…‐‑–—‘’“”„•€₪¿¡\xa0\u200b-\u200f\u202a-\u202e\u2066-\u2069\ufeff]"
)
_FOREIGN, _OTHERS = re.compile(_FOREIGN_CLASS), re.compile(f"[{_OTHER}]")
_ODD = re.compile(
    _FOREIGN_CLASS
    + f"|[{_LATIN}][{_LATIN}]|[ÃÂ][^A-ZÀ-Þ]|[a-zß-ÿ][À-ÖØ-Þ{_EXTENDED_UPPER}]"
    f"|[{_RARE}ĂĹ][{_LATIN}{_EXTENDED}]|[{_LATIN}{_EXTENDED}][{_RARE}ĂĹ]|[ĂĹ][^A-Za-z]|[ÄÂÃ][{_EXTENDED}]"
    f"|[{_EXTENDED}][„“”‘•…€§°«»¡¿·]|[„“”‘•…€§°«»¡¿·][{_EXTENDED}]"
    f"|[A-Za-zÀ-ÿ{_EXTENDED}А-яЁёא-תء-ي][{_OTHER}]|[{_OTHER}][A-Za-zÀ-ÿ{_EXTENDED}А-яЁёא-תء-ي]"
    f"|[{_EXTENDED}][А-яЁёא-תء-ي]|[А-яЁёא-תء-ي][{_EXTENDED}]|[α-ωά-ώ][Α-ΩΆ-Ώ]|[Α-Ω]{{3}}"
    "|[а-яё][А-ЯЁ]|[А-ЯЁ]{3}|[A-Za-zÀ-ÿ][А-яЁёא-תء-ي]|[А-яЁёא-תء-ي][A-Za-zÀ-ÿ]"
    "|[^\\W\\d_][„“”‘•…€§°«»¡¿·][^\\W\\d_]"
)


# Symbols that stand alone in clean text, and marks that divide a line's last word; next to letters beyond ASCII they may be half a character.
_ALONE = re.compile("(?<![^\\x00-\\x7f])(?:(?<![A-Za-z])[¢£¤¥¦©¬®¯±µ¶º¹¼½¾×÷ª†‡№™‰≠≤≥≈∞∑∏∂√∫Ø]|[²³])(?![^\\x00-\\x7f]|[A-Za-z])|(?<=[^\\W\\d_])[\xad¬]\\s*$")


_HAN = re.compile("[一-鿿]")


@lru_cache(maxsize=20_000)
def _common_han(c: str) -> bool:
    raw = c.encode("gb2312", "ignore")
    return len(raw) == 2 and 0xB0 <= raw[0] <= 0xD7


def trustworthy(line: str) -> bool:
    """Whether a line may teach the clean state: no characters or neighbours that wrong decoding leaves."""
    if line.isascii():
        return True
    if _ODD.search(line) and _ODD.search(_ALONE.sub("", _SIDE_BY_SIDE.sub("", line))):
        return False
    return all(map(_common_han, set(_HAN.findall(line))))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of each code point: 0 plain, 1 and 2 ASCII letters (lower, upper), 3 and 4 the Latin letters beyond, 5 Ã and Â,
    6 and 7 Cyrillic, 8 Hebrew and Arabic, 9 Han, 10 symbols, 11 what no text should hold, 12 further Latin letters, 13 other scripts."""
    kinds = np.full(0x110000, 11, dtype=np.uint8)
    kinds[:0x80] = 0
    for code in range(0x41, 0x10000):
        c = chr(code)
        if "一" <= c <= "鿿":
            kinds[code] = 9 if _common_han(c) else 11
        elif c.isascii():
            kinds[code] = 0 if not c.isalpha() else 2 if c.isupper() else 1
        elif not _FOREIGN.match(c):
            kinds[code] = 12 if c in _RARE or 0x100 <= code < 0x250 or 0x1E00 <= code < 0x1F00 else 13 if _OTHERS.match(c) else 5 if c in "ÃÂ" else (4 if c.isupper() else 3) if c in _LATIN else (7 if c.isupper() else 6) if "Ѐ" <= c <= "ӿ" else 8 if "֐" <= c <= "ۿ" and c.isalpha() else 10 if c in _SYMBOLS else 0
    return kinds


@lru_cache(maxsize=1)
def _neighbours() -> np.ndarray:
    """Which kinds are odd side by side: a superset of what :func:`trustworthy` refuses."""
    odd = np.zeros((14, 14), dtype=bool)
    odd[12, :] = odd[:, 12] = odd[13, :] = odd[:, 13] = True
    odd[11, :] = odd[:, 11] = True
    odd[np.ix_([3, 4, 5], [3, 4, 5])] = True
    odd[5, [0, 1, 3, 6, 7, 8, 9, 10]] = True
    odd[np.ix_([1, 3], [4, 5])] = True
    odd[6, 7] = odd[7, 7] = True
    odd[np.ix_([1, 2, 3, 4, 5], [6, 7, 8])] = odd[np.ix_([6, 7, 8], [1, 2, 3, 4, 5])] = True
    odd[1:10, 10] = True
    return odd


def trustworthy_lines(texts: list[str | None]) -> list[str]:
    """The lines of ``texts`` that may teach the clean state; only lines with odd neighbours are looked at one by one."""
    lines = "\n".join(text for text in texts if text).split("\n")
    kinds = _kinds()[np.frombuffer(("\n".join(lines) + "\n\n").encode("utf-32-le", "replace"), dtype=np.uint32)]
    odd = _neighbours()[kinds[:-1], kinds[1:]]
    starts = np.cumsum([0, *[len(line) + 1 for line in lines[:-1]]])
    doubtful = np.add.reduceat(odd, starts, dtype=np.int64) > 0
    return [line for line, doubt in zip(lines, doubtful.tolist()) if not doubt or trustworthy(line)]


def count_bigrams(files: DataFrame, text_col: str = "markdown") -> DataFrame:
    """(pair, n): bigrams of code points over all trustworthy lines, as first * 2^21 + second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                lines = trustworthy_lines(batch.column(0).slice(start, 256).to_pylist())
                codes = np.frombuffer(("\n" + "\n".join(lines)).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
                n = pd.Series((codes[:-1] << 21) | codes[1:]).value_counts(sort=False)
                yield pa.RecordBatch.from_arrays([pa.array(n.index.to_numpy(), pa.int64()), pa.array(n.to_numpy(), pa.int64())], names=["pair", "n"])

    return files.select(F.col(text_col)).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _least(c: str) -> float:
    """Least probability of a character in clean text that the corpus hasn't shown."""
    if c == LOSS:
        return 1e-16
    if "\x80" <= c <= "\x9f":
        return 1e-10
    return 1e-5 if c.isalpha() and ord(c) < 0x250 else 3e-6


def _utf8_pairs(span: str) -> list[int]:
    """The pairs of UTF-8 in which the first two neighbours beyond ASCII can begin a character."""
    beside = _ADJACENT.search(span)
    if not beside:
        return []
    a, b = beside[0]
    out = []
    for k in _UTF8:
        name = PAIRS[k - 1][0].split(">")[-1]
        if name == "gbk" or 0xC2 <= _bytes_of(name).get(a, 0) <= 0xF4 and 0x80 <= _bytes_of(name).get(b, 0) < 0xC0:
            out.append(k)
    return out


def _script(c: str) -> int:
    """0 for what is no letter, else one number per script that words don't mix."""
    code = ord(c) if c and c.isalpha() else 0
    return 0 if not code else 1 if code < 0x250 else 2 if code < 0x400 else 3 if code < 0x530 else code >> 8


def _breaks(text: str) -> int:
    """Places where letters of two scripts meet, or a capital follows a small letter: words of clean text have few."""
    return sum(1 for a, b in zip(text, text[1:]) if (x := _script(a)) and (y := _script(b)) and (x != y or a.islower() and b.isupper()))


def _misfits(before: str, span: str, better: str, after: str) -> int:
    """How many words that were whole a restored span breaks: by letters of another script or case, by a symbol in the
    place of a letter or a smudge, by a space that ends a word a second time."""
    broken = max(0, _breaks(before + better + after) - _breaks(before + span + after))
    if before.isalpha() and after.isalpha():
        broken += span[0].isalpha() and not better[0].isalpha() or span[-1].isalpha() and not better[-1].isalpha() or len(span) == 1 and not better[0].isalpha() and better not in "'’‘-"
    return broken + (better.isspace() and before.isalpha() and not after.isalnum())


# Marks that divide a word at a line's end, and smudges of scanners; these alone are no misreading.
_BEYOND = re.compile("[^\x00-\x7f]+")
_ADJACENT, _SHOUTED = re.compile("[^\x00-\x7f]{2}"), re.compile("[^\\W\\d_]+")
_UTF8 = [k for k, (_, true) in enumerate(PAIRS, 1) if true == "utf-8"]
_ASCII = re.compile("[\x00-\x7f]+")
_SMUDGE = re.compile("[\xad¬]|(?P<s>[¬■\xad])(?P=s)+|■")


class Model:
    """Emission tables of all states over the alphabet that the counts and their misreadings span.

    It is built once, by the driver, and broadcast: the bigrams of :func:`fit` and the misreadings of each.
    """

    def __init__(self, counts: list[tuple[int, int]]) -> None:
        clean = [(chr(k >> 21), chr(k & 0x1FFFFF), n) for k, n in counts]
        scripts: dict[int, int] = defaultdict(int)
        for _, b, n in clean:
            scripts[ord(b) >> 7] += n
        self.scripts = frozenset(k for k, n in scripts.items() if n >= LEAST_SCRIPT * sum(scripts.values()))
        tables: list[dict[tuple[str, str], float]] = [{(a, b): float(n) for a, b, n in clean}]
        for wrong, true in PAIRS:
            tables.append(self._simulate(clean, wrong, true))
        alphabet = sorted({c for t in tables for ab in t for c in ab})
        self.code = np.zeros(0x110000, dtype=np.int32)  # 0: a character of no table
        for k, c in enumerate(alphabet, 1):
            self.code[ord(c)] = k
        self.size = len(alphabet) + 1
        states = len(tables)
        keys = sorted({self._key(a, b) for t in tables for a, b in t})
        self.keys = np.array(keys, dtype=np.int64)
        at = {k: i for i, k in enumerate(keys)}
        uni = np.full((self.size, states), FLOOR)
        row_sum = np.zeros((self.size, states))
        for s, t in enumerate(tables):
            total = sum(t.values()) or 1.0
            for (a, b), n in t.items():
                uni[self.code[ord(b)], s] += n / total
                row_sum[self.code[ord(a)], s] += n
        for k, c in enumerate(alphabet, 1):
            uni[k, 0] = max(uni[k, 0], _least(c))
        uni[0] = 1e-9
        uni[0, 0] = 3e-6
        self.log_back = np.log(SMOOTH / (row_sum + SMOOTH)).astype(np.float32)  # weight of the unigram after a character
        self.log_uni = np.log(uni).astype(np.float32)
        probability = np.zeros((len(keys), states))
        firsts, seconds = self.keys // self.size, self.keys % self.size
        for s, t in enumerate(tables):
            for (a, b), n in t.items():
                probability[at[self._key(a, b)], s] = n
        probability = (probability + SMOOTH * uni[seconds]) / (row_sum[firsts] + SMOOTH)
        self.log_bi = np.log(probability).astype(np.float32)
        # one ASCII character after another says nothing about the encoding
        plain = np.array([True, *[c < "\x80" for c in alphabet]])
        plain[0] = False
        both = plain[firsts] & plain[seconds]
        self.log_bi[both] = self.log_bi[both, :1]
        self.plain = plain
        self.gains = self.clean = None

    def _tabulate(self) -> None:
        """Bound on the gain of a state over the clean one by pair of characters, a table for each group of states: pairs
        that read letters as letters of another alphabet would loosen the bound of all others."""
        if self.gains is not None:
            return
        letters = {"cp1253": 1, "cp1255": 1, "cp1256": 1, "cp1251": 2, "koi8-r": 2, "cp866": 2}
        group = [letters.get(wrong, 0) if true != "utf-8" else 0 for wrong, true in PAIRS]
        width = min(self.size, DENSE)
        self.slot = np.arange(self.size)
        if self.size > width:  # the characters that are likeliest in any state keep a slot of their own, ASCII and unknown ones first
            rank = self.log_uni.max(axis=1) + 100 * (self.plain | (np.arange(self.size) == 0))
            order = np.argsort(-rank, kind="stable")
            self.slot[order] = np.minimum(np.arange(self.size), width - SHARED + np.arange(self.size) % SHARED)
        own = np.bincount(self.slot, minlength=width) == 1
        firsts, seconds = self.slot[self.keys // self.size], self.slot[self.keys % self.size]
        exact = own[firsts] & own[seconds]
        plain = self.slot[self.plain]
        self.gains = []
        for g in sorted(set(group)):
            states = [k for k, x in enumerate(group, 1) if x == g]
            after, into = np.full((width, len(states)), -np.inf, dtype=np.float32), np.full((width, len(states)), -np.inf, dtype=np.float32)
            np.maximum.at(after, self.slot, self.log_back[:, states] - self.log_back[:, :1])
            np.maximum.at(into, self.slot, self.log_uni[:, states] - self.log_uni[:, :1])
            table = np.empty((width, width), dtype=np.float32)
            for a in range(width):
                table[a] = (into + after[a]).max(axis=1)
            gain = self.log_bi[:, states].max(axis=1) - self.log_bi[:, 0]
            table[np.ix_(plain, plain)] = 0
            table[firsts[exact], seconds[exact]] = gain[exact]
            np.maximum.at(table, (firsts[~exact], seconds[~exact]), gain[~exact])
            self.gains.append(table)

    def _key(self, a: str, b: str) -> int:
        return int(self.code[ord(a)]) * self.size + int(self.code[ord(b)])

    @staticmethod
    def _simulate(clean: list[tuple[str, str, int]], wrong: str, true: str) -> dict[tuple[str, str], float]:
        out: dict[tuple[str, str], float] = {}

        def add(text: str, start: int, n: float) -> None:
            for i in range(start, len(text)):
                out[text[i - 1], text[i]] = out.get((text[i - 1], text[i]), 0.0) + n

        single: dict[tuple[str, bool], str | None] = {}
        lossy = true == "utf-8" and ">" not in wrong and wrong not in ("latin-1", "gbk")
        for a, b, n in clean:
            if wrong == "gbk" and true == "utf-8" and not (a.isascii() and b.isascii()):
                whole = (a + b).encode("utf-8")
                for skip in (0, 1):
                    text = whole[skip if not a.isascii() else 0 :].decode("gbk", "replace")
                    add(text, 1, n / 2)
                continue
            for lose in (False, True) if lossy else (False,):
                for c in (a, b):
                    if (c, lose) not in single:
                        single[c, lose] = misread(c, wrong, true, lose)
                wa, wb = single[a, lose], single[b, lose]
                if wa and wb:
                    add(wa[-1] + wb, 1, n / 2 if lossy else n)
        return out

    def emissions(self, codes: np.ndarray, states: list[int] | None = None) -> np.ndarray:
        """Log probability of each character but the first, given the one before, in each state (or in ``states``)."""
        ids = self.code[codes].astype(np.int64)
        a, b = ids[:-1], ids[1:]
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        seen = self.keys[at] == key
        if states is None:
            out = self.log_back[a] + self.log_uni[b]
            out[seen] = self.log_bi[at[seen]]
        else:
            out = self.log_back[a[:, None], states] + self.log_uni[b[:, None], states]
            out[seen] = self.log_bi[at[seen][:, None], states]
        same = ~seen & self.plain[a] & self.plain[b]
        out[same] = out[same, :1]
        return out

    def suspects(self, lines: list[str]) -> list[int]:
        """Which lines could leave the clean state: those whose best gains together exceed the cost of entering."""
        if not lines:
            return []
        self._tabulate()
        codes = np.frombuffer(("\n" + "\n".join(lines)).encode("utf-32-le", "replace"), dtype=np.uint32)
        ids = self.slot[self.code[codes]]
        starts = np.cumsum([0, *[len(line) + 1 for line in lines[:-1]]])
        out: set[int] = set()
        for table in self.gains:
            gain = table[ids[:-1], ids[1:]]
            # a line's last value belongs to the line feed after it; the sum of what is gained bounds every run's sum
            for k in np.flatnonzero(np.add.reduceat(np.maximum(gain, 0), np.minimum(starts, len(gain) - 1)) > -ENTER).tolist():
                if k not in out:
                    over = np.cumsum(gain[starts[k] : starts[k] + len(lines[k])])
                    if (over - np.minimum.accumulate(np.concatenate(([0.0], over[:-1])))).max() > -ENTER:
                        out.add(k)
        return sorted(out)

    def _other_script(self, line: str) -> list[bool]:
        """Which characters stand in ``UNSEEN_RUN`` or more letters in a row of one script that clean text doesn't use, in
        the case of a word."""
        out, start, script = [False] * len(line), 0, 0
        for k, c in enumerate(line + "\n"):
            here = ord(c) >> 7 if c.isalpha() and ord(c) > 0xFF and ord(c) >> 7 not in self.scripts else 0
            if here != script:
                run = line[start:k]
                if script and len(run) >= UNSEEN_RUN and (run[1:] == run[1:].lower() or run == run.upper()):
                    out[start:k] = [True] * len(run)
                start, script = k, here
        return out

    def clean_score(self, text: str) -> float:
        """Log probability of a text in the clean state, as after a line feed. Spans are short, so a table in Python is faster."""
        if self.clean is None:
            chars = ["\0"] * self.size
            for code in np.flatnonzero(self.code):
                chars[self.code[code]] = chr(code)
            pairs = {chars[a] + chars[b]: v for a, b, v in zip((self.keys // self.size).tolist(), (self.keys % self.size).tolist(), self.log_bi[:, 0].tolist())}
            self.clean = pairs, dict(zip(chars, self.log_back[:, 0].tolist())), dict(zip(chars, self.log_uni[:, 0].tolist()))
        pairs, back, uni = self.clean
        total, before, no_back, no_uni = 0.0, "\n", back["\0"], uni["\0"]
        for c in text:
            value = pairs.get(before + c)
            total += back.get(before, no_back) + uni.get(c, no_uni) if value is None else value
            before = c
        return total

    def label(self, lines: list[str], known: list[frozenset[int]], only_known: list[bool]) -> list[list[int] | None]:
        """State of each character of each line, 0 for clean; None for lines that are clean as a whole.

        A line's ``known`` states are easier to enter. ``only_known``: no other state can be worth entering, as
        :meth:`suspects` shows. Lines of like length go through Viterbi together.
        """
        out: list[list[int] | None] = [None] * len(lines)
        jobs = []
        for i, line in enumerate(lines):
            codes = np.frombuffer(("\n" + line).encode("utf-32-le", "replace"), dtype=np.uint32)
            columns = [0, *sorted(known[i])] if only_known[i] else range(len(PAIRS) + 1)
            emit = self.emissions(codes, columns if only_known[i] else None)
            # a state is worth entering only if some run of characters gains more in it than entering costs
            least = np.array([np.inf, *(-AGAIN if s in known[i] else -ENTER for s in columns[1:])])
            gains = emit - emit[:, :1]
            able = np.flatnonzero(np.maximum(gains, 0).sum(axis=0) > least)
            over = np.zeros((len(emit) + 1, len(able)), dtype=np.float32)
            np.cumsum(gains[:, able], axis=0, out=over[1:])
            best = (over - np.minimum.accumulate(over, axis=0)).max(axis=0, initial=0)
            places = [0, *able[best > least[able]].tolist()]
            if len(places) > 1:
                emit = emit[:, places].astype(np.float64)
                # where all states emit alike, staying is best: only the other characters are steps
                steps = np.flatnonzero((emit != emit[:, :1]).any(axis=1))
                jobs.append((len(steps), i, [columns[k] for k in places], steps, emit[steps]))
        jobs.sort(key=lambda job: job[:2])
        while jobs:
            size, most, states = 0, 0, 0
            for n, _, ids, _, _ in jobs:  # as many as fit into about 2 million values
                most, states = max(most, n), max(states, len(ids))
                if size and (size + 1) * most * states > 2_000_000:
                    break
                size += 1
            for (_, i, ids, steps, _), path in zip(jobs[:size], self._paths(jobs[:size], known)):
                labels = np.zeros(len(lines[i]), dtype=np.int64)
                labels[steps] = np.array(ids)[path]
                out[i] = labels.tolist() if labels.any() else None
            jobs = jobs[size:]
        return out

    @staticmethod
    def _paths(jobs: list[tuple], known: list[frozenset[int]]) -> list[np.ndarray]:
        """Viterbi's best path of each job (steps, line, states, places, emissions), shorter ones first."""
        count, longest, width = len(jobs), jobs[-1][0], max(len(job[2]) for job in jobs)
        emit = np.full((longest, count, width), -1e30)
        enter, leave = np.full((count, width), -1e30), np.zeros((count, width))
        for j, (n, i, states, _, part) in enumerate(jobs):
            emit[:n, j, : len(states)] = part
            enter[j, : len(states)] = [0.0, *(AGAIN if s in known[i] else ENTER for s in states[1:])]
        leave[:, 1:] = LEAVE
        begins = np.searchsorted([job[0] for job in jobs], np.arange(longest), side="right")  # the first job that has a step
        moved, sources = np.zeros((longest, count, width), dtype=bool), np.zeros((longest, count), dtype=np.int64)
        value = enter + emit[0]
        rows = np.arange(count)
        for t in range(1, longest):
            k = begins[t]
            out = value[k:] + leave[k:]
            sources[t, k:] = source = out.argmax(axis=1)
            move = enter[k:] + out[rows[: count - k], source][:, None]
            np.greater(move, value[k:], out=moved[t, k:])
            value[k:] = np.maximum(move, value[k:]) + emit[t, k:]
        at = value.argmax(axis=1)
        paths = np.zeros((longest, count), dtype=np.int64)
        for t in range(longest - 1, 0, -1):
            k = begins[t]
            paths[t, k:] = at[k:]
            at[k:] = np.where(moved[t, rows[k:], at[k:]], sources[t, k:], at[k:])
        paths[0] = at
        return [paths[: job[0], j] for j, job in enumerate(jobs)]

    def repair(self, line: str, labels: list[int] | None) -> tuple[str, dict[int, float]] | None:
        """The restored line and what each state that restored it gains, or None if it is clean, by the states of its characters.

        Characters lost in decoding stay replacement characters.
        """
        if labels is None:
            return None
        for s in {x for x in labels if x and PAIRS[x - 1][1] in WIDE}:  # whole runs, as characters have two bytes
            for run in re.finditer(r"[^\x00-\x7f]+", line):
                if s in labels[run.start() : run.end()]:
                    labels[run.start() : run.end()] = [s] * len(run.group())
        for run in _BEYOND.finditer(line):  # a character cut off at a span's end belongs to it if the whole run decodes with it
            inside = labels[run.start() : run.end()]
            states = {x for x in inside if x}
            if 0 in inside and len(states) == 1 and PAIRS[(state := states.pop()) - 1][1] == "utf-8":
                whole = restore(run[0], *PAIRS[state - 1])
                if whole is not None and LOSS not in whole and len(whole) < len(run[0]):
                    labels[run.start() : run.end()] = [state] * len(inside)
        other, folded = self._other_script(line), _SHOUTED.sub(lambda m: m[0].lower() if m[0].isupper() and len(m[0].lower()) == len(m[0]) else m[0], line)
        out, start, used = [], 0, {}
        for i in range(1, len(line) + 1):
            if i < len(line) and labels[i] == labels[start]:
                continue
            span, state, before = line[start:i], labels[start], line[start - 1 : start]
            start = i
            if state and not span.isascii():
                better, whole = restore(span, *PAIRS[state - 1]), False
                if _SMUDGE.fullmatch(_ASCII.sub("", span)) and (before.isalpha() or len(span) > 1):
                    better = span
                elif better is None or PAIRS[state - 1][1] != "utf-8" or LOSS in better:
                    # a span that another pair reads as UTF-8 without loss hardly came about otherwise
                    exact = [(self.clean_score(x), x, k) for k in _utf8_pairs(span) if (x := restore(span, *PAIRS[k - 1])) is not None and LOSS not in x and len(x) < len(span)]
                    if exact and (better is None or LOSS in better or max(exact)[0] + STRONG > self.clean_score(better)):
                        (_, better, state), whole = max(exact), True
                    elif 2 * sum(other[i - len(span) : i]) > sum(map(str.isalpha, span)):
                        better = span  # text of its own script
                    elif better is None or LOSS in better and LOSS not in span:  # a like pair may lose nothing
                        others = [(self.clean_score(x), x, k) for k, pair in enumerate(PAIRS, 1) if (x := restore(span, *pair)) is not None and LOSS not in x and x != span]
                        if others:
                            _, better, state = max(others)
                else:
                    whole = bool(_ADJACENT.search(span))
                if better is not None and (better != span or LOSS in span):
                    ends = line[i : i + 1]
                    found = max(self.clean_score(before + span + ends), self.clean_score(folded[i - len(span) - len(before) : i + 1]))
                    gain = self.clean_score(before + better + ends) - found
                    if LOSS in span or gain > MARGIN + STRONG * (1 + broken if not whole and (broken := _misfits(before, span, better, ends)) else 0):
                        span = better
                        used[state] = used.get(state, 0.0) + (STRONG if LOSS in span else gain)
            out.append(span)
        return ("".join(out), used) if used else None

    def repair_texts(self, texts: list[str | None]) -> list[dict[int, str]]:
        """Restored lines of each text by their place, from 0. States that restore some line are easier to enter in others."""
        lines = [text.split("\n") if text and not text.isascii() else [] for text in texts]
        places = [(i, k) for i, of_text in enumerate(lines) for k, line in enumerate(of_text) if not line.isascii()]
        doubtful = [places[at] for at in self.suspects([lines[i][k] for i, k in places])]
        first: list[dict[int, tuple[str, dict[int, float]]]] = [{} for _ in texts]
        gains: list[dict[int, float]] = [{} for _ in texts]
        for (i, k), labels in zip(doubtful, self.label([lines[i][k] for i, k in doubtful], [frozenset()] * len(doubtful), [False] * len(doubtful))):
            if got := self.repair(lines[i][k], labels):
                first[i][k] = got
                for state, gain in got[1].items():
                    gains[i][state] = gains[i].get(state, 0.0) + gain
        known = [frozenset(state for state, gain in of_text.items() if gain >= STRONG) for of_text in gains]
        done = [{k: better for k, (better, used) in first[i].items() if known[i] & used.keys()} for i in range(len(texts))]
        again, seen = [(i, k) for i, k in places if known[i] and k not in done[i]], set(doubtful)
        for (i, k), labels in zip(again, self.label([lines[i][k] for i, k in again], [known[i] for i, _ in again], [at not in seen for at in again])):
            if (got := self.repair(lines[i][k], labels)) and known[i] & got[1].keys():
                done[i][k] = got[0]
        return done

    def repair_text(self, text: str) -> dict[int, str]:
        return self.repair_texts([text])[0]


def fit(files: DataFrame, text_col: str = "markdown") -> list[tuple[int, int]]:
    """Counts of the bigrams of all trustworthy lines that make up ``LEAST_SHARE`` of their script's, in order."""
    high = F.greatest(F.shiftright("pair", 21), F.col("pair").bitwiseAND(F.lit(0x1FFFFF)))
    script = F.when(high.between(0x3400, 0x9FFF), F.lit(0x4E)).otherwise(F.shiftright(high, 8))
    # the window is over different bigrams, not over texts
    counts = count_bigrams(files, text_col).withColumn("script", script).withColumn("all", F.sum("n").over(Window.partitionBy("script")))
    return sorted((r["pair"], r["n"]) for r in counts.where(F.col("n") >= F.col("all") * LEAST_SHARE).select("pair", "n").collect())


def repaired_lines(files: DataFrame, id_col: str = "file_id", text_col: str = "markdown", counts: list[tuple[int, int]] | None = None) -> DataFrame:
    """One row (id_col, line_no, line, restored) per line in which wrong decoding is found; lines count from 1.

    ``restored`` equals ``line`` where nothing but lost characters is left of it. Null and empty texts have no such
    lines; repeated rows give theirs again; other columns are ignored. The model of ``counts`` (from :func:`fit`) goes by broadcast.
    """
    picked = spread(files.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")), "id")
    shared = files.sparkSession.sparkContext.broadcast(Model(fit(files, text_col) if counts is None else counts))
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                texts, found = part.column(1).to_pylist(), ([], [], [], [])
                for row, repaired in enumerate(model.repair_texts(texts)):
                    lines = texts[row].split("\n") if repaired else []
                    for k, better in sorted(repaired.items()):
                        for column, value in zip(found, (row, k + 1, lines[k], better)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(found[0], pa.int64())), pa.array(found[1], pa.int64()), pa.array(found[2], pa.string()), pa.array(found[3], pa.string())], names=["id", "line_no", "line", "restored"])

    return picked.mapInArrow(run, f"id {kind}, line_no bigint, line string, restored string").withColumnRenamed("id", id_col)


def restored_texts(files: DataFrame, id_col: str = "file_id", text_col: str = "markdown", counts: list[tuple[int, int]] | None = None) -> DataFrame:
    """One row (id_col, text_col) per row of ``files`` with affected lines restored and all others as they are."""
    picked = spread(files.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")), "id")
    shared = files.sparkSession.sparkContext.broadcast(Model(fit(files, text_col) if counts is None else counts))
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                texts = part.column(1).to_pylist()
                for row, better in enumerate(model.repair_texts(texts)):
                    if better:
                        texts[row] = "\n".join(better.get(k, line) for k, line in enumerate(texts[row].split("\n")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "body"])

    return picked.mapInArrow(run, f"id {kind}, body string").withColumnRenamed("id", id_col).withColumnRenamed("body", text_col)
