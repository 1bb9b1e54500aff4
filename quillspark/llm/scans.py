"""Noise in text from scanned pages: furniture, divided words, misrecognised glyphs; found and repaired.

The corpus teaches the words: forms and neighbouring pairs are counted over all files, and those of a least
share (which bounds their number) are broadcast. A word that isn't among them is compared with those of the same
confusable-glyph skeleton; it is misrecognised if one of them becomes it by known confusions, and context (the
pair with the word before), then frequency choose among several. Running headers are lines that come again with
their digits masked, or stand beside page numbers and stamps. Lines flow together again over SQL windows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.marks import drop_invisible, is_blank
from quillspark.util import spread

#: A form or pair is known at this share of all; at most 1 / share of them can be, which bounds the broadcast.
LEAST_SHARE, LEAST_COUNT = 5e-6, 4
#: A form this many times rarer than one of its skeleton it can come from is noise itself.
RARER = 25
#: Widest line that a scan's page can have, and least share of lines that are broken where the width asks for it.
MOST_WIDTH, LEAST_BROKEN = 110, 0.6

# What scanners read (left) for what is written (right).
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("!", "i"), ("1", "i"), ("|", "i"), ("l", "i"), ("i", "l"), ("1", "l"), ("|", "l"), ("!", "l"), ("I", "l"), ("0", "o"),
    ("†", "t"), ("+", "t"), ("@", "a"), ("5", "s"), ("$", "s"), ("(", "c"), ("9", "g"), ("q", "g"), ("2", "z"), ("6", "b"), ("8", "b"), ("ν", "v"),
    ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("rn", "m"), ("m", "rn"), ("h", "li"), ("li", "h"), ("vv", "w"), ("w", "vv"),
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("f", "t"), ("3", "e"), ("4", "a"), ("7", "t"),
    ("ן", "ו"), ("1", "ו"), ("ו", "ן"), ("ח", "ה"), ("ה", "ח"), ("ד", "ר"), ("ר", "ד"), ("n", "ת"), ("'", "י"), ("כ", "ב"), ("ב", "כ"), ("y", "ע"), ("ם", "ס"),
    ("ס", "ם"), ("v", "ט"), ("0", "ס"), ("ז", "ו"), ("ו", "ז"), ("x", "א"), ("p", "ק"), ("w", "ש"), ("l", "ו"), ("י", "ו"), ("ו", "י"),
    ("m", "т"), ("u", "и"), ("g", "д"), ("n", "п"), ("r", "г"), ("ьl", "ы"), ("ьі", "ы"), ("п", "л"), ("л", "п"), ("e", "е"), ("o", "о"), ("a", "а"), ("c", "с"),
    ("p", "р"), ("x", "х"), ("y", "у"), ("k", "к"), ("b", "в"), ("h", "н"), ("3", "з"), ("0", "о"), ("6", "б"), ("ц", "и"), ("и", "н"), ("н", "и"), ("ш", "щ"), ("щ", "ш"),
)
# Words that stand with a page's number.
PAGE_WORDS = "pag|page|pagina|página|págs?|seite|blatt|folio|foglio|fol|pg|p|s|стр|страница|лист|עמוד|עמ|דף|صفحة|ص|第"
OF_WORDS = "di|of|von|de|sur|da|из|מתוך|من|/"
HYPHENS = "-‐‑¬\xad⁃﹣－=⸗"

_LEFT: dict[str, list[str]] = defaultdict(list)
for _noise, _true in CONFUSIONS:
    _LEFT[_noise].append(_true)


def _classes() -> dict[str, str]:
    """One representative for single glyphs that confusions join, in any number of steps."""
    parent: dict[str, str] = {}

    def top(c: str) -> str:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    for noise, true in CONFUSIONS:
        if len(noise) == len(true) == 1:
            a, b = sorted((top(noise), top(true)))
            parent[b] = a
    return {c: top(c) for c in parent}


_CLASS = _classes()
# Glyphs that pass for two others side by side.
_PARTS = {"n": "ri", "m": "rri", "h": "li", "u": "ii", "d": "cl", "w": "vv", "ﬁ": "fi", "ﬂ": "fl", "ы": "ьl"}


def _strokes() -> dict[int, str]:
    """What each glyph is written as in a skeleton: its class, or those of its parts. Taking apart has one result, where
    putting together depends on the order (``rriing`` of ``rning`` could begin with ``ri`` or ``ii``)."""
    parts = {_CLASS.get(c, c): "".join(_CLASS.get(p, p) for p in of) for c, of in _PARTS.items()}
    known = set(_CLASS) | set(_PARTS) | {"і"}
    return {ord(c): parts.get(k, k) for c in known for k in [_CLASS.get("l" if c == "і" else c, c)]}


_STROKES = _strokes()
_STRANGE = re.compile("[^\\w\\s'’‘\\-‐‑­¬./:,&%°״\"׳–—]")
_EDGE = " \t.,;:!?()[]{}«»“”\"„‘’'…–—-‐‑¬\xad*·•|/\\>‹›،؛؟"


_BESIDE = re.compile("[^\\w!|@†(+$'ν]|_")


def skeleton(word: str) -> str:
    """What words share that scanners take for one another: confusable glyphs in one form, composed ones by their parts,
    symbols left out."""
    return _BESIDE.sub("", word.lower()).translate(_STROKES)


def explained(noise: str, true: str) -> list[int] | None:
    """Places in ``noise`` where confusions turned ``true`` into it, as few as may be; None if they can't have.

    At most half of its glyphs, or three, may be confused: a word with more has too little left to tell it by.
    """
    best: dict[tuple[int, int], tuple[int, list[int]]] = {(0, 0): (0, [])}
    n, m = len(noise), len(true)
    most = max(3, n // 2)
    if abs(n - m) > most:
        return None
    for i in range(n + 1):
        for j in range(max(0, i - most), min(m, i + most) + 1):
            here = best.get((i, j))
            if here is None:
                continue
            cost, places = here

            def go(a: int, b: int, more: int, at: int | None) -> None:
                total = cost + more
                if total <= most and (old := best.get((a, b))) is None or total <= most and old[0] > total:
                    best[a, b] = (total, places if at is None else [*places, at])

            if i < n and j < m and noise[i] == true[j]:
                go(i + 1, j + 1, 0, None)
            for size in (1, 2):
                for written in _LEFT.get(noise[i : i + size], ()) if i + size <= n else ():
                    if true.startswith(written, j):
                        go(i + size, j + len(written), 1, i)
            if i < n and not noise[i].isalnum() and noise[i] not in "'’-":
                go(i + 1, j, 1, i)  # a speck beside the letters
                if j < m:
                    go(i + 1, j + 1, 1, i)  # a speck over a letter
    end = best.get((n, m))
    return end[1] if end and end[0] else None


def core(token: str) -> str:
    return token.strip(_EDGE)


class Lexicon:
    """Known forms and pairs of neighbouring forms, with their counts."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.pairs = {k: n for k, n in counts.items() if " " in k}
        forms = {k: n for k, n in counts.items() if " " not in k}
        by: dict[str, list[str]] = defaultdict(list)
        for word in forms:
            if len(word) >= 3:
                by[skeleton(word)].append(word)
        self.by = {k: sorted(words, key=lambda w: -forms[w]) for k, words in by.items()}
        self.words = forms
        for words in self.by.values():
            for word in words[1:]:
                if any(forms.get(other, 0) >= RARER * forms[word] and explained(word, other) is not None for other in words):
                    forms.pop(word)
        self.shapes: dict[int, list[str]] = defaultdict(list)
        for word in forms:
            self.shapes[len(word)].append(word)
        self.known = lru_cache(maxsize=100_000)(self._correct)
        self.masked: dict[tuple[int, tuple[int, ...]], dict[str, list[str]]] = {}

    def _alike(self, length: int, places: tuple[int, ...]) -> dict[str, list[str]]:
        """The forms of a length by what is left of them without the letters at ``places``."""
        got = self.masked.get((length, places))
        if got is None:
            if len(self.masked) >= 512:
                self.masked.clear()
            got = self.masked[length, places] = defaultdict(list)
            for o in self.shapes.get(length, ()):
                if all(o[i].isalnum() or o[i] == "_" for i in places):
                    got["".join(c for i, c in enumerate(o) if i not in places)].append(o)
        return got

    def _correct(self, word: str) -> tuple[tuple[str, tuple[int, ...]], ...]:
        """Known forms that confusions turn into ``word`` (lower case), the most frequent first, with the places."""
        if word in self.words or len(word) < 3:
            return ()
        found = []
        bare = "".join(c for c in word if c.isalnum() or c in "'’-")
        keys = {skeleton(word), skeleton(bare)}
        for key in keys:
            for other in self.by.get(key, ()):
                if other in self.words and (places := explained(word, other)) is not None:
                    found.append((other, tuple(places)))
        if not found and (_STRANGE.search(word) or re.search(r"\d", word)):
            # a symbol may stand for any letter: forms of the same length that agree elsewhere, or without it
            if bare != word and bare in self.words:
                found.append((bare, tuple(i for i, c in enumerate(word) if not c.isalnum())))
            else:
                places = tuple(i for i, c in enumerate(word) if not c.isalnum() and c not in "'’-")
                found = [(o, tuple(i for i, c in enumerate(word) if c != o[i])) for o in self._alike(len(word), places).get("".join(c for i, c in enumerate(word) if i not in places), ())]
        return tuple(sorted(set(found), key=lambda f: (len(f[1]), -self.words[f[0]])))

    def correct(self, token: str, before: str = "") -> tuple[str, list[int]] | None:
        """(form, places of the noise in ``token``) if the token is a misrecognised word, else None."""
        if "¬¬" in token and any(map(str.isalpha, token)):  # a smudge as wide as a glyph
            first = token.index("¬¬")
            got = self.correct(token.replace("¬¬", "■"), before)
            return (got[0] if got else core(token).lower()), [first]
        inner = core(token)
        if inner.lower() in self.words:
            return None
        tries = [inner] if inner else []
        lead = len(token) - len(token.lstrip(_EDGE))
        tail = token[lead + len(inner) :]
        if tail[:1] in tuple("!|'") and inner:
            tries.append(inner + tail[0])
        if lead and token[lead - 1] in "!|('":
            tries.append(token[lead - 1] + inner)
        for k, form in enumerate(tries):
            if sum(map(str.isalpha, form)) < 2:
                continue
            got = self.known(form.lower())
            if got:
                least = len(got[0][1])
                near = [g for g in got if len(g[1]) == least]
                word, places = max(near, key=lambda g: (self.pairs.get(f"{before} {g[0]}", 0), self.words[g[0]]))
                offset = token.index(form)
                return word, [offset + p for p in places]
        letters = sum(map(str.isalpha, inner))
        odd = _STRANGE.search(inner)
        if odd and letters >= 3 and not re.search(r"[@/]\w+\.\w|https?:", inner):
            return inner.lower(), [token.index(inner) + odd.start()]
        return None


def count_forms(files: DataFrame, text_col: str = "markdown") -> DataFrame:
    """(form, n): words in lower case without outer punctuation, and pairs of neighbours, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                n: Counter[str] = Counter()
                for text in batch.column(0).slice(start, 1000).to_pylist():
                    if text:
                        words = [w for t in drop_invisible(text).lower().split() if (w := t.strip(_EDGE))]
                        n.update(words)
                        n.update(map(" ".join, zip(words, words[1:])))
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["form", "n"])

    return files.select(F.col(text_col).cast("string")).mapInArrow(run, "form string, n bigint").groupBy("form").agg(F.sum("n").alias("n"))


def learn(files: DataFrame, text_col: str = "markdown") -> dict[str, int]:
    """Counts of the forms and pairs that make up at least ``LEAST_SHARE`` of all."""
    counts = count_forms(files, text_col).persist(StorageLevel.DISK_ONLY)  # read twice; a lost part is counted again
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = {r["form"]: r["n"] for r in counts.where(F.col("n") >= max(LEAST_COUNT, int(total * LEAST_SHARE))).collect()}
    counts.unpersist()
    return found


_TERMINAL = re.compile("[.;:,!?…。；：，！？،؛؟][\"'”’»)\\]]*\\s*$")
_HEADING = re.compile(r"\W*[^\W\d_]+\W{0,2}\s*\d{1,4}(?:\W*$|\s*[–—:-])")
_LIST_ITEM = re.compile(r"\s*(?:\d{1,3}[.)]|[-–—•*·])\s+\S")
_STAMP = re.compile(r"\d{1,2}[/.]\d{1,2}[/.]\d{2,4}\s+\d{1,2}[:.]\d{2}")
_DIGITLIKE = str.maketrans("lI|OoSsB", "11100558")
_NUMBER = re.compile(r"[\W_]*\d{1,4}(?:\s*/\s*\d{1,4})?[\W_]*")
_OF_NUMBER = re.compile(r"[\W_]*[\dlIO|]{1,4}\s*/\s*[\dlIO|]{1,4}[\W_]*")
_ROMAN = re.compile(r"\W*[IVXLC]{1,7}\W*|\W*[ivxlc]{1,7}\W*")
_PAGE = re.compile(rf"\W*(?:{PAGE_WORDS})\W{{0,2}}\s*[\dlIO|oS]{{1,4}}(?:\s*(?:{OF_WORDS})\s*[\dlIO|oS]{{1,4}})?\W*", re.IGNORECASE)


def is_page_number(line: str) -> bool:
    text = line.strip()
    if not text:
        return False
    if _PAGE.fullmatch(text) and re.search(r"[\dlIO|]", text):
        return True
    tight = text.translate(_DIGITLIKE) if len(text) <= 8 and re.search(r"\d", text) else text
    return bool(_NUMBER.fullmatch(text) or _OF_NUMBER.fullmatch(text) or _NUMBER.fullmatch(tight) or _NUMBER.fullmatch(tight.rstrip("1 ") + " ") and text[-1] == "|" or _ROMAN.fullmatch(text))


def is_marked_header(line: str) -> bool:
    """A running title on one line with the page's number: beside a bar, or set off by wide space."""
    text = line.strip()
    if " | " in text and not text.startswith("|"):
        left, _, right = text.rpartition(" | ")
        first, _, rest = text.partition(" | ")
        if is_page_number(right) or is_page_number(first) and rest:
            return True
    for number, title in re.findall(r"^(\S{1,9})\s{2,}(\S.*)$", text) + [(b, a) for a, b in re.findall(r"^(.*\S)\s{2,}(\S{1,9})$", text)]:
        if is_page_number(number) and re.search(r"[^\W\d_]{2}", title):
            return True
    return False


def header_key(line: str) -> str:
    """A line with its digits masked and confusable glyphs joined: running headers share it."""
    text = re.sub(r"\d+", "9", line.strip())
    return skeleton(re.sub(r"\s+", "", text))


def looks_scanned(lines: list[str]) -> int:
    """The page's width if the lines were broken by it, else 0."""
    full = [x.rstrip() for x in lines]
    filled = [x for x in full if x.strip()]
    if not filled or any(re.match(r"#{1,6} |\|.*\|\s*$|<\w+|```", x) for x in filled):
        return 0
    plain = [x for x in filled if not is_page_number(x) and not is_marked_header(x) and not _STAMP.search(x)]
    lengths = sorted(map(len, plain))
    if not lengths or lengths[-1] > MOST_WIDTH + 20:
        return 0
    width = lengths[int(0.92 * (len(lengths) - 1))]  # stray marks push some lines over the page's width
    if width > MOST_WIDTH or width < 20:
        return 0
    plain_set, good, bad = set(plain), 0, 0
    for a, b in zip(full, full[1:]):
        if a in plain_set and b in plain_set and not _LIST_ITEM.match(b) and not _LIST_ITEM.match(a):
            if len(a) + 1 + len(b.split(None, 1)[0]) > width - 4 or a[-1] in HYPHENS:
                good += 1
            else:
                bad += 1
    seeds = sum(is_page_number(x) or bool(_STAMP.search(x)) for x in filled)
    if good + bad == 0:
        return width if seeds else 0
    if good + bad < 3 and not seeds and len(filled) < 3:
        return width if good > bad else 0
    # headers and footers that touch the text break the pattern once or twice a page
    return width if good >= LEAST_BROKEN * (good + bad - min(bad, 2 * seeds)) and good else 0


def furniture(lines: list[str], width: int, lexicon: Lexicon) -> set[int]:
    """Places of the lines that belong to the page: numbers, stamps, running headers and footers."""
    at = [k for k, x in enumerate(lines) if x.strip()]
    sure = {k for k in at if is_page_number(lines[k]) or is_marked_header(lines[k]) or _STAMP.search(lines[k]) and len(lines[k].strip()) < 70 and len(re.findall(r"[^\W\d_]+", lines[k])) <= 4}

    def title(k: int) -> bool:
        text = lines[k].strip()
        return bool(text) and not _TERMINAL.search(text) and not re.search("[.;:,!?،؛] ", text) and text[-1] not in HYPHENS and not text[0].islower() and not _LIST_ITEM.match(text) and not _HEADING.match(text) and bool(re.search(r"[^\W\d_]{2}", text))

    def joins(a: int, b: int | None) -> bool:
        return b is not None and (core(lines[a].split()[-1]) + " " + core(lines[b].split()[0])).lower() in lexicon.pairs

    titles = {k: header_key(lines[k]) for k in at if title(k)}
    # noise can make a copy of a header look like no title, yet it counts
    keys = Counter(titles.values())
    if titles:  # a key's first glyphs show in a line's first ones, whatever groups they make
        heads = {key[:3] for key in titles.values()}
        keys.update(header_key(lines[k]) for k in at if k not in titles and header_key(lines[k].strip()[:24])[:3] in heads)
    out = set(sure)
    place = {k: i for i, k in enumerate(at)}
    for k in at:
        if k not in out and k in titles and keys[titles[k]] >= 2 and len(lines[k].strip()) > 5:
            out.add(k)
    for _ in range(2):
        for k in at:
            if k in out or k not in titles:
                continue
            i = place[k]
            before, after = at[i - 1] if i else None, at[i + 1] if i + 1 < len(at) else None
            last, following = next((x for x in reversed(at[:i]) if x not in out), None), next((x for x in at[i + 1 :] if x not in out), None)
            if last is not None and not _TERMINAL.search(lines[last]) and joins(last, k) or joins(k, following):
                continue  # the text goes through it
            beside = before in out or after in out
            text = lines[k].strip()
            letters = [c for c in text if c.isalpha()]
            capital = len(letters) > 5 and sum(c.isupper() for c in letters) > 0.8 * len(letters)
            alone_before = before is None or before in out or k - before > 1
            alone_after = after is None or after in out or after - k > 1
            if beside and (capital or alone_before and alone_after):
                out.add(k)
            elif beside and (before is None or before in out) and len(text) < 0.9 * width and after is not None and not _flows(lines[k], lines[after], width):
                out.add(k)
            elif beside and after in out and before is not None and not _TERMINAL.search(lines[before]) and text[0].isupper():
                out.add(k)
            elif i == 0 and sure and alone_after and after is not None and len(text) < 0.85 * width:
                out.add(k)
            elif capital and keys[titles[k]] >= 2:
                out.add(k)
    return out


def _flows(a: str, b: str, width: int) -> bool:
    return len(a.rstrip()) + 1 + len(b.split(None, 1)[0]) > width - 6


def examine(text: str, lexicon: Lexicon) -> tuple[list[str], dict[int, set[str]], dict[int, str]] | None:
    """(lines, kinds of noise by line from 0, repaired lines) of a scanned text; None if it doesn't come from a scan."""
    lines = [drop_invisible(x).replace("\r", "") for x in text.split("\n")]
    width = looks_scanned(lines)
    if not width:
        return None
    page = furniture(lines, width, lexicon)
    body = [k for k, x in enumerate(lines) if x.strip() and k not in page]
    noise: dict[int, set[str]] = {k: {"furniture"} for k in page}
    fixed: dict[int, str] = {}
    divided: dict[int, tuple[str, str]] = {}
    for k, nxt in zip(body, body[1:]):
        tail, head = lines[k].split()[-1], lines[nxt].split()[0]
        mark = tail[-1]
        if mark not in HYPHENS or len(tail) < 2 or not tail[-2].isalpha() and not _STRANGE.match(tail[-2]) and not tail[-2].isdigit():
            continue
        left, right = tail[:-1].lstrip(_EDGE), head.rstrip(_EDGE)
        if not right or right[0].isupper() and not left.isupper() or not any(map(str.isalpha, right)):
            continue
        whole, compound = (left + right).lower(), f"{left}-{right}".lower()
        if mark in "-‐‑" and whole not in lexicon.words and (compound in lexicon.words or lexicon.known(compound) and not lexicon.known(whole)):
            continue
        noise.setdefault(k, set()).add("hyphen")
        divided[k] = (left, right)
    starts = {nxt for k, nxt in zip(body, body[1:]) if k in divided}
    before = ""
    for i, k in enumerate(body):
        tokens = lines[k].split()
        for j, token in enumerate(tokens):
            if j == len(tokens) - 1 and k in divided:
                left, right = divided[k]
                if got := lexicon.correct(left + right, before):
                    word, places = got
                    if any(p < len(left) for p in places):
                        noise.setdefault(k, set()).add("glyph")
                    if any(p >= len(left) for p in places):
                        noise.setdefault(body[i + 1], set()).add("glyph")
                    cut = max(1, min(len(word) - 1, len(left)))
                    tokens[j] = token.replace(left, word[:cut])
                    divided[k] = (left, "\0" + word[cut:])
            elif j == 0 and k in starts:
                pass
            elif got := lexicon.correct(token, before):
                noise.setdefault(k, set()).add("glyph")
                inner = core(token) or token
                word = got[0] if not inner[:1].isupper() else got[0][:1].upper() + got[0][1:]
                tokens[j] = token.replace(inner, word)
            before = core(tokens[j]).lower()
        fixed[k] = " ".join(tokens)
    for k, nxt in zip(body, body[1:]):  # the second halves of words that were divided
        if k in divided:
            first, _, rest = fixed[nxt].partition(" ")
            left, right = divided[k]
            if right.startswith("\0"):
                clean = first.rstrip(_EDGE)
                first = right[1:] + first[len(clean) :]
            joined = fixed[k].rstrip()[:-1] + first
            fixed[k], fixed[nxt] = joined, rest
    return lines, noise, fixed


@lru_cache(maxsize=1)
def _lexicon_of(counts_id: int) -> Lexicon:
    return Lexicon(_pending.pop(counts_id))


_pending: dict[int, dict[str, int]] = {}


def _worker_lexicon(shared) -> Lexicon:
    counts = shared.value
    key = hash((len(counts), sum(counts.values()), min(counts, default="")))
    _pending[key] = counts
    return _lexicon_of(key)


def scanned_lines(files: DataFrame, id_col: str = "file_id", text_col: str = "markdown", counts: dict[str, int] | None = None) -> DataFrame:
    """One row (id_col, line_no, kinds, line, fixed) per line of each scanned text, blank ones left out; lines count from 1.

    ``kinds`` holds ``furniture`` alone, or ``hyphen`` and ``glyph``; ``fixed`` is the repaired line (null for
    furniture), to whose end a divided word's second half has moved. Null, blank and native texts give no row;
    repeated rows give theirs again. ``counts`` (from :func:`learn`) go by broadcast.
    """
    picked = spread(files.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")), "id")
    shared = files.sparkSession.sparkContext.broadcast(learn(files, text_col) if counts is None else counts)
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _worker_lexicon(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows: list[tuple] = []
                for row, text in enumerate(part.column(1).to_pylist()):
                    if not text or is_blank(text) or (got := examine(text, lexicon)) is None:
                        continue
                    lines, noise, fixed = got
                    rows += [(row, k + 1, sorted(noise.get(k, ())), line, fixed.get(k)) for k, line in enumerate(lines) if line.strip()]
                columns = [part.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string()))]
                columns += [pa.array([r[c] for r in rows], pa.string()) for c in (3, 4)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "line_no", "kinds", "line", "fixed"])

    return picked.mapInArrow(run, f"id {kind}, line_no bigint, kinds array<string>, line string, fixed string").withColumnRenamed("id", id_col)


def noise_found(files: DataFrame, id_col: str = "file_id", text_col: str = "markdown", counts: dict[str, int] | None = None) -> DataFrame:
    """(id_col, line_no, noise), one row per line of a scanned text and kind of noise in it."""
    return scanned_lines(files, id_col, text_col, counts).select(id_col, "line_no", F.explode("kinds").alias("noise"))


def continuous_paragraphs(files: DataFrame, id_col: str = "file_id", text_col: str = "markdown", counts: dict[str, int] | None = None) -> DataFrame:
    """One row (id_col, para_no, paragraph) per paragraph of each scanned text, repaired and flowing.

    Windows over a text's lines in order: a line begins a paragraph if blank lines or furniture lie in front of it and
    the line before ends a sentence, or if it is an item or heading. A text's lines are all its window holds.
    """
    lines = scanned_lines(files, id_col, text_col, counts).where("NOT array_contains(kinds, 'furniture') AND fixed <> ''")
    order = Window.partitionBy(id_col).orderBy("line_no")
    ended = r"[.!?:;…。！？؟][\"'”’»)\]]*$"
    item = r"^\s*(?:\d{1,3}[.)]|[-–—•*·])\s+\S"
    seen = lines.withColumn("gap", F.col("line_no") - F.lag("line_no").over(order)).withColumn("prior", F.lag("fixed").over(order))
    begins = F.col("prior").isNull() | F.col("fixed").rlike(item) | ((F.col("gap") > 1) & (F.col("prior").rlike(ended) | ~F.col("fixed").rlike(r"^\p{Ll}") & (F.col("gap") == 2) & F.col("prior").rlike(r"^\S+ \d+\.?$")))
    numbered = seen.withColumn("para_no", F.sum(begins.cast("int")).over(order).cast("bigint"))
    return numbered.groupBy(id_col, "para_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "fixed"))), lambda x: x["fixed"]), " ").alias("paragraph"))
