"""Models as injected functions, with deterministic stand-ins for tests.

A model function takes and gives plain values; the engine calls it inside Arrow batches, and an exception becomes
an error value instead of ending the job. ``MODELS`` is the registry; a deployment replaces entries before use.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.quality import EQUIVALENT, LANGUAGE_WORDS, LEAST_UNIQUE, LEAST_WORDS, LONGEST_RUN, PREFIX


def stub_embed(text: str) -> list[float]:
    """A unit vector of 16 numbers that depends on the words alone."""
    vector = [0.0] * 16
    for word in text.lower().split():
        code = int(hashlib.md5(word.encode("utf-8", "replace")).hexdigest()[:8], 16)
        vector[code % 16] += 1.0 if code & 16 else -1.0
    size = sum(x * x for x in vector) ** 0.5 or 1.0
    return [x / size for x in vector]


def stub_translate(text: str, code: str) -> str:
    return f"[{code}] {text}"


def stub_chat(messages: Sequence[dict]) -> str:
    """Repeats the last message."""
    return messages[-1]["content"]


def stub_language(text: str) -> str | None:
    """``he`` or ``ar`` by the script of the first letter beyond ASCII, else ``en``; None without letters."""
    if not any(map(str.isalpha, text)):
        return None
    first = next((c for c in text if c.isalpha() and not c.isascii()), "a")
    return "he" if "\u0590" <= first <= "\u05ff" else "ar" if "\u0600" <= first <= "\u06ff" else "en"


def stub_pages(content: bytes) -> list[str]:
    """The text layer of a file that is text: its parts between form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def stub_markdown(content: bytes) -> str:
    return content.decode("utf-8", "replace")


def stub_words(content: bytes, dpi: int) -> list[dict]:
    """Each word of a file that is text, a page to a form feed, a block to a blank line, a line to a line; all of them sure."""
    out = []
    for page, text in enumerate(content.decode("utf-8", "replace").split("\f")):
        pos = 0
        for block, part in enumerate(text.split("\n\n")):
            for number, line in enumerate(part.split("\n")):
                for word in line.split():
                    out.append({"page": page, "block_num": block, "par_num": 0, "line_num": number, "pos": pos, "text": word, "conf": "95"})
                    pos += 1
    return out


def stub_script(content: bytes) -> bool | None:
    """Whether the first letter beyond ASCII of a file that is text is Hebrew; None where there is none."""
    first = next((c for c in content.decode("utf-8", "replace") if c.isalpha() and not c.isascii()), None)
    return None if first is None else "\u0590" <= first <= "\u05ff"


def stub_invoice(text: str) -> str:
    """An answer in the agreed shape that depends on the text's length alone; no JSON for texts of 0 modulo 3."""
    if len(text) % 3 == 0:
        return "no invoice"
    return json.dumps({"document_type": "sales" if len(text) % 3 == 1 else "expense", "amount": len(text), "vat": 0})


#: The models by what they do; a deployment replaces entries before it builds queries.
MODELS: dict[str, Callable] = {
    "page_words": stub_words, "image_script": stub_script, "page_texts": stub_pages, "document_markdown": stub_markdown, "language": stub_language, "translate": stub_translate,
    "embed": stub_embed, "chat": stub_chat, "invoice": stub_invoice,
}


def embed(text: Column, model: Callable[[str], Sequence[float]], prefix: str = "", tries: int = 3, wait: float = 1.5) -> Column:
    """I8: vector of ``prefix`` + text, null for blank texts and after ``tries`` failures."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(value: str | None) -> list[float] | None:
            if value is None or not value.strip():
                return None
            for attempt in range(1, tries + 1):
                try:
                    return [float(x) for x in model(prefix + value)]
                except Exception:
                    if attempt < tries:
                        time.sleep(wait * attempt)
            return None

        for batch in batches:
            yield batch.map(one)

    return run(text)


def _degenerate(text: str) -> bool:
    words = text.split()
    if len(words) < LEAST_WORDS:
        return False
    if len(set(words)) / len(words) < LEAST_UNIQUE:
        return True
    heads = [t[:PREFIX] for t in text.replace(".", " ").split() if len(t) >= PREFIX]
    run = best = 1
    for a, b in zip(heads, heads[1:]):
        run = run + 1 if a == b else 1
        best = max(best, run)
    return best >= LONGEST_RUN


def in_language(detect: Callable[[str], str | None]) -> Callable[[str, str], bool]:
    """An ``accept`` for :func:`translate`: short texts pass, others must be in the language asked for, or in one that
    detectors take for it."""
    return lambda out, code: len(out.split()) < LANGUAGE_WORDS or detect(out) in (code, *EQUIVALENT.get(code, ()))


def tagged(model: Callable[[str], str]) -> Callable[[str, str], str]:
    """A model of tagged texts as one of (text, code)."""
    return lambda text, code: model(f"<2{code}> {text}")


# How deep and how small a failed translation is cut.
DEEPEST, SMALLEST = 4, 40


def translate_text(text: str | None, code: str, model: Callable[[str, str], str], accept: Callable[[str, str], bool] | None = None) -> tuple[str | None, bool]:
    """(translation, whether all of it succeeded) with ever smaller pieces after a failure.

    Blank texts translate to themselves. A piece fails if the model raises, or its output degenerates or isn't accepted;
    pieces are sentences, or word runs of half the length where sentences don't shorten; they are joined by spaces.
    """
    from quillspark.functions.text import MARKS, SENTENCE_START

    as_python = lambda c: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), c)
    marks, boundary = re.compile(f"[{as_python(MARKS)}]"), re.compile(rf"(?<=[.!?])\s+(?=[{as_python(SENTENCE_START)}])")

    def pack(words: list[str], most: int) -> list[str]:
        lines: list[str] = []
        for word in words:
            if lines and len(lines[-1]) + 1 + len(word) <= most:
                lines[-1] += " " + word
            else:
                lines.append(word)
        return lines

    def attempt(piece: str, depth: int) -> tuple[str, bool]:
        try:
            out = model(marks.sub("", piece), code)
            if not _degenerate(out) and (accept is None or accept(out, code)):
                return out, True
        except Exception:
            pass
        if depth >= DEEPEST or len(piece) <= SMALLEST:
            return piece, False
        parts = [s for s in (x.strip() for x in boundary.split(piece)) if s]
        if len(parts) < 2 or min(map(len, parts)) >= 0.9 * len(piece):
            parts = pack(piece.split(), max(SMALLEST, len(piece) // 2))
        if len(parts) < 2:
            return piece, False
        done = [attempt(part, depth + 1) for part in parts]
        return " ".join(t for t, _ in done), all(ok for _, ok in done)

    if text is None:
        return None, True
    return (text, True) if not text.strip() else attempt(text.strip(), 0)


def translate(text: Column, code: Column, model: Callable[[str, str], str], accept: Callable[[str, str], bool] | None = None) -> Column:
    """Struct (text, ok) of :func:`translate_text`, one Arrow pass."""

    @F.pandas_udf("text string, ok boolean")
    def run(texts: pd.Series, codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([translate_text(t, c, model, accept) for t, c in zip(texts, codes)], columns=["text", "ok"])

    return run(text, code)


def language(text: Column, model: Callable[[str], str | None]) -> Column:
    """The code that the injected model gives a text; null for null, for none and for what makes the model fail."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(value: str) -> str | None:
            try:
                return model(value)
            except Exception:
                return None

        return texts.map(one, na_action="ignore").astype(object)

    return run(text)


def chat(messages: Column, model: Callable[[Sequence[dict]], str]) -> Column:
    """Struct (text, error): the model's answer to an array of (role, content), or what went wrong."""

    @F.pandas_udf("text string, error string")
    def run(asked: pd.Series) -> pd.DataFrame:
        rows = []
        for turns in asked:
            try:
                rows.append((model([{"role": m["role"], "content": m["content"]} for m in turns]), None))
            except Exception as problem:
                rows.append((None, str(problem) or type(problem).__name__))
        return pd.DataFrame(rows, columns=["text", "error"], dtype=object)

    return run(messages)


#: How much of an invoice's text a model is shown.
INVOICE_CHARS = 4000


def classify(text: Column, model: Callable[[str], str]) -> Column:
    """The model's raw answer for the first ``INVOICE_CHARS`` of an invoice's text; null where it fails, which
    :func:`quillspark.operators.ledger.decode` turns into the default record."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(value: str) -> str | None:
            try:
                return model(value)
            except Exception:
                return None

        return texts.map(one, na_action="ignore").astype(object)

    return run(F.left(F.coalesce(text, F.lit("")), F.lit(INVOICE_CHARS)))


# What a model is told after an answer that is no outline, what is said after the second, and how often it is asked.
OUTLINE_AGAIN, OUTLINE_FAILED, OUTLINE_TRIES = "That wasn't valid. Respond again with ONLY the JSON object, nothing else.", "Could not parse a slide outline from the model's response.", 2


def is_outline(raw: str) -> bool:
    """Whether an answer is JSON, fenced or not, with a slide that has a heading or a bullet."""
    bare = raw.strip()
    if bare.startswith("```"):
        bare = re.sub(r"```\s*$", "", re.sub(r"^```[a-zA-Z]*\n?", "", bare)).strip()
    try:
        slides = json.loads(bare)["slides"]
        return any(isinstance(s, dict) and (str(s.get("heading", "")).strip() or any(str(b).strip() for b in s.get("bullets") or [])) for s in slides or [])
    except (ValueError, TypeError, KeyError, RecursionError):
        return False


def ask_outline(messages: Column, model: Callable[[Sequence[dict]], str]) -> Column:
    """Struct (raw, tries, error): the first answer that is an outline, asked again once with a correction.

    After the last try, or where the model itself fails, ``raw`` is null and ``error`` says why. :func:`quillspark.operators.outline.normalise` reads ``raw``.
    """

    @F.pandas_udf("raw string, tries int, error string")
    def run(asked: pd.Series) -> pd.DataFrame:
        rows = []
        for turns in asked:
            said, done = [{"role": m["role"], "content": m["content"]} for m in turns], None
            for attempt in range(1, OUTLINE_TRIES + 1):
                try:
                    raw = model(said)
                except Exception as problem:
                    done = (None, attempt, str(problem) or type(problem).__name__)
                    break
                if is_outline(raw):
                    done = (raw, attempt, None)
                    break
                said = [*said, {"role": "user", "content": OUTLINE_AGAIN}]
            rows.append(done or (None, OUTLINE_TRIES, OUTLINE_FAILED))
        return pd.DataFrame(rows, columns=["raw", "tries", "error"])

    return run(messages)
