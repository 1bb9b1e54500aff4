"""Unicode white space and invisible characters, as Python sets and as Java character classes."""

from __future__ import annotations

import re

# The characters with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0            "
    "    　"
)
# Zero-width, bidirectional and byte-order marks.
INVISIBLE = "​‌‍‎‏‪‫‬‭‮⁦⁧⁨⁩﻿"

_SPACES = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_MARKS = r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}"
JAVA_SPACE = f"[{_SPACES}]"
JAVA_INVISIBLE = f"[{_MARKS}]"
JAVA_UNSEEN = f"[{_SPACES}{_MARKS}]"


_SEEN = re.compile(f"[^{re.escape(WHITE_SPACE + INVISIBLE)}]")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")


def is_blank(text: str) -> bool:
    """Whether only white space and invisible characters are in ``text``."""
    return not _SEEN.search(text)


def drop_invisible(text: str) -> str:
    return _INVISIBLE.sub("", text)
