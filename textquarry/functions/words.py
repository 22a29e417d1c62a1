"""Word rules for Python workers: the same tokens as functions.text gives on the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

INVISIBLE = "​‌‍­﻿"
_READ_AS = {"‐": "-", "‑": "-", "‘": "'", "’": "'"}


def _ranges(codes: range, keep: Callable[[str], bool]) -> str:
    """The code points for which keep holds, as the inside of a character class."""
    out, start, last = [], None, None
    for code in codes:
        if keep(chr(code)):
            if start is None:
                start = code
            last = code
        elif start is not None:
            out.append((start, last))
            start = None
    if start is not None:
        out.append((start, last))
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in out)


@lru_cache(maxsize=None)
def run_of(kind: str) -> str:
    """A pattern for a run of characters whose Unicode category begins with kind. The basic plane is one class,
    which the matcher reads from a bitmap; what lies beyond is tried only for characters from there."""
    basic, beyond = (_ranges(r, lambda c: unicodedata.category(c).startswith(kind)) for r in (range(0x10000), range(0x10000, sys.maxunicode + 1)))
    return rf"(?:[{basic}]++|(?=[\U00010000-\U0010FFFF])[{beyond}])++"


@lru_cache(maxsize=1)
def word_pattern() -> re.Pattern:
    letters, digits = run_of("L"), run_of("Nd")
    return re.compile(rf"{letters}(?:[-']{letters})*|{digits}(?:[.,]{digits})?")


def clean(text: str) -> str:
    """Without invisible characters, with plain hyphens and apostrophes, composed."""
    for c in INVISIBLE:
        if c in text:
            text = text.replace(c, "")
    for c, plain in _READ_AS.items():
        if c in text:
            text = text.replace(c, plain)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def words(text: str | None) -> list[str]:
    """The words of a text in their order; none for null."""
    if not text:
        return []
    return word_pattern().findall(clean(text).lower().replace("ё", "е"))
