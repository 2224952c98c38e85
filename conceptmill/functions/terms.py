"""Term matching as regular expressions, evaluated in the JVM.

A letter without accent in the pattern matches the letter with any accent, an accented one only
itself, case apart; languages that have a letter of their own keep it apart.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that stand apart in a language, and stroke letters without a decomposition
OWN_LETTERS = {"sv": "åäö", "fi": "åäö", "da": "åæø", "nb": "åæø", "nn": "åæø", "no": "åæø", "es": "ñ", "pl": "ąćęłńóśźż"}
STROKES = {"ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ŧ": "t", "ı": "i"}
SAME_LETTER = {"sv": {"ö": "ø", "ä": "æ"}, "fi": {"ö": "ø", "ä": "æ"}, "da": {"ø": "ö", "æ": "ä"}, "nb": {"ø": "ö", "æ": "ä"}, "nn": {"ø": "ö", "æ": "ä"}, "no": {"ø": "ö", "æ": "ä"}}


@lru_cache(maxsize=1)
def _variants() -> dict[str, str]:
    out: dict[str, str] = {}
    for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(n)
        base = STROKES.get(c) or unicodedata.normalize("NFD", c)[0]
        if base != c and c == c.lower() and base.isascii() and base.isalpha():
            out[base.lower()] = out.get(base.lower(), "") + c
    return out


def _letter(c: str, language: str) -> str:
    own = OWN_LETTERS.get(language, "")
    if c in _variants():
        variants = "".join(v for v in _variants()[c] if v not in own and v not in SAME_LETTER.get(language, {}).values())
        marks = "" if own else "\\p{M}*"
        return f"[{c}{variants}]{marks}"
    same = SAME_LETTER.get(language, {}).get(c)
    return f"[{c}{same}]" if same else re.escape(c)


def pattern(word: str, language: str = "") -> str:
    return "".join(_letter(c, language) for c in unicodedata.normalize("NFC", word).lower())


def _by_language(term: Column, language: Column | None, build) -> Column:
    """One test for languages without letters of their own, one branch for each group of others that needs another."""
    low, plain = F.lower(term), build("")
    if language is None:
        return low.rlike(plain)
    branches: dict[str, list[str]] = {}
    for name in OWN_LETTERS:
        if build(name) != plain:
            branches.setdefault(build(name), []).append(name)
    out = None
    for expression, names in branches.items():
        out = (F.when if out is None else out.when)(language.isin(names), low.rlike(expression))
    return low.rlike(plain) if out is None else out.otherwise(low.rlike(plain))


def matches_words(term: Column, text: str, language: Column | None = None) -> Column:
    """Every word of ``text`` begins a word of the term, in any order."""
    return _by_language(term, language, lambda name: "(?s)^" + "".join("(?=.*(?<![\\p{L}\\p{N}])" + pattern(w, name) + ")" for w in text.split()))


def _split_escaped(text: str) -> list[str]:
    parts, now, i = [], "", 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            now += text[i + 1]
            i += 2
        elif text[i] == "*":
            parts.append(now)
            now = ""
            i += 1
        else:
            now += text[i]
            i += 1
    return [*parts, now]


def matches_wild(term: Column, text: str, language: Column | None = None) -> Column:
    """Parts between stars one after the other; the first and last are bound to the ends unless a star stands there."""
    parts = _split_escaped(text)
    return _by_language(term, language, lambda name: "(?s)^" + ".*".join(pattern(p, name) for p in parts) + "$")
