"""Exact decimals of any length as text: canonical spelling and a key that sorts by value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(text: str) -> str:
    sign = "-" if text.startswith("-") else ""
    whole, _, part = text.lstrip("+-").partition(".")
    whole, part = whole.lstrip("0") or "0", part.rstrip("0")
    if whole == "0" and not part:
        sign = ""
    return sign + whole + ("." + part if part else "")


def key(text: str) -> str:
    """Text whose order is the order of the numbers: sign, number of digits, digits; complements for negative ones."""
    c = canonical(text)
    size = c.lstrip("-")
    digits = f"{len(size.partition('.')[0]):06d}{size}"
    if not c.startswith("-"):
        return "1" + digits
    return "0" + digits.translate(str.maketrans("0123456789", "9876543210")) + "~"


def canonical_column(text: Column) -> Column:
    """As :func:`canonical`; digits with one point at most, which nearly all are, lose their zeros without the patterns."""
    ended = F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
    quick = F.when(ended == "-0", "0").otherwise(ended)
    return F.when(text.rlike("^-?(0|[1-9][0-9]*)(\\.[0-9]*)?\\z"), quick).otherwise(_by_patterns(text))


def _by_patterns(text: Column) -> Column:
    for pattern, instead in (("^\\+", ""), ("^(-?)0+(?=[0-9])", "$1"), ("(\\.[0-9]*?)0+$", "$1"), ("\\.$", ""), ("^-0$", "0")):
        text = F.regexp_replace(text, pattern, instead)
    return text


def key_column(canonical_text: Column) -> Column:
    size = F.regexp_replace(canonical_text, "^-", "")
    digits = F.concat(F.lpad(F.length(F.substring_index(size, ".", 1)).cast("string"), 6, "0"), size)
    return F.when(canonical_text.startswith("-"), F.concat(F.lit("0"), F.translate(digits, "0123456789", "9876543210"), F.lit("~"))).otherwise(F.concat(F.lit("1"), digits))
