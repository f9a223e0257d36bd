"""Word rules that several operators share, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Between words of the white-space rule.
BLANKS = r"[\x20\x09-\x0D]+"
#: Between words of the letters-and-digits rule: every ASCII character that is neither.
PUNCT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; the built-in is used where it means the same."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def blank_words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def alnum_words(text: Column) -> Column:
    """Maximal runs of ASCII letters, digits and non-ASCII characters of the lower-cased text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), PUNCT), "")
