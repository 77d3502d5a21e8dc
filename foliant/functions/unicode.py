"""Character classes that mean the same in every regex dialect the engine meets.

Java's short classes are ASCII and its word boundary depends on the release,
so patterns spell out letters and digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AR = "؀-ۿ"
WORD = r"[\p{L}\p{N}_]"
BEFORE, AFTER = rf"(?<!{WORD})", rf"(?!{WORD})"
SPACE = r"[\s\p{Z}]"
#: Zero-width and directional marks.
HIDDEN = "[​-‏‪-‮⁠-⁯﻿]"
TASHKEEL = "[ً-ْ]"
SUPERSCRIPT, SUBSCRIPT, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉", "0123456789"


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    # most texts have none, and the rule would try each of their characters; the end may stand before a next line
    at_end = lambda t: F.substring(t, 1, 1).rlike(SPACE) | F.substring(t, -1, 1).rlike(rf"{SPACE}|\x85")
    return F.get(F.transform(F.array(text), lambda t: F.when(at_end(t), F.regexp_replace(t, rf"^{SPACE}+|{SPACE}+$", "")).otherwise(t)), F.lit(0))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, in order."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def blanks(text: Column) -> Column:
    """Runs of characters other than white space, in order."""
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))
