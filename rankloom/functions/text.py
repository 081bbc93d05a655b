"""Title and text clean-up before words are counted."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE_SPACE = "\t\n\x0b\f\r"


def cut_at(text: Column, pattern: str) -> Column:
    """Everything before the first match of `pattern`, ignoring case; also inside a word."""
    return F.split(text, f"(?i){pattern}", 2)[0]


def tokens(text: Column) -> Column:
    """Lower-case words of a text, in order, without ASCII punctuation and digits. Runs of white space give
    empty words."""
    spaced = F.translate(F.lower(text), WHITE_SPACE + string.punctuation + string.digits, " " * len(WHITE_SPACE))
    return F.split(spaced, " ")
