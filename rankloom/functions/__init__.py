"""Column expressions: labels, classification rules and title clean-up."""

from rankloom.functions.classify import first_match, listed_label, sub_group
from rankloom.functions.labels import caption, shorten, wrap_words
from rankloom.functions.text import cut_at, tokens

__all__ = ["caption", "cut_at", "first_match", "listed_label", "shorten", "sub_group", "tokens", "wrap_words"]
