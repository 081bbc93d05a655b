"""Rule tables as column expressions. The first rule that matches gives the label."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def found(value: Column, pattern: str) -> Column:
    """Whether `pattern` occurs anywhere in `value`, ignoring case.

    A pattern that only lists plain texts ("hip hop|rap") is searched for as text, several times faster than
    as a regular expression; the lower-cased value is shared by all rules of a table.
    """
    if re.search(r"[\\^$.?*+()\[\]{}]", pattern):
        return value.rlike(f"(?i){pattern}")
    return reduce(or_, (F.lower(value).contains(text.lower()) for text in pattern.split("|")))


def first_match(value: Column, rules: Iterable[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern found in `value`; null gets the default."""
    label = F
    for pattern, name in rules:
        label = label.when(found(value, pattern), F.lit(name))
    return F.lit(default) if label is F else label.otherwise(F.lit(default))


def listed_label(value: Column, lists: Iterable[tuple[str, list[str]]], default: Column) -> Column:
    """Label of the first list that holds `value` exactly."""
    label = F
    for name, members in lists:
        label = label.when(value.isin(members), F.lit(name))
    return default if label is F else label.otherwise(default)


def sub_group(
    group: Column,
    genre: Column,
    lists: Mapping[str, list[tuple[str, list[str]]]],
    defaults: Mapping[str, str | None],
) -> Column:
    """Sub-group of a genre inside its group. A group without lists is its own sub-group."""
    label = F
    for name, members in lists.items():
        fallback = defaults.get(name)
        inside = listed_label(genre, members, genre if fallback is None else F.lit(fallback))
        label = label.when(group == name, inside)
    return group if label is F else label.otherwise(group)
