"""The one rule for ranking: by measure in the asked direction, nulls last, then ties ascending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_top(direction: str) -> bool:
    """True for "top", False for "bottom" (any case)."""
    choice = direction.lower()
    if choice not in ("top", "bottom"):
        raise ValueError(f"direction must be top or bottom, not {direction!r}")
    return choice == "top"


def rank_order(measure: str, ties: Sequence[str], direction: str) -> list[Column]:
    """Sort keys. The ties are ascending in both directions, so a rank never depends on row order."""
    by_measure = F.col(measure).desc_nulls_last() if is_top(direction) else F.col(measure).asc_nulls_last()
    return [by_measure, *(F.col(name).asc_nulls_last() for name in ties)]


def check_count(n: int) -> int:
    if n < 1:
        raise ValueError(f"n must be at least 1, not {n}")
    return n
