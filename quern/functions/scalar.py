"""The dialect's scalar functions as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.plans.dialect import first_match_pattern, replacement


def strlen(text: Column) -> Column:
    """Length in bytes."""
    return F.octet_length(text).cast("bigint")


def substr(text: Column, start: int | Column, length: int | Column | None = None) -> Column:
    """From a 1-based start, which is 1 at least, so many characters; a negative length is none."""
    start = F.greatest(start if isinstance(start, Column) else F.lit(start), F.lit(1))
    if length is None:
        return F.substr(text, start)
    return F.substr(text, start, F.greatest(length if isinstance(length, Column) else F.lit(length), F.lit(0)))


def replace_first(text: Column, pattern: str, new: str) -> Column:
    r"""The first match of a pattern replaced; ``\1`` to ``\9`` are groups and ``\&`` is the match."""
    return F.regexp_replace(text, first_match_pattern(pattern), "$1" + replacement(new))


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("bigint")
