"""The relational operators as DataFrame functions: joins, aggregation, windows, order, sets.

Catalyst plans them. What is added here is what it can't know: a size check before a broadcast, salt for a hot key, and
the kinds that Spark has no name for.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MIRRORED = {"right_semi": "left_semi", "right_anti": "left_anti"}


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``: from file sizes and the plan above them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def checked_broadcast(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows, as counted; else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]] = (), how: str = "inner", residual: Column | None = None, null_safe: bool = False) -> DataFrame:
    """Any join: equality of ``keys`` and a residual condition; without either, the cross product.

    ``how`` takes Spark's names and right_semi and right_anti.
    """
    if how in _MIRRORED:
        left, right, keys, how = right, left, [(r, k) for k, r in keys], _MIRRORED[how]
    same = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in keys]
    conditions = [*same, *([residual] if residual is not None else [])]
    if not conditions:
        return left.crossJoin(right)
    return left.join(right, reduce(lambda a, b: a & b, conditions), how)


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """An equality join for hot keys on the left: its rows are dealt in turn over ``salts`` copies of each right row.

    Only kinds that keep or drop left rows by their own matches: inner, left, left_semi and left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    dealt = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def aggregate(df: DataFrame, keys: Sequence[str | Column], **aggregates: Column) -> DataFrame:
    """One row for each group; one row in all without keys."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], **aggregates: Column) -> DataFrame:
    """The groups of each set in turn; a set given twice counts twice."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(*[c.alias(n) for n, c in aggregates.items()])


def running(partition: Sequence[str], order: Sequence[Column], peers: bool = True):
    """The default frame of an ordered window: from the start to the current row, its peers included or not."""
    window = Window.partitionBy(*partition).orderBy(*order)
    return window.rangeBetween(Window.unboundedPreceding, 0) if peers else window.rowsBetween(Window.unboundedPreceding, 0)


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Sorted by column names, a leading minus for descending; nulls last going up and first going down."""
    return df.orderBy(*[F.desc_nulls_first(k[1:]) if k.startswith("-") else F.asc_nulls_last(k) for k in keys])


def top(df: DataFrame, n: int, *keys: str, offset: int = 0) -> DataFrame:
    """The first rows in an order, which Spark keeps per partition and merges."""
    return ordered(df, *keys).offset(offset).limit(n)


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts)


def set_operation(kind: str, left: DataFrame, right: DataFrame, keep_all: bool = False) -> DataFrame:
    """union, intersect or except, by position; nulls equal each other."""
    if kind == "union":
        return left.union(right) if keep_all else left.union(right).distinct()
    if kind == "intersect":
        return left.intersectAll(right) if keep_all else left.intersect(right)
    if kind == "except":
        return left.exceptAll(right) if keep_all else left.subtract(right)
    raise ValueError(f"unknown set operation: {kind}")
