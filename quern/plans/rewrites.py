"""Rewrites above Catalyst: what it doesn't do by itself."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.relational import planned_bytes


def affine_sums(df: DataFrame, keys: Sequence[str], sums: Mapping[str, tuple[int, str, int]]) -> DataFrame:
    """Sums of a * x + b for many (a, x, b), from one sum and one count for each column x.

    Holds for integers, whose sums don't depend on order; the sum is null where x has no value.
    """
    columns = list(dict.fromkeys(x for _, x, _ in sums.values()))
    parts = [c for k, x in enumerate(columns) for c in (F.sum(F.col(x).cast("bigint")).alias(f"_s{k}"), F.count(x).alias(f"_n{k}"))]
    narrow = df.groupBy(*keys).agg(*parts)
    made = [(F.lit(a).cast("bigint") * F.col(f"_s{columns.index(x)}") + F.lit(b).cast("bigint") * F.col(f"_n{columns.index(x)}")).alias(n) for n, (a, x, b) in sums.items()]
    return narrow.select(*keys, *made)


def narrowed_groups(df: DataFrame, key: str, derived: Mapping[str, tuple[int, int]], **aggregates) -> DataFrame:
    """Groups by a key and by a * key + b of it: grouped by the key alone, the rest computed for each group.

    ``a`` must not be 0 (such a key is a constant).
    """
    grouped = df.groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(key, *[(F.lit(a) * F.col(key) + F.lit(b)).alias(n) for n, (a, b) in derived.items()], *aggregates)


def shared(df: DataFrame, uses: int, most_bytes: int = 8 << 30) -> DataFrame:
    """A common table for ``uses`` readers: kept once if it is read again and its planned size allows, else inlined."""
    if uses < 2 or planned_bytes(df) > most_bytes:
        return df
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def join_in_order(tables: Mapping[str, DataFrame], links: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Inner joins along (table, column, table, column) links, from the smallest table outwards.

    At each step the smallest table that a link connects comes next, so no step is a cross product if the links
    connect all tables. Column names must be distinct.
    """
    sizes = {n: planned_bytes(t) for n, t in tables.items()}
    left = sorted(tables, key=lambda n: (sizes[n], n))
    done = [left.pop(0)]
    out = tables[done[0]]
    while left:
        near = [n for n in left if any({a, c} == {n, d} for a, _, c, _ in links for d in done)]
        name = (near or left)[0]
        on = [(x, y) if a in done else (y, x) for a, x, c, y in links if (a == name and c in done) or (c == name and a in done)]
        if on:
            condition = F.lit(True)
            for x, y in on:
                condition = condition & (F.col(x) == F.col(y))
            out = out.join(tables[name], condition)
        else:
            out = out.crossJoin(tables[name])
        left.remove(name)
        done.append(name)
    return out
