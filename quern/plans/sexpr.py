"""Plans written as s-expressions, built as DataFrames.

    (rel source "path" ["alias"] [hint])      (rel filter R expr)        (rel project R (name expr) ...)
    (rel aggregate R (keys k ...) (agg name function [column]) ...)
    (rel join L R ((l r) ...) (type) [residual])      (rel union-all R ...)
    (rel sort R (column asc|desc nulls) ...)  (rel top-sort R (column ...) ... (limit n))
    (rel limit R (limit n) [(offset m)])      (rel cte-ref id)
    (rel window R [(partition k ...)] [(order (k asc|desc nulls) ...)] [(frame mode (start b) (end b))] (fn name f [column]) ...)
    (query (cte id R) ... (main R))

A path is a Parquet file or a table's name. Expressions are names (``|t.c|`` with an alias), texts, ``(: value type)``,
operators, ``(if c a b)``, ``(cast e type)`` and ``(call f e ...)`` with the names of SQL functions; a caller whose plans
use other names gives a map of them. A hint on a source is left to Parquet pushdown.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scalar
from quern.operators import relational as R
from quern.plans.tokens import DialectError

_READ = re.compile(r"""\s*(?:;[^\n]*\n\s*)*(?:(?P<paren>[()])|"(?P<text>(?:[^"\\]|\\.)*)"|\|(?P<bar>[^|]*)\||(?P<atom>[^\s()"|]+))""")

#: Names of types and of nulls orders. Fixed values.
_TYPES = {"i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "u8": "boolean", "bool": "boolean", "f64": "double", "string": "string"}
_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "like": lambda text, pattern: F.like(text, F.replace(pattern, F.lit("\\"), F.lit("\\\\"))),
    "substring": scalar.substr,
    "year": F.year,
    "sqrt": F.sqrt,
    "strlen": scalar.strlen,
    "abs": F.abs,
    "round": F.round,
    "upper": F.upper,
}
_OPERATORS: dict[str, Callable[..., Column]] = {
    "+": lambda a, b=None: a if b is None else a + b,
    "-": lambda a, b=None: -a if b is None else a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
    "%": lambda a, b: a % b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "&&": lambda a, b: a & b,
    "||": lambda a, b: a | b,
    "!": lambda a: ~a,
}


class Text(str):
    """A quoted text, as opposed to a name."""


def parse(source: str):
    """The expression of a text: lists, names and quoted texts."""
    stack: list[list] = [[]]
    at = 0
    source = source.strip()
    while at < len(source):
        m = _READ.match(source, at)
        if not m:
            raise DialectError(f"unreadable: {source[at : at + 30]!r}")
        at = m.end()
        if m["paren"] == "(":
            stack.append([])
        elif m["paren"] == ")":
            if len(stack) == 1:
                raise DialectError("unbalanced parentheses")
            done = stack.pop()
            stack[-1].append(done)
        elif m["text"] is not None:
            stack[-1].append(Text(re.sub(r"\\(.)", r"\1", m["text"])))
        else:
            stack[-1].append(m["bar"] if m["bar"] is not None else m["atom"])
    if len(stack) != 1 or len(stack[0]) != 1:
        raise DialectError("one balanced expression is expected")
    return stack[0][0]


def column(e, names: Mapping[str, str] = MappingProxyType({})) -> Column:
    """The Column of an expression; ``names`` says what functions of other names are called here."""
    if isinstance(e, Text):
        return F.lit(str(e))
    if isinstance(e, str):
        if e in ("true", "false"):
            return F.lit(e == "true")
        return F.lit(float(e) if "." in e or "e" in e else int(e)) if re.fullmatch(r"-?\d+(\.\d*)?(e-?\d+)?", e) else F.col(e)
    head, *rest = e
    if head == ":":
        value, kind = rest
        return column(value, names).cast(_TYPES[kind]) if kind in _TYPES else column(value, names)
    if head == "cast":
        return column(rest[0], names).cast(_TYPES[rest[1]])
    if head == "if":
        return F.when(column(rest[0], names), column(rest[1], names)).otherwise(column(rest[2], names))
    if head == "call":
        name = names.get(rest[0], rest[0])
        if name not in _FUNCTIONS:
            raise DialectError(f"unknown function: {rest[0]}")
        return _FUNCTIONS[name](*[column(x, names) for x in rest[1:]])
    if head in _OPERATORS:
        return _OPERATORS[head](*[column(x, names) for x in rest])
    raise DialectError(f"unknown operator: {head}")


def order_key(e) -> Column:
    name, direction, nulls = e
    down = direction == "desc"
    first = down if nulls == "nulls-default" else nulls == "nulls-first"
    return getattr(F.col(name), ("desc" if down else "asc") + ("_nulls_first" if first else "_nulls_last"))()


def aggregate(function: str, args: list) -> Column:
    if function == "count":
        return F.count(F.col(args[0]) if args else F.lit(1))
    if function == "rank":
        return F.rank().cast("bigint") if not args else F.rank()
    if function in ("sum", "min", "max", "avg", "stddev_samp"):
        return getattr(F, function)(args[0])
    raise DialectError(f"unknown aggregate: {function}")


class Builder:
    """Builds DataFrames; ``table`` gives the DataFrame of a path or name, ``names`` maps names of functions."""

    def __init__(self, table: Callable[[str], DataFrame], names: Mapping[str, str] = MappingProxyType({})):
        self.table = table
        self.names = names
        self.ctes: dict[str, DataFrame] = {}

    def build(self, e) -> DataFrame:
        if e[0] == "query":
            for part in e[1:]:
                if part[0] == "cte":
                    self.ctes[part[1]] = self.build(part[2])
                elif part[0] == "main":
                    return self.build(part[1])
            raise DialectError("a query needs (main ...)")
        if e[0] != "rel" or not hasattr(self, kind := "rel_" + e[1].replace("-", "_")):
            raise DialectError(f"unknown rel operator: {e[1] if len(e) > 1 else e}")
        return getattr(self, kind)(*e[2:])

    def rel_source(self, path, *more) -> DataFrame:
        df = self.table(str(path))
        return df.alias(str(more[0])) if more and isinstance(more[0], Text) else df

    def rel_cte_ref(self, name) -> DataFrame:
        return self.ctes[name]

    def rel_filter(self, source, condition) -> DataFrame:
        return self.build(source).filter(column(condition, self.names))

    def rel_project(self, source, *items) -> DataFrame:
        return self.build(source).select(*[column(e, self.names).alias(name) for name, e in items])

    def rel_aggregate(self, source, keys, *aggregates) -> DataFrame:
        return self.build(source).groupBy(*keys[1:]).agg(*[aggregate(f, args).alias(name) for _, name, f, *args in aggregates])

    def rel_join(self, left, right, keys, kind, *residual) -> DataFrame:
        a, b = self.build(left), self.build(right)
        names = [(x, y) for x, y in keys]
        condition = column(residual[0], self.names) if residual else None
        return R.join(a, b, names, {"full_outer": "full"}.get(kind[0], kind[0]), condition)

    def rel_union_all(self, *sources) -> DataFrame:
        return R.union_all(*map(self.build, sources))

    def rel_sort(self, source, *keys) -> DataFrame:
        return self.build(source).orderBy(*map(order_key, keys))

    def rel_top_sort(self, source, *keys) -> DataFrame:
        return self.rel_sort(source, *keys[:-1]).limit(int(keys[-1][1]))

    def rel_limit(self, source, *options) -> DataFrame:
        given = {name: int(value) for name, value in options}
        return self.build(source).offset(given.get("offset", 0)).limit(given["limit"])

    def rel_window(self, source, *sections) -> DataFrame:
        df = self.build(source)
        by = {s[0]: s[1:] for s in sections if s[0] != "fn"}
        window = Window.partitionBy(*by.get("partition", []))
        if by.get("order"):
            window = window.orderBy(*map(order_key, by["order"]))
        if "frame" in by:
            mode, (_, *start), (_, *end) = by["frame"]
            window = (window.rowsBetween if mode == "rows" else window.rangeBetween)(_bound(start), _bound(end))
        for _, name, function, *args in (s for s in sections if s[0] == "fn"):
            over = F.rank().over(window).cast("bigint") if function == "rank" else aggregate(function, args).over(window)
            df = df.withColumn(name, over)
        return df


def _bound(bound: list) -> int:
    kind = bound[0]
    fixed = {"unbounded-preceding": Window.unboundedPreceding, "unbounded-following": Window.unboundedFollowing, "current-row": 0}
    if kind in fixed:
        return fixed[kind]
    return -int(bound[1]) if kind == "preceding" else int(bound[1])
