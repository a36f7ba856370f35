"""Tables by name: ``<data>/<name>.parquet``, found when a query names them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.relational import planned_bytes
from quern.plans.tokens import Token, from_items, given_names


_INTEGERS = ("tinyint", "smallint", "int", "bigint")
_NESTED = ("array", "map", "struct", "variant")


def _ranges(column: str) -> list[Column]:
    return [F.min(column).cast("bigint"), F.max(column).cast("bigint")]


def _sketches(column: str) -> list[Column]:
    return [F.approx_count_distinct(column)]


def _summed(spark: SparkSession, path: Callable[[str], str], wanted: Mapping[str, list[str]], of: Callable[[str], list[Column]]) -> dict[str, list[int]]:
    """Of each table its rows, then what ``of`` makes of each column; one job for all tables."""
    parts = []
    for name, columns in wanted.items():
        made = [F.count(F.lit(1)), *(x for c in columns for x in of(f"`{c}`"))]
        row = spark.read.parquet(path(name)).agg(*[x.alias(f"_{k}") for k, x in enumerate(made)])
        parts.append(row.select(F.lit(name).alias("name"), F.array(*[f"_{k}" for k in range(len(made))]).alias("numbers")))
    return {name: [numbers[0] or 0, *numbers[1:]] for name, numbers in reduce(DataFrame.union, parts).collect()}


class Catalog:
    """The tables of one data folder (local, or any path that Spark reads), as views of one session."""

    def __init__(self, spark: SparkSession, data: str):
        self.spark, self.data = spark, data.rstrip("/")
        self._views: dict[str, dict[str, str]] = {}
        self._counts: dict[str, tuple[int, dict[str, int]]] = {}

    def path(self, name: str) -> str:
        return name if name.endswith(".parquet") else f"{self.data}/{name}.parquet"

    def exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def bind(self, tokens: list[Token]) -> dict[str, str]:
        """Makes views of the tables that a query names in FROM and JOIN; the types of their columns, by name.

        A column that two of the tables have with different types is left out, and one whose name the query gives to
        something else. A dotted name is one name of a file.
        """
        local = {tokens[i - 1].text.lower() for i, t in enumerate(tokens) if i and t.is_("AS") and i + 1 < len(tokens) and tokens[i + 1].is_("(")}
        types: dict[str, set[str]] = {}
        for start, end in from_items(tokens):
            t = tokens[start]
            name = "".join(x.text.strip('"') for x in tokens[start:end])
            if t.kind not in ("word", "quoted") or (end == start + 1 and name.lower() in local) or name.endswith(".parquet"):
                continue
            if name not in self._views and self.exists(name):
                self.table(name).createOrReplaceTempView(f"`{name}`")
                self._views[name] = dict(self.spark.table(f"`{name}`").dtypes)
            for column, kind in self._views.get(name, {}).items():
                types.setdefault(column.lower(), set()).add(kind)
        renamed = given_names(tokens)
        return {column: kinds.pop() for column, kinds in types.items() if len(kinds) == 1 and column not in renamed}

    def size(self, name: str) -> int | None:
        """Bytes of a table that a query has named, as planned."""
        return planned_bytes(self.spark.table(f"`{name}`")) if name in self._views else None

    def columns(self, name: str) -> Mapping[str, str]:
        """The columns of a table that a query has named, with their types."""
        return self._views[name]

    def counts(self, wanted: Mapping[str, set[str]]) -> dict[str, tuple[int, dict[str, int]]]:
        """Rows of tables, and how many distinct values these columns (lower-case names) have, at most or about.

        Rows and ranges of integers come from the footers of the files, without reading rows; an integer column has no
        more values than its range. Values of other columns are counted by a sketch over all rows.
        """
        new = {n: {c.lower(): kind for c, kind in self._views[n].items() if c.lower() in cs and c.lower() not in self._counts.get(n, (0, {}))[1]} for n, cs in wanted.items()}
        whole = {n: [c for c, kind in kinds.items() if kind in _INTEGERS] for n, kinds in new.items() if kinds or n not in self._counts}
        if whole:
            try:
                found = _summed(self._footers(), self.path, whole, _ranges)
            except (PySparkException, Py4JError):  # files without such statistics
                found = _summed(self.spark, self.path, whole, _ranges)
            for n, (rows, *ends) in found.items():
                known = self._counts.setdefault(n, (rows, {}))[1]
                known |= {c: min(rows, high - low + 1) for c, low, high in zip(whole[n], ends[::2], ends[1::2], strict=True) if low is not None}
        rest = {n: cs for n, kinds in new.items() if (cs := [c for c, kind in kinds.items() if kind not in _INTEGERS and not kind.startswith(_NESTED)])}
        if rest:
            for n, (_, *distinct) in _summed(self.spark, self.path, rest, _sketches).items():
                self._counts[n][1].update(zip(rest[n], distinct, strict=True))
        return {n: self._counts[n] for n in wanted}

    def _footers(self) -> SparkSession:
        """A session in which count, min and max of whole Parquet tables come from the files' footers."""
        child = self.spark.newSession()
        child.conf.set("spark.sql.sources.useV1SourceList", "")
        child.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        return child

    def describe(self, name: str) -> list[tuple[str, str]]:
        """(column, type) of a table."""
        return self.table(name).dtypes

    def statistics(self, name: str) -> DataFrame:
        """(column, n_rows, n_nulls, n_distinct, least, most) of a table, in one pass; distinct counts are estimates."""
        df = self.table(name)
        plain = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))]
        sums = [F.count(F.lit(1)).alias("n")]
        for k, c in enumerate(plain):
            sums += [F.count(c).alias(f"c{k}"), F.approx_count_distinct(c).alias(f"d{k}"), F.min(c).cast("string").alias(f"l{k}"), F.max(c).cast("string").alias(f"m{k}")]
        rows = [
            F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"c{k}")).alias("n_nulls"), F.col(f"d{k}").alias("n_distinct"), F.col(f"l{k}").alias("least"), F.col(f"m{k}").alias("most"))
            for k, c in enumerate(plain)
        ]
        return df.agg(*sums).select(F.inline(F.array(*rows)))
