"""The SQL entry point: an engine over one data folder."""

from __future__ import annotations

from collections.abc import Mapping
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession

from quern.plans.dialect import rewrite
from quern.plans.modules import Modules
from quern.plans.sexpr import Builder, parse
from quern.plans.tokens import DialectError, Token, statements
from quern.session import with_semantics
from quern.sources.catalog import Catalog

_HELPERS = ("CREATE OR REPLACE TEMPORARY FUNCTION strlen(s STRING) RETURNS BIGINT RETURN CAST(octet_length(s) AS BIGINT)",)


class Engine:
    """Runs the dialect's SQL over ``<data>/<table>.parquet`` with Spark.

    Tables, views and functions live in a session of the engine's own, so engines don't see each other's.
    """

    def __init__(self, spark: SparkSession, data: str):
        self.spark = with_semantics(spark)
        self.catalog = Catalog(self.spark, data)
        self.modules = Modules()
        for helper in _HELPERS:
            self.spark.sql(helper)

    def plan(self, tokens: list[Token]) -> DataFrame:
        types = self.catalog.bind(tokens)
        tables = self.catalog
        return self.spark.sql(rewrite(self.modules.mangle(tokens, types), self.modules.structs(), types, tables.size, tables.columns, tables.counts))

    def run(self, text: str) -> list[DataFrame]:
        """Runs all statements; the result has a DataFrame for each query."""
        out = []
        for tokens in statements(text):
            if tokens[0].is_("CREATE"):
                self.modules.create(tokens, self.spark)
            elif tokens[0].is_("EXPLAIN"):
                out.append(self.spark.createDataFrame([(self.explained(tokens[1:]),)], "plan string"))
            else:
                out.append(self.plan(tokens))
        return out

    def sql(self, text: str) -> DataFrame:
        """The DataFrame of the last query in ``text``."""
        found = self.run(text)
        if not found:
            raise DialectError("no query in the text")
        return found[-1]

    def sexpr(self, text: str, names: Mapping[str, str] = MappingProxyType({})) -> DataFrame:
        """The DataFrame of a plan written as an s-expression; ``names`` maps its names of functions to SQL's."""
        return Builder(self.catalog.table, names).build(parse(text))

    def explained(self, tokens: list[Token], mode: str = "formatted") -> str:
        df = self.plan(tokens)
        execution = df._jdf.queryExecution()
        return df._sc._jvm.PythonSQLUtils.explainString(execution, mode)

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The plan of one query as text."""
        (tokens,) = statements(text)
        return self.explained(tokens, mode)
