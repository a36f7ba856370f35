"""Session construction: the fixed SQL semantics every quern query assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that decide results. They are applied to any session quern is given.
SEMANTICS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.groupByAliases": "true",
}

#: Settings that decide speed only. A cluster's own values win over these.
LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "quern", **conf: str) -> SparkSession:
    """A single-machine session, for the command line, tests and bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    for key, value in {**LOCAL_DEFAULTS, **SEMANTICS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(os.environ.get("QUERN_LOG", "ERROR"))
    return spark


def with_semantics(spark: SparkSession) -> SparkSession:
    """A sibling session with quern's semantics: the caller's own settings stay as they are.

    The sibling shares the Spark context and cluster settings; only SQL settings and temporary views are separate.
    """
    child = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"):
        child.conf.set(key, spark.conf.get(key))
    for key, value in SEMANTICS.items():
        child.conf.set(key, value)
    return child
