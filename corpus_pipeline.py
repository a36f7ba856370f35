"""The corpus pipeline over ``documents``: language ID, near-dedup, decontamination, secret scan, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next
stage; all but the last return the columns of ``documents``. Rows with nulls, empty tables and repeated rows pass
through as each operator's docstring says; a null text is rejected by the first stage, as it has no language.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, language_id, secrets, simhash
from quern.llm.common import read, written
from quern.llm.piece_bpe import encode_pieces

#: A text is rejected if no language holds so much of its labelled spans.
LEAST_SHARE = 0.5

#: Stages that compare documents by id or redact texts cannot be told in SQL as a whole.
ORACLE_SQL = None


def packed(docs: DataFrame) -> DataFrame:
    """The text, and the other columns as one, so that none clashes with what an operator adds."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one language in at least half of their text; undetermined ones go."""
    model = language_id.train(docs, F.lit(True))
    found = language_id.label_spans(packed(docs), model, keep=["row", "text"])
    return unpacked(found.filter((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SHARE)), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the one with the least id (none comes last), the first of those as read."""
    rows = simhash.fingerprints(packed(docs), keep=["row", "text"]).withColumn("number", F.monotonically_increasing_id())
    rows = written(rows, "pipeline-numbered")  # which also settles the numbers
    id_ = F.col("row.doc_id")
    least = rows.groupBy("fp").agg(F.min(F.struct(id_.isNull().alias("none"), id_.alias("id"), "number")).alias("rep"))
    least = written(least, "pipeline-distinct")
    roots = simhash.roots(least.select("fp"))
    heads = least.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("rep").alias("head"))
    # documents always move to their numbers: a broadcast of the numbers would grow with the corpus
    return unpacked(rows.join(heads.select("head.number").hint("merge"), "number", "left_semi"), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    rows = packed(docs).withColumn("doc_id", F.col("row.doc_id"))
    found = decontaminate.contaminated(rows, read(spark, sf_dir, "benchmark"), keep=["row", "text"])
    return unpacked(found.filter("NOT contaminated"), docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of a secret replaced; n_chars follows."""
    found = secrets.scan_secrets(packed(docs), keep=["row", "text"])
    clean = unpacked(found.withColumn("text", secrets.redact(F.col("text"), F.col("spans"))), docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""
    found = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", keep_known_languages),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
