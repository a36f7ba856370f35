"""What the operators share: folds, words, byte-balanced batches, and tables written to the shared folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_JAVA = r"[^\x20\x09-\x0D]+"

#: Lower-casing of A-Z only.
LOWER_AZ = {c: c + 32 for c in range(65, 91)}


def latin_table(word: re.Pattern, lower: bool = False) -> bytes:
    """For each character below 256: itself, or in lower case, if ``word`` takes it so, and a space if not."""
    chars = [chr(c).lower() if lower else chr(c) for c in range(256)]
    return "".join(c if word.fullmatch(c) else " " for c in chars).encode("latin-1")


def latin_words(text: str, table: bytes, most: int) -> list[str] | None:
    """The words that ``table`` leaves of a text; None if it has a character from 256 on, or a word over ``most`` characters."""
    try:
        codes = text.encode("latin-1").translate(table)
    except UnicodeEncodeError:
        return None
    gaps = np.flatnonzero(np.frombuffer(b" %b " % codes, np.uint8) == 32)
    return codes.decode("latin-1").split() if (gaps[1:] - gaps[:-1]).max() <= most + 1 else None


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: str, buckets: int, which: int) -> Column:
    """True where crc32 of the id as text leaves the remainder ``which``; a null id is in no such fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % buckets == which, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in spark.checkpoint.dir. Where that is unset, a single-machine session gets a
    temporary folder of its own; on a cluster it is an error, since no machine-local folder would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and there after an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quern/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``most`` bytes of text each, one row at least; all rows are kept."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


#: What this worker keeps from task to task.
_kept: dict[tuple, object] = {}

#: Not there on every system.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def kept(make: Callable, *args: object) -> object:
    """``make(*args)``, made once in a worker and kept from task to task, until a task keeps or needs something else."""
    key = (make, args)
    if key not in _kept:
        forget()
        _kept[key] = make(*args)
    return _kept[key]


def forget() -> None:
    _kept.clear()


def give_back() -> None:
    """Free memory goes back to the machine."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable, keeps: bool = False) -> Callable:
    """An Arrow function that leaves its worker small: workers stay, and count as memory of the executor, while later stages run.

    Before a task the worker forgets what other operators kept in it (with ``keeps`` that is left to ``kept``), and
    after a task it gives back what is free.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        yield from run(batches)
        give_back()

    return task


def small_batches(spark: SparkSession, most_rows: int = 2000) -> None:
    """Lowers the session's rows in an Arrow batch, where they are more, for functions that hand whole rows on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > most_rows:
        spark.conf.set(key, str(most_rows))


def carried(df: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, list[str], str, str]:
    """Columns for an Arrow function that returns ``keep`` as they are, whatever their names.

    Returns the rows (k0, k1, ... and the text, once), the names to return from each batch, the text's name, and the
    types of ``keep`` for a schema.
    """
    small_batches(df.sparkSession)
    inner = [f"k{i}" for i in range(len(keep))]
    rows = [F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner, strict=True)]
    text = inner[keep.index(text_col)] if text_col in keep else "text"
    if text == "text":
        rows.append(F.col(f"`{text_col}`").alias("text"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*rows), inner, text, kinds
