"""Substring dedup by sliding sentence spans.

A text is cut into sentences (at sentence marks before white space, and at line ends); a sentence of more than
``LONG`` words is cut further before each word whose hash is the least of the ``NEAR`` words to either side, so that a
passage without marks has several units too, and the same ones whatever stands before it.
Every run of at least ``RUN`` consecutive units with at least ``WORDS`` words is hashed: it begins at each unit and
takes as many units as that needs; repeats of fewer words are left alone, wherever they stand. Words are compared in
lower case and white space does not count.

A run that occurs more than once, in one text or over all, is repeated. Its first place is in the row with the least id
(none comes last; of rows with one id, the one with the least number), and there the first one in the text. Units
covered by a repeated run anywhere else are removed.

Rows are told apart by id and a number, which is a hash of file and place in it where ``df`` reads Parquet files
directly; for other tables the rows are numbered and written first. Runs are summed by hash before the shuffle (least
row and number of places), and each row learns which of its runs have their first place elsewhere through a join on the
hash, where Spark splits hot keys; no task or driver ever holds all places of a hash, and what is gathered for a row is
no more than its own runs. Texts move once, to meet their own removals.

Null and empty texts have no units and stay as they are (a null stays null). Rows without an id and rows that share an
id are rows like others: of repeated rows, one keeps its text. Tables may be empty, and other columns are not read.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import text_slices, written

RUN = 3
WORDS = 16
LONG = 12
NEAR = 2

_END = re.compile(r"[.!?]+(?=\s|$)|[。！？]+|\n")
_WORD = re.compile(r"\S+")
#: More than any hash of a word.
_OVER = 1 << 64


def cuts(words: list[str]) -> list[int]:
    """Where the parts of a long sentence begin, by its words alone; equal hashes in reach of each other all cut."""
    h = [_OVER] * NEAR + list(map(xxhash.xxh3_64_intdigest, words)) + [_OVER] * NEAR
    lower = [k for k in range(NEAR + 1, NEAR + len(words)) if h[k - 1] >= h[k] <= h[k + 1]]
    return [0, *[k - NEAR for k in lower if h[k] <= min(h[k - NEAR : k + NEAR + 1])]]


def units(text: str, placed: bool = True) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit of a text; without ``placed``, start and end may be left at 0."""
    out = []
    digest = xxhash.xxh3_128_digest
    start = 0
    for end in [*[m.end() for m in _END.finditer(text)], len(text)]:
        sentence = text[start:end]
        words = sentence.lower().split()
        if len(words) > LONG:
            at = [m.span() for m in _WORD.finditer(text, start, end)] if placed else [(0, 0)] * len(words)
            begins = cuts(words)
            for a, b in zip(begins, [*begins[1:], len(words)], strict=True):
                out.append((at[a][0], at[b - 1][1], b - a, digest(" ".join(words[a:b]))))
        elif words:
            first = start + len(sentence) - len(sentence.lstrip())
            out.append((first, start + len(sentence.rstrip()), len(words), digest(" ".join(words))))
        start = end
    return out


def runs(found: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """(first unit, end unit, digest) of each run."""
    out = []
    words = [0]
    for u in found:
        words.append(words[-1] + u[2])
    end = 0
    for i in range(len(found) - RUN + 1):
        end = max(end, i + RUN)
        while end <= len(found) and words[end] - words[i] < WORDS:
            end += 1
        if end > len(found):
            break
        out.append((i, end, xxhash.xxh3_128_digest(b"".join(u[3] for u in found[i:end]))))
    return out


_KEY = struct.Struct("<qi")


def key(digest: bytes) -> tuple[int, int]:
    """96 bits of a digest, as the two numbers that rows carry."""
    return _KEY.unpack_from(digest)


def removed(text: str, elsewhere: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans to remove: units covered by runs whose first place is elsewhere, or earlier in this text."""
    found = units(text)
    gone = np.zeros(len(found) + 1, np.int64)
    seen: set[tuple[int, int]] = set()
    for first, end, digest in runs(found):
        run = key(digest)
        if run in elsewhere or run in seen:
            gone[first] += 1
            gone[end] -= 1
        seen.add(run)
    spans: list[tuple[int, int]] = []
    last = -1
    for k in np.flatnonzero(np.cumsum(gone)[:-1]):
        start = found[k][0]
        end = found[k + 1][0] if k + 1 < len(found) else len(text)
        if k == last + 1 and spans:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((start, end))
        last = k
    return spans


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            rows, first, second, times = [], [], [], []
            for row, text in enumerate(part.column("text").to_pylist()):
                counts = Counter(key(digest) for _, _, digest in runs(units(text or "", False)))
                rows += [row] * len(counts)
                times += counts.values()
                first += [h for h, _ in counts]
                second += [h for _, h in counts]
            at = pa.array(rows, pa.int64())
            columns = [pa.array(first, pa.int64()), pa.array(second, pa.int32()), *[part.column(c).take(at) for c in ("id", "number")], pa.array(times, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "id", "number", "n"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            spans, texts = [], []
            for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                cut = removed(text, {(g["h1"], g["h2"]) for g in gone if not g["own"]}) if text and gone else []
                spans.append([{"start": a, "end": b} for a, b in cut])
                kept, at = [], 0
                for a, b in cut:
                    kept.append(text[at:a])
                    at = b
                texts.append("".join([*kept, text[at:]]) if cut else text)
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(spans, span), pa.array(texts, pa.string())], names=["id", "removed", "text"])


def numbered(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, number, text): the number and the id tell rows apart, however often the rows are read."""
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    try:
        return df.select(*columns, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("number"))
    except AnalysisException:  # not a scan of files: numbers last only if they are written
        return written(df.select(*columns).withColumn("number", F.monotonically_increasing_id()), "span-rows")


def drop_repeated_spans(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, removed, text) for every row of ``df``: spans removed, in characters of the old text, and what is left."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = numbered(df, text_col, id_col)
    places = written(docs.mapInArrow(_hash_runs, f"h1 bigint, h2 int, id {kind}, number bigint, n int"), "span-places")  # read twice
    # the least id first, as a number that is summed in place; the least number only for what is repeated
    sums = places.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.sum("n").alias("times"))
    repeated = written(sums.filter("times > 1").select("h1", "h2", "first_id"), "span-repeats")
    met = written(places.join(repeated, ["h1", "h2"]).withColumn("own", F.col("id").eqNullSafe(F.col("first_id"))).drop("first_id"), "span-met")
    firsts = met.filter("own").groupBy("h1", "h2").agg(F.min("number").alias("first"))
    # a row of the least id is the first place if it has the least number of them
    own = F.col("own") & (F.col("number") == F.col("first"))
    affected = met.join(firsts, ["h1", "h2"]).withColumn("own", own).filter("NOT own OR n > 1")
    lists = affected.groupBy("id", "number").agg(F.collect_list(F.struct("h1", "h2", "own")).alias("gone"))  # of one row
    lists = lists.select(F.col("id").alias("of"), F.col("number").alias("of_number"), "gone")
    met = docs.join(lists, (docs["number"] == lists["of_number"]) & docs["id"].eqNullSafe(lists["of"]), "left").select("id", "text", "gone")
    span = "array<struct<start:int,end:int>>"
    return met.mapInArrow(_rewrite, f"id {kind}, removed {span}, text string").withColumnRenamed("id", id_col)
