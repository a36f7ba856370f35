"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Texts link at ``RADIUS`` or fewer
differing bits, and a class is all that links can reach.

Covering: bit i gets a vector of r + 1 bits, none zero, and there is one table for each non-zero vector v of r + 1 bits,
whose mask holds the bits with an odd product with v. For any r differing bits some v is orthogonal to all their
vectors, so that table's mask holds none of them: every pair within the radius r meets in some table, always.

Work is done on distinct fingerprints, so exact copies cost one row. Buckets are counted first. A bucket with more than
``HOT`` fingerprints is split before any task holds it, by covering the bits outside its table's mask once more; what
is left outside both masks is so few bits that a bucket of the second kind holds at most 2^16 fingerprints. Inside a
bucket the links found are those of a spanning forest, not all pairs. Forests are joined into classes by alternating
star contraction, each round a table in the shared folder.

Null and empty texts have the fingerprint zero and link like any other. A class with null ids takes the least id that
is not null (null if there is none). Repeated rows are kept, an empty table gives an empty table, and other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import carried, lean, text_slices, written

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
HOT = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text: shingles of lower-case (A-Z) words, repeats included."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    digest = xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    hashes = [digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=False)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over).view(">u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(id, fp) for every row, fp as a signed 64-bit number.

    ``keep`` names columns to return in place of the id alone, for callers that go on with the rows.
    """
    name = "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, name):
                found = np.array([fingerprint(t) for t in part.column(name).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*map(part.column, inner), pa.array(found.view(np.int64))], names=[*out, "fp"])

    if keep:
        rows, inner, name, kinds = carried(df, keep, text_col)
        out = keep
    else:
        rows, inner, kinds = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], f"id {df.schema[id_col].dataType.simpleString()}"
        out = inner
    return rows.mapInArrow(lean(run), f"{kinds}, fp bigint")


def masks(places: list[int], radius: int = RADIUS) -> list[int]:
    """The covering masks over the given bit places, one for each non-zero vector of radius + 1 bits."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << p for j, p in enumerate(places) if (j % vectors + 1 & v).bit_count() % 2) for v in range(1, vectors + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


FIRST = masks(list(range(BITS)))


def second(table: int) -> list[int]:
    """The masks that split a hot bucket of a first table: that table's mask and a cover of the other bits."""
    return [FIRST[table] | m for m in masks([p for p in range(BITS) if not FIRST[table] >> p & 1])]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signed 64-bit numbers; the count is of the bits as they stand, not of absolute values."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within the radius of each other."""
    left, links = fps, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = distance(left, at) <= radius
            if near.any():
                queue += (found := list(left[near]))
                links += [(at, f) for f in found]
                left = left[~near]
    return links


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the buckets of rows (t, key, fp) that come in order of bucket."""
    rest = None
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "key", "fp")])
        rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
        if not rows.shape[1]:
            continue
        cuts = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
        last = cuts[-1] if len(cuts) else 0
        rest = rows[:, last:]
        yield from _links(rows[2, :last], np.concatenate([[0], cuts])[: len(cuts)], last)
    if rest is not None:
        yield from _links(rest[2], np.array([0]), rest.shape[1])


def _links(fps: np.ndarray, starts: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(np.append(starts, end))
    two = starts[sizes == 2]
    a, b = fps[two], fps[two + 1]
    near = distance(a, b) <= RADIUS
    more = [link for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True) for link in forest(fps[s : s + n])]
    more = np.array(more, np.int64).reshape(-1, 2)
    a, b = np.concatenate([a[near], more[:, 0]]), np.concatenate([b[near], more[:, 1]])
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b), a > b: links between distinct fingerprints that join the same classes as all pairs within the radius."""

    def banded(tables: list[tuple[int, int]]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in tables])
        return distinct.select("fp", F.explode(each).alias("b")).select("b.t", "b.key", "fp")

    def linked(rows: DataFrame) -> DataFrame:
        return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(lean(bucket_links), "a bigint, b bigint")

    rows = banded(list(enumerate(FIRST)))
    large = written(rows.groupBy("t", "key").count().filter(F.col("count") > hot).select("t", "key"), "simhash-hot")
    n = large.count()
    if n == 0:
        return linked(rows).distinct()
    if n <= 100_000:
        large = F.broadcast(large)
    cold = rows.join(large, ["t", "key"], "left_anti")
    inner = F.create_map(*[x for t in range(len(FIRST)) for x in (F.lit(t), F.array(*[F.lit(signed(m)) for m in second(t)]))])
    split = rows.join(large, ["t", "key"], "left_semi").select("t", "fp", F.posexplode(inner[F.col("t")]).alias("k", "mask"))
    split = split.select((F.col("t") * 64 + F.col("k") + 64).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    return linked(cold).union(linked(split)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node that it can reach.

    Alternating stars: each node tells its larger neighbours, then its smaller ones, of the least it knows.
    """

    def state(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before, known = None, state(now)
    while known != before and known[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        wide = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        wide = written(wide, "stars")
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        narrow = wide.join(least, "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = written(narrow.union(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        before, known = known, state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()


def roots(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(fp, root) for the distinct fingerprints that link to another; the rest are classes of their own."""
    return written(components(links(distinct, hot)), "simhash-roots").withColumnRenamed("node", "fp")


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", hot: int = HOT) -> DataFrame:
    """(id, fp, component_id) for every row of ``df``: the least id of its class."""
    docs = written(fingerprints(df, text_col, id_col), "simhash-fp")
    least = written(docs.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-distinct")
    linked = roots(least.select("fp"), hot).join(least, "fp")
    heads = linked.groupBy("root").agg(F.min("rep").alias("head"))
    moved = linked.join(heads, "root").select("fp", "head")
    named = written(least.join(moved, "fp", "left").select("fp", F.coalesce("head", "rep").alias("component_id")), "simhash-named")
    return docs.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
