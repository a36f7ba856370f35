"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are made alike (lower case; runs of anything but letters and digits are one space) and
compared as UTF-8 bytes. An item is cut into overlapping probes of ``PROBE`` bytes (a shorter item is one probe). A
probe of length n found with at most e = floor(n * RATE) edits shares at least n + 1 - Q (e + 1) of its q-grams with the
place where it is found, all within e diagonals (the q-gram lemma). So:

1. All q-grams of a text are looked up among the probes' q-grams; each hit has a diagonal (text place less probe place).
2. Hits are counted in diagonal bands of width 2 e that overlap by e, so that any e + 1 neighbouring diagonals lie in
   one band. Bands with fewer hits than the bound are dropped.
3. The regions left are verified by aligning the probe to the text in the cells of the band alone, edits counted exactly.

Work does not grow with the square of a text's repetitions: where hits are many, places of a text with the same bytes
around them are looked at once, and hits are laid out a bounded number at a time.

The probes are a broadcast of bounded size: a benchmark is taken in blocks of ``block_bytes`` of text (one item at
least), with one pass over the documents for each. A usual benchmark is one block, and then nothing is shuffled; for
several the documents are written with a number for each row, and the hits of the passes are written and joined by
that number.

Probes shorter than ``LEAST`` bytes leave no room for an edit and must be found as they are; items without Q bytes are
found where they stand as whole words. An item without a letter or digit names nothing. Null and empty texts contain
nothing. Null ids and repeated rows are kept, an empty table or benchmark gives no hits, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm.common import carried, lean, text_slices, written

Q = 12
RATE = 0.05
PROBE = 96
STEP = 48
LEAST = 2 * Q
#: Bytes around a q-gram that decide whether a probe is found there: a probe, its edits to either side and bands.
REACH = PROBE + 4 * int(PROBE * RATE) + 2 * Q

#: Bytes that stay: digits, a-z and all of other scripts. The rest separates words.
_KEEPS = np.zeros(256, bool)
_KEEPS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_SPACE = 32


def alike(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The made-alike bytes of all texts, one after another with Q spaces between, and where each begins (and the end)."""
    lower = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    lower = pa.concat_arrays([lower])  # offsets from 0
    raw = np.frombuffer(lower.buffers()[2] or b"", np.uint8)
    cuts = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    raw, cuts = raw[cuts[0] : cuts[-1]], cuts - cuts[0]
    keeps = _KEEPS[raw]
    stays = keeps.copy()
    stays[1:] |= keeps[:-1]  # the first separator of a run stays
    places = np.concatenate([[0], np.cumsum(stays)])[cuts]
    sizes = np.diff(places)
    out = np.full(int(places[-1]) + Q * (len(sizes) + 1), _SPACE, np.uint8)
    begins = places[:-1] + Q * np.arange(1, len(sizes) + 1)
    to = np.arange(int(places[-1])) + np.repeat(begins - places[:-1], sizes)
    out[to] = np.where(keeps, raw, _SPACE)[stays]
    return out, np.append(begins, len(out))


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit mix of the Q bytes at each place; equal bytes give equal mixes, and hits are verified later anyway."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((n,), "<u8", padded, 0, (1,))
    four = np.ndarray((n,), "<u4", padded, 8, (1,))
    return (eight ^ (four.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Probes:
    """Probes of a block of items with their q-gram index."""

    items: list  # item of each probe
    texts: list[bytes]
    keys: np.ndarray  # sorted grams
    probe: np.ndarray
    place: np.ndarray
    seen: np.ndarray  # which 20-bit prefixes of grams occur
    edits: np.ndarray  # of each probe, at most
    bounds: np.ndarray  # common grams of each probe, at least
    short: dict[int, dict[bytes, int]]  # items without Q bytes, by size: with a space after them, the probe

    @classmethod
    def of(cls, block: list[tuple]) -> Probes:
        items, cut = [], []
        short: dict[int, dict[bytes, int]] = {}
        for i, text in block:
            data, begins = alike(pa.array([text], pa.string()))
            whole = data[begins[0] : len(data) - Q].tobytes().strip()
            if len(whole) < Q:
                mine = [whole] if whole else []
            else:
                starts = [0] if len(whole) <= PROBE else [*range(0, len(whole) - PROBE, STEP), len(whole) - PROBE]
                mine = list(dict.fromkeys(whole[s : s + PROBE] for s in starts))
            items += [[i]] * len(mine)
            cut += mine
        same: dict[bytes, int] = {}  # one probe for all items that have it
        first = [same.setdefault(t, len(same)) for t in cut]
        names: list[list] = [[] for _ in same]
        for k, mine in zip(first, items, strict=True):
            names[k] += mine
        texts = list(same)
        for k, t in enumerate(texts):
            if len(t) < Q:
                short.setdefault(len(t), {})[t + b" "] = k
        found = [grams(np.frombuffer(t, np.uint8)) for t in texts]
        keys = np.concatenate([np.zeros(0, np.uint64), *found])
        probe = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(f)) for f in found]])
        order = np.argsort(keys, kind="stable")
        seen = np.zeros(1 << 20, bool)
        seen[(keys >> np.uint64(44)).astype(np.int64)] = True
        sizes = np.array([len(t) for t in texts], np.int64)
        edits = np.where(sizes >= LEAST, (sizes * RATE).astype(np.int64), 0)
        return cls(names, texts, keys[order], probe[order], place[order], seen, edits, sizes + 1 - Q * (edits + 1), short)


def banded_edits(probes: list[bytes], data: np.ndarray, lows: np.ndarray, width: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least edits with which each probe is found along ``width`` diagonals, the first of them ``lows``.

    A probe may begin on any diagonal of its band and end on any. Row k of the alignments holds only the cells (k, k +
    diagonal) of the band. What lies outside the text, from ``begins`` to ``ends``, is like no byte.
    """
    sizes = np.array([len(p) for p in probes])
    longest = int(sizes.max())
    letters = np.frombuffer(b"".join(p.ljust(longest, b"\0") for p in probes), np.uint8).reshape(len(probes), longest)
    at = lows[:, None] + np.arange(longest + width)
    inside = (at >= begins[:, None]) & (at < ends[:, None])
    text = np.where(inside, data[np.clip(at, 0, len(data) - 1)], -1).astype(np.int16)
    ramp = np.arange(width, dtype=np.int16)
    row = np.zeros((len(probes), width), np.int16)
    out = np.zeros(len(probes), np.int64)
    for k in range(longest):
        new = row + (text[:, k : k + width] != letters[:, k, None])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        done = sizes == k + 1
        out[done] = row[done].min(axis=1)
    return out


def distinct_windows(data: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` are the first in their text with the same ``REACH`` bytes on either side.

    A probe found at a later one is found at the first as well, with all its q-grams, so the later ones can go.
    """
    mult = np.uint64(0x9E3779B97F4A7C15)
    value = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(31)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), mult)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value[data] * power[:-1])])
    low, high = np.maximum(at - REACH, 0), np.minimum(at + REACH, len(data))
    mix = (sums[high] - sums[low]) * power[len(data) - low]  # the same at every place
    order = np.lexsort((at, high - low, mix, text))
    same = (np.diff(mix[order]) == 0) & (np.diff(text[order]) == 0) & (np.diff((high - low)[order]) == 0)
    keeps = np.ones(len(at), bool)
    keeps[order[1:][same]] = False
    return keeps


def found_short(probes: Probes, data: np.ndarray, begins: np.ndarray) -> set[tuple[int, int]]:
    """(text, probe) where a short item stands as whole words."""
    found: set[tuple[int, int]] = set()
    starts = np.flatnonzero((data[1:] != _SPACE) & (data[:-1] == _SPACE)) + 1 if probes.short else np.zeros(0, np.int64)
    for size, known in probes.short.items():
        words = np.stack([data[starts + k] for k in range(size + 1)], axis=1)  # texts are followed by Q spaces
        keys = np.ascontiguousarray(words).view(f"S{size + 1}").ravel()
        want = np.array(sorted(known))
        at = np.minimum(np.searchsorted(want, keys), len(want) - 1)
        hits = np.flatnonzero(want[at] == keys)
        text = np.searchsorted(begins, starts[hits], "right") - 1
        found |= {(t, known[key]) for t, key in zip(text.tolist(), keys[hits].tolist(), strict=True)}
    return found


def find(probes: Probes, data: np.ndarray, begins: np.ndarray, most_hits: int = 1 << 21) -> list[tuple[int, int]]:
    """(text, probe) for every text of the batch that holds a probe within its edits.

    Hits are laid out ``most_hits`` at a time, in overlapping stretches of the batch.
    """
    found = found_short(probes, data, begins)
    mixed = grams(data)
    at = np.flatnonzero(probes.seen[mixed >> np.uint64(44)]) if len(probes.keys) else np.zeros(0, np.int64)
    mixed = mixed[at]
    low = np.searchsorted(probes.keys, mixed)
    if len(at):
        true = probes.keys[np.minimum(low, len(probes.keys) - 1)] == mixed
        at, mixed, low = at[true], mixed[true], low[true]
    times = np.searchsorted(probes.keys, mixed, "right") - low
    text = np.searchsorted(begins, at, "right") - 1
    if times.sum() > most_hits:
        keeps = distinct_windows(data, at, text)
        at, low, times, text = at[keeps], low[keeps], times[keeps], text[keeps]
    done, total = 0, np.cumsum(times)
    while done < len(at):
        first = np.searchsorted(at, at[done] - 2 * REACH)
        end = max(done + 1, int(np.searchsorted(total, total[done] + most_hits)))
        part = slice(first, end)
        found |= _found_in(probes, data, begins, at[part], low[part], times[part], text[part])
        done = end
    return sorted(found)


def _found_in(probes: Probes, data: np.ndarray, begins: np.ndarray, at: np.ndarray, low: np.ndarray, times: np.ndarray, text: np.ndarray) -> set[tuple[int, int]]:
    """(text, probe) found by the q-grams at some places of a batch, with their postings."""
    post = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    probe = probes.probe[post]
    diagonal = np.repeat(at, times) - probes.place[post]
    text = np.repeat(text, times)
    step = np.maximum(1, probes.edits)
    half = diagonal // step[probe] + PROBE  # not negative
    span = len(data) + 2 * PROBE
    # band b holds the half bands b - 1 and b
    keys, counts = np.unique(np.concatenate([(pair := text * len(probes.texts) + probe) * span + half, pair * span + half + 1]), return_counts=True)
    pair, band = np.divmod(keys, span)
    t, p = np.divmod(pair, len(probes.texts))
    likely = counts >= np.maximum(1, probes.bounds[p])
    t, p, band = t[likely], p[likely], band[likely] - PROBE
    found: set[tuple[int, int]] = set()
    for a in range(0, len(t), 8192):
        ts, ps, bs = t[a : a + 8192], p[a : a + 8192], band[a : a + 8192]
        e = probes.edits[ps]
        edits = banded_edits([probes.texts[i] for i in ps.tolist()], data, (bs - 1) * step[ps] - e, int(2 * (step[ps] + e).max()), begins[ts], begins[ts + 1] - Q)
        hit = edits <= e
        found |= set(zip(ts[hit].tolist(), ps[hit].tolist(), strict=True))
    return found


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    block_bytes: int = 1 << 20,
    slice_bytes: int = 4 << 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """(id, contaminated, items) for every row of ``df``; items lists the ids of benchmark items found in its text.

    ``keep`` names columns to return in place of the id alone, for callers that go on with the rows.
    """
    item_kind = benchmark.schema[item_id].dataType.simpleString()
    keep = keep or [id_col]
    item_type = to_arrow_type(benchmark.schema[item_id].dataType)

    list_kind = f"array<{item_kind}>"

    def one_pass(probes: Probes, rows: DataFrame, inner: list[str], name: str, names: list[str], kinds: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(probes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probes = shared.value
            for batch in batches:
                for part in text_slices(batch, name, slice_bytes):
                    items: list[set] = [set() for _ in range(part.num_rows)]
                    for text, probe in find(probes, *alike(part.column(name))):
                        items[text].update(probes.items[probe])
                    lists = pa.array([sorted(s, key=lambda i: (i is not None, i)) for s in items], pa.list_(item_type))
                    yield pa.RecordBatch.from_arrays([*map(part.column, inner), lists], names=[*names, "benchmark_items"])

        return rows.mapInArrow(lean(run), f"{kinds}, benchmark_items {list_kind}")

    rows, inner, name, kinds = carried(df, keep, text_col)
    parts = blocks(benchmark.select(item_id, item_text), block_bytes)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        found = one_pass(Probes.of(first), rows, inner, name, keep, kinds)
    else:
        rows = written(rows.withColumn("number", F.monotonically_increasing_id()), "decontaminate-rows")  # settles the numbers
        hits = []
        for block in chain([first, second], parts):
            found = one_pass(Probes.of(block), rows.select("number", name), ["number"], name, ["number"], "number bigint")
            hits.append(written(found.select("number", F.explode("benchmark_items").alias("item")), "decontaminate"))
        # as structs, so that an item without an id stays in the set
        sets = reduce(DataFrame.union, hits).groupBy("number").agg(F.sort_array(F.collect_set(F.struct("item"))).alias("sets"))
        lists = sets.select("number", F.col("sets.item").alias("benchmark_items"))
        found = rows.join(lists, "number", "left").withColumn("benchmark_items", F.coalesce("benchmark_items", F.array().cast(list_kind)))
        found = found.select(*[F.col(k).alias(c) for k, c in zip(inner, keep, strict=True)], "benchmark_items")
    return found.select(*keep, (F.size("benchmark_items") > 0).alias("contaminated"), F.col("benchmark_items").alias("items"))


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The (id, text) rows of a benchmark in blocks by bytes; rows without a text name nothing."""
    block: list[tuple] = []
    size = 0
    for item, text in benchmark.toLocalIterator():
        n = len(text.encode()) if text else 0
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        if n:
            block.append((item, text))
            size += n
    if block:
        yield block
