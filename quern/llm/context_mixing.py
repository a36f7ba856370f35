"""Language-model scores by online logistic context mixing.

A text is lower-cased (A-Z) and coded as its words joined by one space and ended by a line feed. A byte is coded by the
binary decisions on its way down a Huffman tree of what follows the byte before in the training texts (``Code``), about
3.5 of them in a byte of prose where plain bits would be 8. Bit predictors for the orders 1, 2, 3 and 5 look at as many bytes before, hashed with the
node of the tree. Their stretched predictions are combined by weights; a gate, the highest order that has seen its context,
picks the set of weights. A refining stage then corrects the mix by how sure it is. Weights and refinement start from
what was fitted and adapt while a text is read, along the gradient of its coding cost, from its first byte to its last.
They move after each step of a text; steps are ``FIRST_STEP`` bytes long, later a sixteenth of what has been read and
at most ``MOST_STEP`` (``edges``), so that texts step together and a long text needs few steps. A text's score depends
on its own bytes and the model alone. Total bits per byte follow, and the text's log10 probability.

What is learned covers every training text: counts of all (five bytes before, byte) places are summed over the corpus
and shape the predictors, which stay as they are while scoring. The table of predictors is sized by the
corpus: four slots at least for each distinct place, up to ``most_slots`` (the model's size, 2^25 unless given
otherwise; no text is left out of the counts). A slot has a check byte, so that a context that is not held counts as
unseen but for one in 256; of several that meet in one slot the most frequent is held.

The starting weights and refinement are fitted on every place of every training text, each as often as it occurs. So
that the fit is honest, the texts are dealt into two halves by a hash of id and text, and each half is fitted against
predictors counted in the other; the final predictors count both. The summed places hold all that the fit needs: equal
inputs under one gate are added up (``_count_inputs``), and Newton steps over those sums (``start_of``) find the weights
of least cost, with the strength of ``PRIOR`` decisions for ``FIRST_WEIGHT``, and then the refinement.

Beside it stands the base score by counts of tokens over the training texts: the counts of tokens that make up at
least one in ``most_head`` of all training tokens are broadcast, and the rest of the tokens are joined with the full
table of counts. That head has ``most_head`` tokens at most, and no more bytes than ``most_head`` times the mean length
of a training token: each of its tokens fills at least that share of the corpus.

A null or empty text has one token, the end. Ids may be null or repeated: rows are told apart by a number of their own
inside the run, so each is scored alone. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import small_batches, text_slices, written

ORDERS = (1, 2, 3, 5)
#: Parts of the table that are put together by themselves.
BLOCKS = 1 << 10
LIMIT = 7.5
#: Predictions travel as signed bytes: stretch(p) in 1/16; UNSEEN where a slot holds nothing.
SCALE = 16
UNSEEN = -128
#: Bytes in the first steps of a text, the most in a step, and the step whose gradient counts in full.
FIRST_STEP, MOST_STEP, FULL_STEP = 64, 4096, 64
#: Bins of the refining stage, by half units of the stretched mix.
BINS = 16
#: What weights are where nothing is learned, the strength of that, Newton steps at most, and the last step's size.
FIRST_WEIGHT, PRIOR, MOST_STEPS, LAST_STEP = 0.3, 16.0, 25, 1e-5
#: Parts of a bin of the refining stage that are told apart in its fit.
FINE = 64
#: Places of the cache of distinct keys, and decisions that it holds at most.
CACHE_BITS, POOL = 21, 1 << 24

PAD = bytes(5)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NO_KEY = np.uint64((1 << 64) - 1)  # more than six bytes


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def joined(words: list[bytes]) -> bytes:
    return b" ".join(words) + b"\n"


def coded(text: str | None) -> bytes:
    return joined(words_of(text))


def grams(texts: list[bytes]) -> np.ndarray:
    """The five bytes before each byte (zeros before the first of a text) and the byte itself, as one number."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = bytes(2) + b"".join([PAD + t for t in texts])
    eight = np.ndarray((max(0, len(data) - 7),), ">u8", data, 0, (1,))  # ends at the byte at place + 7
    return (eight.astype(np.uint64) & np.uint64((1 << 48) - 1))[ranges(np.cumsum(lengths + 5) - lengths - 5, lengths)]


def edges(length: int) -> list[int]:
    """Where the steps of a text begin, and the end."""
    out = [0]
    while out[-1] < length:
        out.append(min(length, out[-1] + min(MOST_STEP, max(FIRST_STEP, out[-1] // 16))))
    return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def tree(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """The path, (node, sign) of each decision, of each byte in a Huffman tree."""
    heap = [(c, i) for i, c in enumerate(counts.tolist())]
    heapq.heapify(heap)
    kids = []
    while len(heap) > 1:
        (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a + b, 256 + len(kids)))
        kids.append((left, right))
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    todo: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][1], [])]
    while todo:
        at, path = todo.pop()
        if at < 256:
            paths[at] = path
        else:
            todo += [(kid, [*path, (at - 256, sign)]) for kid, sign in zip(kids[at - 256], (-1, 1), strict=True)]
    return paths


class Code:
    """A Huffman tree for the bytes after each byte: the decisions (node and sign) of every byte after every other.

    ``counts`` is of bytes by the byte before, 256 x 256; bytes rare there are told apart by their counts overall.
    """

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.float64)
        overall = counts.sum(axis=0) + max(1.0, counts.sum()) / (1 << 16)
        smooth = counts + (counts.sum(axis=1, keepdims=True) + 1) / 256 * (overall / overall.sum())
        paths = [path for row in smooth for path in tree(row)]
        self.depth = np.array([len(path) for path in paths], np.int64)
        self.first = np.cumsum(self.depth) - self.depth
        self.node = np.array([n for path in paths for n, _ in path], np.uint8)
        self.sign = np.array([s for path in paths for _, s in path], np.int8)

    def sizes(self, keys: np.ndarray) -> np.ndarray:
        """The number of decisions for the last byte of each key."""
        return self.depth[(keys & np.uint64(65535)).astype(np.int64)]

    def decisions(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which key, which decision of the code) for the last byte of each key."""
        pair = (keys & np.uint64(65535)).astype(np.int64)
        return np.repeat(np.arange(len(keys)), self.depth[pair]), ranges(self.first[pair], self.depth[pair])


def hashed(keys: np.ndarray, nodes: np.ndarray, order: int) -> np.ndarray:
    """64 bits for each node under the context of one order."""
    context = (keys >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)
    h = (context * np.uint64(256) + nodes.astype(np.uint64) + np.uint64(order << 50)) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Table:
    """Predictors by hashed node: the top bits of a hash are its slot, its last byte the check."""

    bits: int
    slots: np.ndarray  # int16: check * 256 + stretch(p) in 1 / SCALE + 128; 0 where nothing is held

    def of(self, h: np.ndarray) -> np.ndarray:
        held = self.slots.take((h >> np.uint64(64 - self.bits)).astype(np.int64))
        own = (held >> 8).astype(np.int8) == h.astype(np.int8)  # the last bytes
        return np.where(own, (held & 255) - 128, UNSEEN).astype(np.int8)


@dataclass
class MixModel:
    """The code, the predictors, and the weights (gates x orders) and refinement (by bin) that each text starts from."""

    code: Code
    table: Table
    weights: np.ndarray
    refine: np.ndarray
    rate: float = 0.00125
    refine_rate: float = 0.02
    _keys: np.ndarray | None = field(default=None, repr=False)
    _start: np.ndarray | None = field(default=None, repr=False)
    _pool: np.ndarray | None = field(default=None, repr=False)
    _used: int = field(default=0, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_keys": None, "_start": None, "_pool": None, "_used": 0}

    def inputs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(predictions of all decisions of the keys times their signs, decisions x orders; the gate of each key)."""
        which, place = self.code.decisions(keys)
        sizes = self.code.sizes(keys)
        first = np.cumsum(sizes) - sizes
        node, sign = self.code.node[place], self.code.sign[place]
        x = np.empty((len(which), len(ORDERS)), np.int8)
        gate = np.zeros(len(keys), np.int8)
        mine = keys[which]
        for k, order in enumerate(ORDERS):
            found = self.table.of(hashed(mine, node, order))
            gate[found[first] != UNSEEN] = k
            x[:, k] = np.where(found == UNSEEN, 0, found) * sign
        return x, gate

    def looked_up(self, keys: np.ndarray) -> np.ndarray:
        """Of each key: where its inputs begin in the pool << 16 | its gate << 8 | its decisions. Earlier keys are cached."""
        if self._keys is None or self._used > POOL // 2:
            size = 1 << CACHE_BITS
            self._keys, self._start = np.full(size, _NO_KEY), np.zeros(size, np.int64)
            self._pool = np.zeros(POOL, np.uint32) if self._pool is None else self._pool
            self._used = 0
        place = (keys * _MIX >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        start = self._start[place]
        miss = np.flatnonzero(self._keys[place] != keys)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            sizes = self.code.sizes(new)
            begins = np.cumsum(sizes) - sizes + self._used
            end = self._used + int(sizes.sum())
            if end > len(self._pool):
                self._pool = np.concatenate([self._pool[: self._used], np.zeros(2 * (end - self._used), np.uint32)])
            gates = np.empty(len(new), np.int8)
            for a in range(0, len(new), 1 << 16):
                b = min(len(new), a + (1 << 16))
                x, gates[a:b] = self.inputs(new[a:b])
                self._pool[begins[a] : begins[a] + len(x)] = x.view(np.uint32).ravel()
            self._used = end
            begins = (begins << 16) | (gates.astype(np.int64) << 8) | sizes
            start[miss] = begins[back]
            at = (new * _MIX >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
            self._keys[at], self._start[at] = new, begins
        return start

    def cost(self, texts: list[bytes], learn: bool = False) -> np.ndarray:
        """Bits that each text takes; ``learn`` leaves what the texts end with, on average, as the start of others."""
        if not texts:
            return np.zeros(0)
        order = np.array(sorted(range(len(texts)), key=lambda i: -len(texts[i])))
        lengths = np.array([len(texts[i]) for i in order])
        run = self.looked_up(grams([texts[i] for i in order]))
        begins = np.cumsum(lengths) - lengths
        n_in = len(ORDERS)
        weights = np.tile(self.weights.T.astype(np.float32), (1, len(texts)))  # orders x (lanes x gates)
        refine = np.tile(self.refine.astype(np.float32), len(texts))
        total = np.zeros(len(texts))
        one, half, two = np.float32(1), np.float32(1 / SCALE), np.float32(2)
        steps = edges(int(lengths[0]))
        for a, b in zip(steps, steps[1:], strict=False):
            n = int(np.searchsorted(-lengths, -a, "left"))
            sizes = np.minimum(lengths[:n], b) - a
            at = ranges(begins[:n] + a, sizes)
            mine = run[at]
            d, gate = mine & 255, mine >> 8 & 255
            ends = np.cumsum(d)
            x = self._pool.take(np.repeat((mine >> 16) - (ends - d), d) + np.arange(ends[-1])).view(np.int8).reshape(-1, n_in).T.astype(np.float32, order="C")
            mine = np.repeat(np.repeat(np.arange(n) * n_in, sizes) + gate, d)
            mixed = x[0] * weights[0].take(mine)
            for k in range(1, n_in):
                mixed += x[k] * weights[k].take(mine)
            mixed *= half
            np.clip(mixed, -LIMIT, LIMIT, out=mixed)
            lanes = ends[np.cumsum(sizes) - 1]  # where the decisions of each lane end
            firsts = np.concatenate([[0], lanes[:-1]])
            bins = np.abs(mixed * two).astype(np.int64)
            bins += np.repeat(np.arange(0, n * BINS, BINS), lanes - firsts)
            side = np.sign(mixed)
            refined = mixed + side * refine.take(bins)
            far = one + np.exp(-refined)
            total[:n] += np.add.reduceat(np.log(far), firsts)
            slow = max(1.0, (b - a) / FULL_STEP)
            error = one / (one + np.exp(mixed))
            error *= np.float32(self.rate / SCALE / slow)
            x *= error
            top = np.arange(n) * n_in + n_in - 1
            weights[:, top] += np.add.reduceat(x, firsts, axis=1)
            rest = np.flatnonzero(gate < n_in - 1)  # the gradient of places with another gate belongs there
            if len(rest):
                where = ranges((ends - d)[rest], d[rest])
                to = mine[where]
                for k in range(n_in):
                    part = x[k, where]
                    weights[k, : n * n_in] += np.bincount(to, part, n * n_in)
                    weights[k, top] -= np.bincount(to // n_in, part, n)
            side *= np.float32(self.refine_rate / slow) * (one - one / far)
            refine[: n * BINS] += np.bincount(bins, side, n * BINS)
        if learn:
            self.weights = np.average(weights.T.reshape(-1, n_in, n_in), axis=0, weights=lengths)
            self.refine = np.average(refine.reshape(-1, BINS), axis=0, weights=lengths)
        out = np.empty(len(texts))
        out[order] = total / math.log(2)
        return out


def fitted(code: Code, table: Table, texts: list[bytes], passes: int = 4) -> MixModel:
    """A model over the predictors of ``table``, with the weights and refinement that the texts end with on average."""
    model = MixModel(code, table, np.full((len(ORDERS), len(ORDERS)), FIRST_WEIGHT), np.zeros(BINS))
    if texts:
        for _ in range(passes):
            model.cost(texts, learn=True)
    return model


def _summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(distinct keys, sums of each column of counts) of several such lists."""
    keys, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    return keys, *[np.bincount(at, np.concatenate([h[k] for h in held]), len(keys)) for k in range(1, len(held[0]))]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, byte, n, n_tuning) of every place of the texts, summed by slices and then over slices while memory allows."""
    held: list[tuple[np.ndarray, ...]] = []

    def rows(keys: np.ndarray, n: np.ndarray, tuning: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array((keys >> np.uint64(8)).astype(np.int64)), pa.array((keys & np.uint64(255)).astype(np.int16))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64)), pa.array(tuning.astype(np.int64))], names=["context", "byte", "n", "n_tuning"])

    for batch in batches:
        for part in text_slices(batch):
            apart: tuple[list, list] = ([], [])
            for text, tuning in zip(part.column("text").to_pylist(), part.column("tuning").to_pylist(), strict=True):
                apart[tuning].append(coded(text))
            for tuning, found in enumerate(apart):
                if found:
                    keys, n = np.unique(grams(found), return_counts=True)
                    held.append((keys, n, n * tuning))
            if sum(len(h[0]) for h in held) > 1_500_000:
                held = [_summed(held)]
                if len(held[0][0]) > 1_000_000:
                    yield rows(*held.pop())
    if held:
        yield rows(*_summed(held))


def _count_nodes(code: Code, block_shift: int):
    """(block, node, zeros, ones, and those of tuning texts) of summed places, for every order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def rows(nodes: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
            block = (nodes >> np.uint64(block_shift)).astype(np.int32)
            columns = [pa.array(block), pa.array(nodes.view(np.int64)), *[pa.array(s.astype(np.int64)) for s in sums]]
            return pa.RecordBatch.from_arrays(columns, names=["block", "node", "zeros", "ones", "zeros_t", "ones_t"])

        for batch in batches:
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            keys = (number("context").astype(np.uint64) << np.uint64(8)) | number("byte").astype(np.uint64)
            which, place = code.decisions(keys)
            mine, node, one = keys[which], code.node[place], code.sign[place] > 0
            n, t = number("n")[which], number("n_tuning")[which]
            counts = [n * ~one, n * one, t * ~one, t * one]
            held += [(hashed(mine, node, order), *counts) for order in ORDERS]
            if sum(len(h[0]) for h in held) > 1_500_000:
                held = [_summed(held)]
                if len(held[0][0]) > 750_000:
                    yield rows(*held.pop())
        if held:
            yield rows(*_summed(held))

    return run


def _fill_blocks(bits: int):
    """(block, slots, slots without tuning texts, slots of tuning texts alone) of a table from its summed nodes, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << bits) // BLOCKS
        blocks: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            # by frequency, then by the last bits of the node, whatever the order of rows
            total = (np.minimum(number("zeros") + number("ones"), 1 << 40) << 22) | (number("node") & ((1 << 22) - 1))
            order = np.argsort(total)
            node, total = number("node")[order].view(np.uint64), total[order]
            at = (node >> np.uint64(64 - bits)).astype(np.int64)
            check = node.astype(np.int8).astype(np.int16) * 256
            held = [(check + number(c)[order]).astype(np.int16) for c in ("x", "x_without", "x_tuning")]
            for block in np.unique(at // size).tolist():
                best, *slots = blocks.setdefault(block, (np.zeros(size, np.int64), *[np.zeros(size, np.int16) for _ in held]))
                rows = np.flatnonzero(at // size == block)
                rows = rows[total[rows] > best[at[rows] % size]]
                best[at[rows] % size] = total[rows]
                for mine, new in zip(slots, held, strict=True):
                    mine[at[rows] % size] = new[rows]
        for block, (_, *slots) in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([s.tobytes()], pa.binary()) for s in slots]], names=["block", "slots", "without", "tuning"])

    return run


def _counted(texts: DataFrame, most_slots: int) -> tuple[DataFrame, Code, list[Table]]:
    """(places, code, tables of all rows of ``texts`` (text, tuning), of those not for tuning, and of those for tuning)."""
    places = texts.mapInArrow(_count_grams, "context bigint, byte smallint, n bigint, n_tuning bigint")
    places = places.repartition("context").groupBy("context", "byte").agg(F.sum("n").alias("n"), F.sum("n_tuning").alias("n_tuning"))
    places = written(places, "lm-places")
    counts, distinct = np.zeros((256, 256)), 0
    before = F.col("context").bitwiseAND(F.lit(255))
    for last, byte, n, rows in places.groupBy(before, "byte").agg(F.sum("n"), F.count(F.lit(1))).collect():  # 2^16 at most
        counts[last, byte] = n
        distinct += rows
    code = Code(counts)
    bits = int(min(math.log2(most_slots), max(16, math.ceil(math.log2(4 * distinct + 1)))))
    shape = "block int, node bigint, zeros bigint, ones bigint, zeros_t bigint, ones_t bigint"
    nodes = places.mapInArrow(_count_nodes(code, 64 - BLOCKS.bit_length() + 1), shape).repartition("block")
    sums = nodes.groupBy("block", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "zeros_t", "ones_t")])

    def stretched(zeros: Column, ones: Column) -> Column:
        x = F.round(SCALE * F.log((ones + 0.4) / (zeros + 0.4)))
        bounded = F.greatest(F.least(x, F.lit(LIMIT * SCALE)), F.lit(-LIMIT * SCALE)) - UNSEEN
        return F.when(zeros + ones > 0, bounded).otherwise(0).cast("smallint")

    whole = stretched(F.col("zeros"), F.col("ones"))
    without = stretched(F.col("zeros") - F.col("zeros_t"), F.col("ones") - F.col("ones_t"))
    tuning = stretched(F.col("zeros_t"), F.col("ones_t"))
    filled = sums.select("node", "zeros", "ones", whole.alias("x"), without.alias("x_without"), tuning.alias("x_tuning"))
    filled = filled.mapInArrow(_fill_blocks(bits), "block int, slots binary, without binary, tuning binary")
    tables = [np.zeros(1 << bits, np.int16) for _ in range(3)]
    size = (1 << bits) // BLOCKS
    for batch in filled.toArrow().to_batches():  # six bytes a slot in all
        for row in range(batch.num_rows):
            block = batch.column(0)[row].as_py()
            for table, slots in zip(tables, batch.columns[1:], strict=True):
                table[block * size : (block + 1) * size] = np.frombuffer(slots[row].as_buffer(), np.int16)
    return places, code, [Table(bits, t) for t in tables]


def predictors(texts: DataFrame, most_slots: int = 1 << 25) -> tuple[Code, Table, Table]:
    """The code, the table of all rows of ``texts`` (text, tuning), and the table of those that are not for tuning."""
    _, code, (table, without, _) = _counted(texts, most_slots)
    return code, table, without


def _count_inputs(shared):
    """(input, n) of the decisions of summed places: the gate << 32 | predictions from the other half times their signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        waiting: list[tuple[np.ndarray, ...]] = []

        def found() -> Iterator[tuple[np.ndarray, ...]]:
            keys, n, tuning = map(np.concatenate, zip(*waiting, strict=True))
            for model, times in zip(shared.value, (n - tuning, tuning), strict=True):
                mine = np.flatnonzero(times)
                if len(mine):
                    x, gate = model.inputs(keys[mine])
                    sizes = model.code.sizes(keys[mine])
                    yield x.view(np.uint32).ravel().astype(np.int64) | np.repeat(gate.astype(np.int64) << 32, sizes), np.repeat(times[mine], sizes)

        def rows(inputs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(inputs), pa.array(n.astype(np.int64))], names=["input", "n"])

        for batch in batches:
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            waiting.append(((number("context").astype(np.uint64) << np.uint64(8)) | number("byte").astype(np.uint64), number("n"), number("n_tuning")))
            if sum(len(w[0]) for w in waiting) > 1 << 16:
                held += found()
                waiting.clear()
            if sum(len(h[0]) for h in held) > 1_500_000:
                held = [_summed(held)]
                if len(held[0][0]) > 750_000:
                    yield rows(*held.pop())
        if waiting:
            held += found()
        if held:
            yield rows(*_summed(held))

    return run


def _slopes(weights: np.ndarray):
    """(sums) of one pass over inputs, as bytes: by gate the cost, its slopes and its curvature; right and wrong decisions by parts of bins."""
    n_in = len(ORDERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, slope, curve = np.zeros(n_in), np.zeros((n_in, n_in)), np.zeros((n_in, n_in, n_in))
        parts = np.zeros(2 * BINS * FINE)

        def add(inputs: np.ndarray, n: np.ndarray) -> None:
            gate = inputs >> 32
            x = inputs.astype(np.uint32).view(np.int8).reshape(-1, n_in) / SCALE
            mixed = (x * weights[gate]).sum(axis=1)
            error = 1 / (1 + np.exp(mixed))
            cost[:] += np.bincount(gate, n * np.logaddexp(0, -mixed), n_in)
            for g in np.unique(gate).tolist():
                mine = gate == g
                xs, times = x[mine], n[mine] * error[mine]
                slope[g] -= times @ xs
                curve[g] += (xs * (times * (1 - error[mine]))[:, None]).T @ xs
            place = (np.minimum(np.abs(mixed), LIMIT) * (2 * FINE)).astype(np.int64)
            parts[:] += np.bincount((place + BINS * FINE * (mixed < 0))[mixed != 0], n[mixed != 0], len(parts))

        waiting: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            waiting.append((batch.column("input").to_numpy(), batch.column("n").to_numpy()))
            if sum(len(w[0]) for w in waiting) > 1 << 15:
                add(*map(np.concatenate, zip(*waiting, strict=True)))
                waiting.clear()
        if waiting:
            add(*map(np.concatenate, zip(*waiting, strict=True)))
        sums = np.concatenate([cost, slope.ravel(), curve.ravel(), parts])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    return run


def _refinement(parts: np.ndarray) -> np.ndarray:
    """The refinement of least cost in each bin, by Newton steps over the right and wrong decisions of its parts."""
    right, wrong = parts.reshape(2, BINS, FINE)
    at = (np.arange(BINS * FINE).reshape(BINS, FINE) + 0.5) / (2 * FINE)
    refine = np.zeros(BINS)
    for _ in range(100):
        p = 1 / (1 + np.exp(-at - refine[:, None]))
        slope = (wrong * p - right * (1 - p)).sum(axis=1) + PRIOR * refine
        curve = ((right + wrong) * p * (1 - p)).sum(axis=1) + PRIOR
        refine -= np.clip(slope / curve, -0.5, 0.5)
    return refine


def start_of(inputs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The weights and refinement of least cost over summed ``inputs`` (input, n)."""
    n_in = len(ORDERS)

    def passed(weights: np.ndarray) -> tuple[np.ndarray, ...]:
        # a row of fixed size from each task
        sums = sum((np.frombuffer(r[0]) for r in inputs.mapInArrow(_slopes(weights), "sums binary").collect()), np.zeros(n_in + n_in**2 + n_in**3 + 2 * BINS * FINE))
        cost, slope, curve, parts = np.split(sums, np.cumsum([n_in, n_in**2, n_in**3]))
        off = weights - FIRST_WEIGHT
        curve = curve.reshape(n_in, n_in, n_in) + PRIOR * np.eye(n_in)
        return cost + PRIOR / 2 * (off**2).sum(axis=1), slope.reshape(n_in, n_in) + PRIOR * off, curve, parts

    weights = np.full((n_in, n_in), FIRST_WEIGHT)
    cost, slope, curve, parts = passed(weights)
    scale = np.ones(n_in)
    for _ in range(MOST_STEPS):
        step = np.linalg.solve(curve, slope[:, :, None])[:, :, 0] * scale[:, None]
        if np.abs(step).max() < LAST_STEP:
            break
        tried = passed(weights - step)
        better = tried[0] <= cost + 1e-9 * np.abs(cost)  # each gate by itself; where a step went too far it is halved
        scale = np.where(better, 1.0, scale / 2)
        weights = np.where(better[:, None], weights - step, weights)
        cost, slope, curve = (np.where(better.reshape(-1, *[1] * (old.ndim - 1)), new, old) for new, old in zip(tried[:3], (cost, slope, curve), strict=True))
        parts = tried[3] if better.all() else passed(weights)[3]
    return np.round(weights, 6), np.round(_refinement(parts), 6)  # the order of sums leaves no trace


def train(df: DataFrame, keep: Column, text_col: str = "text", id_col: str = "doc_id", most_slots: int = 1 << 25) -> MixModel:
    """A model from the rows of ``df`` for which ``keep`` holds."""
    half = F.xxhash64(F.col(id_col).cast("string"), text_col).bitwiseAND(F.lit(1)) == 1
    texts = df.filter(keep).select(F.col(text_col).alias("text"), half.alias("tuning"))
    places, code, (table, without, tuning) = _counted(texts, most_slots)
    none = np.zeros((len(ORDERS), len(ORDERS))), np.zeros(BINS)
    shared = df.sparkSession.sparkContext.broadcast((MixModel(code, tuning, *none), MixModel(code, without, *none)))
    inputs = places.mapInArrow(_count_inputs(shared), "input bigint, n bigint").groupBy("input").agg(F.sum("n").alias("n"))
    return MixModel(code, table, *start_of(written(inputs, "lm-inputs")))


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of training rows."""
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])
        counts.clear()
        return found

    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(words_of(text))
            counts[b""] += 1
            if len(counts) > 250_000:
                yield rows()
    if counts:
        yield rows()


def score_texts(
    df: DataFrame,
    keep: Column,
    model: MixModel | None = None,
    most_head: int = 1 << 20,
    text_col: str = "text",
    id_col: str = "doc_id",
    slice_bytes: int = 3 << 19,
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, bits, n_coded, score) for every row of ``df``.

    ``keep`` marks the training rows; n_coded is the number of bytes that the ``bits`` code.
    """
    spark = df.sparkSession
    small_batches(spark)
    model = model or train(df, keep, text_col=text_col, id_col=id_col)
    learn = df.filter(keep).select(F.col(text_col).alias("text"))
    counts = written(learn.mapInArrow(_count_tokens, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("c")), "lm-counts")
    known, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    frequent = counts.filter(F.col("c") * most_head >= total).toArrow()
    head = dict(zip(frequent.column("token").cast(pa.binary()).to_pylist(), frequent.column("c").to_pylist(), strict=True))
    shared = spark.sparkContext.broadcast((model, {t: math.log10(c + 1) for t, c in head.items()}))
    per_token = math.log10(total + known + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head = shared.value
        for batch in batches:
            for part in text_slices(batch, "text", slice_bytes):
                texts = part.column("text").to_pylist()
                words = [words_of(t) for t in texts]
                data = [joined(w) for w in words]
                bits = model.cost(data)
                sizes = np.array([len(w) + 1 for w in words])  # the end is a token
                tokens = list(chain.from_iterable(chain(w, (b"",)) for w in words))
                logs = np.fromiter(map(head.get, tokens, repeat(-1.0)), np.float64, len(tokens))
                first = np.cumsum(sizes) - sizes
                near = np.add.reduceat(np.maximum(logs, 0), first)
                n_head = np.add.reduceat((logs >= 0).astype(np.int64), first)
                far = np.flatnonzero(logs < 0)
                row = np.searchsorted(first, far, "right") - 1
                times = Counter(zip(row.tolist(), map(tokens.__getitem__, far.tolist()), strict=True))  # in order of rows
                ends = np.concatenate([[0], np.cumsum(np.bincount([r for r, _ in times], minlength=len(words)))])
                rare = [t for _, t in times]
                pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()).cast(pa.string()), pa.array(list(times.values()), pa.int32())], ["token", "n"])
                columns = [part.column("id"), pa.array(sizes), pa.array(n_head), pa.array(near)]
                columns += [pa.array(bits), pa.array([len(b) for b in data], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "n_head", "near", "bits", "n_coded", "rest"])

    kind = df.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, n_tokens bigint, n_head bigint, near double, bits double, n_coded bigint, rest array<struct<token:string,n:int>>"
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, shape)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = rows.select("row", F.explode("rest").alias("r")).select("row", "r.token", "r.n").join(counts, "token")
    far = rare.groupBy("row").agg(F.sum("n").alias("n_far"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("far"))
    met = rows.drop("rest").join(far, "row", "left")
    base = F.col("near") + F.coalesce("far", F.lit(0.0)) - F.col("n_tokens") * per_token
    return met.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_far", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "bits",
        "n_coded",
        (-F.col("bits") * math.log10(2)).alias("score"),
    )
