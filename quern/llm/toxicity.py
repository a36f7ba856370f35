"""Toxicity by a convolutional text classifier in numpy, with thresholds calibrated by language.

A word's embedding is the sum of hashed embeddings of the word and of its first four and six characters. Filters of
widths 1, 2 and 3 slide over the words of the whole text, the maximum of each filter over the text is taken, and a
logistic layer gives the raw score. Gradients flow only through the places of the maxima.

Training takes every labelled text, whole, as often as it occurs. Three quarters, by a hash of the id, train the
network. Their words are written as rows of the embedding table, dealt by a hash of id and text into shards of about
``SHARD_CHARS`` characters, however many that makes. In each round every shard trains a copy of the network on all its
texts, and the copies are averaged: each weight over the shards that moved it, by their texts. One shard alone needs no
averaging and does its rounds at once. Labelled ids are broadcast, or joined where they are more than ``most_ids``. Shards and their order depend on the rows alone, not on how they are spread.

On all texts of the other quarter, scored by the network and counted in steps of 1 / ``FINE``, a threshold is set for
all languages together, and one for each language that has at least ``least_toxic`` toxic texts there, where the F1
score is best (the middle of the best range). A language with fewer of them, but ``least_clean`` others, gets the
threshold that raises as many false alarms as the common one does. The language of a text is found from its words, by
the language model of ``language_id``; it shifts the score so that a language's threshold is at ``CUT``.

Null and empty texts, and those without a word, have the score of an empty text. Labels without an id or a class teach
nothing; an id labelled more than once counts as toxic if any of its labels does. Without labelled texts of both classes
every score is 0. Null ids and repeated rows are kept; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import latin_table, latin_words, small_batches, text_slices, written
from quern.llm.language_id import LanguageModel, gram_buckets

CUT = 0.3
WIDTHS = (1, 2, 3)
FILTERS = 16
SIZE = 16
BUCKETS = 1 << 14
PARTS = 3
#: Characters of a shard, those that a shard's copies of the network read in all, and the bounds of rounds.
SHARD_CHARS, READ_CHARS, LEAST_ROUNDS, MOST_ROUNDS = 48 << 20, 150 << 20, 4, 20
#: Steps of a raw score that are told apart when thresholds are set.
FINE = 1024
#: Parts of the network that are averaged by themselves.
CHUNKS = 16
#: Words that filters slide over at once, so that what they give is near at hand; a text that is scored is not cut.
SOME_WORDS = 1 << 12
#: Characters of a word.
MOST = 40
#: A run of letters and digits, or a piece of ``MOST`` of a longer run.
TOKEN = re.compile(r"[^\W_]{1,%d}" % MOST)
_LATIN = latin_table(TOKEN, lower=True)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32s(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes; all runs step together, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j, n in enumerate(np.searchsorted(-left, -np.arange(1, left.max(initial=0) + 1), "right")):  # runs with a byte at j
        state[:n] = _CRC[(state[:n] ^ codes[at[:n] + j]) & 255] ^ state[:n] >> 8
    out = np.empty_like(state)
    out[order] = ~state
    return out


def hashed(words: list[str]) -> np.ndarray:
    """Rows of the embedding table for each word: itself, its first four and its first six characters, by crc32."""
    codes = np.frombuffer("".join(words).encode(), np.uint8)
    chars = np.fromiter(map(len, words), np.int64, len(words))
    places = np.append(np.flatnonzero(codes & 0xC0 != 0x80), len(codes))  # where characters begin
    first = np.cumsum(chars) - chars
    starts = places[first]
    parts = [crc32s(codes, starts, places[first + np.minimum(chars, most)] - starts) % BUCKETS for most in (chars, 4, 6)]
    return (np.stack(parts, axis=1) + np.arange(PARTS, dtype=np.uint32) * BUCKETS).astype(np.int32)


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    found = latin_words(text, _LATIN, MOST)
    return TOKEN.findall(text.lower()) if found is None else found


@dataclass
class Network:
    """Weights of the classifier."""

    table: np.ndarray  # embeddings
    filters: list[np.ndarray]  # for each width: width x SIZE x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        f32 = np.float32
        return cls(
            (rng.standard_normal((PARTS * BUCKETS, SIZE)) * 0.1).astype(f32),
            [(rng.standard_normal((w, SIZE, FILTERS)) / np.sqrt(w * SIZE)).astype(f32) for w in WIDTHS],
            np.zeros(len(WIDTHS) * FILTERS, f32),
            (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(f32),
            np.zeros(1, f32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.table, *self.filters, self.bias, self.out, self.out_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights()])

    @classmethod
    def of_flat(cls, flat: np.ndarray) -> Network:
        net = cls.fresh()
        for weight, part in zip(net.weights(), np.split(flat, np.cumsum([w.size for w in net.weights()])[:-1]), strict=True):
            weight[...] = part.reshape(weight.shape)
        return net

    def maps(self, words: np.ndarray) -> np.ndarray:
        """Outputs of each filter (a row) at each word (a column) of texts laid out with empty words between them."""
        flat = np.concatenate([f for w in self.filters for f in w], axis=1)  # SIZE x (sum of widths * FILTERS)
        each = flat.T @ words.T
        out = np.empty((len(WIDTHS) * FILTERS, len(words)), np.float32)
        row = 0
        for k, w in enumerate(WIDTHS):
            sums = out[k * FILTERS : (k + 1) * FILTERS]
            sums[:] = each[row : row + FILTERS]
            for j in range(1, w):
                sums[:, : len(words) - j] += each[row + j * FILTERS : row + (j + 1) * FILTERS, j:]
            row += w * FILTERS
        return out

    def logits(self, embedded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Raw scores of texts whose words begin at ``starts``: filters begin at each word and at the first empty one."""
        cuts = np.stack([starts, starts + lengths + 1], axis=1).ravel()
        pooled = np.maximum.reduceat(self.maps(embedded), cuts, axis=1)[:, ::2].T
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias[0]


def neighbours(sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of neighbours whose sizes make about ``most`` together, one at least."""
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1)


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(place of each word, start of each text, total) with as many empty words after each text as a filter can reach.

    A filter that begins at the first empty word then ends before the next text.
    """
    gap = max(WIDTHS)
    starts = np.cumsum(lengths + gap) - (lengths + gap)
    places = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return places, starts, int((lengths + gap).sum())


def peaks(net: Network, texts: list[np.ndarray], most_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(the highest output, the word where it begins) of each filter in each text; ``most_words`` are laid out at once."""
    best = np.full((len(texts), len(net.bias)), -np.inf, np.float32)
    top = np.zeros(best.shape, np.int64)
    pieces = [(i, a) for i, t in enumerate(texts) for a in range(0, max(1, len(t)), most_words)]
    sizes = np.array([min(most_words, len(texts[i]) - a) for i, a in pieces])
    for group in np.split(np.arange(len(pieces)), np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // most_words)) + 1):
        mine = [pieces[g] for g in group]
        parts = [texts[i][a : a + most_words + max(WIDTHS) - 1] for i, a in mine]  # filters reach into the next piece
        places, starts, total = layout(np.array([len(p) for p in parts]))
        words = np.zeros((total, SIZE), np.float32)
        ids = np.concatenate(parts)
        embedded = net.table[ids[:, 0]]
        for part in range(1, PARTS):
            embedded += net.table[ids[:, part]]
        words[places] = embedded
        maps = net.maps(words)
        for (i, a), start in zip(mine, starts, strict=True):
            rest = len(texts[i]) - a
            found = maps[:, start : start + (most_words if rest > most_words else rest + 1)]
            at = found.argmax(axis=1)
            value = found[np.arange(len(found)), at]
            higher = value > best[i]
            best[i][higher], top[i][higher] = value[higher], at[higher] + a
    return best, top


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 15, batch_words: int = 12_000, rate: float = 0.004, seed: int = 11, net: Network | None = None, balance: tuple[float, float] | None = None) -> Network:
    """A network trained by Adam on texts given as rows of ``hashed`` words, from ``net`` on.

    ``balance`` weighs the texts of the classes 0 and 1; they are as heavy as each other unless it is given.
    """
    net = net or Network.fresh()
    rng = np.random.default_rng(seed)
    state = [tuple(np.zeros_like(w) for _ in range(4)) for w in net.weights()]  # moments, gradient, scratch
    balance = balance or (len(labels) * 0.5 / max(1, (1 - labels).sum()), len(labels) * 0.5 / max(1, labels.sum()))
    weigh = np.where(labels == 1, balance[1], balance[0])
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        cuts = np.flatnonzero(np.diff(np.cumsum([len(texts[i]) + 2 for i in order]) // batch_words)) + 1
        for rows in np.split(order, cuts):
            step += 1
            mine = [texts[i] for i in rows]
            lengths = np.array([len(t) for t in mine])
            first = (np.cumsum(lengths) - lengths)[:, None]
            ids = np.concatenate([*mine, np.zeros((1, PARTS), mine[0].dtype)])
            highest, top = peaks(net, mine, SOME_WORDS)
            pooled = highest + net.bias
            active = np.maximum(pooled, 0)
            raw = active @ net.out + net.out_bias[0]
            error = (1 / (1 + np.exp(-raw)) - labels[rows]) * weigh[rows] / len(rows)
            back = (error[:, None] * net.out * (pooled > 0)).astype(np.float32)
            grads = [grad for _, _, grad, _ in state]
            grads[0].fill(0)
            for grad, found in zip(grads[1 + len(WIDTHS) :], (back.sum(axis=0), active.T @ error, error.sum()), strict=True):
                grad[:] = found
            for k, w in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(w):
                    inside = top[:, own] + j < lengths[:, None]
                    seen = ids[np.where(inside, first + top[:, own] + j, 0)]
                    words = net.table[seen].sum(axis=2) * inside[:, :, None]
                    grads[1 + k][j] = np.einsum("bf,bfd->df", back[:, own], words)
                    push = (back[:, own, None] * net.filters[k][j].T[None])[inside]
                    for part in range(PARTS):
                        np.add.at(grads[0], seen[:, :, part][inside], push)
            for weight, (m, v, grad, some) in zip(net.weights(), state, strict=True):  # in place, as most of the time goes here
                np.subtract(grad, m, out=some)
                some *= 0.1
                m += some
                grad *= grad
                grad -= v
                grad *= 0.01
                v += grad
                np.multiply(v, 1 / (1 - 0.99**step), out=some)
                np.sqrt(some, out=some)
                some += 1e-7
                np.divide(m, some, out=some)
                some *= rate / (1 - 0.9**step)
                weight -= some
    return net


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, place, label, words) of (shard, place, label, text): rows of ``hashed`` words as 16-bit numbers in a part."""
    rows: dict[str, int] = {}
    held = np.zeros((0, PARTS), np.uint16)
    for batch in batches:
        for part in text_slices(batch):
            cut = [tokens(t) for t in part.column("text").to_pylist()]
            new = list({w for c in cut for w in c}.difference(rows))
            if len(rows) + len(new) > 300_000:
                rows.clear()
                new, held = list({w for c in cut for w in c}), held[:0]
            rows.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
            held = np.concatenate([held, (hashed(new) % BUCKETS).astype(np.uint16)])
            words = [held[np.fromiter(map(rows.__getitem__, c), np.int64, len(c))].tobytes() for c in cut]
            yield pa.RecordBatch.from_arrays([*map(part.column, ("shard", "place", "label")), pa.array(words, pa.binary())], names=["shard", "place", "label", "words"])


def _fit_shards(shared, balance: tuple[float, float], epochs: int, seed: int):
    """(shard, chunk, n, weights) of the network trained by each shard on its n texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        labels: list[int] = []

        def trained(shard: int) -> pa.RecordBatch:
            base = np.arange(PARTS, dtype=np.int32) * BUCKETS
            net = fit([np.frombuffer(t, np.uint16).reshape(-1, PARTS) + base for t in texts], np.array(labels, np.float64), epochs, seed=seed, net=Network.of_flat(shared.value), balance=balance)
            parts = [pa.scalar(w.tobytes(), pa.binary()) for w in np.array_split(net.flat(), CHUNKS)]
            columns = [pa.array([shard] * CHUNKS, pa.int32()), pa.array(range(CHUNKS), pa.int32()), pa.array([len(texts)] * CHUNKS, pa.int64()), pa.array(parts, pa.binary())]
            texts.clear()
            labels.clear()
            return pa.RecordBatch.from_arrays(columns, names=["shard", "chunk", "n", "weights"])

        last = None
        for batch in batches:
            for shard, label, words in zip(*[batch.column(c).to_pylist() for c in ("shard", "label", "words")], strict=True):
                if texts and shard != last:
                    yield trained(last)
                last = shard
                texts.append(words)
                labels.append(label)
        if texts:
            yield trained(last)

    return run


def _average(shared):
    """(chunk, weights): the start moved by the mean move of the shards that moved a weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.array_split(shared.value.astype(np.float64), CHUNKS)
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for chunk, n, weights in zip(*[batch.column(c).to_pylist() for c in ("chunk", "n", "weights")], strict=True):
                move = np.frombuffer(weights, np.float32) - start[chunk]
                moved, by = sums.setdefault(chunk, [np.zeros(len(move)), np.zeros(len(move))])
                moved += n * move
                by += n * (move != 0)
        for chunk, (moved, by) in sums.items():
            weights = (start[chunk] + moved / np.maximum(by, 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([weights.tobytes()], pa.binary())], names=["chunk", "weights"])

    return run


def fit_shards(texts: DataFrame, shards: int, rounds: int, balance: tuple[float, float]) -> Network:
    """A network trained on all of ``texts`` (shard, place, label, words), whose shards lie together."""
    flat = Network.fresh().flat()
    rounds, epochs = (1, rounds) if shards == 1 else (rounds, 1)
    for k in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast(flat)
        each = texts.mapInArrow(_fit_shards(shared, balance, epochs, 11 + k), "shard int, chunk int, n bigint, weights binary")
        mean = each.repartition("chunk").sortWithinPartitions("chunk", "shard", "n").mapInArrow(_average(shared), "chunk int, weights binary")
        flat = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in mean.orderBy("chunk").collect()])
    return Network.of_flat(flat)


def best_threshold(raw: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the range of thresholds with the best weighted F1 score; equal raw scores are not parted."""
    order = np.argsort(-raw, kind="stable")
    hit, all_hit = np.cumsum((labels * weight)[order]), (labels * weight).sum()
    taken = np.cumsum(weight[order])
    f1 = 2 * hit / (taken + all_hit)
    f1[:-1][np.diff(raw[order]) == 0] = -1
    best = int(f1.argmax())
    above, below = raw[order[best]], raw[order[best + 1]] if best + 1 < len(order) else raw[order[best]] - 1
    return float((above + below) / 2)


@dataclass
class ToxicityModel:
    """The network, the language model and the thresholds; remembers words that it has met."""

    net: Network | None
    langs: LanguageModel
    thresholds: dict[str, float]
    default: float
    most_words: int = 300_000
    _rows: dict[str, int] | None = field(default=None, repr=False)
    _words: np.ndarray | None = field(default=None, repr=False)
    _met: np.ndarray | None = field(default=None, repr=False)  # how often each word was met

    def __getstate__(self):
        return self.__dict__ | {"_rows": None, "_words": None, "_met": None}

    def _features(self, words: list[str]) -> np.ndarray:
        """Embedding and language scores of each word."""
        embedded = self.net.table[hashed(words)].sum(axis=1)
        if not self.langs.langs:
            return embedded
        bucket, owner = gram_buckets(words, len(self.langs.logp))
        scores = np.stack([np.bincount(owner, self.langs.logp[bucket, k], len(words)) for k in range(len(self.langs.langs))], axis=1)
        scores = np.maximum(scores - scores.max(axis=1, keepdims=True), -12)
        return np.concatenate([embedded, scores], axis=1).astype(np.float32)

    def _ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Rows of ``_words`` for the words of each text, from 1 on; row 0 is an empty word's."""
        rows, self._rows = self._rows, None  # not there again before its words are
        if rows is None:
            rows, self._met = defaultdict(count(1).__next__), np.zeros(1, np.int64)
        elif len(rows) > self.most_words:  # the half met most often stays
            stay = np.sort(np.argsort(-self._met[1:], kind="stable")[: self.most_words // 2])
            names = list(rows)
            rows = defaultdict(count(1 + len(stay)).__next__, zip(map(names.__getitem__, stay.tolist()), count(1)))
            self._words[1 : 1 + len(stay)] = self._words[1 + stay]
            self._met = np.append(0, self._met[1 + stay] // 2)
        first, row_of = len(rows), rows.__getitem__
        ids = []
        for text in texts:
            words = tokens(text)  # gone before the next text's, while the cache holds them
            ids.append(np.fromiter(map(row_of, words), np.int32, len(words)))
        need = 1 + len(rows)
        if self._words is None or need > len(self._words):
            grown = np.zeros((2 * need, SIZE + len(self.langs.langs)), np.float32)
            if self._words is not None:
                grown[: first + 1] = self._words[: first + 1]
            self._words = grown
        new = list(islice(reversed(rows), len(rows) - first))[::-1]
        if new:
            self._words[first + 1 : need] = self._features(new)
        met = np.bincount(np.concatenate(ids), minlength=need)
        met[: first + 1] += self._met
        self._rows, self._met = rows, met
        return ids

    def raw(self, texts: list[str | None], most_bytes: int = 1 << 19) -> tuple[np.ndarray, list[str]]:
        """Raw scores and languages of texts, a few at a time by their bytes."""
        groups = neighbours(np.array([len(t or "") for t in texts]), most_bytes)
        found = [self._raw([texts[i] for i in group]) for group in groups]
        return np.concatenate([raw for raw, _ in found]), [name for _, names in found for name in names]

    def _raw(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        found = self._ids(texts)
        lengths = np.array([len(ids) for ids in found])
        ids, ends = np.concatenate(found), np.cumsum(lengths)
        raw, named = np.empty(len(texts), np.float32), []
        for group in neighbours(lengths, SOME_WORDS):
            mine = lengths[group]
            places, starts, total = layout(mine)
            rows = np.zeros(total, np.int32)
            rows[places] = ids[ends[group[0]] - mine[0] : ends[group[-1]]]
            table = self._words[rows]
            raw[group] = self.net.logits(table[:, :SIZE], starts, mine)
            scores = np.add.reduceat(table[:, SIZE:], starts, axis=0) if self.langs.langs else np.zeros((len(mine), 0))
            named += [self.langs.langs[s.argmax()] if n and len(s) else "" for s, n in zip(scores, mine, strict=True)]
        return raw, named

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.net is None or not texts:
            return np.zeros(len(texts))
        raw, named = self.raw(texts)
        shift = np.array([self.thresholds.get(n, self.default) for n in named])
        return 1 / (1 + np.exp(-np.clip(raw - shift + np.log(CUT / (1 - CUT)), -60, 60).astype(np.float64)))


def _count_raw(shared, slice_bytes: int):
    """(lang, label, step, n) of texts: how many of a language and label have a raw score at each step of 1 / FINE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = shared.value, Counter()
        for batch in batches:
            for part in text_slices(batch, "text", slice_bytes):
                raw, named = model.raw(part.column("text").to_pylist())
                steps = np.round(np.clip(raw.astype(np.float64), -60, 60) * FINE).astype(np.int64)
                counts.update(zip(named, part.column("label").to_pylist(), steps.tolist(), strict=True))
        lang, label, step = zip(*counts, strict=True) if counts else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(label, pa.int32()), pa.array(step, pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["lang", "label", "step", "n"])

    return run


def train(df: DataFrame, labels: DataFrame, keep: Column, langs: LanguageModel, least_toxic: int = 15, least_clean: int = 30, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", shard_chars: int = SHARD_CHARS, most_ids: int = 1 << 21, slice_bytes: int = 2 << 20) -> ToxicityModel:
    """A model from the labelled rows of ``df`` for whose id ``keep`` holds."""
    spark = df.sparkSession
    small_batches(spark)
    known = labels.filter(keep & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("of")).agg((F.max(label_col) == 1).cast("int").alias("label"))
    known = written(known, "toxicity-labels")
    few = known.count() <= most_ids
    texts = df.filter(keep).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = F.col("id").cast("string")
    rows = texts.join(F.broadcast(known) if few else known, F.col("id") == F.col("of")).select(named.alias("id"), "text", "label", (F.crc32(F.concat(F.lit("part "), named)) % 4 == 0).alias("check"))
    rows = rows if few else written(rows, "toxicity-rows")  # so that texts move once
    size = {(r["check"], r["label"]): r for r in rows.groupBy("check", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars")).collect()}
    if len({label for _, label in size}) < 2:
        return ToxicityModel(None, langs, {}, 0.0)
    both = lambda part: all((part, label) in size for label in (0, 1))
    learn, check = (rows.filter(F.col("check") == part) if both(part) else rows for part in (False, True))
    of = [[r for (part, k), r in size.items() if k == label and (not part or not both(False))] for label in (0, 1)]
    n, chars = [sum(r["n"] for r in rs) for rs in of], sum(r["chars"] for rs in of for r in rs)
    shards = max(1, math.ceil(chars / shard_chars))
    rounds = min(MOST_ROUNDS, max(LEAST_ROUNDS, math.ceil(READ_CHARS * shards / max(1, chars))))
    place = F.xxhash64("id", "text")
    dealt = learn.select(F.pmod(place, F.lit(shards)).cast("int").alias("shard"), place.alias("place"), "label", "text")
    dealt = dealt.mapInArrow(_hash_words, "shard int, place bigint, label int, words binary").repartitionById(shards, "shard").sortWithinPartitions("shard", "place", "label", "words")
    net = fit_shards(written(dealt, "toxicity-words"), shards, rounds, (sum(n) * 0.5 / n[0], sum(n) * 0.5 / n[1]))
    model = ToxicityModel(net, langs, {}, 0.0)
    counts = check.select("label", "text").mapInArrow(_count_raw(spark.sparkContext.broadcast(model), slice_bytes), "lang string, label int, step bigint, n bigint")
    found = counts.groupBy("lang", "label", "step").agg(F.sum("n").alias("n")).orderBy("lang", "label", "step").toPandas()
    names, y, raw, n = found["lang"].to_numpy(), found["label"].to_numpy().astype(np.float64), found["step"].to_numpy() / FINE, found["n"].to_numpy().astype(np.float64)
    model.default = best_threshold(raw, y, n)
    alarms = max(0.01, float(n[(y == 0) & (raw >= model.default)].sum() / max(1, n[y == 0].sum())))
    for lang in sorted(set(names)):
        mine = names == lang
        toxic, clean = n[mine & (y == 1)].sum(), n[mine & (y == 0)].sum()
        if toxic >= least_toxic and clean:
            model.thresholds[lang] = best_threshold(raw[mine], y[mine], n[mine])
        elif clean >= least_clean:
            at = mine & (y == 0)  # by raw score, as found is sorted
            model.thresholds[lang] = float(raw[at][min(at.sum() - 1, np.searchsorted(np.cumsum(n[at]), (1 - alarms) * clean))])
    return model


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text", id_col: str = "doc_id", slice_bytes: int = 2 << 20) -> DataFrame:
    """(id, score) for every row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in text_slices(batch, "text", slice_bytes):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.scores(part.column("text").to_pylist()), pa.float64())], names=[id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double")
