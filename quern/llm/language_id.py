"""Language ID by labelled spans of whole texts.

A word is a run of letters of one script, or a piece of ``MOST`` letters of a longer run, so that scripts without
spaces have words too and every letter counts. Its script narrows the candidate languages to those that used that script
in training; each candidate gets a score from hashed character n-grams. A Viterbi pass over the words of a
text, with a penalty for each switch of language, labels every word, and neighbours with one label make a span.

Training takes whole labelled texts, ``most_docs`` a language at most in expectation (all if it is infinite; by a hash of id and text, so
that the choice does not depend on the order of rows, and rows without an id are like others). Counts are summed on the executors; what comes back is one number for each language
and n-gram bucket, which no corpus can make larger.

Nulls: a null text, or one without a letter, is ``und`` with score 0 and no spans; rows without a label or text teach
nothing. Ties go to the language first in alphabetical order. With no training row at all every text is ``und``.
Repeated rows and null ids are kept; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import carried, latin_table, latin_words, lean, text_slices

UND = "und"
#: Letters in a word at most.
MOST = 40
LETTERS = re.compile(r"[^\W\d_]{1,%d}" % MOST)
_LATIN = latin_table(LETTERS)
#: Beyond the first script.
_WIDE = re.compile("[\u0370-\U0010ffff]")
ORDERS = (1, 2, 3, 4)
#: Words whose n-grams are laid out at once, at about 1 kB each.
SOME_WORDS = 1 << 14

#: First code point of each script range (Unicode blocks), in order. Fixed values.
SCRIPT_STARTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Burmese"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
)
_STARTS = np.array([s for s, _ in SCRIPT_STARTS])
SCRIPTS = tuple(dict.fromkeys(n for _, n in SCRIPT_STARTS))
_SCRIPT_OF = np.array([SCRIPTS.index(n) for _, n in SCRIPT_STARTS])


def script(char: str) -> int:
    return int(_SCRIPT_OF[np.searchsorted(_STARTS, ord(char), "right") - 1])


def places(text: str) -> list[tuple[int, int]]:
    """(start, end) of each word."""
    runs = [m.span() for m in LETTERS.finditer(text)]
    if not _WIDE.search(text):
        return runs
    kinds = _SCRIPT_OF[np.searchsorted(_STARTS, np.frombuffer(text.encode("utf-32-le"), np.uint32), "right") - 1]
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    first = np.searchsorted(cuts, [a for a, _ in runs], "right").tolist()
    last = np.searchsorted(cuts, [b for _, b in runs], "left").tolist()
    at = cuts.tolist()
    return [pair for (a, b), i, j in zip(runs, first, last, strict=True) for pair in pairwise([a, *at[i:j], b])]


def words_of(text: str) -> list[str]:
    found = latin_words(text, _LATIN, MOST)
    if found is not None:
        return found
    return [text[a:b] for a, b in places(text)] if _WIDE.search(text) else LETTERS.findall(text)


def gram_buckets(words: list[str], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of each word, ends marked and in lower case, and of the word itself; and whose each is."""
    marked = [f"^{w.lower()}$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    mult, seed = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    hashes, owners = [], []
    for n in ORDERS:
        if len(codes) < n:
            break
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * mult
        whole = np.arange(len(h)) + n <= ends[owner[: len(h)]]
        hashes.append(h[whole])
        owners.append(owner[: len(h)][whole])
    place = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
    spread = (codes + seed) * ((place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * mult)
    hashes.append(np.add.reduceat(spread ^ (spread >> np.uint64(29)), ends - lengths))
    owners.append(np.arange(len(words)))
    mixed = np.concatenate(hashes)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * mult
    return (mixed >> np.uint64(33)).astype(np.int64) % n_buckets, np.concatenate(owners)


@dataclass
class LanguageModel:
    """Log probabilities of buckets and the scripts of each language."""

    langs: list[str]
    logp: np.ndarray  # buckets x languages
    uses: np.ndarray  # scripts x languages, bool
    switch: float = 8.0
    floor: float = 6.0
    most_words: int = 250_000
    _rows: dict[str, int] = field(default_factory=dict, repr=False)
    _table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_rows": {}, "_table": None}

    def _score(self, words: list[str]) -> np.ndarray:
        """Per-language scores, the best 0: other scripts are out, and no word outweighs ``floor``."""
        bucket, owner = gram_buckets(words, len(self.logp))
        columns = [np.bincount(owner, self.logp[bucket, k], len(words)) for k in range(len(self.langs))]
        s = np.stack(columns, axis=1) / len(ORDERS)
        may = self.uses[[script(w[0]) for w in words]]
        may |= ~may.any(axis=1, keepdims=True)
        s = np.maximum(s - np.where(may, s, -np.inf).max(axis=1, keepdims=True), -self.floor)
        return np.where(may, s, -4 * self.floor).astype(np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        rows = self._rows
        new = list(set(words).difference(rows))
        if len(rows) + len(new) > self.most_words:
            rows.clear()
            new = list(set(words))
        if new:
            first, need = len(rows), len(rows) + len(new)
            if self._table is None or need > len(self._table):
                grown = np.zeros((2 * need, len(self.langs)), np.float32)
                if self._table is not None:
                    grown[:first] = self._table[:first]
                self._table = grown
            for a in range(0, len(new), SOME_WORDS):
                self._table[first + a : min(first + a + SOME_WORDS, need)] = self._score(new[a : a + SOME_WORDS])
            rows.update(zip(new, range(first, need), strict=True))
        return np.fromiter(map(rows.__getitem__, words), np.int32, len(words))

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The best path of languages for each list of words; all texts step together, the longest first."""
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        scores = self._table_of([w for t in texts for w in t])
        back = np.zeros(scores.shape, np.int8 if len(self.langs) < 128 else np.int16)
        path = np.zeros(len(scores), np.int32)
        if not len(scores):
            return [path for _ in texts]
        at, left = starts[order], lengths[order]
        active = np.searchsorted(-left, -np.arange(1, left[0] + 1), "right")  # texts with a word at step t
        best = scores[at[: active[0]]].copy()
        stay = np.arange(len(self.langs), dtype=back.dtype)
        for t in range(1, len(active)):
            n = active[t]
            best = best[:n]
            top = best.argmax(axis=1)
            moved = best[np.arange(n), top][:, None] - self.switch
            here = at[:n] + t
            back[here] = np.where(best >= moved, stay, top[:, None])
            best = np.maximum(best, moved) + scores[here]
            path[here] = best.argmax(axis=1)  # the last word's label, if the text ends here
        path[at[: active[0]]] = scores[at[: active[0]]].argmax(axis=1) * (left[: active[0]] == 1)
        for t in range(len(active) - 1, 0, -1):
            here = at[: active[t]] + t
            path[here - 1] = back[here, path[here]]
        return [path[s : s + n] for s, n in zip(starts, lengths, strict=True)]

    def _table_of(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        ids = self._ids(words)
        return self._table[ids]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, language) of each text's spans, in characters."""
        words = [words_of(t) for t in texts]
        out: list[list[tuple[int, int, str]]] = []
        for text, found, labels in zip(texts, words, self.label(words), strict=True):
            if not found:
                out.append([])
            elif (labels == labels[0]).all():
                out.append([(text.index(found[0]), text.rindex(found[-1]) + len(found[-1]), self.langs[labels[0]])])
            else:
                at = places(text)
                cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1), len(found)]
                out.append([(at[a][0], at[b - 1][1], self.langs[labels[a]]) for a, b in zip(cuts, cuts[1:], strict=False)])
        return out


def chosen_rows(df: DataFrame, keep: Column, most_docs: float, lang_col: str, id_col: str, text_col: str) -> DataFrame:
    """Labelled rows to train on: all, or about ``most_docs`` a language by a hash of the id."""
    rows = df.filter(keep & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    limits = {lang: int(min(1.0, most_docs / n) * (1 << 30)) for lang, n in counts.items()}
    if not limits:
        return rows.limit(0)
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col(lang_col)]
    return rows.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_col), F.lit(1 << 30)) < limit)


def train(df: DataFrame, keep: Column, most_docs: float = 3000, n_buckets: int = 1 << 15, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """A model from the rows of ``df`` for which ``keep`` holds and a language is given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for lang in sorted(k for k, found in words.items() if found):
                mine = list(words[lang].items())
                row = np.zeros(n_buckets + len(SCRIPTS))
                for a in range(0, len(mine), SOME_WORDS):
                    some = mine[a : a + SOME_WORDS]
                    times = np.array([n for _, n in some])
                    bucket, owner = gram_buckets([w for w, _ in some], n_buckets)
                    row += np.bincount(bucket, times[owner], len(row))
                    scripts = _SCRIPT_OF[np.searchsorted(_STARTS, [ord(w[0]) for w, _ in some], "right") - 1]
                    row[n_buckets:] += np.bincount(scripts, times, len(SCRIPTS))
                seen = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(seen), pa.array(row[seen].astype(np.int64))], names=["lang", "bucket", "n"])
            words.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, words.values())) > 500_000:
                yield from sums()
        yield from sums()

    rows = chosen_rows(df, keep, most_docs, lang_col, id_col, text_col).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sums = rows.mapInArrow(lean(count), "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    table = np.zeros((n_buckets + len(SCRIPTS), max(1, len(langs))))
    if langs:
        table[sums["bucket"].to_numpy(), np.searchsorted(langs, sums["lang"].to_numpy())] = sums["n"].to_numpy()
    grams, scripts = table[:n_buckets], table[n_buckets:]
    logp = np.log(grams + 0.5) - np.log(grams.sum(axis=0) + 0.5 * n_buckets)
    return LanguageModel(list(langs), logp.astype(np.float32), scripts > 0.001 * np.maximum(1, scripts.sum(axis=0)))


def label_spans(df: DataFrame, model: LanguageModel, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, slice_bytes: int = 6 << 20) -> DataFrame:
    """(id, lang_pred, score, spans) for every row of ``df``.

    spans holds (start, end, lang) in characters. lang_pred is the language whose spans hold most characters, and
    score their share of the characters of all spans. ``keep`` names columns to return in place of the id alone, for
    callers that go on with the rows.
    """
    keep = keep or [id_col]
    rows, inner, name, kinds = carried(df, keep, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in text_slices(batch, name, slice_bytes):
                langs, scores, spans = [], [], []
                texts = [t or "" for t in part.column(name).to_pylist()]
                for text, found in zip(texts, model.spans(texts) if model.langs else [[] for _ in texts], strict=True):
                    letters: Counter = Counter()
                    for a, b, lang in found:
                        letters[lang] += b - a
                    lang = min(letters, key=lambda k: (-letters[k], k), default=UND)
                    langs.append(lang)
                    scores.append(letters[lang] / letters.total() if letters else 0.0)
                    spans.append([{"start": a, "end": b, "lang": k} for a, b, k in found])
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([*map(part.column, inner), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)], names=[*keep, "lang_pred", "score", "spans"])

    return rows.mapInArrow(lean(predict), f"{kinds}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
