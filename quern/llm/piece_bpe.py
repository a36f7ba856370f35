"""SentencePiece encoding of the merge type by backtracking, and decoding.

The merge procedure joins, again and again, the adjacent pair whose joined piece scores best, leftmost first. Its
result is found here without playing all merges over a text:

* An Aho-Corasick automaton gives the longest piece that starts at a position; each piece knows the next shorter one
  that begins it.
* A candidate may follow the token before it only if merging just the two tokens' characters again gives back those
  two tokens. Answers are remembered by pair.
* Where no candidate fits, the position is marked in a bitfield of failed positions, the last token is taken back
  and the next shorter one tried. A failed position is never entered twice.

The space mark only begins pieces (it is checked when the model is loaded), so no piece crosses the place before a
space mark that follows another character: words are encoded one by one and remembered. Characters without a piece
are written as bytes, and nothing merges across them. Pieces that tie in score (runs of space marks among them) have
no order to check pairs by, so a stretch that holds a tied piece is merged as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import kept, lean, text_slices

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")


class PieceModel:
    """A merge-type model with byte fallback and an added leading space, read from a SentencePiece file."""

    def __init__(self, path: str, most_words: int = 200_000, most_pairs: int = 500_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.unknown = model.unk_id()
        self.silent = {i for i in range(size) if model.is_control(i)}
        # ids that say the same anywhere, and those that need their neighbours: bytes of longer characters, and unknowns
        self.said = ["" if i in self.silent else chr(self.byte_of[i]) if i in self.byte_of else p for i, p in enumerate(self.pieces)]
        self.joint = {i for i, b in self.byte_of.items() if b > 127} | {self.unknown}
        special = self.silent | self.byte_of.keys() | {self.unknown}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece crosses the place before a space mark; words cannot be encoded one by one")
        seen: dict[float, str] = {}
        self.tied: set[str] = set()
        for p, s in self.score.items():
            if len(p) > 1 and s in seen:
                self.tied |= {p, seen[s]}
            elif len(p) > 1:
                seen[s] = p
        self.known_chars = {p for p in self.ids if len(p) == 1}
        self.tied_cores = [p for p in self.tied if not any(q in p for q in self.tied if q != p)]
        automaton = ahocorasick.Automaton()
        self.lengths = [len(p) for p in self.pieces]
        self.shorter = [-1] * size  # the longest piece that begins a piece and is not it
        #: The longest piece that begins each string that begins a piece.
        self.begins: dict[str, int] = {}
        whole = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [p]}
        for p, i in whole.items():
            automaton.add_word(p, i)
            best = -1
            for k in range(1, len(p)):
                best = self.begins[p[:k]] = whole.get(p[:k], best)
            self.begins[p], self.shorter[i] = i, best
        automaton.make_automaton()
        self.automaton = automaton
        self.longest = max(map(len, whole), default=1)
        self.most_words, self.most_pairs = most_words, most_pairs
        # words of late, and those of the time before, so that frequent ones are not forgotten with the rest
        self._words: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """The merge procedure itself, for short stretches: best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: int, right: int) -> bool:
        key = left * len(self.pieces) + right
        known = self._pairs.get(key)
        if known is None:
            a, b = self.pieces[left], self.pieces[right]
            if len(self._pairs) >= self.most_pairs:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(a + b) == [a, b]
        return known

    def _stretch(self, text: str) -> list[int]:
        """Ids of a stretch of characters that all have pieces of their own."""
        for core in self.tied_cores:
            if core in text:
                return [self.ids[p] for p in self._merge_long(text)]
        begins, longest, match, shorter, lengths = self.begins, self.longest, self.automaton.longest_prefix, self.shorter, self.lengths
        pairs, size, last = self._pairs, len(self.pieces), len(text)
        failed, pos, before, tokens = 0, 0, -1, []
        while pos < last:
            rest = text[pos : pos + longest]
            piece = begins[rest[: match(rest)]]
            while True:
                while piece >= 0:
                    if not failed >> (pos + lengths[piece]) & 1:
                        if before < 0 or pairs.get(before * size + piece):
                            break
                        if before * size + piece not in pairs and self._fits(before, piece):
                            break
                    piece = shorter[piece]
                if piece >= 0:
                    break
                failed |= 1 << pos
                taken = tokens.pop()
                pos -= lengths[taken]
                before = tokens[-1] if tokens else -1
                piece = shorter[taken]
            tokens.append(piece)
            pos += lengths[piece]
            before = piece
        return tokens

    def _merge_long(self, text: str) -> list[str]:
        """The merge procedure with a queue, in n log n steps."""
        import heapq

        n, score = len(text), self.score
        parts, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, str, str]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (s := score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-s, i, parts[i], parts[j]))

        for i in range(n - 1):
            push(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [p for p in parts if p]

    def _word(self, word: str) -> tuple[int, ...]:
        known = self.known_chars
        if known.issuperset(word):
            return tuple(self._stretch(word))
        out: list[int] = []
        start = 0
        for k, c in enumerate(word):
            if c not in known:
                out += self._stretch(word[start:k])
                out += [self.byte_id[b] for b in c.encode()]
                start = k + 1
        return tuple(out + self._stretch(word[start:]))

    def encode(self, text: str) -> list[int]:
        """Ids of a text, as the library gives them without begin, end or sampling."""
        if not text:
            return []
        found = _WORDS.findall(MARK + text.replace(" ", MARK))
        words, older = self._words, self._older
        new = set(found).difference(words)
        for word in new:
            words[word] = older.get(word) or self._word(word)
        out = list(chain.from_iterable(map(words.__getitem__, found)))
        if new:
            for word in new:
                if len(word) > 48:
                    del words[word]
            if len(words) > self.most_words:
                self._words, self._older = {}, words
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of any list of ids: control ids vanish, bytes join into characters, one leading space goes."""
        pieces, byte_of = self.pieces, self.byte_of
        if self.joint.isdisjoint(ids):
            return self._unmarked("".join(map(self.said.__getitem__, ids)), ids)
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in byte_of:
                raw.append(byte_of[i])
                continue
            if raw:
                out.append(characters(bytes(raw)))
                raw.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(pieces[i])
        if raw:
            out.append(characters(bytes(raw)))
        return self._unmarked("".join(out), ids)

    def _unmarked(self, text: str, ids: list[int]) -> str:
        pieces, byte_of = self.pieces, self.byte_of
        first = next((i for i in ids if i not in self.silent), None)
        led = first is not None and first not in byte_of and pieces[first].startswith(MARK)
        return (text[1:] if led else text).replace(MARK, " ")


def load(path: str) -> PieceModel:
    """The model of a file; a worker keeps it, with what it remembers, from task to task until another operator runs."""
    return kept(PieceModel, path)


def characters(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that is no part of a character."""
    out, k = [], 0
    while k < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[k : k + n].decode())
                k += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


def encode_pieces(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", slice_bytes: int = 2 << 20) -> DataFrame:
    """(id, ids, decoded) for every row: the ids of its whole text, and the text that these ids decode to.

    Nulls and empty texts have no ids and decode to an empty text. Null ids, repeated rows and empty tables pass
    through; other columns are not read. ``path`` names the model's file, which every machine has at that place.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in text_slices(batch, "text", slice_bytes):
                ids = [model.encode(t) for t in pc.fill_null(part.column("text"), "").to_pylist()]
                columns = [part.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(i) for i in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(encode, keeps=True), f"`{id_col}` {kind}, ids array<int>, decoded string")
