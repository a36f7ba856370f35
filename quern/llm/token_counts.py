"""Token counts of whole texts under a public tokenizer.

Texts go through Arrow batches that are cut by bytes, and only lengths come back. Texts are split where no token can
cross, so a very long text is never one call of the tokenizer, and the length of a piece seen before is looked up.

Where a split is safe. A byte-level tokenizer with the usual pattern never joins a non-space character with a space
after it, so the place before white space that follows a non-space character ends a token whatever stands around it.
The four characters U+001C to U+001F are white space to Python but not to the tokenizer; texts with them are encoded
whole, and so are texts for tokenizers of any other kind.

Nulls and empty texts have no tokens. A null id is kept as it is, repeated rows are counted each, an empty table gives
an empty table, and other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import text_slices

_PIECE = re.compile(r"\s*\S+|\s+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def splits_at_spaces(path: str) -> bool:
    """True for byte-level tokenizers whose tokens cannot cross the place before white space."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = spec.get("added_tokens", [])
    strict = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
    return bool(plain and strict and spec.get("normalizer") is None)


def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to numbers of tokens, with the library that the file is for."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


class TokenCounter:
    """Counts tokens of texts, remembering up to ``most_pieces`` pieces of up to ``longest`` characters."""

    def __init__(self, path: str, batch_bytes: int = 1 << 20, most_pieces: int = 400_000, longest: int = 64):
        self.encode = encoder(path)
        self.split = splits_at_spaces(path)
        self.batch_bytes, self.most_pieces, self.longest = batch_bytes, most_pieces, longest
        self.known: dict[str, int] = {}

    def _encode_all(self, texts: list[str]) -> list[int]:
        """Lengths, by batches of about ``batch_bytes`` bytes."""
        out: list[int] = []
        start = size = 0
        for i, text in enumerate(texts):
            n = len(text.encode())
            if size and size + n > self.batch_bytes:
                out += self.encode(texts[start:i])
                start, size = i, 0
            size += n
        return out + self.encode(texts[start:]) if start < len(texts) else out

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.split:
            return self._encode_all(texts)
        cut = [[t] if _ODD_SPACE.search(t) else _PIECE.findall(t) for t in texts]
        known = self.known
        new = list({p: None for pieces in cut for p in pieces if p not in known})
        known.update(zip(new, self._encode_all(new), strict=True))
        counts = [sum(map(known.__getitem__, pieces)) for pieces in cut]
        for piece in new:
            if len(piece) > self.longest:
                del known[piece]
        if len(known) > self.most_pieces:
            known.clear()
        return counts


@lru_cache(maxsize=2)
def load(path: str) -> TokenCounter:
    """The counter of a file; a worker keeps it, with what it remembers, from task to task."""
    return TokenCounter(path)


def count_tokens(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", slice_bytes: int = 4 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of ``df``, whatever its other columns are.

    ``path`` names the tokenizer's file, which every machine has at that place.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            for part in text_slices(batch, "text", slice_bytes):
                texts = pc.fill_null(part.column("text"), "")
                sizes = pc.cast(pc.binary_length(texts), pa.int64())
                n = pa.array(counter(texts.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), sizes, n], names=[id_col, "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
