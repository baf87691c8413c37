"""Encoding of a corpus with a public tokenizer.

Texts go through the ``tokenizers`` library by Arrow batches. Byte-level pieces are
related to characters through the byte table (every byte has a printable stand-in):
``byte_offsets`` gives each token's place in the text in characters, ``decode``
reverses the table, joining characters whose bytes are split over tokens.

Defined results: a null and an empty text each give an empty list; strings that look
like special tokens are ordinary text; blank texts are encoded as they stand; equal
texts give equal ids; texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

TOKENIZER = os.environ.get("INKWELL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """The printable stand-in of each byte -> the byte. Printable bytes stand for
    themselves; the others, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def piece_bytes(path: str) -> list[bytes]:
    """The bytes of each id's piece."""
    table, t = byte_table(), load_tokenizer(path)
    vocab = t.get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode()
    return out


def decode(ids: Iterable[int] | None, path: str = TOKENIZER) -> str:
    """The text of ids. Bytes are joined before they are read as UTF-8, so characters that
    are split over tokens come back whole; bytes that are no character become U+FFFD."""
    known = piece_bytes(path)
    return b"".join(known[i] for i in ids or ()).decode("utf-8", "replace")


def byte_offsets(text: str, ids: Iterable[int], path: str = TOKENIZER) -> list[tuple[int, int]]:
    """Start and end of each token in characters; a token inside a character spans it."""
    known = piece_bytes(path)
    char_of = [i for i, c in enumerate(text) for _ in range(len(c.encode("utf-8", "surrogatepass")))]
    out, at = [], 0
    for i in ids:
        n = len(known[i])
        out.append((char_of[at], char_of[at + n - 1] + 1))
        at += n
    return out


# Fixed value: the pattern of byte-level pieces (contractions, words, numbers, marks, white space).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside blocks in which every Unicode version has the same letters, digits and blanks:
#: the library cuts texts that hold one, as its tables may be older than the pattern's.
_ODD = re.compile("[^\x00-\u0527\u1e00-\u206f\u20a0-\u20b9\u2190-\u21ff\u2500-\u27bf\ufb00-\ufb06\uff01-\uff5e]")
_CACHE_LIMIT = 500_000


class _Pieces(dict):
    """Piece -> its ids, by the library. The cache only saves time: it is emptied when it grows past its limit."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> list[int]:
        if len(self) > _CACHE_LIMIT:
            self.clear()
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def _known_pieces(path: str) -> _Pieces | None:
    """Where the tokenizer cuts by ``PIECES`` and changes no character before: nothing crosses a piece then,
    so that a text's ids are those of its pieces, one after the other. Else None."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    cut = own.get("pre_tokenizer") or {}
    plain = own.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    return _Pieces(load_tokenizer(path)) if plain else None


_CUT = regex.compile(PIECES)


def encode_batch(texts: list[str | None], path: str = TOKENIZER) -> list[list[int]]:
    """The ids of each text. Words come again and again, so each distinct piece goes through the
    library once and its ids are looked up from then on; whole texts go through it where they hold
    characters on which Unicode tables differ, or the tokenizer isn't of the byte-level kind."""
    t, known = load_tokenizer(path), _known_pieces(path)
    if known is None:
        return [e.ids for e in t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]
    look, cut, joined = known.__getitem__, _CUT.findall, chain.from_iterable
    out = [[] if not x else None if not x.isascii() and _ODD.search(x) else list(joined(map(look, cut(x)))) for x in texts]
    odd = [i for i, x in enumerate(out) if x is None]
    for i, e in zip(odd, t.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)):
        out[i] = e.ids
    return out


#: Characters that are given to the library at a time, so that a batch of long texts fits in memory.
CHARS_AT_A_TIME = 2_000_000


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    part: list[str | None] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= CHARS_AT_A_TIME or len(part) >= 1000:
            yield part
            part, size = [], 0
    if part:
        yield part


def encoded(documents: DataFrame, path: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids of every row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in _slices(b.column(1).to_pylist()):
                ids = pa.array(encode_batch(part, path), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), ids], ["id", "ids"])
                at += len(part)

    src = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(src).mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(documents: DataFrame, path: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens of every row; the ids stay in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: list[int] = []
            for part in _slices(b.column(1).to_pylist()):
                n += map(len, encode_batch(part, path))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], ["id", "n_tokens"])

    src = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(src).mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_tokens int").withColumnRenamed("id", id_col)


def decoded(encodings: DataFrame, path: str = TOKENIZER, id_col: str = "doc_id") -> DataFrame:
    """id, text of encoded rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(x, path) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    src = encodings.select(F.col(id_col).alias("id"), "ids")
    return spread(src).mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
