"""Splitting oversized items at natural boundaries.

Recursive bisection: an item of more than ``limit - overlap`` words is cut at the
strongest boundary (paragraph, line, sentence) near its midpoint, else in a wider
reach, at last anywhere in it, and between any two words only if it has no boundary;
parts that still exceed it are cut again, and then every piece after the first
gets the last ``overlap`` words of the words before it.

A word is a run of characters that are not Unicode white space. A piece's text is
the stretch of the item's text from its first to its last word, as it stands.

Defined results: null, empty and blank texts, and texts of at most ``limit`` words,
have no pieces; rows that stand twice give their pieces once; a null ``word_start``
counts as 0; null keys stay null; a text without boundaries is cut at words.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

LIMIT, OVERLAP = 120, 12
_WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SENTENCE_END = re.compile("[.!?;\u2026\u3002\uff0e\uff01\uff1f][\"'\u2019\u201d\u00bb)*_\\]]*\\Z")
_PARAGRAPH = re.compile("(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])[^\\S\n\r\x0b\x0c\x85\u2028\u2029]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])|\u2029")
_LINE = re.compile("[\n\r\x0b\x0c\x85\u2028\u2029]")


def boundaries(text: str, at: list[tuple[int, int]]) -> tuple[list[int], list[int], list[int]]:
    """Where paragraphs, lines and sentences end: numbers of words before each such cut."""
    paragraphs, lines, sentences = [], [], []
    for i in range(1, len(at)):
        gap = text[at[i - 1][1] : at[i][0]].replace("\r\n", "\n")
        if gap != " " and _PARAGRAPH.search(gap):
            paragraphs.append(i)
        elif gap != " " and _LINE.search(gap):
            lines.append(i)
        elif _SENTENCE_END.search(text[max(at[i - 1][0], at[i - 1][1] - 8) : at[i - 1][1]]):
            sentences.append(i)
    return paragraphs, lines, sentences


def bisected(n: int, most: int, ranked: tuple[list[int], ...]) -> list[int]:
    """Ascending ends of the bodies of n words, each of at most ``most`` words."""
    ends: list[int] = []
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if b - a <= most:
            ends.append(b)
            continue
        reach = max(1, min((b - a) // 4, most // 2)) if b - a > 2 * most else max(1, min(most - (b - a + 1) // 2, (b - a) // 3))
        mid = (a + b) / 2
        cut = (a + b) // 2
        for r in (reach, max(reach, (b - a) // 4), b - a):
            low, high = max(a + 1, int(mid - r)), min(b - 1, int(mid + r))
            spans = [(kind, bisect_left(kind, low), bisect_right(kind, high)) for kind in ranked]
            kind, i, j = next((x for x in spans if x[1] < x[2]), ((), 0, 0))
            if i < j:
                k = bisect_left(kind, mid, i, j)
                cut = min((kind[x] for x in (k - 1, k) if i <= x < j), key=lambda c: (abs(c - mid), c))
                break
        stack.append((cut, b))
        stack.append((a, cut))
    return ends


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, int, int]]:
    """(text, first word, end word) of each piece; empty if the text is within the limit."""
    if not text:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    if len(at) <= limit:
        return []
    out, start = [], 0
    for end in bisected(len(at), limit - overlap, boundaries(text, at)):
        first = max(0, start - overlap)
        out.append((text[at[first][0] : at[end - 1][1]], first, end))
        start = end
    return out


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every chunk of more than ``limit`` words: creation_id, chunk_index,
    piece_index, text, n_words, word_start, word_end, sha256. The scan does all the work;
    what is shuffled is pieces only, to fold rows that stand twice."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    fields = pa.schema([("creation_id", pa.string()), ("chunk_index", pa.int32()), ("piece_index", pa.int32()), ("text", pa.string()), ("n_words", pa.int32()), ("word_start", pa.int32()), ("word_end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c, i, t, s in zip(*(b.column(k).to_pylist() for k in range(4))):
                rows += [(c, i, k, x, end - first, s + first, s + end) for k, (x, first, end) in enumerate(pieces(t, limit, overlap))]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows), fields)], schema=fields) if rows else pa.RecordBatch.from_pylist([], schema=fields)

    src = chunks.select(F.col("creation_id").cast("string"), F.col("chunk_index").cast("int"), F.col("text").cast("string"), F.coalesce(F.col("word_start").cast("int"), F.lit(0)).alias("word_start"))
    # a row of over `limit` words has at least 2 * limit + 1 characters
    src = src.where(F.length("text") > 2 * limit)
    out = spread(src).mapInArrow(run, "creation_id string, chunk_index int, piece_index int, text string, n_words int, word_start int, word_end int")
    return out.distinct().withColumn("sha256", F.sha2("text", 256))
