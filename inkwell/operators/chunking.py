"""Cutting texts into chunks of a fixed number of words, and checks of chunk tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicon import CHUNK_WORDS
from ..session import spread
from .ordered import with_previous


def chunked(df: DataFrame, id_col: str, text_col: str = "text", size: int = CHUNK_WORDS) -> DataFrame:
    """creation_id, chunk_index, text, n_words, word_start, word_end, sha256 of every chunk. The
    short last chunk stays; a text without words has none. No shuffle: rows are cut where they
    are read, in one Arrow pass (as expressions over arrays of words it takes several times as long)."""
    if size < 1:
        raise ValueError("a chunk has at least one word")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, index, texts, n, starts = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                w = t.split() if t else []
                for k, s in enumerate(range(0, len(w), size)):
                    part = w[s : s + size]
                    at.append(i)
                    index.append(k)
                    texts.append(" ".join(part))
                    n.append(len(part))
                    starts.append(s)
            ends = [s + x for s, x in zip(starts, n)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(texts, pa.string()), *(pa.array(x, pa.int32()) for x in (n, starts, ends))], ["creation_id", "chunk_index", "text", "n_words", "word_start", "word_end"])

    own = spread(df.select(F.col(id_col).alias("creation_id"), F.col(text_col).alias("_t")))
    out = own.mapInArrow(cut, f"creation_id {own.schema['creation_id'].dataType.simpleString()}, chunk_index int, text string, n_words int, word_start int, word_end int")
    return out.withColumn("sha256", F.sha2("text", 256))


def chunk_counts(df: DataFrame, id_col: str, text_col: str = "text", size: int = CHUNK_WORDS) -> DataFrame:
    """Words and expected chunks of every text, without cutting it."""
    n = tx.n_words(F.col(text_col))
    return df.select(F.col(id_col).alias("creation_id"), n.alias("n_words"), F.ceil(n / size).cast("bigint").alias("n_chunks"))


def tiling(chunks: DataFrame) -> DataFrame:
    """Every distinct chunk that doesn't start where the chunk before it ends, or whose range
    and text disagree. A creation of any number of chunks is looked at by many tasks; a row holds
    numbers only, as the text is measured first."""
    rows = chunks.select("creation_id", "chunk_index", "word_start", "word_end", tx.n_words(F.col("text")).alias("words")).distinct()
    rows = with_previous(rows.withColumn("_end", F.col("word_start") + F.col("words")), ("chunk_index", "word_start", "word_end", "words"), {"before_end": "_end"}, ("creation_id",))
    gap = F.coalesce(F.col("before_end") != F.col("word_start"), F.lit(False))
    bad_range = F.coalesce(F.col("word_end") - F.col("word_start") != F.col("words"), F.lit(True))
    return rows.select("creation_id", "chunk_index", gap.alias("gap"), bad_range.alias("bad_range")).where("gap OR bad_range")


def repaired(chunks: DataFrame) -> DataFrame:
    """Chunks once each, with n_words, word_end and sha256 as the text has them."""
    once = chunks.dropDuplicates(["creation_id", "chunk_index", "text"])
    n = tx.n_words(F.col("text")).cast("int")
    return once.withColumns({"n_words": n, "word_end": F.col("word_start") + n, "sha256": F.sha2("text", 256)})
