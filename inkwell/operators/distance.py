"""Distances between an original and its rewrite, over their function words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicon import FUNCTION_WORDS

Distance = Callable[[Column, Column], Column]
_REGISTRY: dict[str, Distance] = {}


def register(name: str, distance: Distance) -> None:
    """Make a distance known by name. A name is given once."""
    if name in _REGISTRY:
        raise ValueError(f"a distance named {name!r} is registered already")
    _REGISTRY[name] = distance


def available() -> list[str]:
    return sorted(_REGISTRY)


def build_distance(name: str) -> Distance:
    if name not in _REGISTRY:
        raise ValueError(f"no distance named {name!r}; there are {', '.join(available())}")
    return _REGISTRY[name]


def edit_distance(a: Column, b: Column) -> Column:
    """Edits between two encoded sequences over the longer length; 0 where both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longer)


def _counts(a: Column, b: Column) -> Column:
    """How often each function word of either encoded sequence stands in both: pairs (p, q)."""

    def count(c: Column, ch: Column) -> Column:
        return (F.length(c) - F.length(F.replace(c, ch, F.lit("")))).cast("double")

    chars = F.filter(F.array_distinct(F.split(F.concat(a, b), "")), lambda ch: ch != "")
    return F.transform(chars, lambda ch: F.struct(count(a, ch).alias("p"), count(b, ch).alias("q")))


def _where_not_empty(a: Column, b: Column, d: Column) -> Column:
    """0 where both sequences are empty, 1 where one is."""
    return F.when((F.length(a) == 0) & (F.length(b) == 0), 0.0).when((F.length(a) == 0) | (F.length(b) == 0), 1.0).otherwise(d)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine of the two frequency vectors."""
    zero = F.struct(F.lit(0.0).alias("pq"), F.lit(0.0).alias("pp"), F.lit(0.0).alias("qq"))
    step = lambda s, c: F.struct((s["pq"] + c["p"] * c["q"]).alias("pq"), (s["pp"] + c["p"] * c["p"]).alias("pp"), (s["qq"] + c["q"] * c["q"]).alias("qq"))
    return _where_not_empty(a, b, F.aggregate(_counts(a, b), zero, step, lambda s: F.greatest(F.lit(0.0), 1 - s["pq"] / F.sqrt(s["pp"] * s["qq"]))))


def manhattan_distance(a: Column, b: Column) -> Column:
    """Half the sum of differences between the two relative frequency vectors."""
    total = F.aggregate(_counts(a, b), F.lit(0.0), lambda s, c: s + F.abs(c["p"] / F.length(a) - c["q"] / F.length(b)))
    return _where_not_empty(a, b, F.least(F.lit(1.0), total / 2))


register("fwed", edit_distance)
register("fw_freq_cosine", cosine_distance)
register("fw_freq_manhattan", manhattan_distance)


def with_encodings(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with fw_a and fw_b, the encoded function words, in place of the two texts."""
    return pairs.withColumns({"fw_a": tx.encoded(F.col(left)), "fw_b": tx.encoded(F.col(right))}).drop(left, right)


def measured(encoded_pairs: DataFrame, name: str = "fwed") -> DataFrame:
    """``encoded_pairs`` with n_a, n_b, delta and degenerate. A value outside [0, 1] stops the job."""
    d = build_distance(name)(F.col("fw_a"), F.col("fw_b"))
    out = encoded_pairs.withColumns({"n_a": F.length("fw_a").cast("bigint"), "n_b": F.length("fw_b").cast("bigint"), "delta": d})
    guard = F.when((F.col("delta") < 0) | (F.col("delta") > 1), F.raise_error(F.lit("a distance lies outside 0 to 1"))).otherwise(F.col("delta"))
    return out.withColumn("delta", guard).withColumn("degenerate", (F.col("n_a") == 0) & (F.col("n_b") == 0))


def edit_operations(a: str, b: str) -> list[tuple[str, int, str | None, str | None]]:
    """The edits that turn an encoded sequence into another: (op, at, from, to), in order.
    Among equally short scripts: matches first, then replacements, deletions, insertions."""
    n, m = len(a), len(b)
    # left[i][j]: edits between what is left of both sequences from i and j on; a row at a time, an
    # insertion's cost being a running minimum along the row
    left = np.empty((n + 1, m + 1), np.int32)
    at = np.arange(m + 1, dtype=np.int32)
    left[n] = m - at
    codes = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    for i in range(n - 1, -1, -1):
        row = left[i + 1] + 1
        row[:m] = np.minimum(row[:m], left[i + 1, 1:] + (codes != ord(a[i])))
        left[i] = np.minimum.accumulate((row + at)[::-1])[::-1] - at
    word = lambda ch: FUNCTION_WORDS[ord(ch) - 1]
    out, i, j = [], 0, 0
    while i < n or j < m:
        here = left[i][j]
        if i < n and j < m and a[i] == b[j] and here == left[i + 1][j + 1]:
            i, j = i + 1, j + 1
        elif i < n and j < m and here == left[i + 1][j + 1] + 1:
            out.append(("replace", i, word(a[i]), word(b[j])))
            i, j = i + 1, j + 1
        elif i < n and here == left[i + 1][j] + 1:
            out.append(("delete", i, word(a[i]), None))
            i += 1
        else:
            out.append(("insert", i, None, word(b[j])))
            j += 1
    return out


def edit_scripts(encoded_pairs: DataFrame, *keys: str) -> DataFrame:
    """One row for every edit: keys, step, op, at, from_word, to_word."""
    src = encoded_pairs.select(*keys, "fw_a", "fw_b")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*row[:-2], s, *e) for row in b.itertuples(index=False, name=None) for s, e in enumerate(edit_operations(row[-2], row[-1]))]
            yield pd.DataFrame(rows, columns=[*keys, "step", "op", "at", "from_word", "to_word"])

    return src.mapInPandas(run, f"{schema}, step int, op string, at int, from_word string, to_word string")
