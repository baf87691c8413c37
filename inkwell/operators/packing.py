"""Token estimates and first-fit-decreasing bins for calls with a bounded context."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import CONTEXT_FRACTION, TOKENS_PER_WORD
from ..session import checkpointed
from .ordered import with_position


def estimated_tokens(n_words: Column, per_word: float = TOKENS_PER_WORD) -> Column:
    """Words times the tokens of a word, rounded down."""
    return F.floor(n_words.cast("double") * F.lit(per_word)).cast("bigint")


def context_budget(window: int, fraction: float = CONTEXT_FRACTION) -> int:
    return int(window * fraction)


#: Runs of bins that are looked at together.
_BLOCK = 256


def first_fit(histogram: Iterable[tuple[int, int]], room: int) -> list[tuple[int, int, int, int, int]]:
    """First-fit decreasing over a histogram of sizes: segments (size, first rank, count, first bin, items a bin):
    the item of rank r of a segment goes to bin ``first bin + (r - first rank) // items``.

    The same bins as when items are placed one by one, as each bin, in order, takes all it has room for
    before the next is looked at. Bins that are filled alike and stand side by side are one run, so that the
    work follows from the sizes, of which there are at most ``room``, and not from the bins: a size
    splits two runs at most. Runs stand in blocks with the most room of each, so that full ones are passed over.
    """
    blocks: list[list[list[int]]] = []  # runs (first bin, end, room left) in order
    most: list[int] = []
    made = 0
    out = []
    for size, count in sorted(histogram, reverse=True):
        rank = 0
        if size <= 0:  # takes no room: all in the first bin
            if count:
                out.append((size, 0, count, 0, count))
                if not made:
                    blocks, most, made = [[[0, 1, room]]], [room], 1
            continue
        for i, block in enumerate(blocks):
            if rank == count:
                break
            if most[i] < size:
                continue
            kept = []
            for first, end, left in block:
                if left < size or rank == count:
                    kept.append([first, end, left])
                    continue
                each = left // size
                full = min((count - rank) // each, end - first)
                if full:
                    out.append((size, rank, full * each, first, each))
                    rank += full * each
                    kept.append([first, first + full, left - each * size])
                    first += full
                if first < end and rank < count:  # fewer than ``each`` are left
                    out.append((size, rank, count - rank, first, each))
                    kept.append([first, first + 1, left - (count - rank) * size])
                    first, rank = first + 1, count
                if first < end:
                    kept.append([first, end, left])
            blocks[i] = kept
            most[i] = max(r[2] for r in kept)
        if rank < count:
            each = max(1, room // size)
            full, over = divmod(count - rank, each)
            out.append((size, rank, count - rank, made, each))
            own = [[made, made + full, room - each * size]] if full else []
            made += full
            if over:
                own.append([made, made + 1, room - over * size])
                made += 1
            blocks.append(own)
            most.append(max(r[2] for r in own))
        if len(blocks) > 2 * _BLOCK or any(len(b) > 2 * _BLOCK for b in blocks):
            runs = [r for b in blocks for r in b]
            blocks = [runs[k : k + _BLOCK] for k in range(0, len(runs), _BLOCK)]
            most = [max(r[2] for r in b) for b in blocks]
    return out


def bins_needed(segments: Iterable[tuple[int, int, int, int, int]]) -> int:
    """How many bins the segments of ``first_fit`` take."""
    return max((first + -(-count // each) for _, _, count, first, each in segments), default=0)


def calls_by_budget(sizes: DataFrame, budgets: DataFrame, size_col: str = "tokens") -> DataFrame:
    """``budgets`` (a few rows with a column budget) with n_bins, n_calls (one more where several are merged) and
    fits: the calls that the collection takes within each budget, by first fit over its sizes. No bins
    where a creation is larger than the budget."""
    counted = [(r[size_col], r["count"]) for r in sizes.groupBy(size_col).count().collect()]  # at most a row a size
    largest = max((s for s, _ in counted), default=0)
    needed = {b: bins_needed(first_fit(counted, b)) if 0 < b and largest <= b else None for b in {r["budget"] for r in budgets.select("budget").distinct().collect()}}
    known = budgets.sparkSession.createDataFrame(sorted(needed.items()) or [(0, None)], "budget bigint, n_bins bigint")
    out = budgets.join(F.broadcast(known), "budget")  # a row a budget
    return out.withColumns({"n_calls": F.col("n_bins") + (F.col("n_bins") > 1).cast("int"), "fits": F.col("n_bins").isNotNull()})


def packed_bins(sizes: DataFrame, budget: int, overhead: int = 0, id_col: str = "creation_id", size_col: str = "tokens") -> DataFrame:
    """id, tokens, bin_index of every creation: largest first, ties by id, first bin with room.

    The plan is made over sizes, of which there are at most ``budget``; creations are numbered
    within their size in the order of ids and joined to it. A creation that is larger than the
    room stops the job with its name.
    """
    room = budget - overhead
    if budget <= 0 or room <= 0:
        raise ValueError("the budget must leave room beside the overhead")
    items = checkpointed(sizes.select(id_col, size_col))
    largest = items.where(F.col(size_col) > room).orderBy(F.desc(size_col), id_col).limit(10).collect()
    if largest:
        raise ValueError("larger than the budget: " + ", ".join(f"{r[id_col]} ({r[size_col]})" for r in largest))
    histogram = [(r[size_col], r["count"]) for r in items.groupBy(size_col).count().collect()]
    plan = items.sparkSession.createDataFrame(first_fit(histogram, room) or [(0, 0, 0, 0, 1)], "_size bigint, _first bigint, _count bigint, _bin bigint, _each bigint")
    ranked = with_position(items, F.col(id_col), by=(size_col,))
    rank = F.col("pos") - 1
    # segments follow from the sizes, of which there are at most ``budget``, not from the number of creations or bins
    out = ranked.join(plan, (F.col(size_col) == F.col("_size")) & (rank >= F.col("_first")) & (rank < F.col("_first") + F.col("_count")))
    return out.select(id_col, size_col, (F.col("_bin") + F.floor((rank - F.col("_first")) / F.col("_each"))).cast("int").alias("bin_index"))


def bin_summary(bins: DataFrame, size_col: str = "tokens") -> DataFrame:
    return bins.groupBy("bin_index").agg(F.count(F.lit(1)).alias("n_creations"), F.sum(size_col).alias("tokens"))
