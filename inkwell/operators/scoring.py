"""From chunk distances to scores of creations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicon import MAX_FAILED_FRACTION
from ..session import spread
from .distance import measured, with_encodings


def chunk_deltas(rewrites: DataFrame, distance: str = "fwed", rules: Mapping | None = None) -> DataFrame:
    """run_index, creation_id, chunk_index, status, reason, delta, n_words, degenerate of every
    rewrite. A failed rewrite keeps delta 0.0 and is never averaged. Texts end here: only the
    encoded sequences reach the distance."""
    src = spread(rewrites.select("run_index", "creation_id", "chunk_index", "status", "reason", "original", F.when(F.col("status") == "ok", F.col("rewrite")).alias("rewrite"))).select("run_index", "creation_id", "chunk_index", "status", "reason", tx.n_words(F.col("original")).alias("n_words"), "original", tx.cleaned(F.col("rewrite"), (rules or {}).get("strip_code_fences", True), (rules or {}).get("strip_preamble", True)).alias("_r"))
    out = measured(with_encodings(src, "original", "_r"), distance)
    ok = F.col("status") == "ok"
    return out.select("run_index", "creation_id", "chunk_index", "status", "reason", F.when(ok, F.col("delta")).otherwise(0.0).alias("delta"), "n_words", (ok & F.col("degenerate")).alias("degenerate"))


#: Places that means are rounded to, so that they are the same whatever the order in which tasks' sums arrive.
PLACES = 12


def run_scores(deltas: DataFrame) -> DataFrame:
    """Scores by run and creation: means over chunks that are ok, null where none is. Partial sums
    are made before the shuffle, so a creation of any number of chunks is a row a task."""
    ok = F.col("status") == "ok"
    out = deltas.groupBy("run_index", "creation_id").agg(
        F.round(F.avg(F.when(ok, F.col("delta"))), PLACES).alias("mean_delta"), F.count(F.lit(1)).alias("n_total"), F.count_if(ok).alias("n_used"), F.count_if(~ok).alias("n_failed"), F.count_if(ok & F.col("degenerate")).alias("n_degenerate"),
        F.sum(F.when(ok, F.col("delta") * F.col("n_words"))).alias("_dw"), F.sum(F.when(ok, F.col("n_words"))).alias("_w"),
    )
    out = out.withColumn("length_weighted_mean", F.expr("_dw / nullif(_w, 0)")).drop("_dw", "_w")
    return out.withColumn("failed_fraction", F.coalesce(F.expr("n_failed / nullif(n_total, 0)"), F.lit(0.0)))


def creation_scores(runs: DataFrame, max_failed: float = MAX_FAILED_FRACTION) -> DataFrame:
    """Scores over runs: mean and sample deviation of the runs that were scored (no deviation
    for one), and whether a score is to be trusted."""
    out = runs.groupBy("creation_id").agg(
        F.round(F.avg("mean_delta"), PLACES).alias("score"), F.stddev_samp("mean_delta").alias("score_std"), F.count("mean_delta").alias("n_runs_scored"), F.count(F.lit(1)).alias("n_runs"), F.max("failed_fraction").alias("worst_failed"),
        F.avg("length_weighted_mean").alias("length_weighted_score"), F.max(F.struct(-F.col("run_index"), "n_total"))["n_total"].alias("n_chunks"),
        F.array_sort(F.collect_list(F.struct("run_index", "mean_delta"))).alias("per_run"),
    )
    few, many = F.col("n_runs_scored") < F.col("n_runs"), F.col("worst_failed") > max_failed
    none = F.col("n_runs_scored") == 0
    reason = F.when(none, "no chunk was scored in any run").otherwise(F.concat_ws("; ", F.when(few, F.concat(F.col("n_runs_scored").cast("string"), F.lit(" of "), F.col("n_runs").cast("string"), F.lit(" runs scored"))), F.when(many, F.lit("too many chunks failed"))))
    return out.withColumn("unreliable", none | few | many).withColumn("unreliable_reason", reason)


def unscorable_report(creations: DataFrame, scores: DataFrame) -> DataFrame:
    """Every creation with its score or, where it has none, why."""
    out = creations.select("creation_id").distinct().join(scores.select("creation_id", "score", "unreliable_reason"), "creation_id", "left")
    return out.withColumn("scorable", F.col("score").isNotNull()).withColumn("unreliable_reason", F.when(F.col("score").isNull(), F.coalesce("unreliable_reason", F.lit("no rewrite of it was made"))).otherwise(F.col("unreliable_reason")))


def scores_pivot(runs: DataFrame, n_runs: int) -> DataFrame:
    """creation_id, s_1 .. s_M."""
    wide = runs.groupBy("creation_id").pivot("run_index", list(range(1, n_runs + 1))).agg(F.first("mean_delta"))
    return wide.select("creation_id", *[F.col(str(i)).alias(f"s_{i}") for i in range(1, n_runs + 1)])
