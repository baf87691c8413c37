"""Tables that a run is read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import CHUNK_WORDS
from .ordered import with_position


def scores_table(pivot: DataFrame, scores: DataFrame, labels: DataFrame, titles: DataFrame) -> DataFrame:
    """One row a creation, unscorable ones too: title, counts, mean and deviation, s_1.., label."""
    out = scores.select("creation_id", "n_chunks", "score", "score_std", "unreliable", "unreliable_reason", "length_weighted_score").join(pivot, "creation_id", "left")
    out = out.join(labels.select("creation_id", "label", "borderline"), "creation_id", "left").join(titles.select("creation_id", "title").dropDuplicates(["creation_id"]), "creation_id", "left")
    return out.withColumns({"label": F.coalesce("label", F.lit("")), "borderline": F.coalesce("borderline", F.lit(False)), "title": F.coalesce("title", F.lit(""))})


def with_titles(df: DataFrame, sources: DataFrame) -> DataFrame:
    """``df`` with the title first declared for its creation, '' where none is."""
    first = sources.groupBy(F.col("id").alias("creation_id")).agg(F.min_by("title", "decl_order").alias("title"))
    return df.join(first, "creation_id", "left").withColumn("title", F.coalesce("title", F.lit("")))


def deltas_table(deltas: DataFrame) -> DataFrame:
    """The rows of a run's delta file: six places, blank for failures, which say why."""
    ok = F.col("status") == "ok"
    return deltas.select(
        "run_index", "creation_id", "chunk_index", F.when(ok, F.format_string("%.6f", F.col("delta"))).otherwise("").alias("delta"), "n_words",
        F.when(ok, "ok").otherwise(F.concat(F.lit("failed:"), F.coalesce("reason", F.lit("unknown")))).alias("status"), "degenerate",
    )


def noise_diagnostics(runs: DataFrame, noise: DataFrame, tau: DataFrame) -> DataFrame:
    """run_index, creation_id, score, above_tau of each run's noise text (null where unscored)."""
    own = noise.join(runs.select("run_index", "creation_id", F.col("mean_delta").alias("score")), ["run_index", "creation_id"], "left")
    return own.crossJoin(F.broadcast(tau.select("tau"))).select("run_index", "creation_id", "score", F.when(F.col("score").isNotNull(), (F.col("score") > F.col("tau")).cast("int")).alias("above_tau"))


def suspicious(labels: DataFrame, k: int | None = None) -> DataFrame:
    """Suspicious creations, the highest score first; the first k where k is given."""
    out = labels.where("label = 'suspicious'").select("creation_id", "score").orderBy(F.desc("score"), "creation_id")
    return out if k is None else out.limit(k)


def _cell(c: Column, kind: str) -> Column:
    if kind in ("double", "float"):
        return F.when(c.isNull() | F.isnan(c), "").otherwise(F.format_string("%.4f", c))
    return F.coalesce(c.cast("string"), F.lit(""))


def markdown_rows(df: DataFrame) -> DataFrame:
    """Every row as a line of a Markdown table; missing values blank, numbers with four places."""
    cells = [_cell(F.col(c), kind) for c, kind in df.dtypes]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def histogram(scores: DataFrame, bins: int = 20) -> DataFrame:
    """bin, low, high, n of equal bins over the scores' range; the last takes its upper edge."""
    s = scores.where("score IS NOT NULL").select("score")
    e = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("lo")) / width))).otherwise(0).cast("int")
    counts = s.crossJoin(F.broadcast(e)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = s.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").na.fill({"n": 0}).crossJoin(F.broadcast(e))
    return grid.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def run_spread(runs: DataFrame) -> DataFrame:
    """creation_id, low, high, spread over runs."""
    out = runs.where("mean_delta IS NOT NULL").groupBy("creation_id").agg(F.min("mean_delta").alias("low"), F.max("mean_delta").alias("high"))
    return out.withColumn("spread", F.col("high") - F.col("low"))


def sorted_scatter(scores: DataFrame) -> DataFrame:
    """Scores with their rank (ties by id), for a plot of sorted scores."""
    s = scores.where("score IS NOT NULL").select("creation_id", F.col("score").cast("double").alias("score"))
    return with_position(s, F.col("score"), F.col("creation_id")).withColumnRenamed("pos", "rank")


def run_counts(scores: DataFrame, rewrites: DataFrame) -> DataFrame:
    """One row: what a run's manifest counts."""
    s = scores.agg(F.count("score").alias("n_scored"), F.count_if("unreliable").alias("n_unreliable"))
    return s.crossJoin(rewrites.agg(F.count(F.lit(1)).alias("n_rewrites"), F.count_if(F.col("status") != "ok").alias("n_failed"), F.count_if(F.col("attempts") > 1).alias("n_retried")))


def model_comparison(calls: DataFrame) -> DataFrame:
    """Lines, sound lines, latency and tokens by model. The median is exact; latencies are counted
    by value first, so a model of any number of calls is one sketch-free aggregate."""
    ok = F.col("status") == "ok"
    by = ["provider", "model_id"]
    counted = calls.where("tag <> 'profile'").groupBy(*by, "latency_ms").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.sum(F.when(ok, F.col("output_tokens"))).alias("ook"))
    return counted.groupBy(*by).agg(
        F.sum("n").alias("n_chunks"), F.sum("ok").alias("n_ok"), F.expr("CAST(percentile(latency_ms, 0.5, n) AS BIGINT)").alias("median_latency_ms"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"),
        (F.sum("ook") / F.expr("nullif(sum(ok), 0)")).alias("mean_output_tokens"),
    )


def delta_comparison(deltas: DataFrame, by: str) -> DataFrame:
    """Mean and sample deviation (0 for under two) of the deltas of sound chunks by group."""
    ok = F.col("status") == "ok"
    d = F.when(ok, F.col("delta"))
    return deltas.groupBy(by).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(ok).alias("n_ok"), F.coalesce(F.avg(d), F.lit(0.0)).alias("mean_delta"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd_delta"))


def side_by_side(rewrites: DataFrame) -> DataFrame:
    """The attempts at each chunk, by run, in one row: at most as many as there are runs."""
    one = F.concat(F.col("x.run_index").cast("string"), F.lit(":"), F.col("x.status"))
    rows = rewrites.select("creation_id", "chunk_index", F.struct("run_index", "rewrite_id", "status").alias("x"))
    return rows.groupBy("creation_id", "chunk_index").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("x.run_index").alias("r"), F.col("x.rewrite_id").alias("i"), one.alias("s")))), lambda e: e["s"]), " ").alias("attempts"))


def passages_side_by_side(rows: DataFrame) -> DataFrame:
    """A Markdown text for each sampled chunk of a comparison: its passage, then every model's version of it
    with its delta and verdict. One row a chunk, so as many versions as there are models."""
    verdict = F.when(F.col("status") == "ok", "ok").otherwise(F.concat(F.lit("rejected: "), F.coalesce("reason", F.lit("unknown"))))
    part = F.concat(F.lit("## "), F.col("model"), F.lit(", delta "), F.format_string("%.4f", F.coalesce("delta", F.lit(0.0))), F.lit(", "), verdict, F.lit("\n\n"), F.coalesce("rewrite", F.lit("(no text)")), F.lit("\n"))
    own = rows.select("creation_id", "chunk_index", "original", F.struct("model", part.alias("part")).alias("x"))
    text = F.concat(F.lit("# "), F.col("creation_id"), F.lit(" "), F.col("chunk_index").cast("string"), F.lit("\n\n"), F.first("original"), F.lit("\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda e: e["part"]), "\n"))
    return own.groupBy("creation_id", "chunk_index").agg(text.alias("value")).select("value")


def dry_run_plan(creations: DataFrame, noise: DataFrame, n_runs: int, bins: int, size: int = CHUNK_WORDS, tokens_per_word: float = 1.35) -> DataFrame:
    """One row: the calls and input tokens a run would take. creations and noise: creation_id,
    n_words (noise: of each run's text). ``bins``: profile calls of a run before the merge."""
    c = creations.agg(F.count(F.lit(1)).alias("n_creations"), F.sum(F.ceil(F.col("n_words") / size)).alias("n_chunks"), F.sum(F.floor(F.col("n_words") * tokens_per_word)).alias("tokens"))
    n = noise.agg(F.coalesce(F.sum(F.ceil(F.col("n_words") / size)), F.lit(0)).alias("noise_chunks"), F.coalesce(F.sum(F.floor(F.col("n_words") * tokens_per_word)), F.lit(0)).alias("noise_tokens"))
    profile = n_runs * (bins + (1 if bins > 1 else 0))
    return c.crossJoin(n).select(
        "n_creations", "n_chunks", F.lit(n_runs).alias("n_runs"), F.lit(profile).cast("bigint").alias("profile_calls"), (F.col("n_chunks") * n_runs + F.col("noise_chunks")).alias("rewrite_calls"),
        (F.col("tokens") * 2 * n_runs + F.col("noise_tokens") * 2).alias("input_tokens"),
    )
