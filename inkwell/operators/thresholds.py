"""One-dimensional thresholds between typical and atypical scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import AGREEMENT_TOLERANCE, BORDERLINE_BAND, MIN_GAP_RATIO, MIN_SEPARABILITY
from .ordered import with_position


#: Variances that differ by less than this share are equal.
TIE = 1e-10
#: Gaps between means of less than this share of the largest score are rounding.
NOISE = 1e-12


def scorable(scores: DataFrame) -> DataFrame:
    return scores.where("score IS NOT NULL").select("creation_id", F.col("score").cast("double").alias("score"))


def otsu_candidates(scores: DataFrame) -> DataFrame:
    """k, lower, upper, variance of every split of the sorted scores (ties by id). Running sums
    are made over range-partitioned rows, so the number of creations isn't bounded by a task."""
    rows = with_position(scorable(scores), F.col("score"), F.col("creation_id"), sums=("score",))
    total = rows.agg(F.max("pos").alias("n"), F.sum("score").alias("total"))
    nxt = rows.select((F.col("pos") - 1).alias("pos"), F.col("score").alias("upper"))
    out = rows.join(nxt, "pos").crossJoin(F.broadcast(total))  # one row
    k, n = F.col("pos"), F.col("n")
    gap = F.col("sum_score") / k - (F.col("total") - F.col("sum_score")) / (n - k)
    return out.select(k.alias("k"), F.col("score").alias("lower"), "upper", ((k / n) * (1 - k / n) * gap * gap).alias("variance"))


def otsu_exact(scores: DataFrame) -> DataFrame:
    """One row: n, k, tau, variance, lower, upper, gap, total_variance, separability. The first
    of equal maxima wins. Fewer than two scores stop the job."""
    s = scorable(scores).agg(F.count(F.lit(1)).alias("n"), F.var_pop("score").alias("total_variance"), F.stddev_pop("score").alias("spread"))
    splits = otsu_candidates(scores)
    # equal but for the noise of sums, whatever the spread of the scores
    most = splits.agg(F.max("variance").alias("_most"), F.pow(F.max(F.abs("upper")) * NOISE, 2).alias("_noise"))
    best = splits.crossJoin(F.broadcast(most)).where(F.col("variance") >= F.col("_most") * (1 - TIE) - F.col("_noise")).orderBy("k").limit(1)
    out = s.crossJoin(best.groupBy().agg(*[F.first(c).alias(c) for c in ("k", "lower", "upper", "variance")]))
    out = out.withColumn("tau", F.when(F.col("n") < 2, F.raise_error(F.lit("a threshold needs at least two scores"))).otherwise((F.col("lower") + F.col("upper")) / 2))
    out = out.withColumn("gap", F.col("upper") - F.col("lower")).withColumn("separability", F.when(F.col("total_variance") > 0, F.col("variance") / F.col("total_variance")).otherwise(0.0))
    return out.withColumn("gap_ratio", F.when(F.col("spread") > 0, F.col("gap") / F.col("spread")).otherwise(0.0))


def otsu_binned(scores: DataFrame, bins: int = 256) -> DataFrame:
    """One row: tau, the centre of the last of ``bins`` equal bins below the best split. Sums run
    over bins, of which there are ``bins``. Scores that are all equal stop the job."""
    from pyspark.sql import Window

    s = scorable(scores)
    edge = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("lo")) / width)).cast("int")
    counts = s.crossJoin(F.broadcast(edge)).where("hi > lo").groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = s.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").na.fill({"n": 0}).crossJoin(F.broadcast(edge))
    grid = grid.withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * width)
    up, down = Window.orderBy("bin"), Window.orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    grid = grid.withColumns({"w1": F.sum("n").over(up), "m1": F.sum(F.col("n") * F.col("centre")).over(up), "w2": F.sum("n").over(down), "m2": F.sum(F.col("n") * F.col("centre")).over(down)})
    gap = F.col("m1") / F.col("w1") - F.col("m2") / F.col("w2")
    between = grid.where("w1 > 0 AND w2 > 0").withColumn("between", F.col("w1") * F.col("w2") * gap * gap)
    best = between.agg(F.max_by("centre", F.struct(F.round("between", 9), -F.col("bin"))).alias("tau"))
    return best.select(F.coalesce("tau", F.raise_error(F.lit("equal scores have no threshold")).cast("double")).alias("tau"))


def mixture(values: np.ndarray, seed: int = 0, starts: int = 5, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and deviations of two normal components by expectation-maximisation over a
    weighted sample (value, weight). The best of several seeded starts."""
    x, w = values[:, 0], values[:, 1] / values[:, 1].sum()
    rng, best = np.random.default_rng(seed), None
    floor = max(1e-6, np.sqrt(np.sum(w * (x - np.sum(w * x)) ** 2)) * 1e-3)
    for _ in range(starts):
        mu = np.sort(rng.choice(x, 2, p=w))
        if mu[0] == mu[1]:
            mu = np.array([x.min(), x.max()])
        sd, pi = np.full(2, max(floor, x.std())), np.full(2, 0.5)
        for _ in range(rounds):
            log = np.log(pi) - np.log(sd) - 0.5 * ((x[:, None] - mu) / sd) ** 2
            z = np.logaddexp(log[:, 0], log[:, 1])
            r = np.exp(log - z[:, None]) * w[:, None]
            pi = np.maximum(r.sum(0), 1e-12)
            mu = (r * x[:, None]).sum(0) / pi
            sd = np.maximum(floor, np.sqrt((r * (x[:, None] - mu) ** 2).sum(0) / pi))
        score = float((w * z).sum())
        if best is None or score > best[0]:
            best = (score, pi, mu, sd)
    return best[1:]


def gmm_threshold(scores: DataFrame, seed: int = 0, cells: int = 100_000) -> DataFrame:
    """One row: tau, where the posterior of the lower of two normal components first crosses one
    half between their means, else the middle of the means. Scores lie in [0, 1] and are counted
    in ``cells`` equal cells, so what one task fits is bounded for any number of creations."""
    counted = scorable(scores).groupBy(F.round("score", len(str(cells)) - 1).alias("score")).count()

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        v = pd.concat(frames).sort_values("score").to_numpy(float) if frames else np.zeros((0, 2))
        if not len(v):
            return
        pi, mu, sd = mixture(v, seed) if len(v) > 1 else (np.ones(2) / 2, np.repeat(v[0, 0], 2), np.ones(2))
        o = np.argsort(mu)
        pi, mu, sd = pi[o], mu[o], sd[o]
        grid = np.linspace(mu[0], mu[1], 4096)
        log = np.log(pi) - np.log(sd) - 0.5 * ((grid[:, None] - mu) / sd) ** 2
        cross = np.flatnonzero(np.diff(np.sign(log[:, 0] - log[:, 1])))
        yield pd.DataFrame({"tau": [grid[cross[0]] if len(cross) else mu.mean()], "mean_low": mu[:1], "mean_high": mu[1:]})

    return counted.coalesce(1).mapInPandas(fit, "tau double, mean_low double, mean_high double")


def manual_threshold(scores: DataFrame, tau: float | None) -> DataFrame:
    if tau is None:
        raise ValueError("the manual threshold needs a tau")
    return scores.sparkSession.createDataFrame([(float(tau),)], "tau double")


METHODS: dict[str, Callable[..., DataFrame]] = {"otsu_exact": otsu_exact, "otsu_binned": otsu_binned, "gmm_2": gmm_threshold}


def threshold(scores: DataFrame, method: str = "otsu_exact", tau: float | None = None) -> DataFrame:
    """One row with tau, by the method named."""
    if method == "manual":
        return manual_threshold(scores, tau)
    if method not in METHODS:
        raise ValueError(f"no threshold method {method!r}; there are manual, {', '.join(METHODS)}")
    return METHODS[method](scores)


def diagnostics(scores: DataFrame, min_separability: float = MIN_SEPARABILITY, min_gap_ratio: float = MIN_GAP_RATIO) -> DataFrame:
    """One row: how far the exact split can be trusted, and flags in words."""
    o = otsu_exact(scores)
    low, narrow = F.col("separability") < min_separability, F.col("gap_ratio") < min_gap_ratio
    flags = F.array_compact(F.array(F.when(low, F.lit("low separability")), F.when(narrow, F.lit("narrow gap"))))
    return o.select("n", "k", "tau", "separability", "gap_ratio", (~low & ~narrow).alias("bimodal"), F.array_join(flags, "; ").alias("flags"))


def cross_check(scores: DataFrame, tolerance: float = AGREEMENT_TOLERANCE) -> DataFrame:
    """One row: whether the binned threshold lies in the gap of the exact split, and whether both
    part the scores alike."""
    o = otsu_exact(scores).select("tau", "lower", "upper")
    both = o.crossJoin(F.broadcast(otsu_binned(scores).select(F.col("tau").alias("binned_tau"))))  # one row each
    outside = F.greatest(F.col("lower") - F.col("binned_tau"), F.col("binned_tau") - F.col("upper"), F.lit(0.0))
    s = scorable(scores).crossJoin(F.broadcast(both))
    differ = F.count_if((F.col("score") > F.col("tau")) != (F.col("score") > F.col("binned_tau")))
    return s.groupBy("tau", "binned_tau", outside.alias("outside_gap")).agg(differ.alias("n_differ")).withColumn("same_gap", F.col("outside_gap") <= tolerance).withColumn("same_partition", F.col("n_differ") == 0)


def classified(scores: DataFrame, tau: DataFrame, band: float = BORDERLINE_BAND) -> DataFrame:
    """creation_id, score, tau, label, borderline: suspicious strictly above tau."""
    rows = scorable(scores).crossJoin(F.broadcast(tau.select("tau")))  # one row
    return rows.withColumn("label", F.when(F.col("score") > F.col("tau"), "suspicious").otherwise("authentic")).withColumn("borderline", F.abs(F.col("score") - F.col("tau")) <= band)
