"""Deterministic choices: noise texts for runs, round-robin and stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import with_position


def noise_assignment(pool: DataFrame, n_runs: int, seed: int, enabled: bool = True, first_run_plain: bool = True, id_col: str = "id") -> DataFrame:
    """run_index, creation_id: which noise text each run gets. Ids are sorted; the first noisy
    run takes number ``seed`` (modulo their count), each later run the next. A pool smaller
    than the noisy runs stops the job; no row where noise is off or no run needs any."""
    spark = pool.sparkSession
    ids = pool.select(F.col(id_col).alias("creation_id")).where("creation_id IS NOT NULL").distinct()
    first = 2 if first_run_plain else 1
    if not enabled or n_runs < first:
        return spark.createDataFrame([], "run_index int, creation_id string")
    n = ids.count()
    if n < n_runs - first + 1:
        raise ValueError(f"{n_runs - first + 1} runs need noise, the pool holds {n} texts")
    runs = spark.range(first, n_runs + 1).select(F.col("id").cast("int").alias("run_index"), ((F.lit(seed % n) + F.col("id") - first) % n + 1).alias("pos"))
    # a few rows, one a run
    return with_position(ids, F.col("creation_id")).join(F.broadcast(runs), "pos").select("run_index", "creation_id")


def run_corpora(creations: DataFrame, noise: DataFrame, n_runs: int, id_col: str = "creation_id") -> DataFrame:
    """run_index, creation_id, is_noise: every run has all creations and its own noise text."""
    runs = F.explode(F.sequence(F.lit(1), F.lit(n_runs)))
    own = creations.select(F.col(id_col).alias("creation_id")).withColumn("run_index", runs).withColumn("is_noise", F.lit(False))
    return own.select("run_index", "creation_id", "is_noise").unionByName(noise.select("run_index", "creation_id", F.lit(True).alias("is_noise")))


def round_robin_sample(chunks: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """creation_id, chunk_index, round of a sample that visits creations in order of their ids,
    one chunk each, round after round, starting in each at chunk ``seed`` (modulo its chunks),
    until ``size`` chunks are taken or ``size`` rounds have passed. Never the same chunk twice.

    No creation is asked for more rounds than it has chunks, and rounds beyond the first that
    is full are cut early, so the grid stays near ``size`` rows for any number of creations.
    """
    once = chunks.select("creation_id", "chunk_index").distinct()
    # positions by range partitions, counts by partial sums: a creation may hold any share of the chunks
    placed = with_position(once.where("creation_id IS NOT NULL"), F.col("chunk_index"), by=("creation_id",))
    numbered = placed.withColumn("k", F.col("pos") - 1).join(once.groupBy("creation_id").agg(F.count(F.lit(1)).alias("n")), "creation_id")
    # chunk k of n is visited in round (k - seed) mod n, the first time
    visits = numbered.withColumn("round", F.pmod(F.col("k") - F.lit(seed), F.col("n"))).where(F.col("round") < size)
    return visits.orderBy("round", "creation_id").limit(size).select("creation_id", "chunk_index", "round")


def stratified_sample(df: DataFrame, stratum: str, id_col: str, share: float, seed: int = 0, buckets: int = 64) -> DataFrame:
    """A share of every stratum (at least one row), by the order of a hash of the id. Ranks are
    made within hash ranges of a stratum and added up, so that a stratum of any size is ranked
    by many tasks."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    b = df.withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") * buckets / 2**32).cast("int"))
    counts = b.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(stratum)
    counts = counts.withColumn("_before", F.sum("_n").over(w.orderBy("_b")) - F.col("_n")).withColumn("_quota", F.greatest(F.lit(1), F.round(F.sum("_n").over(w) * share).cast("bigint"))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", id_col))
    # range-ordered buckets: only those that start below the quota are ranked
    ranked = b.join(counts.where("_before < _quota"), [stratum, "_b"]).withColumn("_rank", inside + F.col("_before"))
    return ranked.where("_rank <= _quota").drop("_h", "_b", "_before", "_quota", "_rank")


def runs_frame(spark: SparkSession, n_runs: int) -> DataFrame:
    return spark.range(1, n_runs + 1).select(F.col("id").cast("int").alias("run_index"))
