"""Experiments over deltas: control, sensitivity, stability, set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import with_position


def paired_test(a: DataFrame, b: DataFrame, keys: tuple[str, ...], value: str = "delta") -> DataFrame:
    """One row: pairs, mean difference, its deviation, t statistic, effect size."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys)).withColumn("d", F.col("_a") - F.col("_b"))
    s = j.agg(F.count("d").alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("sd"))
    return s.withColumn("t", F.expr("mean_difference / nullif(sd / sqrt(n), 0)")).withColumn("effect_size", F.expr("mean_difference / nullif(sd, 0)"))


def stability(deltas: DataFrame) -> DataFrame:
    """Coefficient of variation of each chunk's deltas over runs."""
    d = deltas.where("status = 'ok'").groupBy("creation_id", "chunk_index").agg(F.count("delta").alias("n_runs"), F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("sd"))
    return d.withColumn("variation", F.expr("sd / nullif(mean_delta, 0)")).drop("sd")


def sensitivity(texts: DataFrame, id_col: str, sizes: tuple[int, ...], text_col: str = "text") -> DataFrame:
    """Chunks and words of the last chunk for each chunk size: the size is a column, not a loop."""
    from ..functions import text as tx

    n = texts.select(F.col(id_col).alias("creation_id"), tx.n_words(F.col(text_col)).alias("n_words"))
    out = n.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    return out.groupBy("size").agg(F.sum(F.ceil(F.col("n_words") / F.col("size"))).alias("n_chunks"), F.count_if(F.pmod("n_words", "size") > 0).alias("n_short"))


def set_delta(before: DataFrame, after: DataFrame, id_col: str = "creation_id") -> DataFrame:
    """id, change: what left and what joined a set between two iterations."""
    b, a = before.select(id_col).distinct(), after.select(id_col).distinct()
    return b.join(a, id_col, "left_anti").withColumn("change", F.lit("left")).unionByName(a.join(b, id_col, "left_anti").withColumn("change", F.lit("joined")))


def partition_difference(a: DataFrame, b: DataFrame, id_col: str = "creation_id") -> DataFrame:
    """One row: whether two sets of ids are equal, and how many ids are in one only."""
    d = set_delta(a, b, id_col)
    return d.agg(F.count_if(F.col("change") == "left").alias("only_first"), F.count_if(F.col("change") == "joined").alias("only_second")).withColumn("equal", (F.col("only_first") + F.col("only_second")) == 0)


def spliced(hosts: DataFrame, passages: DataFrame, id_col: str = "creation_id") -> DataFrame:
    """Hosts with foreign passages put in: creation_id, text, splices (first word and words of each,
    in the new text). passages: creation_id, at (a word of the host), text."""
    from ..functions import text as tx

    # a few passages a host
    own = passages.select(F.col(id_col), F.struct("at", tx.words(F.col("text")).alias("w")).alias("p")).groupBy(id_col).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    h = hosts.select(id_col, tx.words(F.col("text")).alias("h")).join(own, id_col)
    start = F.struct(F.lit(0).alias("done"), F.array().cast("array<string>").alias("out"), F.array().cast("array<struct<word_start:int,n_words:int>>").alias("splices"))

    def put(s, p):
        at = F.least(p["at"], F.size("h"))
        before = F.slice(F.col("h"), s["done"] + 1, F.greatest(F.lit(0), at - s["done"]))
        place = F.struct((F.size(s["out"]) + F.size(before)).alias("word_start"), F.size(p["w"]).alias("n_words"))
        return F.struct(F.greatest(at, s["done"]).alias("done"), F.concat(s["out"], before, p["w"]).alias("out"), F.concat(s["splices"], F.array(place)).alias("splices"))

    m = h.withColumn("m", F.aggregate("ps", start, put))
    rest = F.slice(F.col("h"), F.col("m.done") + 1, F.greatest(F.lit(0), F.size("h") - F.col("m.done")))
    return m.select(id_col, F.array_join(F.concat("m.out", rest), " ").alias("text"), F.col("m.splices").alias("splices"))


def splice_recall(deltas: DataFrame, foreign: DataFrame) -> DataFrame:
    """creation_id, n_foreign, n_found: how many of a creation's foreign chunks are among as many of
    its chunks of highest delta. foreign: creation_id, chunk_index. Ranks are made by range partitions."""
    f = foreign.select("creation_id", "chunk_index").distinct().withColumn("is_foreign", F.lit(1))
    d = deltas.where("status = 'ok'").groupBy("creation_id", "chunk_index").agg(F.avg("delta").alias("delta")).join(f, ["creation_id", "chunk_index"], "left").na.fill({"is_foreign": 0})
    n = d.groupBy("creation_id").agg(F.sum("is_foreign").alias("n_foreign"))
    ranked = with_position(d.withColumn("_down", -F.col("delta")), F.col("_down"), F.col("chunk_index"), by=("creation_id",)).withColumnRenamed("pos", "rank").join(n, "creation_id")
    return ranked.where("n_foreign > 0").groupBy("creation_id").agg(F.max("n_foreign").alias("n_foreign"), F.count_if((F.col("rank") <= F.col("n_foreign")) & (F.col("is_foreign") == 1)).alias("n_found"))
