"""Declared sources and the collection of texts: constraints, subsets, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import ingest

SETS = ("texts", "noise_pool", "heldout", "mixture_sources")


def set_spelling(c: Column) -> Column:
    """A set's name in one spelling; null stays null."""
    out = F.regexp_replace(F.lower(F.btrim(c)), "[ _-]+", "_")
    return F.when(out == "held_out", "heldout").otherwise(out)


def declarations(sources: DataFrame) -> DataFrame:
    """Declared rows with set_name in one spelling and numbers above 0 only, each once."""
    numbers = F.array_sort(F.array_distinct(F.filter(F.coalesce("gutenberg_ids", F.array().cast("array<int>")), lambda g: g > 0)))
    return sources.withColumn("set_name", set_spelling(F.col("set_name"))).withColumn("gutenberg_ids", numbers)


def disjointness(sources: DataFrame) -> DataFrame:
    """kind, value, n of ids declared more than once, and of numbers declared in several sets."""
    d = declarations(sources)
    ids = d.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("id").alias("kind"), F.col("id").alias("value"), "n")
    numbers = d.where("set_name IS NOT NULL").select("set_name", F.explode("gutenberg_ids").alias("g")).distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return ids.unionByName(numbers.select(F.lit("number").alias("kind"), F.col("g").cast("string").alias("value"), "n"))


def subset(creations: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, id_col: str = "creation_id") -> DataFrame:
    """Creations that are included (all, where nothing is) and not excluded. Ids to exclude that
    match nothing are no error; check ids to include with ``unknown_ids``."""
    out = creations
    if include is not None:
        out = out.join(include.select(id_col), id_col, "left_semi")
    if exclude is not None:
        out = out.join(exclude.select(id_col), id_col, "left_anti")
    return out


def unknown_ids(include: DataFrame, creations: DataFrame, id_col: str = "creation_id") -> DataFrame:
    return include.select(id_col).distinct().join(creations.select(id_col), id_col, "left_anti")


def all_in_order(sources: DataFrame) -> DataFrame:
    """Every declared row of the four sets, with its place: sets in their fixed order, then as declared."""
    d = declarations(sources)
    return d.where(F.col("set_name").isin(*SETS)).withColumn("set_order", F.array_position(F.array(*map(F.lit, SETS)), F.col("set_name")).cast("int"))


def totals(texts: DataFrame, text_col: str = "text") -> DataFrame:
    c = F.col(text_col)
    return texts.agg(F.count(F.lit(1)).alias("n_texts"), F.sum(tx.n_words(c)).alias("n_words"), F.sum(F.length(tx.text_or_empty(c)).cast("bigint")).alias("n_chars"))


def manifest(texts: DataFrame, id_col: str = "creation_id", text_col: str = "text") -> DataFrame:
    c = tx.text_or_empty(F.col(text_col))
    return texts.select(F.col(id_col).alias("id"), F.sha2(c, 256).alias("sha256"), tx.n_words(c).alias("n_words"), F.length(c).cast("bigint").alias("n_chars"))


def collection_findings(texts: DataFrame, expected_count: int | None, expected_words: DataFrame | None = None, tolerance: float = 0.15, text_col: str = "text") -> DataFrame:
    """id ('*'), finding, severity for the collection as a whole and for texts that still hold what should have
    been stripped: another number of texts than expected, a total outside the band round the sum of the expected
    words, boilerplate left in a text (id is the text's)."""
    left = texts.where(ingest.has_residue(F.col(text_col))).select(F.col("creation_id").alias("id"), F.lit("boilerplate").alias("finding"), F.lit("failure").alias("severity"))
    t = totals(texts, text_col)
    if expected_words is not None:
        t = t.crossJoin(F.broadcast(expected_words.agg(F.sum("expected_words").alias("_expected"))))  # one row
    else:
        t = t.withColumn("_expected", F.lit(None).cast("bigint"))
    count = F.lit(False) if expected_count is None else F.col("n_texts") != expected_count
    off = F.coalesce(F.abs(F.coalesce("n_words", F.lit(0)) - F.col("_expected")) > F.col("_expected") * tolerance, F.lit(False))
    whole = F.filter(F.array(F.when(count, F.struct(F.lit("text_count").alias("finding"), F.lit("failure").alias("severity"))), F.when(off, F.struct(F.lit("total_outside_band").alias("finding"), F.lit("warning").alias("severity")))), lambda x: x.isNotNull())
    return left.unionByName(t.select(F.lit("*").alias("id"), F.explode(whole).alias("x")).select("id", "x.finding", "x.severity"))


def reconciled(declared: DataFrame, recorded: DataFrame, found: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """id, finding, severity. declared: id, expected_words; recorded and found: id, sha256, n_words
    (the manifest and what is there). One row a finding; warnings don't fail a collection."""
    d = declared.select("id", "expected_words").groupBy("id").agg(F.max("expected_words").alias("expected_words")).withColumn("_d", F.lit(True))
    m = recorded.select("id", F.col("sha256").alias("m_sha"), F.col("n_words").alias("m_words")).withColumn("_m", F.lit(True))
    f = found.select("id", F.col("sha256").alias("f_sha"), F.col("n_words").alias("f_words")).withColumn("_f", F.lit(True))
    j = d.join(m, "id", "full_outer").join(f, "id", "full_outer")
    dd, mm, ff = (F.coalesce(c, F.lit(False)) for c in ("_d", "_m", "_f"))
    both = dd & mm & ff
    off = F.abs(F.col("f_words") - F.col("expected_words")) > F.col("expected_words") * tolerance
    checks = [
        ("missing", "failure", dd & ~ff), ("not_in_manifest", "failure", dd & ff & ~mm), ("undeclared", "failure", mm & ~dd), ("checksum_drift", "failure", both & (F.col("m_sha") != F.col("f_sha"))),
        ("word_count_drift", "failure", both & (F.col("m_words") != F.col("f_words"))), ("empty", "failure", dd & ff & (F.col("f_words") == 0)), ("outside_band", "warning", both & F.coalesce(off, F.lit(False))),
    ]
    found_ = F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("finding"), F.lit(s).alias("severity"))) for k, s, c in checks]), lambda x: x.isNotNull())
    return j.select("id", F.explode(found_).alias("x")).select("id", "x.finding", "x.severity")


def duplicate_texts(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """sha256, n, first_id of texts that stand more than once. Hashes are shuffled, not texts."""
    rows = df.where(F.col(text_col).isNotNull()).select(F.sha2(F.col(text_col), 256).alias("sha256"), id_col)
    return rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).where("n > 1")
