"""Text files as rows, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """creation_id, text of every .txt file under a folder, the id being the file's name. Files are
    listed and read by the executors; bytes that are no UTF-8 stop the job."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(folder)
    text = F.decode("content", "UTF-8")
    return raw.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("creation_id"), F.regexp_replace(text, "^\ufeff", "").alias("text"))


def missing_texts(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Declared ids of which there is no text: what is still to be fetched."""
    return declared.select(F.col("id").alias("creation_id")).distinct().join(found.select("creation_id"), "creation_id", "left_anti")


def read_raw_cache(spark: SparkSession, folder: str) -> DataFrame:
    """number, text, error of what was fetched before; no rows where the folder isn't there yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    kind = "number int, text string, error string"
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(folder)


def missing_numbers(numbers: DataFrame, known: DataFrame) -> DataFrame:
    """Numbers of which no text was fetched yet; a failure is tried again."""
    return numbers.select("number").distinct().join(known.where("text IS NOT NULL").select("number"), "number", "left_anti")
