"""The call ledger as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SCHEMA = (
    "schema_version int, ts_utc string, run_id string, cache_key string, tag string, provider string, model_id string, cached boolean, status string, attempt int, prompt string, prompt_sha256 string, system string, "
    "temperature double, max_output_tokens int, response_format string, prompt_schema_version int, creation_id string, chunk_index int, run_index int, response string, response_sha256 string, model_version string, "
    "input_tokens int, output_tokens int, latency_ms int, finish_reason string, error string, error_class string"
)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The lines of one ledger file. A torn last line (a run that was killed) is dropped; a bad line
    before the last stops the job. Only numbers and offsets of lines are compared to tell which is last."""
    return parsed_lines(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_n")))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """The ledger's lines from value (the text of a line), _file and _n (its place in the file). A torn last
    line of a file is dropped, blank lines too; a bad line before the last stops the job."""
    raw = lines.where(F.trim("value") != "")
    parsed = raw.withColumn("r", F.from_json("value", f"{LEDGER_SCHEMA}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    last = raw.groupBy("_file").agg(F.max("_n").alias("_last"))
    rows = parsed.join(F.broadcast(last), "_file")  # a row a file
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    checked = F.when(bad & (F.col("_n") < F.col("_last")), F.raise_error(F.concat(F.lit("bad ledger line: "), F.substring("value", 1, 200)))).otherwise(bad)
    names = [f.name for f in parsed.schema["r"].dataType.fields if f.name != "_bad"]
    return rows.withColumn("_skip", checked.cast("boolean")).where("NOT _skip").select(*[F.col(f"r.{n}").alias(n) for n in names])


def append_ledger(entries: DataFrame, path: str) -> None:
    """More lines, one for every outcome, cache hits too."""
    entries.write.mode("append").json(path)
