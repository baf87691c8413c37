"""The files of a run, and its identity. The manifest comes last: a run is whole when it has one.

Frames and small files go through the same file system (Hadoop's), so that a folder may lie on the
cluster's shared storage.
"""

from __future__ import annotations

import json
import platform
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__


def run_id(settings: dict, identity: str, now: datetime | None = None) -> str:
    t = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M")
    tag = settings["run"]["tag"]
    return f"{t}-{identity[:8]}-s{settings['run']['seed']}" + (f"-{tag}" if tag else "")


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, over what stood there."""
    fs, p = _at(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n")


def is_complete(spark: SparkSession, folder: str) -> bool:
    text = read_text(spark, f"{folder}/run.json")
    return text is not None and bool(json.loads(text).get("ended_utc"))


def open_run(spark: SparkSession, folder: str) -> str:
    """A run's folder. A whole run is never written again; one that was broken off is gone on with (the
    answers it paid for are in the cache)."""
    if is_complete(spark, folder):
        raise FileExistsError(f"{folder} holds a whole run")
    return str(folder)


def _table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def threshold_record(threshold: DataFrame, labels: DataFrame, method: str, diagnostics: DataFrame | None = None, cross_check: DataFrame | None = None) -> dict:
    """What threshold.json holds: the threshold with its numbers, how many creations fell on each side, and the
    flags, which are there even when empty. The sets themselves are the table of labels."""
    out = {"method": method, **(threshold.first().asDict() if threshold is not None else {})}
    counts = labels.agg(F.count_if(F.col("label") == "suspicious").alias("n_suspicious"), F.count_if(F.col("label") == "authentic").alias("n_authentic"), F.count_if("borderline").alias("n_borderline")).first().asDict()
    found = diagnostics.first().asDict() if diagnostics is not None else {}
    cross = cross_check.first() if cross_check is not None else None
    flags = [x for x in found.get("flags", "").split("; ") if x]
    if cross is not None and not cross["same_gap"]:
        flags.append("the binned threshold lies outside the gap")
    return {**out, **counts, "diagnostics": found, "cross_check": cross.asDict() if cross is not None else None, "flags": flags, "flagged": bool(flags)}


def run_record(settings: dict, identity: str, name: str, started: datetime, counts: dict, calls: DataFrame | None, threshold: dict) -> dict:
    """What a run's manifest holds: identity, settings, counts, calls by tag (of its own lines), the threshold."""
    by_tag = {r["tag"]: r.asDict() for r in calls.collect()} if calls is not None else {}  # a row a tag
    total = by_tag.pop("*", {})
    return {
        "run_id": name, "started_utc": started.strftime("%Y-%m-%dT%H:%M:%SZ"), "ended_utc": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "package_version": __version__, "python": platform.python_version(), "identity": identity,
        "seed": settings["run"]["seed"], "M": settings["run"]["M"], "P": settings["chunking"]["P"], "distance_metric": settings["distance"]["metric"], "classifier": settings["classify"]["method"], "provider": settings["llm"]["provider"],
        "model_id": settings["llm"]["model_id"], "mode": settings["llm"]["mode"], "settings": settings, "counts": counts, "calls": {**{k: v for k, v in total.items() if k != "tag"}, "by_tag": by_tag},
        "threshold": {k: threshold.get(k) for k in ("tau", "method", "flagged")},
    }


def write_run(
    folder: str, *, chunks: DataFrame, rewrites: DataFrame, deltas: DataFrame, scores: DataFrame, threshold: dict, labels: DataFrame, noise: DataFrame, profiles: DataFrame, manifest: dict, partial_profiles: DataFrame | None = None,
    packing: DataFrame | None = None, score_lines: DataFrame | None = None,
) -> str:
    """All artifacts of a run. Files are as many as tasks wrote, whatever the number of creations."""
    spark = chunks.sparkSession
    p = open_run(spark, folder)
    chunks.write.mode("overwrite").json(f"{p}/chunks")
    rewrites.write.mode("overwrite").partitionBy("run_index").json(f"{p}/rewrites")
    deltas.write.mode("overwrite").partitionBy("run_index").option("header", True).csv(f"{p}/deltas")
    profiles.write.mode("overwrite").json(f"{p}/profiles/merged")
    if partial_profiles is not None:
        partial_profiles.write.mode("overwrite").json(f"{p}/profiles/partial")
    if packing is not None:
        packing.write.mode("overwrite").json(f"{p}/profiles/packing")
    _table(scores, f"{p}/scores")
    if score_lines is not None:
        score_lines.write.mode("overwrite").text(f"{p}/scores_markdown")
    _table(labels, f"{p}/labels")
    _table(noise, f"{p}/noise")
    write_json(spark, f"{p}/threshold.json", threshold)
    write_json(spark, f"{p}/run.json", manifest)
    return p


def write_comparison(folder: str, rows: DataFrame, summary: DataFrame, lines: DataFrame, record: dict) -> str:
    """The artifacts of a comparison: its rows, the summary by model (as JSON and as a Markdown table), and every
    passage with each model's version beneath it."""
    spark = rows.sparkSession
    _table(rows.drop("original", "rewrite"), f"{folder}/comparison")
    models = [r.asDict() for r in summary.orderBy("model").collect()]  # a row a model
    write_json(spark, f"{folder}/summary.json", {**record, "models": models})
    names = list(models[0]) if models else []
    table = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in m.values()) + " |" for m in models)]
    write_text(spark, f"{folder}/summary.md", "\n".join(["# Models side by side", "", *table, ""]))
    lines.write.mode("overwrite").text(f"{folder}/rewrites")
    return folder


def write_manifest(folder: str, entries: DataFrame, totals: DataFrame, record: dict) -> str:
    """A collection's manifest: an entry for each text as JSON lines, and beside them its totals and provenance."""
    entries.write.mode("overwrite").json(f"{folder}/entries")
    write_json(entries.sparkSession, f"{folder}/manifest.json", {**record, "generated_utc": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "totals": totals.first().asDict()})
    return folder


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of a manifest."""
    if read_text(spark, f"{folder}/manifest.json") is None:
        raise FileNotFoundError(f"no manifest at {folder}: write it with `corpus manifest` first")
    return spark.read.schema("id string, sha256 string, n_words bigint, n_chars bigint").json(f"{folder}/entries")
