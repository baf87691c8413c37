"""Command line: settings, collection, cache, runs."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys

from . import __version__, config


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkwell")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    c = sub.add_parser("config")
    c.add_argument("action", choices=("show", "validate"))
    v = sub.add_parser("corpus")
    v.add_argument("action", choices=("fetch", "manifest", "verify"))
    k = sub.add_parser("cache")
    k.add_argument("action", choices=("stats", "verify"))
    r = sub.add_parser("run")
    r.add_argument("--dry-run", action="store_true")
    m = sub.add_parser("compare")
    m.add_argument("-m", "--model", action="append", required=True)
    m.add_argument("--yes", action="store_true")
    m.add_argument("--chunks", type=int, default=20, help="chunks of the shared sample")
    for s in (c, v, k, r, m):
        s.add_argument("--config")
        s.add_argument("--preset", choices=sorted(config.PRESETS))
        s.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
        s.add_argument("--provider")
        s.add_argument("--mode")
        s.add_argument("--seed", type=int)
        s.add_argument("--out")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    try:
        settings = config.build(a.config, a.preset, a.set, provider=a.provider, mode=a.mode, seed=a.seed)
    except config.ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    if a.command == "config":
        print(json.dumps(settings, indent=2) if a.action == "show" else f"valid, {config.identity(settings)[:8]}")
        return 0
    from datetime import UTC, datetime

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .functions import lexicon as lx
    from .operators import collection, ledger, reports, scoring
    from .plans import pipeline
    from .session import local_session, ship_package
    from .sources import artifacts, declarations, http, ledger_log, texts

    # under spark-submit the session is the cluster's; by itself the command makes a local one
    spark = SparkSession.getActiveSession() or (SparkSession.builder.getOrCreate() if "PYSPARK_GATEWAY_PORT" in os.environ else local_session())
    ship_package(spark)
    cache_dir = settings["llm"]["cache_dir"]
    if a.command == "cache":
        row = ledger.cache_problems(ledger.read_cache(spark, cache_dir)).first().asDict()
        print(json.dumps(row))
        return int(a.action == "verify" and row["n_empty"] + row["n_bad_hash"] > 0)
    corpus_settings = settings["corpus"]
    declared = declarations.read_declarations(spark, corpus_settings["sources"])
    if a.command == "corpus" and a.action == "fetch":
        numbers = declared.select(F.explode("gutenberg_ids").alias("number")).distinct()
        folder = a.out or "data/_raw"
        known = texts.read_raw_cache(spark, folder)
        http.fetched(texts.missing_numbers(numbers, known)).write.mode("append").parquet(folder)
        return 0
    found = texts.read_texts(spark, corpus_settings["dir"])
    if a.command == "corpus" and a.action == "manifest":
        words = {"count": len(lx.FUNCTION_WORDS), "sha256": hashlib.sha256("\n".join(lx.FUNCTION_WORDS).encode()).hexdigest()}
        print(artifacts.write_manifest(a.out or corpus_settings["manifest"], collection.manifest(found), collection.totals(found), {"function_words": words, "speaker_prefixes": "kept", "stage_directions": "kept"}))
        return 0
    own = collection.declarations(declared).where("set_name = 'texts'").select(F.col("id").alias("creation_id"))
    if a.command == "corpus":
        recorded = artifacts.read_manifest(spark, corpus_settings["manifest"])
        of_texts = found.join(own, "creation_id", "left_semi")
        findings = collection.reconciled(declared, recorded, collection.manifest(found)).unionByName(collection.collection_findings(of_texts, corpus_settings["expected_count"], collection.declarations(declared).where("set_name = 'texts'")))
        for r in findings.orderBy("severity", "finding", "id").toLocalIterator():  # all of them, a partition at a time
            print(f"{r['severity']}\t{r['finding']}\t{r['id']}")
        return int(not findings.where("severity = 'failure'").isEmpty())
    only, never = corpus_settings["include_ids"], corpus_settings["exclude_ids"]
    if only is not None:
        named = spark.createDataFrame([(x,) for x in only], "creation_id string")
        unknown = [r[0] for r in collection.unknown_ids(named, own).collect()]  # at most as many as the settings name
        if unknown:
            print(f"unknown ids: {', '.join(unknown)}", file=sys.stderr)
            return 2
        own = own.join(named, "creation_id", "left_semi")
    if never:
        own = own.where(~F.col("creation_id").isin(*never))
    corpus = found.join(own, "creation_id", "left_semi")
    pool = texts.read_texts(spark, settings["noise"]["pool_dir"])
    identity = config.identity(settings)
    if a.command == "compare":
        n = len(a.model)
        print(f"{n} models, {a.chunks} chunks each: at most {a.chunks * n} calls")
        if a.yes:
            from .session import checkpointed

            rows = checkpointed(pipeline.compare(corpus, a.model, settings, a.chunks, cache_dir if all(pipeline.provider_named(x).call for x in a.model if x in pipeline.PROVIDERS) else None))
            summary = pipeline.comparison_summary(rows)
            folder = a.out or f"{settings['run']['out_dir']}/compare-{artifacts.run_id(settings, identity)}"
            print(artifacts.write_comparison(folder, rows, summary, reports.passages_side_by_side(rows), {"seed": settings["run"]["seed"], "n_chunks": a.chunks}))
            summary.show(n, truncate=False)
        return 0
    pipeline.plan(corpus, pool, settings).show(truncate=False)
    if a.dry_run:
        return 0
    started = datetime.now(UTC)
    name = artifacts.run_id(settings, identity, started)
    folder = artifacts.open_run(spark, a.out or f"{settings['run']['out_dir']}/{name}")
    log = f"{folder}/calls"
    r = pipeline.run(corpus, pool, settings, cache_dir, log=log, run_id=name)
    table = reports.scores_table(scoring.scores_pivot(r.run_scores, settings["run"]["M"]), r.scores, r.labels, declared.select(F.col("id").alias("creation_id"), "title"))
    lines = ledger.ledger_summary(spark.read.schema(ledger_log.LEDGER_SCHEMA).json(log).where(F.col("run_id") == name))
    tau = artifacts.threshold_record(r.threshold, r.labels, settings["classify"]["method"], r.diagnostics, r.cross_check)
    counts = {**reports.run_counts(r.scores, r.rewrites).first().asDict(), "n_creations": r.scores.count(), "n_chunks": r.chunks.count()}
    artifacts.write_run(
        folder, chunks=r.chunks, rewrites=r.rewrites, deltas=reports.deltas_table(r.deltas), scores=table, threshold=tau, labels=r.labels, noise=reports.noise_diagnostics(r.run_scores, r.noise, r.threshold), profiles=r.profiles,
        partial_profiles=r.partial_profiles, packing=r.packing, score_lines=reports.markdown_rows(table), manifest=artifacts.run_record(settings, identity, name, started, counts, lines, tau),
    )
    print(folder)
    return 0


if __name__ == "__main__":
    sys.exit(main())
