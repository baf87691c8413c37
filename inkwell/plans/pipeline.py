"""The whole method as one plan: chunks, profiles, rewrites, distances, scores, threshold, labels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators import chunking, experiments, ledger, packing, prompts, reports, rewriting, sampling, scoring, thresholds
from ..session import checkpointed

@dataclass(frozen=True)
class Provider:
    """What answers prompts: ``call`` a request (a dict of its fields) at a time, as a remote model does, or ``columns``
    an expression over the prompt and the passage. With the model it takes by default, and its window. A ``local`` one
    sends nothing, so it is asked without regard to rates."""

    call: Callable[[dict], str] | None = None
    columns: Callable[[Column, Column], Column] | None = None
    model_id: str = ""
    context_window: int = 1_000_000
    local: bool = False


def _offline_profile(prompt: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda p: rewriting.offline_profile(p or ""))

    return run(prompt)


def _offline_answer(request: dict) -> str:
    prompt = request["prompt"] or ""
    return rewriting.offline_profile(prompt) if request["tag"] == "profile" else rewriting.seeded_rewrite_text(prompt, request["original"] or "")


def _answers_by_hash(prompt: Column, passage: Column) -> Column:
    return rewriting.hashed_rewrite(passage, F.sha2(prompt, 256))


PROVIDERS: dict[str, Provider] = {
    "fake": Provider(_offline_answer, rewriting.seeded_rewrite, "offline-seeded", local=True),
    "fake_sql": Provider(None, _answers_by_hash, "offline-hashed", local=True),
}


def register_provider(name: str, provider: Provider) -> None:
    if name in PROVIDERS:
        raise ValueError(f"a provider named {name!r} is registered already")
    PROVIDERS[name] = provider


def provider_named(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name!r}; there are {', '.join(PROVIDERS)}")
    return PROVIDERS[name]


def window_of(settings: dict) -> int:
    """The context window that a run's calls are planned for."""
    return provider_named(settings["llm"]["provider"]).context_window


@dataclass(frozen=True)
class Calls:
    """The calls of a run: which provider and model, under what settings, and where answers and lines are kept.
    Without a cache folder and a log, expressions answer in the plan itself, and nothing is written."""

    settings: dict
    cache: str | None = None
    log: str | None = None
    run_id: str = ""

    def ask(self, df: DataFrame, tag: str | Column, identity: tuple[str, ...], max_output_tokens: int, response_format: str = "text") -> DataFrame:
        """``df`` (prompt, original, and the columns of ``identity``) with response."""
        m = self.settings["llm"]
        own = provider_named(m["provider"])
        fields = {
            "provider": F.lit(m["provider"]), "model_id": F.lit(m["model_id"] or own.model_id), "system": F.lit(None).cast("string"), "temperature": F.lit(float(m["temperature"])), "max_output_tokens": F.lit(int(max_output_tokens)),
            "response_format": F.lit(response_format), "prompt_schema_version": F.lit(prompts.SCHEMA_VERSION), "tag": F.lit(tag) if isinstance(tag, str) else tag,
        }
        live = m["mode"] == "live" and self.cache is None and self.log is None
        if live and own.columns is not None:
            answer = _offline_profile(F.col("prompt")) if isinstance(tag, str) and tag == "profile" else own.columns(F.col("prompt"), F.col("original"))
            return df.withColumn("response", answer)
        if own.call is None:
            raise ValueError(f"provider {m['provider']!r} answers in plans only: it takes no cache")
        out = ledger.answered(
            df.withColumns(fields), own.call, identity, mode=m["mode"], cache=self.cache, log=self.log, run_id=self.run_id, concurrency=m["concurrency"],
            per_minute=1e12 if own.local else m["requests_per_minute"], tokens_per_minute=1e15 if own.local else m["tokens_per_minute"], retries=m["max_transient_retries"], timeout=m["timeout_seconds"],
        )
        # what replay may not call stops the run; any other failure is a row without an answer
        answer = F.when(F.col("error_class") == "CacheMissError", F.raise_error(F.col("error")).cast("string")).otherwise(F.col("response"))
        return out.select(*df.columns, answer.alias("response"))


@dataclass
class Run:
    """The frames of a run."""

    chunks: DataFrame
    noise: DataFrame
    profiles: DataFrame
    rewrites: DataFrame
    deltas: DataFrame
    run_scores: DataFrame
    scores: DataFrame
    threshold: DataFrame
    labels: DataFrame
    settings: dict = field(default_factory=dict)
    diagnostics: DataFrame | None = None
    cross_check: DataFrame | None = None
    packing: DataFrame | None = None
    partial_profiles: DataFrame | None = None


def extract_profiles(texts: DataFrame, corpora: DataFrame, settings: dict, calls: Calls | None = None, window: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """run_index, n_calls, merged, fields, free_text of each run's profile; its packing (run_index, bin_index,
    n_creations, tokens); and the answer to each call (run_index, bin_index, response).

    Creations are packed into calls by estimated tokens; a call's prompt holds its creations, so it
    is bounded by the context window. A run of several calls has one more that merges them.
    """
    p = settings["profile"]
    calls = calls or Calls(settings)
    budget = p["context_budget_tokens"] or packing.context_budget(window or window_of(settings))
    kind = "json" if p["structured_output"] else "text"
    own = texts.select("creation_id", "text", packing.estimated_tokens(tx.n_words(F.col("text")), p["tokens_per_word"]).alias("tokens"))
    out = sizes = None
    for r in range(1, settings["run"]["M"] + 1):
        ids = corpora.where(F.col("run_index") == r).select("creation_id")
        bins = packing.packed_bins(own.join(ids, "creation_id", "left_semi").select("creation_id", "tokens"), budget)
        filled = bins.join(own.select("creation_id", "text"), "creation_id")
        numbered = F.transform(F.array_sort(F.collect_list(F.struct("creation_id", "text"))), lambda c, i: F.concat(F.lit("Creation "), (i + 1).cast("string"), F.lit(": "), c["text"]))
        own_calls = filled.groupBy("bin_index").agg(F.array_join(numbered, "\n\n").alias("body")).select(F.lit(r).alias("run_index"), "bin_index", prompts.render(f"profile_{kind}", texts=F.col("body")).alias("prompt"), F.lit("").alias("original"))
        out = own_calls if out is None else out.unionByName(own_calls)
        summary = packing.bin_summary(bins).withColumn("run_index", F.lit(r))
        sizes = summary if sizes is None else sizes.unionByName(summary)
    partial = checkpointed(calls.ask(out, "profile", ("run_index", "bin_index"), p["max_output_tokens"], kind).select("run_index", "bin_index", "response"))
    # a few answers of a few hundred characters each
    joined = partial.groupBy("run_index").agg(F.count(F.lit(1)).alias("n_bins"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin_index", "response"))), lambda x: x["response"]), "\n\n").alias("all"), F.min_by("response", "bin_index").alias("first"))
    several = (F.col("n_bins") > 1) & F.lit(bool(p["merge_when_multiple"]))
    to_merge = joined.where(several).select("run_index", F.lit(-1).alias("bin_index"), prompts.render(f"merge_{kind}", analyses=F.col("all")).alias("prompt"), F.lit("").alias("original"))
    merged = checkpointed(calls.ask(to_merge, "profile", ("run_index", "bin_index"), p["max_output_tokens"], kind).select("run_index", F.col("response").alias("_merged")))
    answer = joined.join(merged, "run_index", "left").withColumn("response", F.when(several, F.col("_merged")).otherwise(F.col("first")))
    answer = answer.select("run_index", (F.col("n_bins") + several.cast("int")).alias("n_calls"), several.alias("merged"), "response")
    if p["structured_output"]:
        profiles = rewriting.parsed_profiles(answer)
    else:
        profiles = answer.withColumns({"fields": F.lit(None).cast("map<string,string>"), "structured": F.lit(False), "free_text": tx.strip(F.col("response"))})
    return profiles.drop("response"), sizes.select("run_index", "bin_index", "n_creations", "tokens"), partial


def rewrite_requests(chunks: DataFrame, corpora: DataFrame, profiles: DataFrame) -> DataFrame:
    """A request for each chunk of each run; the run is a column, not a loop."""
    profile = F.when(F.col("structured"), rewriting.rendered_profile(F.col("fields"))).otherwise(F.col("free_text"))
    p = profiles.select("run_index", profile.alias("profile"))
    # profiles: a row a run
    return chunks.select("creation_id", "chunk_index", F.col("text").alias("original")).join(corpora, "creation_id").join(F.broadcast(p), "run_index")


def run(texts: DataFrame, pool: DataFrame, settings: dict, cache: str | None = None, profiled: DataFrame | None = None, log: str | None = None, run_id: str = "") -> Run:
    """texts and pool: creation_id, text (the collection, and texts known to be foreign). cache: the folder
    of answers, read and written; log: the ledger, appended to. profiled: the creations
    (creation_id) that profiles are taken from; all, where it isn't given."""
    m, seed = settings["run"]["M"], settings["run"]["seed"]
    n, w, rules = settings["noise"], settings["rewrite"], settings["rewrite"]["validation"]
    calls = Calls(settings, cache, log, run_id)
    provider_named(settings["llm"]["provider"])
    noise = checkpointed(sampling.noise_assignment(pool, m, seed, n["enabled"], n["first_run_plain"], "creation_id"))
    every = texts.select("creation_id", "text").unionByName(pool.join(noise, "creation_id", "left_semi").select("creation_id", "text"))
    chunks = chunking.chunked(every, "creation_id", size=settings["chunking"]["P"])
    corpora = sampling.run_corpora(texts, noise, m)
    described = corpora if profiled is None else corpora.where("is_noise").unionByName(corpora.where("NOT is_noise").join(profiled.select("creation_id"), "creation_id", "left_semi").select(corpora.columns))
    profiles, bins, partial = extract_profiles(every, described, settings, calls)
    profiles = checkpointed(profiles)
    scored = corpora if n["score_injected_text"] else corpora.where("NOT is_noise")
    requests = rewrite_requests(chunks, scored, profiles)
    keys = ("run_index", "creation_id", "chunk_index")

    def rewrite(df: DataFrame) -> DataFrame:
        asked = df.withColumn("prompt", rewriting.rendered_prompt(F.col("profile"), F.col("original"), F.col("attempt")))
        tag = F.when(F.col("attempt") > 1, "rewrite_retry").otherwise("rewrite")
        return calls.ask(asked, tag, keys, w["max_output_tokens"]).withColumnRenamed("response", "rewrite").drop("prompt")

    done = rewriting.with_retries(requests, rewrite, keys, w["max_retries"], rules)
    rewrites = done.select(*keys, "is_noise", "original", "rewrite", F.when(F.col("ok"), "ok").otherwise("failed").alias("status"), "attempts", "reason", "length_ratio", "content_retention")
    deltas = checkpointed(scoring.chunk_deltas(rewrites, settings["distance"]["metric"], rules).join(rewrites.select(*keys, "is_noise"), list(keys)))
    run_scores = scoring.run_scores(deltas)
    noise_ids = noise.select("creation_id")
    scores = checkpointed(scoring.creation_scores(run_scores.join(noise_ids, "creation_id", "left_anti"), w["max_failed_fraction"]))
    c = settings["classify"]
    tau = thresholds.threshold(scores, {"otsu_skimage": "otsu_binned"}.get(c["method"], c["method"]), c["manual_tau"])
    diagnostics = thresholds.diagnostics(scores, c["bimodality_min_separability"], c["bimodality_min_gap_ratio"])
    cross = thresholds.cross_check(scores, c["otsu_agreement_tol"]) if c["cross_check_skimage"] else None
    return Run(chunks, noise, profiles, rewrites, deltas, run_scores, scores, tau, thresholds.classified(scores, tau, c["borderline_band"]), settings, diagnostics, cross, bins, partial)


def purified(texts: DataFrame, pool: DataFrame, settings: dict) -> tuple[Run, list[dict]]:
    """Runs whose profiles are taken from the creations that the run before found authentic, until
    the suspicious set stays the same or the cap is met. The last run, and for each round how many
    creations left the suspicious set and joined it."""
    p = settings["purification"]
    before, profiled, rounds, unchanged = None, None, [], 0
    for n in range(1, p["T_max"] + 1):
        r = run(texts, pool, settings, profiled=profiled)
        labels = checkpointed(r.labels)
        now = labels.where("label = 'suspicious'").select("creation_id")
        if before is None:
            left, joined = 0, now.count()
        else:
            d = experiments.partition_difference(before, now).first()
            left, joined = d["only_first"], d["only_second"]
        rounds.append({"round": n, "left": left, "joined": joined})
        unchanged = unchanged + 1 if before is not None and left + joined == 0 else 0
        before, profiled = now, labels.where("label = 'authentic'").select("creation_id")
        if unchanged >= p["stop_when_unchanged_for"]:
            break
    return r, rounds


def plan(texts: DataFrame, pool: DataFrame, settings: dict, window: int | None = None) -> DataFrame:
    """One row: what a run would take, without a call. Noise texts and creations without words count as they are."""
    m, p = settings["run"]["M"], settings["profile"]
    noise = sampling.noise_assignment(pool, m, settings["run"]["seed"], settings["noise"]["enabled"], settings["noise"]["first_run_plain"], "creation_id")
    words = texts.select("creation_id", tx.n_words(F.col("text")).alias("n_words"))
    of_noise = noise.join(pool.select("creation_id", tx.n_words(F.col("text")).alias("n_words")), "creation_id")
    sizes = words.withColumn("tokens", packing.estimated_tokens(F.col("n_words"), p["tokens_per_word"]))
    budget = p["context_budget_tokens"] or packing.context_budget(window or window_of(settings))
    bins = packing.packed_bins(sizes.select("creation_id", "tokens"), budget).agg(F.max("bin_index")).first()[0]
    return reports.dry_run_plan(words, of_noise, m, (bins if bins is not None else -1) + 1, settings["chunking"]["P"], p["tokens_per_word"])


def shared_sample(texts: DataFrame, settings: dict, size: int) -> DataFrame:
    """creation_id, chunk_index, original of the chunks that a comparison asks of every model."""
    chunks = chunking.chunked(texts, "creation_id", size=settings["chunking"]["P"])
    sample = checkpointed(sampling.round_robin_sample(chunks, size, settings["run"]["seed"]))
    return chunks.join(sample.select("creation_id", "chunk_index"), ["creation_id", "chunk_index"], "left_semi").select("creation_id", "chunk_index", F.col("text").alias("original"))


def compare(texts: DataFrame, providers: list[str], settings: dict, size: int = 20, cache: str | None = None, log: str | None = None, run_id: str = "") -> DataFrame:
    """Each provider's rewrites of one shared sample of chunks: rows by provider and chunk. A provider that can't
    be asked, or fails on every chunk, has failed rows with the reason; it doesn't stop the others."""
    picked = checkpointed(shared_sample(texts, settings, size))
    rules = settings["rewrite"]["validation"]
    out = None
    for name in providers:
        asked = picked.withColumn("prompt", rewriting.rendered_prompt(F.lit("plain"), F.col("original")))
        own = {**settings, "llm": {**settings["llm"], "provider": name}}
        try:
            got = checkpointed(Calls(own, cache, log, run_id).ask(asked, "rewrite", ("creation_id", "chunk_index"), settings["rewrite"]["max_output_tokens"]))
            rows = rewriting.validated(got.withColumnRenamed("response", "rewrite"), rules=rules)
        except Exception as e:  # one bad candidate must not stop the others
            reason = F.lit(f"{type(e).__name__}: {e}".splitlines()[0][:200])
            rows = picked.select("*", F.lit(None).cast("string").alias("rewrite"), F.lit(False).alias("ok"), reason.alias("reason"), F.lit(0.0).alias("length_ratio"), F.lit(0.0).alias("content_retention"))
        rows = rows.select(F.lit(name).alias("model"), F.lit(1).alias("run_index"), "creation_id", "chunk_index", "original", "rewrite", F.when(F.col("ok"), "ok").otherwise("failed").alias("status"), "reason", "length_ratio", "content_retention")
        out = rows if out is None else out.unionByName(rows)
    keys = ["model", "creation_id", "chunk_index"]
    measured = scoring.chunk_deltas(out.withColumn("creation_id", F.concat_ws("\x1f", "model", "creation_id")), settings["distance"]["metric"], rules).select(F.split("creation_id", "\x1f")[0].alias("model"), F.split("creation_id", "\x1f")[1].alias("creation_id"), "chunk_index", "delta")
    return out.join(measured, keys)


def comparison_summary(rows: DataFrame) -> DataFrame:
    """Rows of ``compare`` by model: chunks, sound ones, answers that had to be cleaned, mean and deviation of delta."""
    put_round = F.coalesce(tx.strip(F.col("rewrite")) != tx.cleaned(F.col("rewrite")), F.lit(False))
    return reports.delta_comparison(rows, "model").join(rows.groupBy("model").agg(F.count_if(put_round).alias("n_cleaned")), "model")
