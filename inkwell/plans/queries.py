"""Queries over whole tables, one for each operator of the core.

Integers come out as BIGINT and doubles rounded to six places, so that rows compare
between engines.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import chunking, collection, distance, experiments, ingest, ledger, packing, reports, rewriting, sampling, scoring, thresholds
from ..session import checkpointed, spread
from ..sources import ledger_log

N_RUNS = 3
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def comparable(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("bigint").alias(c) if k in ("int", "smallint", "tinyint") else F.round(c, 6).alias(c) if k in ("double", "float") else F.col(c) for c, k in kinds.items()])


class Tables:
    """The tables of a folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return comparable(f(Tables(spark, folder)))

    QUERIES[f.__name__] = run
    return f


# --- sources and the collection -------------------------------------------------------


@query
def src_declarations(t):
    d = collection.declarations(t.text_sources)
    return d.select("decl_order", "id", "title", "set_name", F.array_join(F.transform("gutenberg_ids", lambda g: g.cast("string")), ",").alias("numbers"), "expected_words")


@query
def chk_disjoint(t):
    return collection.disjointness(t.text_sources)


@query
def scan_documents(t):
    c = F.col("text")
    return t.documents.select("doc_id", F.length(c).alias("n_code_points"), tx.n_words(c).alias("n_words"))


def _declared(t, *sets):
    return collection.declarations(t.text_sources).where(F.col("set_name").isin(*sets)).select(F.col("id").alias("creation_id"))


@query
def corpus_subset(t):
    docs = t.documents.select("doc_id", "creation_id", "source")
    return collection.subset(docs, _declared(t, "texts", "heldout"), _declared(t, "noise_pool"))


@query
def unknown_includes(t):
    return collection.unknown_ids(t.documents.where("creation_id IS NOT NULL"), t.chunks)


@query
def union_sets(t):
    return collection.all_in_order(t.text_sources).select("set_order", "decl_order", "id")


@query
def corpus_totals(t):
    return collection.totals(t.documents)


@query
def dup_text(t):
    return collection.duplicate_texts(t.documents, "doc_id")


@query
def manifest_reconcile(t):
    chunks = t.chunks
    found = chunks.select("creation_id", "chunk_index", F.sha2("text", 256).alias("s"), tx.n_words(F.col("text")).alias("w")).distinct().groupBy("creation_id")
    found = found.agg(F.sum("w").alias("n_words"), F.format_string("%016x", F.bit_xor(F.conv(F.substring("s", 1, 15), 16, 10).cast("bigint"))).alias("sha256")).withColumnRenamed("creation_id", "id")
    recorded = chunks.where("sha256 IS NOT NULL AND n_words IS NOT NULL").select("creation_id", "chunk_index", F.col("sha256").alias("s"), F.col("n_words").alias("w")).distinct().groupBy("creation_id")
    recorded = recorded.agg(F.sum("w").alias("n_words"), F.format_string("%016x", F.bit_xor(F.conv(F.substring("s", 1, 15), 16, 10).cast("bigint"))).alias("sha256")).withColumnRenamed("creation_id", "id")
    return collection.reconciled(t.text_sources, recorded, found)


@query
def collection_findings(t):
    """The collection as a whole: number of texts, the band round the declared total, boilerplate left in a text."""
    texts = t.documents.select(F.col("doc_id").cast("string").alias("creation_id"), "text")
    return collection.collection_findings(texts, 49, t.text_sources.select("expected_words"))


@query
def join_titles(t):
    return reports.with_titles(t.documents.select("doc_id", "creation_id"), t.text_sources)


# --- normalisation ---------------------------------------------------------------------


@query
def strip_between_markers(t):
    wrapped = F.concat(F.lit("head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n"), F.col("text"), F.lit("\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\ntail"))
    return t.documents.select("doc_id", F.sha2(ingest.between_markers(F.when(F.col("doc_id") % 7 != 0, wrapped).otherwise(F.col("text"))), 256).alias("inner_sha"))


@query
def residual_filter(t):
    return t.documents.where(ingest.has_residue(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 11 == 0, " Project Gutenberg").otherwise("")))).select("doc_id")


@query
def fold_quotes(t):
    return t.documents.select("doc_id", F.sha2(ingest.plain_quotes(F.col("text")), 256).alias("plain_sha"))


@query
def strip_notes(t):
    c = F.concat(F.lit("[Transcriber's note: as printed]\n"), tx.text_or_empty(F.col("text")), F.lit("\nEditor's note on the text\n\nend"))
    return t.documents.select("doc_id", ingest.note_count(c).alias("n_notes"), F.sha2(ingest.without_notes(c), 256).alias("without_sha"))


@query
def collapse_ws(t):
    return t.documents.select("doc_id", F.sha2(ingest.tidy_space(F.col("text")), 256).alias("tidy_sha"))


@query
def front_matter(t):
    return ingest.front_matter(t.documents.select("doc_id", "text")).drop("text")


@query
def normalize_docs(t):
    return ingest.normalized(spread(t.documents.select("doc_id", "text"))).withColumn("text", F.sha2("text", 256))


@query
def composite_docs(t):
    parts = ingest.normalized(t.documents.where("creation_id IS NOT NULL").select("doc_id", "creation_id", "text"))
    return ingest.merged_reports(parts)


@query
def composite_texts(t):
    """Texts of the declared composites (creations of several numbers), assembled from their parts in order."""
    declared = collection.declarations(t.text_sources).where(F.size("gutenberg_ids") > 1).select(F.col("id").alias("creation_id"))
    parts = t.documents.select("doc_id", "creation_id", "text").join(declared, "creation_id", "left_semi")
    return ingest.composed(parts, "doc_id").select("creation_id", F.sha2("text", 256).alias("text_sha"), "n_parts")


@query
def word_count(t):
    return t.chunks.select("creation_id", "chunk_index", tx.n_words(F.col("text")).alias("n_words"))


@query
def text_sha(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))


# --- chunks ---------------------------------------------------------------------------


@query
def chunk_documents(t):
    return chunking.chunked(t.documents, "doc_id").drop("text")


@query
def chunk_counts(t):
    return chunking.chunk_counts(t.documents, "doc_id")


@query
def chunk_tiling_check(t):
    return chunking.tiling(t.chunks)


@query
def chunk_sha(t):
    return chunking.repaired(t.chunks).drop("text")


# --- tokens and distances ---------------------------------------------------------------


@query
def dim_function_words(t):
    return t.spark.createDataFrame([(i, w) for i, w in enumerate(lx.FUNCTION_WORDS, 1)], "code int, word string")


@query
def tokenize_docs(t):
    k = tx.tokens(F.col("text"))
    docs = spread(t.documents.select("doc_id", "text")).select("doc_id", k.alias("k"))
    return docs.select("doc_id", F.size("k").alias("n_tokens"), F.sha2(F.array_join("k", " "), 256).alias("tokens_sha"))


@query
def exact_tokens(t):
    k = t.documents.select("doc_id", tx.exact_tokens(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").alias("n_tokens"), F.sha2(F.array_join("k", " "), 256).alias("tokens_sha"))


@query
def fw_sequence(t):
    return t.chunks.select("creation_id", "chunk_index", F.array_join(tx.function_words(F.col("text")), " ").alias("sequence"))


@query
def fw_encode(t):
    return t.chunks.select("creation_id", "chunk_index", F.hex(tx.encoded(F.col("text"))).alias("codes"))


def _encoded_rewrites(t):
    r = spread(t.rewrites.select("rewrite_id", "original", "rewrite")).select("rewrite_id", "original", tx.cleaned(F.col("rewrite")).alias("cleaned"))
    return distance.with_encodings(r, "original", "cleaned")


@query
def fw_levenshtein(t):
    return _encoded_rewrites(t).select("rewrite_id", F.levenshtein("fw_a", "fw_b").alias("edits"))


@query
def fwed_pairs(t):
    return distance.measured(_encoded_rewrites(t)).drop("fw_a", "fw_b")


@query
def fw_freq_cosine(t):
    return distance.measured(_encoded_rewrites(t), "fw_freq_cosine").select("rewrite_id", "delta")


@query
def fw_freq_manhattan(t):
    return distance.measured(_encoded_rewrites(t), "fw_freq_manhattan").select("rewrite_id", "delta")


@query
def fwed_edit_script(t):
    return distance.edit_scripts(_encoded_rewrites(t), "rewrite_id")


@query
def edit_script_sizes(t):
    """How many edits each pair's script has, by kind: as many in all as the distance counts."""
    e = distance.edit_scripts(_encoded_rewrites(t), "rewrite_id")
    return e.groupBy("rewrite_id").agg(F.count(F.lit(1)).alias("edits"), (F.count_if(F.col("op") == "insert") - F.count_if(F.col("op") == "delete")).alias("grown"))


# --- packing, noise, samples --------------------------------------------------------------


def _sizes(t):
    return t.text_sources.where("expected_words IS NOT NULL").groupBy(F.col("id").alias("creation_id")).agg(F.max("expected_words").alias("n_words")).withColumn("tokens", packing.estimated_tokens(F.col("n_words")))


BUDGET = packing.context_budget(200_000)
PLAN_BUDGET = packing.context_budget(1_000_000)


@query
def token_estimates(t):
    return _sizes(t)


@query
def ffd_bins(t):
    return packing.packed_bins(_sizes(t), BUDGET)


@query
def bin_summary(t):
    return packing.bin_summary(packing.packed_bins(_sizes(t), BUDGET))


def _budgets(t):
    return t.model_catalogue.withColumn("budget", F.floor(F.col("context_window") * lx.CONTEXT_FRACTION).cast("bigint"))


@query
def profile_plan(t):
    """Calls by model: the bins into which first fit packs the collection within the model's own window, and
    one call more that merges them; none where a creation is larger than the window's budget."""
    return packing.calls_by_budget(_sizes(t), _budgets(t)).select("provider", "model_id", "budget", "n_bins", "n_calls", "fits")


def _pool(t):
    return collection.declarations(t.text_sources).where(F.col("set_name").isin("noise_pool", "heldout")).select("id")


def _noise(t):
    return sampling.noise_assignment(_pool(t), N_RUNS, lx.SEED)


@query
def noise_assignment(t):
    return _noise(t)


@query
def run_corpora(t):
    return sampling.run_corpora(t.chunks.select("creation_id").distinct(), _noise(t), N_RUNS)


@query
def roundrobin_sample(t):
    return sampling.round_robin_sample(t.chunks, 100, 7)


@query
def strat_sample(t):
    return sampling.stratified_sample(t.documents.select("doc_id", "source"), "source", "doc_id", 0.1, 5)


# --- cleaning and validation ---------------------------------------------------------------


@query
def strip_fences(t):
    return t.calls.select("call_id", F.sha2(tx.without_fences(F.col("response")), 256).alias("sha"))


@query
def strip_preamble(t):
    return t.calls.where("response IS NOT NULL").select("call_id", F.sha2(tx.without_lead_in(F.col("response")), 256).alias("sha"))


@query
def clean_responses(t):
    return t.calls.select("call_id", F.sha2(tx.cleaned(F.col("response")), 256).alias("sha"))


@query
def refusal_flag(t):
    return t.calls.select("call_id", tx.refuses(tx.cleaned(F.col("response"))).alias("refuses"))


@query
def length_ratio(t):
    return t.rewrites.select("rewrite_id", rewriting.length_ratio(F.col("original"), tx.cleaned(F.col("rewrite"))).alias("length_ratio"))


@query
def content_retention(t):
    r = spread(t.rewrites.select("rewrite_id", "original", "rewrite")).withColumn("cleaned", tx.cleaned(F.col("rewrite")))
    return rewriting.with_retention(r, "original", "cleaned").select("rewrite_id", "content_retention")


@query
def validate_rewrites(t):
    return rewriting.validated(t.rewrites.select("rewrite_id", "original", "rewrite")).select("rewrite_id", "ok", "reason", "length_ratio", "content_retention")


@query
def retry_rounds(t):
    """Chunks rewritten offline until valid; the first round drops words of every third chunk."""
    req = chunking.repaired(t.chunks).select("creation_id", "chunk_index", F.col("text").alias("original"))

    def rewrite(df):
        key = F.concat_ws(":", "creation_id", F.col("chunk_index").cast("string"))
        out = rewriting.hashed_rewrite(F.col("original"), key)
        return df.withColumn("rewrite", F.when((F.col("attempt") == 1) & (F.pmod("chunk_index", F.lit(3)) == 0), F.lit("")).otherwise(out))

    return rewriting.with_retries(req, rewrite, ("creation_id", "chunk_index")).select("creation_id", "chunk_index", "attempts", "ok", "reason")


@query
def failure_report(t):
    return rewriting.failure_report(t.rewrites)


@query
def parse_profiles(t):
    p = rewriting.parsed_profiles(t.calls.where("tag = 'profile'").select("call_id", "response"))
    return p.select("call_id", "structured", rewriting.rendered_profile(F.col("fields")).alias("profile"), F.sha2("free_text", 256).alias("free_sha"))


@query
def render_prompts(t):
    profile = F.create_map(*[F.lit(x) for k in lx.PROFILE_LABELS for x in (k, f"{k} as it stands")])
    prompt = rewriting.rendered_prompt(rewriting.rendered_profile(profile), F.col("text"), F.pmod("chunk_index", F.lit(2)) + 1)
    return t.chunks.select("creation_id", "chunk_index", F.sha2(prompt, 256).alias("prompt_sha")).distinct()


@query
def fake_rewrite_sql(t):
    key = F.concat_ws(":", "creation_id", F.col("chunk_index").cast("string"))
    return t.chunks.select("creation_id", "chunk_index", F.sha2(rewriting.hashed_rewrite(F.col("text"), key), 256).alias("rewrite_sha"))


@query
def fake_rewrite_exact(t):
    return t.chunks.select("creation_id", "chunk_index", F.sha2(rewriting.seeded_rewrite(F.concat(F.lit("Passage to rewrite:\n"), F.col("text")), F.col("text")), 256).alias("rewrite_sha"))


# --- scores ------------------------------------------------------------------------------


def _deltas(t):
    return scoring.chunk_deltas(t.rewrites)


def _runs(t):
    return scoring.run_scores(_deltas(t))


def _scores(t):
    return scoring.creation_scores(_runs(t))


def _kept_scores(t):
    """Scores for plans that read them several times: a row a creation, computed once."""
    return checkpointed(_scores(t))


@query
def chunk_deltas(t):
    return _deltas(t)


@query
def deltas_table(t):
    return reports.deltas_table(_deltas(t))


@query
def run_scores(t):
    return _runs(t)


@query
def creation_scores(t):
    return _scores(t).drop("per_run")


@query
def unscorable_report(t):
    return scoring.unscorable_report(t.chunks, _scores(t))


@query
def scores_pivot(t):
    return scoring.scores_pivot(_runs(t), N_RUNS)


@query
def scores_table(t):
    runs = checkpointed(_runs(t))
    scores = checkpointed(scoring.creation_scores(runs))
    labels = thresholds.classified(scores, thresholds.otsu_exact(scores))
    titles = t.text_sources.groupBy(F.col("id").alias("creation_id")).agg(F.min_by("title", "decl_order").alias("title"))
    return reports.scores_table(scoring.scores_pivot(runs, N_RUNS), scores, labels, titles)


@query
def run_counts(t):
    return reports.run_counts(_scores(t), t.rewrites)


@query
def run_variance_data(t):
    return reports.run_spread(_runs(t))


@query
def otsu_candidates(t):
    return thresholds.otsu_candidates(_kept_scores(t))


@query
def otsu_threshold(t):
    return thresholds.otsu_exact(_kept_scores(t))


@query
def otsu_binned(t):
    return thresholds.otsu_binned(_kept_scores(t))


@query
def gmm_threshold(t):
    return thresholds.gmm_threshold(_kept_scores(t))


@query
def otsu_diagnostics(t):
    return thresholds.diagnostics(_kept_scores(t))


@query
def otsu_crosscheck(t):
    return thresholds.cross_check(_kept_scores(t))


def _labels(t):
    scores = _kept_scores(t)
    return thresholds.classified(scores, thresholds.otsu_exact(scores))


@query
def classify_creations(t):
    return _labels(t)


@query
def partition_equality(t):
    scores = _kept_scores(t)
    a = thresholds.classified(scores, thresholds.otsu_exact(scores)).where("label = 'suspicious'")
    b = thresholds.classified(scores, thresholds.otsu_binned(scores)).where("label = 'suspicious'")
    return experiments.partition_difference(a, b)


@query
def suspicious_topk(t):
    return reports.suspicious(_labels(t), 10)


@query
def markdown_rows(t):
    return reports.markdown_rows(_labels(t).select("creation_id", F.round("score", 6).alias("score"), "label"))


@query
def noise_diagnostics(t):
    runs = checkpointed(_runs(t))
    return reports.noise_diagnostics(runs, _noise(t), thresholds.otsu_exact(checkpointed(scoring.creation_scores(runs))))


@query
def histogram_bins(t):
    return reports.histogram(_kept_scores(t))


@query
def sorted_scatter_data(t):
    return reports.sorted_scatter(_scores(t))


# --- joins and sets -------------------------------------------------------------------------


@query
def join_requests_results(t):
    req = chunking.repaired(t.chunks).select("creation_id", "chunk_index", F.col("n_words").alias("chunk_words"))
    return t.rewrites.select("rewrite_id", "creation_id", "chunk_index", "run_index", "status").join(req, ["creation_id", "chunk_index"])


@query
def ordered_jobs(t):
    return t.calls.select("creation_id", F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"), F.coalesce("run_index", F.lit(-1)).alias("run_index"), "call_id").orderBy("creation_id", "chunk_index", "run_index", "call_id")


@query
def band_join(t):
    """Pairs of creations whose scores differ by at most a band, found by equality on buckets of
    the band's width and its neighbours, not by a theta join."""
    s = thresholds.scorable(_kept_scores(t))
    width = 0.0005
    a = s.withColumn("b", F.floor(F.col("score") / width))
    b = s.select(F.col("creation_id").alias("other_id"), F.col("score").alias("other"), F.explode(F.array(*[F.floor(F.col("score") / width) + d for d in (-1, 0, 1)])).alias("b"))
    return a.join(b, "b").where((F.abs(F.round("score", 6) - F.round("other", 6)) <= width) & (F.col("creation_id") < F.col("other_id"))).select("creation_id", "other_id")


@query
def band_counts(t):
    """How many other creations' scores lie within the band of each creation's: ``band_join`` counted. Equal scores are
    folded, and scores have six places, so a bucket holds at most 500 of them however many creations share one."""
    s = thresholds.scorable(_kept_scores(t)).select("creation_id", F.round(F.col("score") * 1_000_000).cast("bigint").alias("v"))
    width = 500
    values = checkpointed(s.groupBy("v").agg(F.count(F.lit(1)).alias("n"))).withColumn("b", F.floor(F.col("v") / width))
    near = values.select(F.col("v").alias("w"), "n", F.explode(F.array(*[F.col("b") + d for d in (-1, 0, 1)])).alias("b"))
    sums = values.select("v", "b").join(near, "b").where(F.abs(F.col("v") - F.col("w")) <= width).groupBy("v").agg(F.sum("n").alias("n"))
    return s.join(sums, "v").select("creation_id", (F.col("n") - 1).alias("n_near"))


@query
def set_delta(t):
    return experiments.set_delta(_declared(t, "texts"), _declared(t, "heldout", "mixture_sources"))


@query
def control_test(t):
    d = _deltas(t).where("status = 'ok'")
    return experiments.paired_test(d.where("run_index = 1"), d.where("run_index = 2"), ("creation_id", "chunk_index"))


@query
def chunk_stability(t):
    return experiments.stability(_deltas(t))


@query
def size_sensitivity(t):
    return experiments.sensitivity(t.documents, "doc_id", (100, 200, 400, 600))


# --- the call layer ----------------------------------------------------------------------------


@query
def request_key(t):
    return t.calls.select("call_id", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in ledger.KEY_FIELDS if f != "temperature"]), 256).alias("plain_key"))


@query
def request_key_json(t):
    return t.calls.select("call_id", ledger.request_key().alias("key"))


@query
def cache_anti_join(t):
    return ledger.misses(t.calls.where("status = 'failed'").select("cache_key"), ledger.cache_table(t.calls))


@query
def cache_hit_miss(t):
    return ledger.probe(t.calls.select("call_id", "cache_key"), ledger.cache_table(t.calls.where("NOT cached")))


@query
def cache_verify(t):
    """Over the cache: the newest line of each key with status ok and a response. Older lines and
    lines without a response are not looked at, so n_empty is 0."""
    return ledger.cache_problems(ledger.cache_table(t.calls))


@query
def replay_lookup(t):
    return ledger.replayed(t.calls.where("cached").select("call_id", "cache_key"), ledger.cache_table(t.calls), strict=False).select("call_id", F.sha2("response", 256).alias("response_sha"))


@query
def ledger_validate(t):
    return ledger.ledger_problems(t.calls)


@query
def ledger_summary(t):
    return ledger.ledger_summary(t.calls)


@query
def rollup_tag(t):
    return t.calls.rollup("provider", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum("output_tokens").alias("output_tokens"))


@query
def latest_lines(t):
    return ledger.latest_lines(t.calls).select("call_id")


@query
def longest_prefix_match(t):
    known = t.model_catalogue.select(F.col("model_id").alias("prefix"), "context_window")
    return ledger.longest_prefix(t.calls.select("call_id", F.col("model_version").alias("model_id")), known).select("call_id", "prefix", "context_window")


@query
def run_jobs(t):
    """The call layer over all chunks, without a cache: equal requests are called once, and results come in the
    order of their requests."""
    req = t.chunks.dropDuplicates(["creation_id", "chunk_index"]).select("creation_id", "chunk_index", F.col("text").alias("prompt"))
    fields = {"max_output_tokens": F.lit(2048), "model_id": F.lit("offline-seeded"), "prompt_schema_version": F.lit(1), "provider": F.lit("fake"), "response_format": F.lit("text"), "system": F.lit(None).cast("string"), "temperature": F.lit(0.0), "tag": F.lit("rewrite")}
    out = ledger.answered(req.withColumns(fields), lambda r: rewriting.seeded_rewrite_text(r["prompt"], r["prompt"]), ("creation_id", "chunk_index"), per_minute=1e12, tokens_per_minute=1e15)
    return out.select("creation_id", "chunk_index", "status", "cached", F.sha2("response", 256).alias("response_sha")).orderBy("creation_id", "chunk_index")


@query
def resume_calls(t):
    """What each run asked, what the cache answers of it, and what a resumed run still has to call."""
    return ledger.remaining(t.calls, ledger.cache_table(t.calls))


@query
def ledger_scan(t):
    """The ledger written as JSON lines with a torn tail, and read again."""
    fields = [f.split()[0] for f in ledger_log.LEDGER_SCHEMA.split(", ")]
    whole = t.calls.select(F.to_json(F.struct(*fields)).alias("value"), F.lit("calls").alias("_file"), F.col("call_id").alias("_n"))
    torn = t.calls.agg(F.lit('{"schema_version": 1, "ts').alias("value"), F.lit("calls").alias("_file"), (F.max("call_id") + 1).alias("_n"))
    read = ledger_log.parsed_lines(whole.unionByName(torn))
    return read.select("run_id", "cache_key", "tag", "attempt", "cached", "ts_utc", "temperature", F.sha2("response", 256).alias("response_sha"))


@query
def model_comparison(t):
    return reports.model_comparison(t.calls)


@query
def compare_models(t):
    """Two offline models asked for one shared sample of twenty chunks, side by side. The sample is the feature."""
    from . import pipeline

    texts = t.documents.select(F.col("doc_id").cast("string").alias("creation_id"), "text")
    return pipeline.comparison_summary(pipeline.compare(texts, ["fake", "fake_sql"], config.build(environ={}), size=20))


@query
def delta_by_run(t):
    return reports.delta_comparison(_deltas(t), "run_index")


@query
def side_by_side(t):
    return reports.side_by_side(t.rewrites)


@query
def comparison_plan(t):
    """Calls of a comparison by model: every chunk once, and the profile's calls within the model's window."""
    n = t.chunks.select("creation_id", "chunk_index").distinct().agg(F.count(F.lit(1)).alias("n_chunks"))  # one row
    plan = packing.calls_by_budget(_sizes(t), _budgets(t)).crossJoin(F.broadcast(n))
    return plan.select("provider", "model_id", F.col("n_calls").alias("profile_calls"), (F.col("n_chunks") + F.col("n_calls")).alias("n_calls"))


@query
def dry_run_plan(t):
    creations = chunking.repaired(t.chunks).groupBy("creation_id").agg(F.sum("n_words").alias("n_words"))
    # noise texts of which no size is declared count as empty, they aren't left out
    noise = _noise(t).join(_sizes(t).select("creation_id", "n_words"), "creation_id", "left").na.fill({"n_words": 0})
    own = checkpointed(creations.withColumn("tokens", packing.estimated_tokens(F.col("n_words"))))
    counted = [(r["tokens"], r["count"]) for r in own.groupBy("tokens").count().collect()]  # at most a row a size
    return reports.dry_run_plan(own, noise, N_RUNS, packing.bins_needed(packing.first_fit(counted, max([PLAN_BUDGET, *(s for s, _ in counted)]))))


@query
def ledger_throughput(t):
    return ledger.call_timeline(t.calls).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query
def event_throughput(t):
    w = F.window("ts", "1 hour")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")
