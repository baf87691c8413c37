"""The call layer: keys, the response cache, the ledger, and running calls."""

from __future__ import annotations

import functools
import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexicon import TOKENS_PER_WORD
from ..session import checkpointed
from ..sources import ledger_log

SCHEMA_VERSION = 1
KEY_FIELDS = ("max_output_tokens", "model_id", "prompt", "prompt_schema_version", "provider", "response_format", "system", "temperature")
REQUIRED_FIELDS = ("schema_version", "ts_utc", "run_id", "cache_key", "tag", "provider", "model_id", "cached", "status", "attempt", "prompt", "prompt_sha256")


class TransientError(Exception):
    """A call that may succeed when it is made again."""


class PermanentError(Exception):
    """A call that fails however often it is made."""


class CacheMissError(PermanentError):
    """A call that replay mode may not make."""


def request_key(df: DataFrame | None = None) -> Column:
    """The hash of what decides a response: the fields in alphabetical order as JSON, nulls kept.
    What a call is for (its tag) is none of them."""
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in KEY_FIELDS]), {"ignoreNullFields": "false"}), 256)


def cache_table(calls: DataFrame) -> DataFrame:
    """The newest sound response of each key. Only keys and ids are shuffled to find it."""
    sound = calls.where("status = 'ok' AND response IS NOT NULL")
    newest = sound.groupBy("cache_key").agg(F.max(F.struct("logged_at", "call_id"))["call_id"].alias("call_id"))
    return sound.join(newest, ["cache_key", "call_id"], "left_semi")


def probe(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests`` with ``hit``. Keys are made distinct before they meet the requests."""
    keys = cache.select("cache_key").distinct().withColumn("_hit", F.lit(True))
    return requests.join(keys, "cache_key", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct requests that the cache doesn't answer: each is called once."""
    return requests.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])


def replayed(requests: DataFrame, cache: DataFrame, strict: bool = True) -> DataFrame:
    """Requests with the response recorded under their key; in strict mode a miss stops the job."""
    once = cache.groupBy("cache_key").agg(F.max("response").alias("_r"))  # keys that stand twice don't multiply requests
    out = requests.join(once, "cache_key", "left")
    r = F.coalesce("_r", F.raise_error(F.concat(F.lit("not in the cache: "), F.col("cache_key")))) if strict else F.col("_r")
    return out.withColumn("response", r).drop("_r")


def cache_problems(cache: DataFrame) -> DataFrame:
    """Totals of a cache table and how many entries are unsound: no response, or a hash that
    isn't the response's."""
    bad_hash = F.coalesce(F.sha2("response", 256) != F.col("response_sha256"), F.lit(True))
    return cache.agg(F.count(F.lit(1)).alias("n_entries"), F.coalesce(F.sum(F.octet_length("response").cast("bigint")), F.lit(0)).alias("n_bytes"), F.count_if(F.col("response").isNull()).alias("n_empty"), F.count_if(bad_hash).alias("n_bad_hash"))


def ledger_problems(calls: DataFrame) -> DataFrame:
    """call_id and problems of every line that breaks a rule of the ledger."""
    missing = [F.when(F.col(f).isNull(), F.lit(f"missing {f}")) for f in REQUIRED_FIELDS]
    rules = [
        F.when(F.col("schema_version") != SCHEMA_VERSION, F.lit("schema_version")), F.when(~F.col("status").isin("ok", "failed"), F.lit("status")),
        F.when((F.col("status") == "ok") & (F.coalesce("response_sha256", F.lit("")) == ""), F.lit("no response hash")),
        F.when((F.coalesce("prompt", F.lit("")) != "") & (F.coalesce("prompt_sha256", F.lit("")) != F.sha2("prompt", 256)), F.lit("prompt hash")),
    ]
    out = calls.select("call_id", F.array_join(F.array_compact(F.array(*missing, *rules)), "; ").alias("problems"))
    return out.where("problems <> ''")


def ledger_summary(calls: DataFrame) -> DataFrame:
    """Totals and totals by tag in one pass (tag '*' is the total)."""
    live = ~F.col("cached")
    out = calls.withColumn("tag", F.coalesce("tag", F.lit(""))).rollup("tag").agg(
        F.grouping("tag").alias("_g"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if("cached").alias("cached"), F.count_if(live).alias("live"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )
    return out.withColumn("tag", F.when(F.col("_g") == 1, "*").otherwise(F.col("tag"))).drop("_g")


def latest_lines(calls: DataFrame) -> DataFrame:
    """One line for each call: lines written twice, and late ones, leave the last to arrive. Only
    narrow columns are ranked."""
    keys = ["run_id", "cache_key", "tag", "attempt", "cached"]
    w = Window.partitionBy(*keys, "ts_utc").orderBy(F.desc("logged_at"), F.desc("call_id"))
    return calls.select("call_id", *keys, "ts_utc", "logged_at").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("call_id", *keys, "ts_utc", "logged_at")


def longest_prefix(models: DataFrame, known: DataFrame, model_col: str = "model_id", known_col: str = "prefix") -> DataFrame:
    """``models`` with what is known of the longest listed prefix of their id (itself, if listed).
    The prefixes of an id are looked up by equality, so no theta join is needed."""
    ids = models.select(model_col).distinct().where(F.col(model_col).isNotNull())
    cut = ids.select(model_col, F.explode(F.expr(f"transform(sequence(1, length({model_col})), n -> substring({model_col}, 1, n))")).alias(known_col))
    best = cut.join(known, known_col).groupBy(model_col).agg(F.max(F.struct(F.length(known_col).alias("n"), F.struct(*known.columns).alias("k")))["k"].alias("k"))
    return models.join(best.select(model_col, "k.*"), model_col, "left")


class TokenBucket:
    """A limiter with continuous refill. A demand above the capacity is taken as the capacity."""

    def __init__(self, per_minute: float, capacity: float | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, timeout: float = 300.0) -> None:
        self.rate, self.capacity = per_minute / 60.0, capacity or per_minute
        self.level, self.clock, self.sleep, self.timeout = self.capacity, clock, sleep, timeout
        self.at, self.lock = clock(), threading.Lock()

    def take(self, n: float = 1.0) -> None:
        need, began = min(n, self.capacity), self.clock()
        while True:
            with self.lock:
                now = self.clock()
                self.level, self.at = min(self.capacity, self.level + (now - self.at) * self.rate), now
                if self.level >= need:
                    self.level -= need
                    return
                wait = (need - self.level) / self.rate
            if now + wait - began > self.timeout:
                raise TransientError("the rate limit was not met in time")
            self.sleep(wait)


def call_with_retries(call: Callable[[], str], retries: int = 5, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> str:
    """The call's answer; transient errors are tried again after growing, jittered pauses."""
    rng = rng or random.Random(0)
    for n in range(retries + 1):
        try:
            return call()
        except TransientError:
            if n == retries:
                raise
            sleep(min(60.0, 2.0**n) * (0.5 + rng.random()))
    raise AssertionError


ANSWER_FIELDS = "response string, status string, error string, error_class string, latency_ms int"


def run_calls(requests: DataFrame, provider: Callable[[dict], str], concurrency: int = 8, per_minute: float = 1e9, retries: int = 5, tokens_per_minute: float = 1e12, timeout: float = 120.0, per_word: float = TOKENS_PER_WORD) -> DataFrame:
    """``requests`` with response, status, error, error_class, latency_ms. Rows are spread over ``concurrency``
    tasks, each with its share of both rates (a call takes its prompt's tokens and its ``max_output_tokens``); an
    answer that takes longer than ``timeout`` seconds is a transient error; a failed call is a row, it doesn't stop the job."""
    schema = f"{requests.schema.simpleString()[7:-1]}, {ANSWER_FIELDS}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls, tokens = TokenBucket(per_minute / concurrency), TokenBucket(tokens_per_minute / concurrency)
        pool = ThreadPoolExecutor(1)

        def one(request: dict) -> str:
            calls.take()
            tokens.take(len((request.get("prompt") or "").split()) * per_word + (request.get("max_output_tokens") or 0))
            try:
                return pool.submit(provider, request).result(timeout)
            except FutureTimeout as e:
                raise TransientError(f"no answer within {timeout} seconds") from e

        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                began = time.monotonic()
                try:
                    got = (call_with_retries(lambda r=r: one(r), retries), "ok", "", "")
                except (TransientError, PermanentError) as e:
                    got = (None, "failed", str(e), type(e).__name__)
                rows.append((*got, int((time.monotonic() - began) * 1000)))
            names = [f.split()[0] for f in ANSWER_FIELDS.split(", ")]
            yield b.assign(**{c: pd.Series([r[i] for r in rows], index=b.index, dtype="int32" if c == "latency_ms" else object) for i, c in enumerate(names)})

    return requests.repartition(concurrency).mapInPandas(run, schema)


CACHE_FIELDS = "cache_key string, response string, response_sha256 string, provider string, model_id string, written_at timestamp"


def read_cache(spark: SparkSession, path: str | None) -> DataFrame:
    """The newest answer of each key of a cache folder; no rows where the folder isn't there yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path) if path else None
    if hadoop is None or not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE_FIELDS)
    newest = F.max_by(F.struct("response", "response_sha256", "provider", "model_id", "written_at"), F.struct("written_at", "response_sha256"))
    return spark.read.schema(CACHE_FIELDS).parquet(path).groupBy("cache_key").agg(newest.alias("x")).select("cache_key", "x.*")


def write_cache(answers: DataFrame, path: str) -> None:
    """Sound answers (cache_key, response, provider, model_id), appended. Failures are never cached."""
    sound = answers.where("status = 'ok' AND response IS NOT NULL")
    sound.select("cache_key", "response", F.sha2("response", 256).alias("response_sha256"), "provider", "model_id", F.current_timestamp().alias("written_at")).write.mode("append").parquet(path)


def remaining(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """asked, answered, left: distinct keys of ``requests``, and those that the cache answers or not. One row a run."""
    keys = requests.select("run_id", "cache_key").distinct()
    hit = probe(keys, cache)
    return hit.groupBy("run_id").agg(F.count(F.lit(1)).alias("asked"), F.count_if("hit").alias("answered"), F.count_if(~F.col("hit")).alias("left"))


def answered(
    requests: DataFrame, provider: Callable[[dict], str], identity: tuple[str, ...], *, mode: str = "live", cache: str | None = None, log: str | None = None, run_id: str = "",
    concurrency: int = 8, per_minute: float = 240, tokens_per_minute: float = 1_000_000, retries: int = 5, timeout: float = 120.0, wave: int | None = None,
) -> DataFrame:
    """``requests`` (KEY_FIELDS, tag, and the columns of ``identity``) with cache_key, response, status, error,
    error_class, latency_ms and cached: the whole call layer.

    What the cache folder answers is not called; of equal requests one is. Calls are made in waves of
    ``wave`` (what five minutes of ``per_minute`` allow) and every wave's answers are in the cache before
    the next begins, so a run that is broken off pays for one wave again at most. Mode ``refresh`` calls
    everything again and writes it back; mode ``replay`` calls nothing, and what isn't cached is a failed row
    (CacheMissError). Every outcome, hits too, is a line of ``log``.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("cache_key", request_key())
    known = read_cache(spark, cache if mode != "refresh" else None).select("cache_key", "response")
    lost = F.lit("failed").alias("status"), F.concat(F.lit("not in the cache: "), F.col("cache_key")).alias("error"), F.lit("CacheMissError").alias("error_class"), F.lit(0).alias("latency_ms")
    asked = misses(keyed, known)
    if mode == "replay":
        fresh = asked.select("cache_key", F.lit(None).cast("string").alias("response"), *lost)
    else:
        asked = checkpointed(asked)
        wave = wave or max(1, int(per_minute * 5))
        n = -(-asked.count() // wave)
        parts = []
        for i in range(n):
            part = asked.where(F.pmod(F.xxhash64("cache_key"), F.lit(n)) == i) if n > 1 else asked
            made = checkpointed(run_calls(part, provider, concurrency, per_minute, retries, tokens_per_minute, timeout).select("cache_key", "provider", "model_id", *[f.split()[0] for f in ANSWER_FIELDS.split(", ")]))
            if cache:
                write_cache(made, cache)
            parts.append(made.drop("provider", "model_id"))
        fresh = functools.reduce(DataFrame.unionByName, parts) if parts else asked.select("cache_key", F.lit(None).cast("string").alias("response"), *lost).limit(0)
    first = keyed.groupBy("cache_key").agg(F.min(F.struct(*identity)).alias("_first"))
    answers = known.select("cache_key", "response", F.lit("ok").alias("status"), F.lit("").alias("error"), F.lit("").alias("error_class"), F.lit(0).alias("latency_ms"), F.lit(True).alias("_known"))
    answers = answers.unionByName(fresh.withColumn("_known", F.lit(False)))
    out = keyed.join(answers, "cache_key").join(first, "cache_key")
    # of equal requests the first was called, the others were served from its answer
    out = out.withColumn("cached", (F.col("status") == "ok") & (F.col("_known") | (F.struct(*identity) != F.col("_first")))).drop("_known", "_first")
    if log:
        out = checkpointed(out)
        append_lines(out, log, run_id)
    return out


def append_lines(outcomes: DataFrame, path: str, run_id: str) -> None:
    """A line of the ledger for every outcome of ``answered``."""
    own = set(outcomes.columns)

    def field(name: str, kind: str) -> Column:
        return (F.col(name) if name in own else F.lit(None)).cast(kind).alias(name)

    made = {
        "schema_version": F.lit(SCHEMA_VERSION), "ts_utc": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "run_id": F.lit(run_id), "attempt": F.coalesce(F.col("attempt"), F.lit(1)) if "attempt" in own else F.lit(1),
        "prompt_sha256": F.sha2("prompt", 256), "response_sha256": F.sha2("response", 256), "model_version": F.col("model_id"),
        "input_tokens": F.floor(F.size(F.split("prompt", r"\s+")) * TOKENS_PER_WORD), "output_tokens": F.when(F.col("response").isNotNull(), F.floor(F.size(F.split("response", r"\s+")) * TOKENS_PER_WORD)),
    }
    ledger_log.append_ledger(outcomes.select(*[made[n].cast(k).alias(n) if n in made else field(n, k) for n, k in (f.split() for f in ledger_log.LEDGER_SCHEMA.split(", "))]), path)


def call_timeline(calls: DataFrame, width: str = "1 hour") -> DataFrame:
    """Calls, failures and tokens by window of the call's own time: the batch form of the monitor."""
    ts = F.try_to_timestamp(F.substring("ts_utc", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    w = F.window(ts, width)
    return calls.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.sum("output_tokens").alias("output_tokens")).select(F.col("w.start").alias("window_start"), "n_calls", "n_failed", "output_tokens")
