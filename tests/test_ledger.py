import json

import pytest
from pyspark.sql import functions as F

from inkwell import config
from inkwell.operators import ledger
from inkwell.sources import artifacts, declarations, http, ledger_log, texts
from inkwell.streaming import monitor


def line(i, **over):
    prompt = f"p{i}"
    import hashlib

    e = {"schema_version": 1, "ts_utc": f"2031-01-0{1 + i % 3}T10:00:00Z", "run_id": "r", "cache_key": f"k{i}", "tag": "rewrite", "provider": "x", "model_id": "m", "cached": False, "status": "ok", "attempt": 1, "prompt": prompt, "prompt_sha256": hashlib.sha256(prompt.encode()).hexdigest(), "response": "R", "response_sha256": "h", "input_tokens": 1, "output_tokens": 2}
    return json.dumps({**e, **over})


def test_a_torn_tail_is_dropped_and_a_bad_middle_stops(spark, tmp_path):
    p = tmp_path / "calls.jsonl"
    p.write_text("\n".join([line(0), line(1), '{"schema_version": 1, "ts']))
    assert ledger_log.read_ledger(spark, str(p)).count() == 2
    p.write_text("\n".join([line(0), "{bad", line(1)]) + "\n")
    with pytest.raises(Exception, match="bad ledger line"):
        ledger_log.read_ledger(spark, str(p)).collect()


def test_validation(spark, tmp_path):
    p = tmp_path / "calls.jsonl"
    p.write_text("\n".join([line(0), line(1, prompt_sha256="x"), line(2, status="odd"), line(3, response_sha256=None), line(4, tag=None)]) + "\n")
    df = ledger_log.read_ledger(spark, str(p)).withColumn("call_id", F.substring("cache_key", 2, 9).cast("long"))
    assert {r.call_id: r.problems for r in ledger.ledger_problems(df).collect()} == {1: "prompt hash", 2: "status", 3: "no response hash", 4: "missing tag"}


def test_key_leaves_out_the_tag_and_sees_every_field(spark):
    base = {"max_output_tokens": 5, "model_id": "m", "prompt": "p", "prompt_schema_version": 1, "provider": "x", "response_format": "text", "system": None, "temperature": 0.0}
    schema = "max_output_tokens int, model_id string, prompt string, prompt_schema_version int, provider string, response_format string, system string, temperature double, tag string"
    changed = [{**base, "tag": "a"}, {**base, "tag": "b"}, *({**base, "tag": "a", k: (v + 1 if isinstance(v, (int, float)) else f"{v}!")} for k, v in base.items())]
    df = spark.createDataFrame([tuple(c[n] for n in [f.split()[0] for f in schema.split(", ")]) for c in changed], schema)
    keys = [r[0] for r in df.select(ledger.request_key()).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 9


def test_cache(spark):
    calls = spark.createDataFrame([(1, "a", "ok", "old", 1), (2, "a", "ok", "new", 2), (3, "b", "failed", None, 1), (4, "c", "ok", None, 1)], "call_id long, cache_key string, status string, response string, logged_at long")
    cache = ledger.cache_table(calls)
    assert {(r.cache_key, r.response) for r in cache.collect()} == {("a", "new")}
    req = spark.createDataFrame([("a", 1), ("z", 2), ("z", 3), (None, 4)], "cache_key string, n int")
    assert {(r.n, r.hit) for r in ledger.probe(req, cache).collect()} == {(1, True), (2, False), (3, False), (4, False)}
    assert ledger.misses(req, cache).count() == 2
    with pytest.raises(Exception, match="not in the cache"):
        ledger.replayed(req, cache).collect()


def test_longest_prefix(spark):
    known = spark.createDataFrame([("gpt", 1), ("gpt-4", 2), ("z", 3)], "prefix string, w int")
    m = spark.createDataFrame([("gpt-4-turbo",), ("gpt-3",), ("z",), ("q",), (None,)], "model_id string")
    assert {r.model_id: r.w for r in ledger.longest_prefix(m, known).collect()} == {"gpt-4-turbo": 2, "gpt-3": 1, "z": 3, "q": None, None: None}


def test_token_bucket_and_retries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    b = ledger.TokenBucket(60, 2, lambda: now[0], sleep)
    for _ in range(4):
        b.take()
    assert abs(sum(slept) - 2.0) < 1e-6
    b.take(99)  # taken as the capacity
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ledger.TransientError("again")
        return "ok"

    assert ledger.call_with_retries(flaky, 5, lambda s: None) == "ok" and len(calls) == 3
    with pytest.raises(ledger.PermanentError):
        ledger.call_with_retries(lambda: (_ for _ in ()).throw(ledger.PermanentError("no")), 5, lambda s: None)


def test_run_calls_keeps_failures_as_rows(spark):
    def provider(r):
        if r["prompt"] == "bad":
            raise ledger.PermanentError("refused")
        return r["prompt"].upper()

    df = spark.createDataFrame([("a",), ("bad",)], "prompt string")
    got = {r.prompt: (r.response, r.status, r.error_class) for r in ledger.run_calls(df, provider, 2).collect()}
    assert got == {"a": ("A", "ok", ""), "bad": (None, "failed", "PermanentError")}


def test_declarations(spark, tmp_path):
    p = tmp_path / "s.yaml"
    p.write_text("texts:\n- {id: a, title: A, gutenberg_id: 5}\n- {id: b, title: B, gutenberg_id: [1, 2], expected_words: 9}\nnoise_pool:\n- {id: c, title: C, gutenberg_id: null}\n")
    got = declarations.read_declarations(spark, p).orderBy("decl_order").collect()
    assert [(r.id, r.gutenberg_ids, r.set_name) for r in got] == [("a", [5], "texts"), ("b", [1, 2], "texts"), ("c", [], "noise_pool")]
    p.write_text("texts: {id: a}")
    with pytest.raises(ValueError):
        declarations.read_declarations(spark, p)
    p.write_text("texts:\n- {id: a}")
    with pytest.raises(ValueError):
        declarations.read_declarations(spark, p)


def test_text_files(spark, tmp_path):
    (tmp_path / "alpha.txt").write_bytes(b"\xef\xbb\xbfone\ntwo\n")
    (tmp_path / "beta.txt").write_text("three")
    got = texts.read_texts(spark, str(tmp_path))
    assert {r.creation_id: r.text for r in got.collect()} == {"alpha": "one\ntwo\n", "beta": "three"}
    d = spark.createDataFrame([("alpha",), ("gamma",)], "id string")
    assert [r[0] for r in texts.missing_texts(d, got).collect()] == ["gamma"]


def test_mirrors(spark):
    seen = []

    def opener(url, timeout):
        seen.append(url)
        if len(seen) < 3:
            raise OSError("down")
        return "﻿text".encode()

    assert http.fetch_text(7, opener, attempts=2, sleep=lambda s: None) == "text" and "/files/7/" in seen[-1]
    with pytest.raises(OSError):
        http.fetch_text(7, lambda u, t: (_ for _ in ()).throw(OSError("x")), attempts=1, sleep=lambda s: None)


def test_settings(tmp_path):
    (tmp_path / "base.yaml").write_text("chunking: {P: 200}\ncorpus: {exclude_ids: [a, b]}\n")
    (tmp_path / "own.yaml").write_text("extends: base.yaml\ncorpus: {exclude_ids: [c]}\n")
    c = config.build(tmp_path / "own.yaml", environ={"INKWELL_CHUNKING__p": "300", "INKWELL_RUN__SEED": "5"}, sets=["run.m=4"], seed=7)
    assert (c["chunking"]["P"], c["corpus"]["exclude_ids"], c["run"]["M"], c["run"]["seed"]) == (300, ["c"], 4, 7)
    assert config.identity(c) == config.identity(json.loads(json.dumps(c, sort_keys=True)))
    (tmp_path / "loop.yaml").write_text("extends: loop.yaml\n")
    for bad in (lambda: config.build(tmp_path / "loop.yaml"), lambda: config.build(sets=["nope.x=1"]), lambda: config.build(sets=["classify.method=manual"]), lambda: config.validated({"x": 1}), lambda: config.build(sets=["rewrite.validation.min_length_ratio=3"]), lambda: config.build(sets=["run.M=text"])):
        with pytest.raises(config.ConfigError):
            bad()
    for preset in config.PRESETS:
        config.build(preset=preset)


def test_runs_are_written_once(spark, tmp_path):
    p = artifacts.open_run(spark, str(tmp_path / "r"))
    assert not artifacts.is_complete(spark, p) and artifacts.read_text(spark, f"{p}/run.json") is None
    artifacts.write_json(spark, f"{p}/run.json", {"ended_utc": None})
    assert artifacts.open_run(spark, p) == p  # broken off
    artifacts.write_json(spark, f"{p}/run.json", {"ended_utc": "é"})
    assert artifacts.read_text(spark, f"{p}/run.json").count("é") == 1
    with pytest.raises(FileExistsError):
        artifacts.open_run(spark, p)


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(line(i, status="failed" if i == 1 else "ok") for i in range(6)) + "\n")
    q = monitor.throughput(monitor.ledger_stream(spark, str(src)), "1 day").writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    got = {(str(r.window_start)[:10], r.n_calls, r.n_failed) for r in spark.table("seen").collect()}
    want = {(str(r.window_start)[:10], r.n_calls, r.n_failed) for r in ledger.call_timeline(spark.read.schema(ledger_log.LEDGER_SCHEMA).json(str(src)), "1 day").collect()}
    assert got == want and len(got) == 3


def _counting(folder, most=None):
    def call(request):
        made = list(folder.iterdir())
        if most is not None and len(made) >= most:
            raise ledger.PermanentError("the power went out")
        (folder / f"{request['prompt']}-{len(made)}").write_text("x")
        return request["prompt"].upper()

    return call


def _requests(spark, n, **over):
    base = {"max_output_tokens": 5, "model_id": "m", "prompt_schema_version": 1, "provider": "x", "response_format": "text", "system": None, "temperature": 0.0, "tag": "rewrite", **over}
    schema = "n int, prompt string, max_output_tokens int, model_id string, prompt_schema_version int, provider string, response_format string, system string, temperature double, tag string"
    return spark.createDataFrame([(i, f"p{i}", *(base[f.split()[0]] for f in schema.split(", ")[2:])) for i in range(n)], schema)


def test_a_broken_run_is_gone_on_with(spark, tmp_path):
    calls = tmp_path / "made"
    calls.mkdir()
    cache, log, req = str(tmp_path / "cache"), str(tmp_path / "log"), _requests(spark, 40)
    own = dict(cache=cache, log=log, concurrency=1, per_minute=1e6, tokens_per_minute=1e9)
    first = ledger.answered(req, _counting(calls, 17), ("n",), run_id="1", **own)
    assert first.where("status = 'ok'").count() == 17 and first.where("error_class = 'PermanentError'").count() == 23 and len(list(calls.iterdir())) == 17
    again = ledger.answered(req, _counting(calls), ("n",), run_id="2", **own)
    assert {(r.n, r.response) for r in again.collect()} == {(i, f"P{i}") for i in range(40)} and len(list(calls.iterdir())) == 40 and again.where("cached").count() == 17
    ledger.answered(req, _counting(calls), ("n",), run_id="3", **own)
    assert len(list(calls.iterdir())) == 40
    lines = ledger_log.read_ledger(spark, log).groupBy("run_id", "status", "cached").count()
    assert {tuple(r) for r in lines.collect()} == {("1", "ok", False, 17), ("1", "failed", False, 23), ("2", "ok", True, 17), ("2", "ok", False, 23), ("3", "ok", True, 40)}
    assert {tuple(r) for r in ledger.remaining(ledger_log.read_ledger(spark, log), ledger.read_cache(spark, cache)).collect()} == {(k, 40, 40, 0) for k in "123"}


def test_modes_and_waves(spark, tmp_path):
    calls = tmp_path / "made"
    calls.mkdir()
    cache, req = str(tmp_path / "cache"), _requests(spark, 6)
    twice = req.unionByName(req.withColumn("n", F.col("n") + 100))  # equal requests are called once
    own = dict(cache=cache, concurrency=1, per_minute=1e6, tokens_per_minute=1e9)
    got = ledger.answered(twice, _counting(calls), ("n",), wave=2, **own)
    assert got.count() == 12 and got.where("cached").count() == 6 and len(list(calls.iterdir())) == 6
    other = ledger.answered(_requests(spark, 6, model_id="other"), _counting(calls), ("n",), **own)
    assert other.count() == 6 and len(list(calls.iterdir())) == 12  # another model's answers are its own
    ledger.answered(req, _counting(calls), ("n",), mode="refresh", **own).count()
    assert len(list(calls.iterdir())) == 18 and ledger.read_cache(spark, cache).count() == 12
    lost = ledger.answered(_requests(spark, 7), _counting(calls), ("n",), mode="replay", **own)
    assert [(r.n, r.error_class) for r in lost.where("status = 'failed'").collect()] == [(6, "CacheMissError")] and len(list(calls.iterdir())) == 18
    assert ledger.answered(req.limit(0), _counting(calls), ("n",), **own).count() == 0


def test_slow_answers_and_token_rates(spark, tmp_path):
    def slow(request):
        import time

        time.sleep(5)

    got = ledger.run_calls(_requests(spark, 1), slow, 1, retries=0, timeout=0.2).first()
    assert (got.status, got.error_class) == ("failed", "TransientError")
    assert ledger.run_calls(_requests(spark, 3, max_output_tokens=10), lambda r: "x", 1, tokens_per_minute=600.0).where("status = 'ok'").count() == 3


def test_prompts_fill_all_places_and_no_others(spark):
    from inkwell.operators import prompts

    assert prompts.places("rewrite") == ["profile", "passage"] and set(prompts.VERSIONS) == set(prompts.TEMPLATES)
    df = spark.createDataFrame([("{x}", "a {profile} b")], "p string, t string")
    assert df.select(prompts.render("rewrite", profile=F.col("p"), passage=F.col("t"))).first()[0].endswith("rewrite:\na {profile} b")
    for bad in ({"profile": F.lit("")}, {"profile": F.lit(""), "passage": F.lit(""), "more": F.lit("")}):
        with pytest.raises(prompts.TemplateError):
            prompts.render("rewrite", **bad)
    with pytest.raises(prompts.TemplateError):
        prompts.render("unheard of")


def test_manifests(spark, tmp_path):
    from inkwell.operators import collection

    found = spark.createDataFrame([("a", "one two three"), ("b", "x y\nProject Gutenberg"), ("c", "")], "creation_id string, text string")
    with pytest.raises(FileNotFoundError):
        artifacts.read_manifest(spark, str(tmp_path / "m"))
    artifacts.write_manifest(str(tmp_path / "m"), collection.manifest(found), collection.totals(found), {"function_words": {"count": 127}})
    assert {r.id: r.n_words for r in artifacts.read_manifest(spark, str(tmp_path / "m")).collect()} == {"a": 3, "b": 4, "c": 0}
    m = json.loads((tmp_path / "m" / "manifest.json").read_text())
    assert m["totals"]["n_texts"] == 3 and m["totals"]["n_words"] == 7 and m["function_words"]["count"] == 127
    expected = spark.createDataFrame([(100,), (None,)], "expected_words int")
    assert {tuple(r) for r in collection.collection_findings(found, 49, expected).collect()} == {("b", "boilerplate", "failure"), ("*", "text_count", "failure"), ("*", "total_outside_band", "warning")}
    assert [tuple(r) for r in collection.collection_findings(found, 3).collect()] == [("b", "boilerplate", "failure")]


def test_fetching_asks_only_for_what_is_not_there(spark, tmp_path):
    numbers = spark.createDataFrame([(1,), (2,), (3,), (3,)], "number int")
    folder = str(tmp_path / "raw")
    assert texts.missing_numbers(numbers, texts.read_raw_cache(spark, folder)).count() == 3
    spark.createDataFrame([(1, "t", None), (2, None, "down")], "number int, text string, error string").write.parquet(folder)
    assert sorted(r[0] for r in texts.missing_numbers(numbers, texts.read_raw_cache(spark, folder)).collect()) == [2, 3]


def test_mirrors_as_a_data_source(spark):
    class Fake(http.MirrorSource):
        opener = staticmethod(lambda url, timeout: f"text of {url[-10:]}".encode() if "/7/" not in url else b"\xff")

    spark.dataSource.register(Fake)
    got = {r.number: r for r in spark.read.format("inkwell_mirrors").option("numbers", "5, 6,5").load().collect()}
    assert set(got) == {5, 6} and got[5].text.startswith("text of") and got[6].error is None
    assert spark.read.format("inkwell_mirrors").load().count() == 0
