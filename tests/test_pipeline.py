import json

import pytest

from pyspark.sql import functions as F

from inkwell import config
from inkwell.operators import ledger, reports
from inkwell.plans import pipeline
from inkwell.sources import artifacts, ledger_log

PLAIN = "the king of the castle and his brother were riding over the hill because you would not do what we could do upon the road while they have your sword "


def corpus(spark):
    rows = [(f"c{i}", (PLAIN if i % 2 else PLAIN.replace("you", "he").replace("your", "his").replace("do", "see")) * (3 + i)) for i in range(6)]
    pool = [(f"n{i}", f"foreign text number {i} with the words of another hand " * 20) for i in range(4)]
    s = "creation_id string, text string"
    return spark.createDataFrame(rows, s), spark.createDataFrame(pool, s)


@pytest.fixture(scope="module")
def done(spark):
    texts, pool = corpus(spark)
    settings = config.build(preset="mini", sets=["chunking.P=40", "run.M=2"])
    return pipeline.run(texts, pool, settings), pipeline.plan(texts, pool, settings).first(), settings


def test_every_creation_is_scored_and_labelled(done):
    r, _, _ = done
    assert {x.creation_id for x in r.scores.collect()} == {f"c{i}" for i in range(6)}
    assert r.labels.count() == r.scores.where("score IS NOT NULL").count() == 6
    assert all(x.n_runs == 2 for x in r.scores.collect())


def test_the_plan_counts_the_calls(done):
    r, p, _ = done
    assert p.rewrite_calls == r.rewrites.count()
    assert p.n_chunks == r.rewrites.where("run_index = 1 AND NOT is_noise").count()
    assert p.profile_calls == sum(x.n_calls for x in r.profiles.collect())


def test_noise_makes_runs_differ(done):
    r, _, _ = done
    assert {x.run_index for x in r.noise.collect()} == {2}
    assert len({json.dumps(x.fields, sort_keys=True) for x in r.profiles.collect()}) == 2


def test_runs_repeat(spark, done):
    r, _, settings = done
    texts, pool = corpus(spark)
    again = pipeline.run(texts, pool, settings)
    assert sorted(map(tuple, again.labels.collect())) == sorted(map(tuple, r.labels.collect()))


def test_artifacts(done, tmp_path):
    r, _, settings = done
    spark, folder = r.chunks.sparkSession, tmp_path / "run"
    tau = artifacts.threshold_record(r.threshold, r.labels, "otsu_exact", r.diagnostics, r.cross_check)
    record = artifacts.run_record(settings, "abc", "r1", artifacts.datetime.now(artifacts.UTC), {"n_scored": 6}, None, tau)
    written = dict(chunks=r.chunks, rewrites=r.rewrites, deltas=r.deltas.drop("is_noise"), scores=r.scores.drop("per_run"), threshold=tau, labels=r.labels, noise=r.noise, profiles=r.profiles, partial_profiles=r.partial_profiles, packing=r.packing, manifest=record)
    assert not artifacts.is_complete(spark, str(folder))
    p = artifacts.write_run(str(folder), **written)
    assert artifacts.is_complete(spark, p)
    with pytest.raises(FileExistsError):
        artifacts.write_run(p, **written)
    t = json.loads((folder / "threshold.json").read_text())
    assert t["tau"] > 0 and t["n_suspicious"] + t["n_authentic"] == 6 and isinstance(t["flags"], list)
    m = json.loads((folder / "run.json").read_text())
    assert m["counts"] == {"n_scored": 6} and m["threshold"]["tau"] == t["tau"] and m["ended_utc"]
    assert spark.read.json(f"{p}/chunks").count() == r.chunks.count() and spark.read.json(f"{p}/profiles/packing").count() == spark.read.json(f"{p}/profiles/partial").count()


def test_compare(spark):
    texts, _ = corpus(spark)
    got = pipeline.compare(texts, ["fake", "fake_sql"], config.build(sets=["chunking.P=40"]), size=8)
    assert {(r.model, n) for r, n in ((r, got.where(f"model = '{r.model}'").count()) for r in got.select("model").distinct().collect())} == {("fake", 8), ("fake_sql", 8)}
    with pytest.raises(ValueError):
        pipeline.register_provider("fake", pipeline.PROVIDERS["fake"])
    s = {r.model: r for r in pipeline.comparison_summary(got).collect()}
    assert s["fake"].n_chunks == 8 and s["fake"].n_ok == 8 and s["fake"].mean_delta > 0 and s["fake"].n_cleaned == 0


def _broken(request):
    raise pipeline.ledger.PermanentError("no such model")


def test_one_bad_candidate_does_not_stop_the_others(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(pipeline.PROVIDERS, "broken", pipeline.Provider(_broken))
    texts, _ = corpus(spark)
    got = pipeline.compare(texts, ["broken", "unheard of", "fake"], config.build(sets=["chunking.P=40", "llm.concurrency=1"]), size=4).cache()
    assert {(r.model, r.n_ok, r.n_chunks) for r in pipeline.comparison_summary(got).collect()} == {("broken", 0, 4), ("unheard of", 0, 4), ("fake", 4, 4)}
    folder = artifacts.write_comparison(str(tmp_path / "c"), got, pipeline.comparison_summary(got), reports.passages_side_by_side(got), {"seed": 1})
    assert [m["model"] for m in json.loads((tmp_path / "c" / "summary.json").read_text())["models"]] == ["broken", "fake", "unheard of"]
    assert "| fake | 4 |" in (tmp_path / "c" / "summary.md").read_text() and spark.read.option("header", True).csv(f"{folder}/comparison").count() == 12
    page = spark.read.text(f"{folder}/rewrites", wholetext=True).first().value
    assert page.startswith("# c") and "## broken, delta" in page and "## fake, delta" in page


def _lines(spark, log):
    return spark.read.schema(ledger_log.LEDGER_SCHEMA).json(log)


def test_a_run_writes_its_cache_and_lines_and_the_next_one_calls_nothing(spark, tmp_path):
    texts, pool = corpus(spark)
    settings = config.build(preset="mini", sets=["chunking.P=40", "run.M=1"])
    cache, log = str(tmp_path / "cache"), str(tmp_path / "calls")
    plain = pipeline.run(texts, pool, settings)
    r = pipeline.run(texts, pool, settings, cache, log=log, run_id="a")
    assert sorted(map(tuple, r.labels.collect())) == sorted(map(tuple, plain.labels.collect()))
    own = _lines(spark, log)
    assert ledger.ledger_problems(own.withColumn("call_id", F.monotonically_increasing_id())).count() == 0
    n = r.rewrites.count() + r.partial_profiles.count()
    assert own.count() == n and own.where("NOT cached").count() == own.select("cache_key").distinct().count() == ledger.read_cache(spark, cache).count()
    pipeline.run(texts, pool, settings, cache, log=log, run_id="b")
    assert _lines(spark, log).where("run_id = 'b' AND NOT cached").count() == 0 and _lines(spark, log).where("run_id = 'b'").count() == n
    replay = config.build(preset="mini", sets=["chunking.P=40", "run.M=1", "llm.mode=replay"])
    assert sorted(map(tuple, pipeline.run(texts, pool, replay, cache).labels.collect())) == sorted(map(tuple, plain.labels.collect()))
    with pytest.raises(Exception, match="not in the cache"):
        pipeline.run(texts, pool, config.build(preset="mini", sets=["chunking.P=40", "run.M=1", "llm.mode=replay", "llm.temperature=0.5"]), cache).labels.collect()
    refresh = config.build(preset="mini", sets=["chunking.P=40", "run.M=1", "llm.mode=refresh"])
    pipeline.run(texts, pool, refresh, cache, log=log, run_id="c")
    assert _lines(spark, log).where("run_id = 'c' AND NOT cached").count() > 0 and ledger.read_cache(spark, cache).count() == own.select("cache_key").distinct().count()


@pytest.mark.parametrize(
    "key,value",
    [
        ("rewrite.validation.min_length_ratio", "1.5"), ("rewrite.validation.max_length_ratio", "0.7"), ("rewrite.validation.min_content_retention", "1.1"), ("rewrite.max_failed_fraction", "-1.0"),
        ("classify.otsu_agreement_tol", "-1.0"), ("classify.bimodality_min_separability", "2.0"), ("classify.bimodality_min_gap_ratio", "99.0"), ("profile.structured_output", "false"), ("distance.metric", "fw_freq_cosine"), ("classify.borderline_band", "1.0"),
    ],
)
def test_settings_change_rows(spark, done, key, value):
    texts, pool = corpus(spark)

    def seen(r):
        return (
            sorted(map(str, r.rewrites.select("creation_id", "status", "reason").collect())), sorted(map(str, r.scores.select("creation_id", "score", "unreliable").collect())), str(r.diagnostics.collect()), str(r.cross_check.select("same_gap").collect()),
            sorted(map(str, r.profiles.collect())), sorted(map(str, r.labels.collect())),
        )

    sets = ["chunking.P=40", "run.M=1", "rewrite.max_retries=0"]
    if key == "rewrite.validation.max_length_ratio":
        sets.append("rewrite.validation.min_length_ratio=0.1")
    if "base" not in _SEEN:
        _SEEN["base"] = seen(pipeline.run(texts, pool, config.build(preset="mini", sets=list(sets[:3]))))
    try:
        got = seen(pipeline.run(texts, pool, config.build(preset="mini", sets=[*sets, f"{key}={value}"])))
    except Exception as e:  # no creation is left to be scored
        assert "threshold needs" in str(e) or "no threshold" in str(e)
    else:
        assert got != _SEEN["base"]


_SEEN: dict = {}


def test_purification_stops_when_the_set_stays(spark):
    texts, pool = corpus(spark)
    r, rounds = pipeline.purified(texts, pool, config.build(preset="mini", sets=["chunking.P=40", "run.M=1", "purification.T_max=3"]))
    assert 2 <= len(rounds) <= 3 and rounds[0]["left"] == 0 and r.labels.count() == 6
    assert len(rounds) == 3 or rounds[-1]["left"] + rounds[-1]["joined"] == 0


def test_rates_hold_for_remote_providers_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pipeline.ledger, "answered", lambda df, *a, **k: seen.append((k["per_minute"], k["tokens_per_minute"], k["concurrency"], k["retries"], k["timeout"])) or df.withColumns({"response": F.lit("x"), "error_class": F.lit(""), "error": F.lit("")}))
    monkeypatch.setitem(pipeline.PROVIDERS, "far", pipeline.Provider(_broken))
    df = spark.createDataFrame([(1, "p", "o")], "n int, prompt string, original string")
    for name in ("far", "fake"):
        settings = config.build(sets=[f"llm.provider={name}", "llm.requests_per_minute=7", "llm.tokens_per_minute=70", "llm.concurrency=3", "llm.max_transient_retries=2", "llm.timeout_seconds=9"])
        assert pipeline.Calls(settings, cache="unused").ask(df, "rewrite", ("n",), 5).first().response == "x"
    assert seen == [(7, 70, 3, 2, 9), (1e12, 1e15, 3, 2, 9)]
