import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import lexicon as lx
from inkwell.functions import text as tx
from inkwell.operators import chunking, distance, ordered, packing, rewriting, sampling, scoring


def delta(spark, a, b, name="fwed"):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    return distance.measured(distance.with_encodings(df, "a", "b"), name).first()


@pytest.mark.parametrize(
    "a,b,expected",
    [
        ("Do you know what he does when the night comes?", "Dost thou know what he doth when the night comes?", 0.5),
        ("the cat sat", "the cat sat on the mat", 2 / 3),
        ("cat sat", "dog ran", 0.0), ("cat sat", "the dog", 1.0), ("the", "", 1.0), (None, None, 0.0),
    ],
)
def test_edit_distance_golden(spark, a, b, expected):
    r = delta(spark, a, b)
    assert abs(r.delta - expected) < 1e-12
    assert r.degenerate == (r.n_a == 0 and r.n_b == 0)


def test_edit_script_golden(spark):
    df = spark.createDataFrame([(1, "Do you know what he does when the night comes?", "Dost thou know what he doth when the night comes?"), (2, "the cat sat", "the cat sat on the mat")], "k int, a string, b string")
    got = sorted((r.k, r.step, r.op, r["from_word"], r["to_word"]) for r in distance.edit_scripts(distance.with_encodings(df, "a", "b"), "k").collect())
    assert got == [(1, 0, "replace", "do", "dost"), (1, 1, "replace", "you", "thou"), (1, 2, "replace", "does", "doth"), (2, 0, "insert", None, "on"), (2, 1, "insert", None, "the")]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


words = st.lists(st.sampled_from(["the", "of", "thou", "you", "cat", "and"]), max_size=12).map(" ".join)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=15))
def test_distances_against_brute_force(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    enc = distance.with_encodings(df, "a", "b")
    for name in distance.available():
        for r in distance.measured(enc, name).collect():
            assert 0 <= r.delta <= 1
    for r in distance.measured(enc).collect():
        x, y = ([w for w in s.split() if w in lx.FUNCTION_WORDS] for s in pairs[r.i])
        assert abs(r.delta - (levenshtein(x, y) / max(len(x), len(y)) if x or y else 0)) < 1e-12
    scripts = distance.edit_scripts(enc, "i").groupBy("i").count().collect()
    for i, n in scripts:
        x, y = ([w for w in s.split() if w in lx.FUNCTION_WORDS] for s in pairs[i])
        assert n == levenshtein(x, y)


def test_registry():
    assert {"fwed", "fw_freq_cosine", "fw_freq_manhattan"} <= set(distance.available())
    with pytest.raises(ValueError):
        distance.register("fwed", distance.edit_distance)
    with pytest.raises(ValueError, match="fwed"):
        distance.build_distance("nope")


@pytest.mark.parametrize("n,size", [(0, 5), (1, 5), (5, 5), (6, 5), (23, 4), (7, 1)])
def test_chunks_cover_the_text(spark, n, size):
    w = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([("c", "  \n ".join(w), "x")], "id string, text string, creation_id string")
    got = sorted((r.chunk_index, r.text, r.n_words, r.word_start, r.word_end) for r in chunking.chunked(df, "id", size=size).collect())
    assert " ".join(g[1] for g in got).split() == w
    assert [g[3] for g in got] == list(range(0, n, size)) and all(e - s == k <= size for _, _, k, s, e in got)
    assert chunking.chunk_counts(df, "id", size=size).first().n_chunks == len(got)


def test_chunks_of_null_text_and_bad_size(spark):
    assert chunking.chunked(spark.createDataFrame([("c", None)], "id string, text string"), "id").count() == 0
    with pytest.raises(ValueError):
        chunking.chunked(spark.createDataFrame([("c", "x")], "id string, text string"), "id", size=0)


def first_fit_by_item(sizes, room):
    bins, out = [], {}
    for i, s in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        k = next((k for k, left in enumerate(bins) if left >= s), None)
        if k is None:
            bins.append(room)
            k = len(bins) - 1
        bins[k] -= s
        out[i] = k
    return out


@pytest.mark.parametrize("seed", range(6))
def test_bins_equal_item_by_item_first_fit(spark, seed):
    rng = random.Random(seed)
    sizes = {f"c{i:03}": rng.choice([0, 1, 5, 30, 60, rng.randint(1, 100)]) for i in range(rng.choice([1, 7, 60, 200]))}
    df = spark.createDataFrame(list(sizes.items()), "creation_id string, tokens long")
    assert {r.creation_id: r.bin_index for r in packing.packed_bins(df, 110, 10).collect()} == first_fit_by_item(sizes, 100)


def test_bins_golden_and_errors(spark):
    df = spark.createDataFrame([("b_large", 600), ("d_large", 600), ("a_small", 400), ("c_small", 400)], "creation_id string, tokens long")
    got = {r.creation_id: r.bin_index for r in packing.packed_bins(df, 1000).collect()}
    assert got == {"a_small": 0, "b_large": 0, "c_small": 1, "d_large": 1}
    assert {r.n_creations for r in packing.bin_summary(packing.packed_bins(df, 1000)).collect()} == {2}
    with pytest.raises(ValueError, match="b_large"):
        packing.packed_bins(df, 500)
    with pytest.raises(ValueError):
        packing.packed_bins(df, 100, 100)
    assert packing.packed_bins(df.limit(0), 100).count() == 0


def test_token_estimate(spark):
    assert spark.range(1).select(packing.estimated_tokens(F.lit(1000))).first()[0] == 1350


def test_positions_and_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 20) / 7, i, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "v double, id int, g int")
    got = {r.id: (r.pos, r.sum_v) for r in ordered.with_position(df, F.col("v"), F.col("id"), sums=("v",)).collect()}
    total = 0.0
    for k, (v, i, _) in enumerate(sorted(rows), 1):
        total += v
        assert got[i][0] == k and abs(got[i][1] - total) < 1e-9
    by = {r.id: r.pos for r in ordered.with_position(df, F.col("v"), F.col("id"), by=("g",)).collect()}
    for g in range(3):
        assert [by[i] for _, i, _ in sorted(r for r in rows if r[2] == g)] == list(range(1, len([r for r in rows if r[2] == g]) + 1))
    assert ordered.with_position(df.limit(0), F.col("v")).count() == 0


def test_noise_assignment(spark):
    pool = spark.createDataFrame([(f"n{i}",) for i in range(10)], "id string")
    got = {r.run_index: r.creation_id for r in sampling.noise_assignment(pool, 4, 12).collect()}
    assert got == {2: "n2", 3: "n3", 4: "n4"}
    assert len({r.creation_id for r in sampling.noise_assignment(pool, 11, 8).collect()}) == 10
    assert sampling.noise_assignment(pool, 3, 0, enabled=False).count() == 0
    assert sampling.noise_assignment(pool, 1, 0).count() == 0
    with pytest.raises(ValueError):
        sampling.noise_assignment(pool, 12, 0)


def sample_by_rounds(chunks, size, seed):
    out = []
    for r in range(size):
        for name in sorted(chunks):
            if len(out) >= size:
                return out
            c = (name, chunks[name][(seed + r) % len(chunks[name])])
            if c not in out:
                out.append(c)
    return out


@pytest.mark.parametrize("size,seed", [(1, 0), (5, 3), (12, 7), (100, 2)])
def test_round_robin_sample(spark, size, seed):
    chunks = {"a": list(range(2)), "b": list(range(9)), "c": [0], "d": list(range(4))}
    df = spark.createDataFrame([(k, i) for k, v in chunks.items() for i in v], "creation_id string, chunk_index int")
    got = {(r.creation_id, r.chunk_index) for r in sampling.round_robin_sample(df, size, seed).collect()}
    assert got == set(sample_by_rounds(chunks, size, seed))


def test_validation_cascade(spark):
    o = " ".join(["castle", "river", "the", "of"] * 5)
    cases = {"": "empty", "```\n```": "empty", "I cannot do this": "refusal", "castle river": "too_short", o + " " + o: "too_long", " ".join(["moon", "sun", "the", "of"] * 5): "content_lost", o: None, f"Sure:\n{o}": None}
    df = spark.createDataFrame([(o, k) for k in cases], "original string, rewrite string")
    assert {r.rewrite: r.reason for r in rewriting.validated(df).collect()} == cases


def test_retries_only_ask_failures_again(spark):
    o = "castle river mountain stone"
    df = spark.createDataFrame([("a", 0, o), ("b", 1, o), ("c", 9, o)], "creation_id string, chunk_index int, original string")
    rw = lambda d: d.withColumn("rewrite", F.when(F.col("attempt") > F.col("chunk_index"), F.col("original")).otherwise(""))
    got = {r.creation_id: (r.attempts, r.ok, r.reason) for r in rewriting.with_retries(df, rw, ("creation_id",)).collect()}
    assert got == {"a": (1, True, None), "b": (2, True, None), "c": (3, False, "empty")}


def test_profiles(spark):
    cases = [('```json\n{"vocabulary": " plain ", "other": 3, "pronouns": "", "x": "y", "verb_forms": ["a"]}\n```', {"vocabulary": "plain", "other": "3"}), ('Here: {"punctuation": "light"} done', {"punctuation": "light"}), ("no json", None), ('{"vocabulary": "cut', None), (None, None), ("[1]", None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, response string")
    got = {r.i: r for r in rewriting.parsed_profiles(df).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i].fields == want and got[i].structured == (want is not None)
    assert got[2].free_text == "no json"


def test_offline_rewriters_are_deterministic(spark):
    df = spark.createDataFrame([("You are what you do, and your will shall be done.",)], "t string")
    e = (rewriting.hashed_rewrite(F.col("t"), F.lit("k")), rewriting.seeded_rewrite(F.col("t"), F.col("t")))
    a, b = df.select(*e).first(), df.select(*e).first()
    assert a == b and len(a[0].split()) == len(a[1].split()) == 11


def test_scores_golden(spark):
    rows = [(1, "a", i, "ok" if i in (0, 2) else "failed", None, [0.1, 0.0, 0.3, 0.0][i], 400, False) for i in range(4)]
    rows += [(1, "w", 0, "ok", None, 0.10, 400, False), (1, "w", 1, "ok", None, 0.60, 40, False), (1, "n", 0, "failed", "empty", 0.0, 5, False)]
    rows += [(r, "m", 0, "ok", None, d, 10, False) for r, d in ((1, 0.042), (2, 0.044), (3, 0.041))]
    df = spark.createDataFrame(rows, "run_index int, creation_id string, chunk_index int, status string, reason string, delta double, n_words long, degenerate boolean")
    runs = {(r.run_index, r.creation_id): r for r in scoring.run_scores(df).collect()}
    assert abs(runs[1, "a"].mean_delta - 0.2) < 1e-12 and runs[1, "a"].failed_fraction == 0.5
    assert abs(runs[1, "w"].mean_delta - 0.35) < 1e-12 and abs(runs[1, "w"].length_weighted_mean - 64 / 440) < 1e-12
    assert runs[1, "n"].mean_delta is None
    s = {r.creation_id: r for r in scoring.creation_scores(scoring.run_scores(df)).collect()}
    assert abs(s["m"].score - 0.127 / 3) < 1e-12 and abs(s["m"].score_std - 0.0015275252316519) < 1e-12
    assert s["w"].score_std is None and not s["w"].unreliable
    assert s["n"].score is None and s["n"].unreliable and s["a"].unreliable


def test_encodings_are_single_bytes(spark):
    df = spark.createDataFrame([(" ".join(lx.FUNCTION_WORDS),)], "t string")
    assert df.select(tx.encoded(F.col("t"))).first()[0] == "".join(chr(i) for i in range(1, 128))
