import random
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import repetition as rp

texts = st.lists(st.sampled_from(["a", "b", "c", "D", "e1", ".", "\n", "é"]), max_size=40).map(" ".join)


def share_by_definition(text):
    import re

    w = re.findall(r"[^\W_]+", text.casefold())
    flags = [False] * len(w)
    for i in range(len(w)):
        for n in range(3, len(w) - i + 1):
            if any(w[j : j + n] == w[i : i + n] for j in range(i)):
                flags[i : i + n] = [True] * n
    return sum(flags) / len(w) if w else 0.0


@settings(max_examples=150, deadline=None)
@given(texts)
def test_share_is_the_definition(text):
    n, rep, content = rp.shares(text)
    assert abs(rep - share_by_definition(text)) < 1e-12 and 0 <= content <= 1


@settings(max_examples=300, deadline=None)
@given(texts)
def test_no_text_with_too_much_repeated_is_without_boilerplate(text):
    _, rep, content = rp.shares(text)
    assert rep < rp.MOST_REPEATED or content < 1.0


def test_no_injected_text_with_too_much_repeated_is_without_boilerplate():
    rng = random.Random(3)
    above = below = 0
    for _ in range(1500):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(rng.choice([5, 40, 900]))) for _ in range(rng.randint(12, 150))]
        tokens, copies = rp.injected(" ".join(w + rng.choice(["", "", "", "."]) for w in words), rng)
        assert len(tokens) == len(copies)
        text = " ".join(tokens)
        _, rep, content = rp.shares(text)
        assert rep < rp.MOST_REPEATED or content < 1.0, text
        above, below = above + (rep >= rp.MOST_REPEATED), below + (content == 1.0 and rep > 0)
    assert above > 300 and below > 30


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5), max_size=8))
def test_viterbi_is_the_best_labelling(margins):
    def score(y):
        return sum(m for l, m in zip(y, margins) if l) + sum(rp.TRANSITION[a, b] for a, b in zip(y, y[1:]))

    got = rp.viterbi(margins)
    assert abs(score(got) - max(map(score, product((0, 1), repeat=len(margins))))) < 1e-9


def test_fresh_lines_are_content_wherever_they_stand():
    # why a text without a repeated run need not be decoded
    fresh = max(rp.WEIGHTS[i] for i in range(3)) + max(rp.WEIGHTS[i] for i in (9,)) + sum(max(0, rp.WEIGHTS[i]) for i in range(15, len(rp.WEIGHTS)))
    for n in range(1, 6):
        assert rp.viterbi([fresh] * n) == [0] * n


def test_training_tells_copies_from_recurring_phrases_on_held_out_texts():
    rng = random.Random(0)
    vocabulary = [f"w{i}" for i in range(900)]
    made = [rp.labelled(". ".join(" ".join(rng.choices(vocabulary, k=rng.randint(4, 16))) for _ in range(8)), rng) for _ in range(320)]
    w, tr = rp.fit_field([o for o, _ in made[:160]], [y for _, y in made[:160]], steps=80)
    right = [a == b for o, y in made[160:] for a, b in zip(rp.viterbi([sum(w[i] for i in f) for f in o], tr), y)]
    assert np.mean(right) > 0.93
    # and so do the weights that are kept
    right = [a == b for o, y in made for a, b in zip(rp.viterbi([sum(rp.WEIGHTS[i] for i in f) for f in o]), y)]
    assert np.mean(right) > 0.93


def test_without_the_field_nothing_is_found(spark, monkeypatch):
    text = "one two three four five six " + "over and over again " * 20
    assert rp.shares(text)[2] < 0.5
    monkeypatch.setattr(rp, "_MARGINS", type("Flat", (dict,), {"__missing__": lambda self, k: 0.0})())
    monkeypatch.setattr(rp, "TRANSITION", np.zeros((2, 2)))
    assert rp.shares(text)[1] > 0.8 and rp.shares(text)[2] == 1.0


def test_lines_end_at_ends_and_where_repetition_begins_or_stops():
    found, ends = rp.split_words("a b c d. e f a b c d x\ny")
    times = rp.times_before(found)
    assert list(times) == [0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 0, 0] and rp.lines_of(times, ends) == [(0, 4), (4, 6), (6, 10), (10, 11), (11, 12)]


def test_edge_cases(spark):
    long = " ".join(f"u{i}" for i in range(60_000))
    rows = [("t", 1, None, 0), ("t", 2, "", 0), ("t", 3, " \n", 0), ("t", 4, "one two", 0), ("t", 5, "a b c " * 50, 0), ("t", 5, "a b c " * 50, 0), ("t", 6, long, 0), ("t", 7, long + " " + long, 0), (None, None, "x y z x y z", 0)]
    df = spark.createDataFrame(rows, "tbl string, row_id long, text string, keep int")
    got = {(r.row_id): r for r in rp.repetition(df).collect()}
    assert rp.repetition(df).count() == len(rows)
    assert all(got[i].keep and got[i].repeated_share == 0.0 and got[i].content_share == 1.0 for i in (1, 2, 3, 4, 6))
    assert not got[5].keep and not got[7].keep and got[None].repeated_share == 0.5
    assert rp.repetition(df.limit(0)).count() == 0


def test_generated_texts(spark):
    r = spark.createDataFrame([(1, "x")], "rewrite_id long, rewrite string")
    c = spark.createDataFrame([(1, None)], "call_id long, response string")
    assert {(x.tbl, x.row_id) for x in rp.generated_texts(r, c).collect()} == {("rewrites", 1), ("calls", 1)}


def test_weights_trained_in_spark(spark):
    df = spark.createDataFrame([("a b c d " * 30,), ("one two three four five six seven eight",), (None,)], "text string")
    w, tr = rp.train(df, 10)
    assert w.shape == (len(rp.FEATURES),) and tr.shape == (2, 2)


def test_refrains_between_fresh_lines_are_found(spark):
    def refrains(new, old, times=20):
        return " ".join(" ".join([f"n{k}x{i}" for i in range(new)] + [f"r{i}" for i in range(old)]) + "." for k in range(times))

    rows = [("t", i, refrains(*x)) for i, x in enumerate([(8, 8), (4, 4), (6, 6), (10, 8), (12, 6)])]
    df = spark.createDataFrame(rows, "tbl string, row_id long, text string")
    assert all((share_by_definition(r[2]) >= 0.4) == (r[1] < 4) for r in rows)
    assert {r.row_id for r in rp.repetition(df).where("NOT keep").collect()} == {0, 1, 2, 3}
