import random

import pytest

from inkwell.llm import truncation as tr


@pytest.mark.parametrize("seed", range(4))
def test_longer_copies_against_brute_force(spark, seed):
    rng = random.Random(seed)
    values = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(150)} | {"x" * n for n in range(1, 40)} | {"é\x00z", "é", "日", "日本"}
    long = ["".join(rng.choice("ab c.") for _ in range(rng.choice([127, 128, 129, 600, 1100]))) for _ in range(12)]
    values |= {v[: rng.choice([7, 8, 9, 31, 32, 33, 127, 128, 129, 255, 256, 257, 512, 513, 1000, len(v)])] for v in long for _ in range(9)}
    df = spark.createDataFrame([(v,) for v in [*values, *values]] + [(None,), ("",)], "text string")
    got = {bytes(r.key): (r.goes_inside, r.next_words) for r in tr.longer_copies(df).collect()}
    copies = {v: [w[len(v) :] for w in values if w != v and w.startswith(v)] for v in values}
    assert {v for v in values if tr.value_hash(v) in got} == {v for v, ws in copies.items() if ws}
    for v, ws in copies.items():
        if ws:
            assert got[tr.value_hash(v)][0] == any(w[0].isalnum() for w in ws)
    assert tr.longer_copies(df.limit(0)).count() == 0


def test_hashes_of_beginnings_are_those_of_values():
    v = "".join(random.Random(1).choice("abc é") for _ in range(1500))
    at = tr.block_starts(len(v))
    for n in [*range(1, 300), 511, 512, 513, 768, 769, 1500]:
        k = max(i for i, a in enumerate(at) if a < n)
        assert tr.value_hash(v[:n]) == tr.hashlib.md5(tr.blocks(v)[0][k][0] + v[at[k] : n].encode()).digest()


def test_prefix_lines(spark):
    rows = [(1, "ok", "ab"), (2, "ok", "abc"), (3, "ok", "ab"), (4, "failed", "a"), (5, "ok", ""), (6, "ok", None), (7, "ok", "abc d"), (8, "failed", "abc d e")]
    df = spark.createDataFrame([(*r, "p", "m", "clash") for r in rows], "call_id long, status string, response string, provider string, model_id string, key string")
    assert sorted(r.call_id for r in tr.prefix_lines(df).collect()) == [1, 2, 3]


def test_states():
    assert tr.state_of("profile", "x", '```json\n{"a": "b"}\n```') == "whole" and tr.state_of("profile", "x", '{"a": "b') == "cut" and tr.state_of("profile", "x", "prose") == "unknown"
    assert tr.state_of("rewrite", None, "x y z words") == "unknown" and tr.state_of("rewrite", "p", None) == "blank" and tr.state_of(None, None, "N/A") == "blank"


def test_lines(spark):
    from test_pairs import GERMAN, PASSAGE, SOUND

    p = f"Restyle.\n\nPassage:\n{PASSAGE}"
    rows = [
        (1, "ok", "rewrite", p, SOUND, "length", 9, 9), (2, "ok", "rewrite", p, SOUND[:80], "stop", 5, 99), (3, "ok", "rewrite", p, PASSAGE, "stop", 5, 99), (4, "ok", "rewrite", p, GERMAN + ".", "stop", 5, 99), (5, "ok", "rewrite", p, GERMAN[:70], "stop", 5, 99),
        (6, "ok", "profile", "x", '{"a": "b', None, 5, 99), (7, "failed", "rewrite", p, SOUND[:80], None, 5, 99), (8, "ok", "rewrite", p, None, None, None, None), (9, "ok", "rewrite", p, SOUND[:80], "stop", 5, 99),
        (10, "ok", "rewrite", p, "I must decline to rewrite that.", "stop", 5, 99), (11, "ok", "rewrite", p, "I must decline to rewrite that. Is there anything else?", "stop", 5, 99), (12, "ok", None, None, "tail without end", "length", 5, 5), (13, "ok", "rewrite", p, SOUND + " and then goes on", "stop", 5, 99),
    ]
    df = spark.createDataFrame([(*r, "m", "m1", "clash") for r in rows], "call_id long, status string, tag string, prompt string, response string, finish_reason string, output_tokens int, max_output_tokens int, provider string, model_id string, is_cut string")
    got = {r.call_id: (r.is_cut, r.has_longer_copy) for r in tr.cut_lines(df).collect()}
    assert {k for k, v in got.items() if v[0]} == {2, 5, 6, 9, 12} and 7 not in got
    assert got[2][1] and got[1][1] and not got[1][0] and got[10] == (False, True)
    s = tr.cut_shares(df).first()
    assert (s.n_lines, s.n_cut) == (12, 5)
    assert tr.cut_lines(df.limit(0)).count() == 0


def test_a_line_with_other_last_words_is_cut_where_a_longer_copy_goes_on_to_the_end(spark):
    from test_pairs import PASSAGE, SOUND

    p = f"Restyle.\n\nPassage:\n{PASSAGE.removesuffix('old harbour of the')}gardener another"
    start = SOUND.removesuffix("old harbour out of the")
    rows = [
        (1, start + "gardener a fur"), (2, start + "gardener a further"), (3, start + "gardener a fur hat"),  # inside a word, behind a copy that goes on with a blank
        (4, start + "gardener of a further"), (5, start + "gardener of a further" + " " + SOUND),  # whole, and looped elsewhere
        (6, start + "gardener upon"), (7, start + "gardener upon another"),  # the passage's last word follows
    ]
    df = spark.createDataFrame([(i, "ok", "rewrite", p, r, "stop", 5, 99, "m", "m1") for i, r in rows], "call_id long, status string, tag string, prompt string, response string, finish_reason string, output_tokens int, max_output_tokens int, provider string, model_id string")
    assert {r.call_id for r in tr.cut_lines(df).where("is_cut").collect()} == {1, 6}
