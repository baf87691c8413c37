import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import splitting as sp

texts = st.lists(st.tuples(st.sampled_from(["word", "end.", "x", "q?"]), st.sampled_from([" ", "\n", "\n\n", "\xa0", "  ", "\r\n", "　"])), max_size=120).map(lambda x: "".join(a + b for a, b in x))


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(2, 30), st.integers(0, 12))
def test_pieces_cover_within_the_limit_and_overlap(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    w = text.split()
    got = sp.pieces(text, limit, overlap)
    if len(w) <= limit:
        assert got == []
        return
    end = 0
    for k, (t, a, b) in enumerate(got):
        assert t.split() == w[a:b] and b - a <= limit and t in text
        assert a == (max(0, end - overlap) if k else 0) and b > end
        end = b
    assert end == len(w)


def test_the_strongest_boundary_near_the_middle_is_taken():
    w = [f"w{i}" for i in range(130)]
    plain = " ".join(w)
    assert [p[1:] for p in sp.pieces(plain)] == [(0, 65), (53, 130)]
    sentence = plain.replace("w69 ", "w69. ")
    assert sp.pieces(sentence)[0][2] == 70
    line = sentence.replace("w59 ", "w59\n")
    assert sp.pieces(line)[0][2] == 60
    paragraph = line.replace("w72 ", "w72\n \n")
    assert sp.pieces(paragraph)[0][2] == 73
    assert sp.pieces(plain.replace("w64 ", "w64\r\n"))[0][2] == 65


def test_edge_cases(spark):
    big, many = " ".join(["a"] * 121), "z " * 100_000
    rows = [("c", 0, None, 5, 1, "t"), ("c", 1, "", 5, 1, "t"), ("c", 2, " \n" * 300, 5, 1, "t"), ("c", 3, big, 5, 1, "t"), ("c", 3, big, 5, 1, "t"), (None, None, big, None, 1, "t"), ("d", 1, many, 0, 1, "t"), ("d", 2, " ".join(["b"] * 120), 0, 999, "t")]
    df = spark.createDataFrame(rows, "creation_id string, chunk_index int, text string, word_start int, n_words int, piece_index string")
    got = sp.split_oversized(df).collect()
    keys = {(r.creation_id, r.chunk_index) for r in got}
    assert keys == {("c", 3), (None, None), ("d", 1)}
    three = sorted((r.piece_index, r.n_words, r.word_start, r.word_end) for r in got if r.chunk_index == 3)
    assert three == [(0, 60, 5, 65), (1, 73, 53, 126)]
    assert max(r.n_words for r in got) <= 120
    ends = sorted((r.word_start, r.word_end) for r in got if r.creation_id == "d")
    assert ends[0][0] == 0 and ends[-1][1] == 100_000 and all(b == c + 12 for (_, b), (c, _) in zip(ends, ends[1:]))
    assert sp.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sp.split_oversized(df, 10, 10)


@pytest.mark.parametrize("n,ends,want", [(210, (87, 99), 99), (212, (88, 100), 100), (125, (17,), 17)])
def test_the_first_piece_ends_with_a_sentence_off_the_middle(n, ends, want):
    text = " ".join(f"w{i}." if i in ends else f"w{i}" for i in range(1, n + 1))
    assert sp.pieces(text)[0][2] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=30), st.integers(2, 30))
def test_only_runs_over_the_limit_without_an_end_are_cut_inside(runs, most):
    ends = [sum(runs[: k + 1]) for k in range(len(runs))]
    got = sp.bisected(ends[-1], most, ([], [], ends[:-1]))
    for a, b in zip([0, *ends], ends):
        assert b - a > most or not any(a < e < b for e in got)
    assert all(b - a <= most for a, b in zip([0, *got], got))
