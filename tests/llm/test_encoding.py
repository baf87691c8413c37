import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import encoding as en

pytestmark = pytest.mark.skipif(not os.path.exists(en.TOKENIZER), reason="the public tokenizer's file is not here")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip_and_offsets(text):
    ids = en.encode_batch([text])[0]
    assert en.decode(ids) == text
    at = en.byte_offsets(text, ids)
    assert len(at) == len(ids) and all(a < b for a, b in at)
    if text:
        assert at[0][0] == 0 and at[-1][1] == len(text) and all(p[0] <= q[0] and q[0] <= p[1] for p, q in zip(at, at[1:]))


def test_special_strings_are_ordinary_text():
    ids = en.encode_batch(["a<|endoftext|>b"])[0]
    assert 50256 not in ids and en.decode(ids) == "a<|endoftext|>b"


def test_split_characters():
    ids = en.encode_batch(["👨‍🌾日"])[0]
    assert len(ids) > 4 and en.decode(ids) == "👨‍🌾日" and en.decode(ids[:1]) == "�"


def test_equals_another_library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks_file = os.path.join(os.path.dirname(en.TOKENIZER), "byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file, "rb"))}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["It's a test, isn't it?  Yes\n\n 12345", "Ünïcödé 日本 🙂", " lead", "trail ", "\t\t"]
    assert en.encode_batch(texts) == [other.encode_ordinary(t) for t in texts]


def test_tables(spark):
    long = "longer text " * 60_000
    df = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "hello world", "q"), (3, "hello world", "q"), (None, " ", "q"), (5, long, "q")], "doc_id long, text string, ids string")
    out = en.encoded(df)
    got = {r.doc_id: r.ids for r in out.collect()}
    assert out.count() == 6 and got[1] == [] and got[2] == [] and en.decode(got[5]) == long and len(got[None]) == 1
    assert {r.doc_id: r.n_tokens for r in en.token_counts(df).collect()} == {k: len(v) for k, v in got.items()}
    assert {r.doc_id: r.text for r in en.decoded(out).collect()} == {1: "", 2: "", 3: "hello world", None: " ", 5: long}
    assert en.encoded(df.limit(0)).count() == 0


def test_ids_by_pieces_equal_those_of_the_library_on_every_character():
    t = en.load_tokenizer(en.TOKENIZER)
    texts = [f"ab{c}cd7{c}8 {c}{c}!{c}. {c}'s  {c}\n\n{c} " for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000, 7)])]
    texts += ["", "   ", "a  b   c    ", "it's 'tis we'll've \u00a0\u00a0x", "word" * 500, "<|endoftext|> x", "\x1c\x1d \x85a"]
    assert en.encode_batch(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
