from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import lexicon as lx
from inkwell.functions import text as tx


def one(spark, value, *exprs):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(*exprs).first()


def test_function_word_list():
    assert len(lx.FUNCTION_WORDS) == 127
    assert list(lx.FUNCTION_WORDS) == sorted(set(lx.FUNCTION_WORDS))
    assert len(lx.SUBSTITUTIONS) == 20


def test_words_split_as_python_does(spark):
    t = "a\xa0b　c\x85d\x1ce\tf  g\n"
    got = one(spark, t, tx.words(F.col("t")), tx.n_words(F.col("t")))
    assert got[0] == t.split() and got[1] == len(t.split())
    assert one(spark, None, tx.words(F.col("t")))[0] == []
    assert one(spark, " \n\t ", tx.words(F.col("t")))[0] == []


def test_tokens_fold_and_strip_edges_but_not_apostrophes(spark):
    t = "“’Tis” (THE) ｔｈｅ ﬁne—, it's ‐ -- Straße ΟΔΟΣ"
    got = one(spark, t, tx.tokens(F.col("t")), tx.exact_tokens(F.col("t")))
    assert got[0] == got[1]
    assert "the" in got[0] and "it's" in got[0] and "strasse" in got[0]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aAtThHeE .,'’ﬁ\xa0\t\nßΣςé", max_size=30), min_size=1, max_size=20))
def test_tokens_equal_the_exact_ones(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for a, b in df.select(tx.tokens(F.col("t")), tx.exact_tokens(F.col("t"))).collect():
        assert a == b


def test_cleaning(spark):
    cases = {
        "```\nabc\n```": "abc", "```text\n```\nabc\n```\n```": "abc", "Sure, here:\nabc": "abc", "Here’s the text:\n\nabc\n": "abc", "```\nCertainly! As asked:\nabc\n```": "abc",
        "abc ``` def": "abc ``` def", "no lead in: abc": "no lead in: abc", "```\n```": "", "   ": "", "Here is:\nBelow is:\nabc": "Below is:\nabc",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", tx.cleaned(F.col("t"))).collect()} == cases


def test_refusals(spark):
    df = spark.createDataFrame([("I CANNOT do",), ("as an AI model",), ("i can do",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.refuses(F.col("t"))).collect()] == [True, True, False, False]


def test_nfkc(spark):
    df = spark.createDataFrame([("ﬁ½ｘ",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.nfkc(F.col("t"))).collect()] == ["fi1⁄2x", "plain", None]
