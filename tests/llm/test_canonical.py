import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import canonical as ca

alphabet = "aoxeAHвнСоνίρéЁ́̈​­\xa0 　‑-ｆＦ．ﬁK½²\r\n\t …’'🙂‍日1１"


@pytest.mark.parametrize(
    "a,b",
    [
        ("ｆｕｌｌ．", "full."), ("é", "é"), ("ze​ro", "zero"), ("a\xa0b", "a b"), ("a　b", "a b"), ("a\tb", "a b"), ("a\r\nb", "a\nb"), ("sо", "so"), ("СОР", "COP"), ("ѕԝοrԁ", "sword"), ("нoc", "нос"), ("ﬁn", "fin"), ("\u212a", "K"), ("\u212b", "\xc5"),
        ("ậ", "ậ"), ("a͏́", "á"), ("Zoë‑Marit", "Zoë-Marit"), ("so­ft", "soft"), ("𝐛old", "bold"), ("ё", "ё"), ("όλα", "oλα".replace("o", "ó")), ("﻿x", "x"),
    ],
)
def test_look_alikes_are_equal(a, b):
    assert ca.canonical(a) == ca.canonical(b)


@pytest.mark.parametrize("a,b", [("a", "b"), ("a", "A"), ("e", "é"), ("é", "è"), ("1", "2"), ("x.", "x,"), ("½", "1/2"), ("x²", "x2"), ("’", "'"), ("“x", '"x'), ("…", "..."), ("a b", "a\nb"), ("a b", "ab"), ("-", "—"), ("👨‍🌾", "👨🌾"), ("з", "3"), ("ж", "х"), ("①", "1")])
def test_visible_differences_stay(a, b):
    assert ca.canonical(a) != ca.canonical(b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=alphabet, max_size=25))
def test_canonical_is_idempotent_and_composed(text):
    once = ca.canonical(text)
    assert ca.canonical(once) == once and unicodedata.is_normalized("NFC", once)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=alphabet + "жЖαωΩйѐЙάѝՕօ", max_size=12))
def test_quick_checks_never_pass_what_would_change(text):
    segment = "".join(text.split())
    if ca.is_stable(segment):
        assert ca._rewritten(segment) == segment
    assert ca.is_stable(ca.canonical(segment)) or ca._rewritten(ca.canonical(segment)) == ca.canonical(segment)


def test_quick_checks_isolate_the_unstable_segments(monkeypatch):
    asked = []
    whole = ca._rewritten
    monkeypatch.setattr(ca, "_rewritten", lambda x: asked.append(x) or whole(x))
    monkeypatch.setattr(ca, "_SEGMENTS", ca._Segments())
    assert ca.canonical("Собака лает, το σπίτι; café “Zoë”") == "Собака лает, το σπίτι; café “Zoë”" and not asked
    assert ca.canonical("Собака ла​ет, café ｆull ½") == "Собака лает, café full ½" and asked == ["ла​ет,", "ｆull", "½"]


def test_look_alikes_are_in_the_public_table_of_confusables(spark):
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    others = [(a, b) for own, latin in ca.LOOKALIKES.values() for a, b in zip(own, latin) if checker.getSkeleton(a) != checker.getSkeleton(b)]
    assert others == [("ӏ", "l"), ("Ԛ", "Q")]  # the table has them under other letters of the same look, or in one case only


def test_words_keep_their_script():
    assert ca.canonical("Собака и кот, το σπίτι") == "Собака и кот, το σπίτι" and ca.canonical("собaкa") == "собака"


def test_null_blank_and_plain():
    assert ca.canonical(None) is None and ca.canonical("") == "" and not ca.is_visible(ca.canonical("​ \xa0")) and ca.canonical("plain text\n") == "plain text\n"


def test_long_segments_are_whole():
    t = "é" * 100_000 + "ö" * 1000
    assert ca.canonical(t) == "é" * 100_000 + "ö" * 1000


def test_pairs_against_brute_force(spark):
    base = ["The cold harbour.", "Собака", "a b", "", None, " ", "​", "x²"]
    dressed = [*base, "The c​old harbour.", "Ｔhe cold harbour.", "Тhe cold\xa0harbour.", "Coбaкa", "a b", "a  b", "x2", "　"]
    rows = [(i, t, "z") for i, t in enumerate([*dressed, *dressed, "The cold harbour!"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, look string")
    want = {(a, b) for a, s, _ in rows for b, t, _ in rows if a < b and s is not None and t is not None and s != t and ca.canonical(s) == ca.canonical(t) and ca.is_visible(ca.canonical(s))}
    got = [tuple(r) for r in ca.lookalike_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert ca.lookalike_pairs(df.limit(0)).count() == 0
    classes = {r.doc_id: r for r in ca.lookalike_classes(df).collect()}
    assert set(classes) == {i for i, t, _ in rows if t is not None and ca.is_visible(ca.canonical(t))}
    assert all(r.n_links == sum(i in p for p in want) and r.class_id <= i for i, r in classes.items())
    assert all(classes[a].class_id == classes[b].class_id for a, b in want)
    out = {r.doc_id: r.canonical_text for r in ca.canonical_texts(df).collect()}
    assert out[4] is None and out[8] == "The cold harbour."


def test_a_hot_group_of_copies(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id < 2000 THEN 'the same text' WHEN id = 2500 THEN 'the s​ame text' ELSE concat('own ', id) END AS text")
    assert ca.lookalike_pairs(df).count() == 2000
