from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import pairs as pr
from inkwell.llm import wording as wd

seq = st.lists(st.sampled_from("abcd"), max_size=14)


@settings(max_examples=200, deadline=None)
@given(seq, seq, st.integers(1, 4))
def test_copied_words_are_those_in_runs_of_the_passage(a, b, run):
    flags = [False] * len(b)
    for i in range(len(b)):
        for n in range(run, len(b) - i + 1):
            if any(a[j : j + n] == b[i : i + n] for j in range(len(a))):
                flags[i : i + n] = [True] * n
    assert pr.SuffixAutomaton(a).copied(b, run) == sum(flags)


@settings(max_examples=200, deadline=None)
@given(seq, seq)
def test_agreement_is_the_longest_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    bits = pr.agreement(a, b)
    for i in range(len(a) + 1):
        assert (bits & ((1 << i) - 1)).bit_count() == t[i][len(b)]


PASSAGE = "the careless mantle comforted this tailor of his hunger beyond the ancient orchard, until some thunder rescued that winter. Her stable was ragged beside thy patient ferry, for no silent chapel was winding with the old harbour of the"
SOUND = PASSAGE.replace("the ", "that ").replace("of ", "out of ").replace("was", "had been").replace("for no", "since not any")
GERMAN = "Der bleiche Turm war nicht mit dem Garten und ein Schmied von der Burg hütete die Laterne auf dem Markt und das Fenster war kein Brief"


def test_defects():
    cases = {
        None: "empty", "": "empty", " \n\xa0": "empty", "```\n```": "empty", "N/A": "empty", '""': "empty", "(empty)": "empty", "[no output]": "empty", "---": "empty", "Sure, this is my version:\n```\n```": "empty", "​": "empty",
        "I'm sorry, but I can't produce that text. Is there anything else you need?": "refusal", "```\nApologies; I must decline.\n```": "refusal", "Leider kann ich bei dieser Anfrage nicht helfen.": "refusal",
        f'About the lines that start with "the careless mantle comforted": I have to pass on this one.': "refusal",
        PASSAGE: "copy", PASSAGE.upper(): "copy", f"Below is the text:\n```\n{PASSAGE}\n```": "copy", PASSAGE.replace("tailor", "smith").replace("ragged", "torn"): "copy", PASSAGE.replace(" ", "\n"): "copy",
        f"Restyle the passage below so that it fits the profile.\nProfile: x\n\nPassage:\n{PASSAGE}\n\nReturn nothing but the passage.": "copy",
        GERMAN: "other_language", SOUND: None, SOUND[: len(SOUND) // 2]: "truncated", SOUND[:60]: "truncated", SOUND + " " + "beyond that ancient orchard " * 20: None,
    }
    for answer, want in cases.items():
        assert pr.defect_of(PASSAGE, answer) == want, answer


def test_a_passage_that_speaks_of_refusing_is_no_refusal():
    passage = PASSAGE + ' "I am sorry, I must decline," said the king of the castle.'
    assert pr.defect_of(passage, passage.replace("the ", "that ").replace("of ", "out of ")) is None


REFUSING = """I'm afraid rewriting this passage is not something I'm willing to attempt.
This request goes against my guidelines, so I won't be rephrasing it.
I cannot process this excerpt in good conscience.
It would be impossible for me to restyle these lines as the instructions demand.
Sorry, I'd prefer not to paraphrase that.
We are not in a position to fulfil this.
Our policy means I am not able to reproduce the text.
I refuse to rewrite this.
I'll have to pass on this one, friend.
Such a transformation lies outside of what I can offer.
Unfortunately the content policy prohibits rewriting of this kind.
I could not in fairness carry out what you ask.
This version would not comply with the rules I follow.
I am declining this task.
Je regrette, mais il m'est impossible de reformuler ces lignes.
Je ne saurais traiter cette demande.
Mes consignes ne me permettent pas de réécrire ceci.
Diese Aufgabe kann ich nicht übernehmen.
Leider ist es mir nicht möglich, diesen Text zu bearbeiten.
Ich lehne diese Anfrage ab.
Lo siento, pero no es posible atender esta petición.
No soy capaz de reformular este pasaje.
Mis normas me lo impiden: no puedo reescribir nada de esto.""".splitlines()

NOT_REFUSING = """The tower would not fall, and the old king could not sleep before the dawn.
He cannot help his sorrow, nor will she not forgive him for the winter.
No man refuses bread when the harbour is frozen and the ferry lies beyond what the eye can see.
I can't help laughing, said the miller, for the fool will not sit down.
Il ne peut pas dormir et la maison est vide depuis que le roi est parti.
Er kann nicht schlafen, denn der Mond steht über dem Garten und die Burg ist leer.
No puedo dormir, dijo el rey, porque la luna está sobre el jardín.""".splitlines()


def test_refusals_in_words_that_no_list_has_whole():
    missed = [x for x in REFUSING if pr.defect_of(PASSAGE, x) != "refusal"]
    assert len(missed) <= 2, missed  # 21 of 23
    assert [x for x in NOT_REFUSING if pr.defect_of(PASSAGE, x) == "refusal"] == []


def test_the_delimiter_stack_tells_a_cut_answer_from_one_with_other_last_words():
    ended = PASSAGE.removesuffix(" the") + " those"
    whole = SOUND.removesuffix(" that") + " yonder"
    if pr.defect_of(ended, whole) is None:
        assert pr.defect_of(ended, f"```text\n{whole}\n```") is None and pr.defect_of(ended, f"```text\n{whole}") == "truncated"
        assert pr.defect_of(ended, whole.replace("some thunder", "(some thunder")) == "truncated" and pr.defect_of(ended.replace("some thunder", "(some thunder"), whole.replace("some thunder", "(some thunder")) is None
    assert pr.defect_of(ended, whole) is None


def test_null_and_blank_passages():
    assert pr.defect_of(None, "some answer") is None and pr.defect_of(" ", "I must decline this.") == "refusal" and pr.defect_of(None, None) == "empty"


def test_prompts():
    p = "Restyle the passage below.\nProfile: x\n\nPassage:\none two\n\nthree\n\nReturn nothing but the restyled passage."
    assert wd.passage_of(p) == "one two\n\nthree"
    assert wd.passage_of("Profile: x\nNow turn this.\n-----\nabc") == "abc" and wd.passage_of("no marker here\n\nabc") == "abc" and wd.passage_of(None) == ""


def test_delimiters():
    assert pr.unclosed('{"a": [1, "}"]}') == [] and pr.unclosed('{"a": "b') == ["{", '"'] and pr.unclosed("([)") == ["(", "["]


def test_tables(spark):
    r = spark.createDataFrame([(1, PASSAGE, None, "calls"), (2, PASSAGE, SOUND, "x"), (2, PASSAGE, PASSAGE, "x"), (3, None, "x y", "x")], "rewrite_id long, original string, rewrite string, tbl string")
    prompt = f"Restyle.\n\nPassage:\n{PASSAGE}"
    c = spark.createDataFrame([(1, "ok", "rewrite", prompt, PASSAGE), (2, "failed", "rewrite", prompt, ""), (3, "ok", "profile", "x", ""), (4, None, None, None, None), (5, "ok", "rewrite_retry", prompt, None)], "call_id long, status string, tag string, prompt string, response string")
    got = sorted(map(tuple, pr.pair_defects(pr.rewrite_pairs(r, c)).collect()))
    assert got == [("calls", 1, "copy"), ("calls", 5, "empty"), ("rewrites", 1, "empty"), ("rewrites", 2, "copy")]
    assert pr.pair_defects(pr.rewrite_pairs(r.limit(0), c.limit(0))).count() == 0


def test_very_long_answers():
    a = " ".join(f"w{i}" for i in range(20_000))
    assert pr.defect_of(a, a) == "copy" and pr.defect_of(a, a[:60_000]) == "truncated"


def test_a_widened_answer_must_come_to_the_last_words_of_a_short_passage():
    passage = "that wandering hammer his hollow almanac about the northern ghost? Bribed that fisherman no"
    assert pr.defect_of(passage, "that wandering hammer his own hollow mark me almanac about this northern ghost? mark me Bri") == "truncated"
    assert pr.defect_of(passage, "that wandering hammer his own hollow mark me almanac about this northern ghost? mark me Bribed yonder fisherman not any") is None
    ended = PASSAGE.removesuffix(" of the")
    assert pr.defect_of(ended + " and he was not", SOUND.removesuffix(" out of the").replace("hunger", "very hunger indeed") + " yet") == "truncated"
    assert pr.defect_of(ended + " and he was not", SOUND.removesuffix(" out of the") + " yet that one had been nowise") is None


def test_measures(spark):
    r = spark.createDataFrame([(1, PASSAGE, PASSAGE), (2, PASSAGE, "I cannot rewrite this passage (sorry"), (3, PASSAGE, GERMAN), (4, None, None)], "rewrite_id long, original string, rewrite string")
    c = spark.createDataFrame([], "call_id long, status string, tag string, prompt string, response string")
    got = {x.row_id: x for x in pr.pair_measures(pr.rewrite_pairs(r, c)).collect()}
    assert (got[1].copied_share, got[1].agreed_share, got[1].n_refusing) == (1.0, 1.0, 0) and got[2].n_refusing > 0 and got[2].n_open == 1 and got[3].language == "de" and got[3].copied_share < 0.2 and got[4].copied_share == 0.0


def test_what_is_copied_decides_between_a_copy_and_a_whole_answer(monkeypatch):
    assert pr.defect_of(PASSAGE, PASSAGE) == "copy"
    monkeypatch.setattr(pr, "copied_words", lambda a, b: 0)
    assert pr.defect_of(PASSAGE, PASSAGE) is None
