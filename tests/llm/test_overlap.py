import random

import pytest

from inkwell.llm import overlap as ov

A = "a_batarn_toumpum_in_flillaxa_floumump"


def meet(a, b):
    """Whether two keys share a signature, whichever is on which side."""
    e, t = "evaluation", "training"
    return all(set(ov.signatures(*x, e)) & set(ov.signatures(*y, t)) for x, y in ((a, b), (b, a)))


@pytest.mark.parametrize(
    "other,same",
    [
        ("A-Batarn-Toumpum-In-Flillaxa-Floumump", True), ("aBatarnToumpumInFlillaxaFloumump", True), ("flillaxa floumump batarn toumpum", True), ("à_bâtarn_toumpum_ïn_flillaxa_floumump", True), (A + "_copy", True), (A + "_2nd_ed", True), (A + "_new_edition", True), (A + "_v2", True), (A + "_rev", True),
        ("the_batarn_toumpum_of_flillaxa_and_floumump", True), ("a_batran_toumpum_ni_flillaxa_floumump", True), ("a_btarn_toumpm_in_flillaxa_floumump", True), ("a_batarn_toumpumin_flillaxa_floumump", True), ("abatarntoumpuminflillaxafloumump", True),
        (A + "_ii", False), (A + "_vol_2", False), (A + "_2", False), ("a_btrn_toumpm_in_flillaxa_floumump", False), ("a_batarn_toumpum_in_flillaxa", False), ("a_batarn_toumpum_in_flillaxa_quaskexi", False),
    ],
)
def test_same_work(other, same):
    assert ov.same_work(ov.name_key(A), ov.name_key(other)) is same
    if same:
        assert meet(ov.name_key(A), ov.name_key(other))


def test_parts_and_numerals():
    k = lambda x: ov.name_key(x)
    assert ov.same_work(k(A + "_vol_2"), k(A.title() + "-Volume-2")) and not ov.same_work(k(A + "_vol_1"), k(A + "_vol_2")) and not ov.same_work(k(A + "_i"), k(A + "_ii")) and ov.same_work(k(A + "_II"), k(A + "_ii"))


def test_two_slips_leave_a_shared_signature():
    rng = random.Random(2)
    letters = "abcdefghijklmnop"
    for k in (1, 2, 3, 4, 5, 7, 9, 12):
        for _ in range(60):
            words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 10))) for _ in range(k)]
            other = list(words)
            for _ in range(2):
                i = rng.randrange(k)
                w = other[i]
                j = rng.randrange(len(w) - 1)
                other[i] = rng.choice([w[:j] + w[j + 1 :], w[:j] + "z" + w[j:], w[:j] + "z" + w[j + 1 :], w[:j] + w[j + 1] + w[j] + w[j + 2 :]])
            a, b = ov.name_key(" ".join(words)), ov.name_key(" ".join(other))
            if ov.same_work(a, b):
                assert meet(a, b), (a, b)


def table(rng, n):
    words = ["batarn", "toumpum", "flillaxa", "floumump", "quaskexi", "brixind", "gytylta"]
    rows = []
    for i in range(n):
        w = rng.sample(words, rng.choice([2, 4, 4, 5]))
        if rng.random() < 0.3:
            j = rng.randrange(len(w))
            w[j] = w[j][1:]
        rows.append((i, rng.choice(["_", " ", "-"]).join(w) + rng.choice(["", "", "_ii", "_copy"]), rng.choice([None, [], [0], [1, 2], [2, 3, 3], [50]]), rng.choice(["texts", "Texts ", "noise pool", "heldout", "held-out", "MIXTURE_SOURCES", None, "other"]), rng.choice([None, " ", "A B"])))
    rows += [(n, None, [2], "texts", None), (n + 1, None, None, "heldout", None), (None, "batarn_toumpum", [50], "heldout", None)]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_pairs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = table(rng, 120)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "decl_order long, id string, gutenberg_ids array<int>, set_name string, author string, name string")
    side = {"texts": "t", "Texts ": "t", "noise pool": "t", "heldout": "e", "held-out": "e", "MIXTURE_SOURCES": "e"}
    want = set()
    for a in rows:
        for b in rows:
            if side.get(a[3]) == "t" and side.get(b[3]) == "e" and a[0] is not None and b[0] is not None:
                shared = {x for x in a[2] or [] if x > 0} & {x for x in b[2] or [] if x > 0}
                if shared or (a[1] and b[1] and ov.same_work(ov.name_key(b[1]), ov.name_key(a[1]))):
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    got = [tuple(r) for r in ov.cross_split_pairs(df.where("decl_order IS NOT NULL")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = ov.overlap_counts(df.where("decl_order IS NOT NULL"))
    assert sum(r.n_pairs for r in counts.collect()) == len(want)
    classes = {r.decl_order: r for r in ov.overlap_classes(df.where("decl_order IS NOT NULL")).collect()}
    assert set(classes) == {a[0] for a in rows if a[0] is not None and side.get(a[3])}
    assert all(r.n_links == sum(i in p for p in want) for i, r in classes.items())


@pytest.mark.parametrize("hot", [1, 4, 50])
def test_hot_signatures_lose_no_pair(spark, hot):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9))) for _ in range(14)]
    rows = []
    for i in range(160):  # two words that all names hold
        w = ["batarn", "toumpum", *rng.sample(words, rng.choice([0, 1, 2, 2]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            j = rng.randrange(len(w))
            k = rng.randrange(len(w[j]) - 1)
            w[j] = rng.choice([w[j][:k] + w[j][k + 1 :], w[j][:k] + "z" + w[j][k + 1 :], w[j][:k] + w[j][k + 1] + w[j][k] + w[j][k + 2 :]])
        rng.shuffle(w)
        name = "_".join(w)
        rows.append((i, name.replace("_", "", 1) if rng.random() < 0.2 else name, rng.choice(["texts", "heldout"])))
    df = spark.createDataFrame([(*r, None, None) for r in rows], "decl_order long, id string, set_name string, gutenberg_ids array<int>, author string")
    keys = {n: ov.name_key(n) for _, n, _ in rows}
    want = {(ov.key_text(a[1]), ov.key_text(b[1])) for a in rows for b in rows if a[2] == "heldout" and b[2] == "texts" and ov.same_work(keys[a[1]], keys[b[1]])}
    assert len(want) > 50 and {(r.key_e, r.key_t) for r in ov.same_names(ov.records(df), hot).collect()} == want


def test_coverage_keeps_every_pair_of_the_same_work_and_turns_others_away():
    rng = random.Random(5)
    turned = kept = 0
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 10)))
    for _ in range(6000):
        k = rng.randint(1, 7)
        words = [word() for _ in range(k)]
        other = list(words)
        for _ in range(rng.choice([1, 2, 2, 3, 5])):
            i = rng.randrange(len(other))
            w = other[i]
            j = rng.randrange(len(w))
            other[i] = rng.choice([w[:j] + w[j + 1 :], w[:j] + "z" + w[j:], w[:j] + w[j : j + 2][::-1] + w[j + 2 :], word()]) or "q"
        if rng.random() < 0.4 and len(other) > 1:
            i = rng.randrange(len(other) - 1)
            other[i : i + 2] = [other[i] + other[i + 1]]
        rng.shuffle(other)
        for x, y in ((words, other), (other, words)):
            a, b = ov.name_key("_".join(x)), ov.name_key("_".join(y))
            parts = ov.pieces(a[0])
            left = ov.uncovered(parts, {p for _, _, p in parts if p in b[2]}, 99)
            if ov.same_work(a, b):
                kept += 1
                assert left <= ov.MOST_PIECES, (a, b)
            elif left > ov.MOST_PIECES:
                turned += 1
    assert kept > 2000 and turned > 500


def test_empty(spark):
    df = spark.createDataFrame([], "decl_order long, id string, gutenberg_ids array<int>, set_name string, author string")
    assert ov.cross_split_pairs(df).count() == 0 and ov.overlap_counts(df).count() == 0


def test_a_lost_space_and_a_slip_leave_a_shared_signature():
    rng = random.Random(3)
    accepted = 0
    a, b = ov.name_key("batarn flillaxa toumpum zoumump"), ov.name_key("batarnflillaxa toumpum zoumumk")
    assert ov.same_work(a, b) and meet(a, b)
    for k in (2, 3, 4, 5, 6, 8, 9, 10, 11, 12):
        for _ in range(200):
            words = sorted("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 10))) for _ in range(k))
            i = rng.randrange(k - 1)
            other = [*words[:i], words[i] + words[i + 1], *words[i + 2 :]]
            i = rng.randrange(k - 1)
            j = rng.randrange(len(other[i]) - 1)
            other[i] = rng.choice([other[i][:j] + other[i][j + 1 :], other[i][:j] + "z" + other[i][j:], other[i][:j] + "z" + other[i][j + 1 :]])
            a, b = ov.name_key(" ".join(words)), ov.name_key(" ".join(other))
            if ov.same_work(a, b):
                accepted += 1
                assert meet(a, b), (a, b)
    assert accepted > 200


def test_coverage_merges_intervals():
    parts = ov.pieces(("batarn", "toumpum"))
    assert [p for _, _, p in parts] == ["ba", "ta", "rn", "to", "um", "pum"]
    assert ov.coverage(parts, {"ba", "ta", "pum"}) == ([(0, 4), (10, 13)], 7 / 13) and ov.coverage([], set()) == ([], 1.0) and ov.coverage(parts, set()) == ([], 0.0)


def test_coverage_of_evaluation_rows(spark):
    rows = [(1, A, "heldout"), (2, A.replace("toumpum", "tounpum"), "texts"), (3, A.upper(), "noise_pool"), (4, "quaskexi_brixind_gytylta", "heldout"), (5, None, "heldout"), (6, "x", None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "decl_order long, id string, set_name string, gutenberg_ids array<int>, author string")
    assert {(r.decl_order, r.n_names, r.coverage) for r in ov.evaluation_coverage(df).collect()} == {(1, 2, 1.0), (4, 0, 0.0)}


def test_random_names_meet_wherever_they_are_the_same_work():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
    kept = 0
    for _ in range(20000):
        k = rng.randint(1, 6)
        words = [word() for _ in range(k)]
        other = list(words)
        for _ in range(rng.choice([0, 1, 1, 2])):
            i = rng.randrange(len(other))
            w = other[i]
            j = rng.randrange(len(w))
            other[i] = rng.choice([w[:j] + w[j + 1 :], w[:j] + "z" + w[j:], w[:j] + w[j : j + 2][::-1] + w[j + 2 :]]) or "q"
        if rng.random() < 0.5 and len(other) > 1:
            i = rng.randrange(len(other) - 1)
            other[i : i + 2] = [other[i] + other[i + 1]]
        if rng.random() < 0.2:
            other.insert(rng.randrange(len(other) + 1), rng.choice(["thf", "teh", "nad", "fo"]))
        if rng.random() < 0.5:
            rng.shuffle(other)
        a, b = ov.name_key("_".join(words)), ov.name_key("_".join(other))
        if ov.same_work(a, b):
            kept += 1
            assert meet(a, b), (a, b)
    assert kept > 8000
