from inkwell.operators import experiments as ex


def test_splices_stand_where_they_are_said_to(spark):
    host = spark.createDataFrame([("h", " ".join(f"w{i}" for i in range(10))), ("g", "one two")], "creation_id string, text string")
    p = spark.createDataFrame([("h", 7, "x y"), ("h", 2, "a b c"), ("g", 9, "z")], "creation_id string, at int, text string")
    got = {r.creation_id: r for r in ex.spliced(host, p).collect()}
    w = got["h"].text.split()
    assert w == "w0 w1 a b c w2 w3 w4 w5 w6 x y w7 w8 w9".split()
    assert [" ".join(w[s.word_start : s.word_start + s.n_words]) for s in got["h"].splices] == ["a b c", "x y"]
    assert got["g"].text == "one two z"


def test_splice_recall(spark):
    d = spark.createDataFrame([("h", i, "ok", v) for i, v in enumerate([0.1, 0.9, 0.2, 0.8, 0.3])] + [("g", 0, "ok", 0.5)], "creation_id string, chunk_index int, status string, delta double")
    f = spark.createDataFrame([("h", 1), ("h", 2)], "creation_id string, chunk_index int")
    assert [tuple(r) for r in ex.splice_recall(d, f).collect()] == [("h", 2, 1)]


def test_paired_test_and_sets(spark):
    a = spark.createDataFrame([(i, float(i)) for i in range(4)], "k int, delta double")
    b = spark.createDataFrame([(i, float(i) - (1 if i % 2 else 2)) for i in range(4)], "k int, delta double")
    r = ex.paired_test(a, b, ("k",)).first()
    assert r.n == 4 and abs(r.mean_difference - 1.5) < 1e-12 and abs(r.t - 1.5 / (0.5773502691896258 / 2)) < 1e-9
    x, y = spark.createDataFrame([("a",), ("b",)], "creation_id string"), spark.createDataFrame([("b",), ("c",)], "creation_id string")
    assert {tuple(r) for r in ex.set_delta(x, y).collect()} == {("a", "left"), ("c", "joined")}
    assert not ex.partition_difference(x, y).first().equal and ex.partition_difference(x, x).first().equal
