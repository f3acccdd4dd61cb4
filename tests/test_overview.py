"""Overlays, texts of tops, presence and alignment."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import overview as ov


def test_overlays_never_multiply(spark):
    base = spark.createDataFrame([(1, 5), (2, 7), (None, 1)], "c int, n int")
    a = spark.createDataFrame([(1, "x")], "c int, t string")
    got = {x.c: x.t for x in ov.overlay_all(base, "c", [(a, {"t": F.lit("")})]).collect()}
    assert got == {1: "x", 2: "", None: ""}
    with pytest.raises(ValueError):
        ov.overlay_all(base, "c", [(a.withColumnRenamed("t", "n"), {})])


def test_texts(spark):
    df = spark.createDataFrame([("a", "q", 2.0), ("a", "p", 2.0), ("a", "z", 3.0), ("a", None, 9.0), ("b", "p", None)], "c string, i string, w double")
    assert [tuple(x) for x in ov.top_text(df, "c", "i", F.col("w"), 2).collect()] == [("a", "z; p")]
    assert [tuple(x) for x in ov.seen_first(df.where("w is not null"), "c", "i", ["w"], 2, "s").collect()] == [("a", "p|q")]
    r = spark.createDataFrame([("PF1", "CL1", "Xer"), ("PF2", "CL1", "Xer"), ("PF3", None, "xerC"), (None, None, None)], "a string, c string, n string")
    assert [x[0] for x in r.select(ov.role(F.col("a"), F.col("c"), F.col("n"), {"PF1": "m"}, {"CL1": "k"}, [("^xer", "integrase")])).collect()] == ["m", "k", "integrase", "other"]
    m = spark.createDataFrame([("PF00589.3",), ("PF07508",), ("X",), (None,)], "m string")
    assert [x[0] for x in m.select(ov.recombinase(F.col("m"), ("PF00589", "PF22022"), ("PF07508",))).collect()] == ["tyrosine", "serine", "other", None]
    assert [x[0] for x in spark.createDataFrame([(True, True), (None, True), (False, None)], "f boolean, c boolean").select(ov.status(F.col("f"), F.col("c"))).collect()] == ["found", "none", "not_checked"]


def test_presence_matrix_and_labels(spark):
    m = spark.createDataFrame([(0, "a"), (0, "b"), (0, "b"), (1, "c")], "k int, e string")
    s1, s2 = spark.createDataFrame([("a", "r", 1), ("b", "r", 0)], "e string, i string, n int"), spark.createDataFrame([("a", "r", 3), ("c", "q", 1)], "e string, i string, n int")
    p = ov.presence(m, [s1, s2], "k", "e", "i")
    assert sorted((x.k, x.i, x.n_with, x.share, x["mean"]) for x in p.collect()) == [(0, "r", 1, 0.5, 1.5), (1, "q", 1, 1.0, 1.0)]
    assert sorted(tuple(x) for x in ov.matrix(p, "k", "i", "share", ["q", "r", "z"]).collect()) == [(0, 0.0, 0.5, 0.0), (1, 1.0, 0.0, 0.0)]
    labels = spark.createDataFrame([("a", 1)], "e string, label int")
    assert ov.aligned(labels, m.where("e = 'a'"), "e").first().label == 1
    with pytest.raises(Exception, match="no label for"):
        ov.aligned(labels, m, "e").collect()
    t = spark.createDataFrame([("a", 1, None), ("a", 1, 2), ("a", 0, 9)], "e string, x int, y int")
    assert [tuple(x) for x in ov.latest(t, ["e"], ["x", "y"]).collect()] == [("a", 1, 2)]
