"""Chains of joins: misses come out, keys stay single, patterns need their order."""

from pyspark.sql import functions as F

from brindle.operators import chains as ch


def test_located_and_either_id(spark):
    m = spark.createDataFrame([("c_1_5", "PF1"), ("c_1_6", "PF2"), ("d_1", "PF3")], "orf string, model string")
    p = spark.createDataFrame([("c_1_5", 1, 9, "+"), ("d_1", 2, 8, "-")], "orf string, start int, end int, strand string")
    n = spark.createDataFrame([("c_1", 900)], "contig string, length int")
    found, missed = ch.located(m, p, n)
    assert [(x.orf, x.contig, x.contig_length) for x in found.collect()] == [("c_1_5", "c_1", 900)]
    assert {tuple(x) for x in missed.collect()} == {("c_1_6", "no coordinates"), ("d_1", "no contig length")}
    e = spark.createDataFrame([("a:b|1",), ("x y",), ("plain",)], "element string")
    h = spark.createDataFrame([("a_b_1", 1), ("a:b|1", 2), ("x y", 3), ("plain", 4)], "element_id string, v int")
    assert {tuple(x) for x in ch.by_either_id(e, h).collect()} == {("a:b|1", 1), ("x y", 3), ("plain", 4)}


def test_appended_described_and_stubs(spark):
    r = spark.createDataFrame([("a", 1)], "k string, n int")
    f = spark.createDataFrame([("a", "attL"), ("z", "attR")], "k string, note string")
    every, lost = ch.appended(r, f, "k", r)
    assert {tuple(x) for x in every.collect()} == {("a", 1, None), ("a", None, "attL")}
    assert [x.k for x in lost.collect()] == ["z"]
    d = ch.described(r.union(spark.createDataFrame([("b", 2), ("c", 3)], "k string, n int")), spark.createDataFrame([("a", "y"), ("a", "x"), ("c", " ")], "k string, text string"), "k", "text")
    assert {x.k: x.text for x in d.collect()} == {"a": "x", "b": "b", "c": "c"}
    s = ch.with_stubs(r, spark.createDataFrame([("a",), ("q",), ("q",)], "k string"), "k", {"n": F.lit(0)})
    assert sorted(tuple(x) for x in s.collect()) == [("a", 1), ("q", 0)]
    g = spark.createDataFrame([("a", None, 9), ("a", True, 1), ("b", False, 3), ("b", False, 2)], "k string, ok boolean, v int")
    assert {x.k: x.v for x in ch.preferred(g, ["k"], "ok", [F.col("v")]).collect()} == {"a": 1, "b": 2}
    assert [x[0] for x in spark.createDataFrame([("a:b:1",), (":x",), (None,)], "h string").select(ch.id_parts(F.col("h"))).collect()] == ["a", None, None]
    assert [x[0] for x in spark.createDataFrame([("x|locus=L 1|y",), ("x",), (None,)], "h string").select(ch.locus_of(F.col("h"))).collect()] == ["L 1", None, None]


def test_patterns_and_tests(spark):
    rows = [("e", i, k) for i, k in enumerate("PxMxxC")] + [("f", i, k) for i, k in enumerate("CMP")] + [("g", i, k) for i, k in enumerate("PxxxxMC")] + [("h", 0, None)]
    t = ch.ordered_triple(spark.createDataFrame(rows, "e string, i int, k string"), "e", "i", F.col("k") == "P", F.col("k") == "M", F.col("k") == "C", 3)
    assert {x.e: x.found for x in t.collect()} == {"e": True, "f": False, "g": False, "h": False}
    w = spark.createDataFrame([("MerA host",), ("host copper",), ("copper",), (None,)], "t string")
    assert [x[0] for x in w.select(ch.three_way(F.col("t"), "mera", "host", "copper")).collect()] == [True, False, True, False]
    s = spark.createDataFrame([("g", "a", "RM_I|CAS_x"), ("g", "a", "RM_I"), ("g", "b", "RM_I; Abi"), ("h", "c", None)], "g string, e string, s string")
    assert [tuple(x) for x in ch.split_systems(s, "g", "e", "s").collect()] == [("g", 1, 2, 1, 3, "CAS_x", "RM_I")]
