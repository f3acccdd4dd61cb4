"""Cargo operators on small cases."""

from pyspark.sql import functions as F

from brindle.operators import cargo as cg


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_pairs_and_compositions(spark):
    lit = F.lit
    status = lambda t, a, o, s: one(spark, cg.pair_status(lit(t), lit(a), lit(o), lit(s)))
    assert [status(True, True, "", None), status(False, True, "", "AbiE"), status(True, False, "HTH domain; Hypothetical protein(90aa,1-270)", ""), status(False, True, "hth x", ""), status(True, False, None, "")] == ["named pair", "named pair", "likely pair", "antitoxin only", "toxin only"]
    assert [one(spark, cg.pair_family(lit(x))) for x in ("HicA toxin", "Doc protein", "dock", "RelE", "PIN family", None)] == ["HicAB", "Phd-Doc", "unnamed", "RelBE", "VapBC", "unnamed"]
    assert [one(spark, cg.composition(lit(c), lit(t))) for c, t in (("Mixed", ""), ("Type I", "x"), ("Type II", "methyltransferase; restriction"), ("Type II", "Methylase"), ("Type II", "REase"), ("Type II", None))] == ["mixed classes", "M+R pair", "M+R pair", "MTase only", "REase only", "M+R pair"]
    arr = lambda *v: F.array(*[lit(x) for x in v]).cast("array<string>")
    assert [one(spark, cg.merged_class(arr(*a), arr(*b), ["MTase only"])) for a, b in ((["Type I"], ["MTase only"]), (["Type I"], ["Type II"]), ([], ["MTase only"]), ([], []))] == ["Type I", "Mixed", "MTase only", ""]


def test_scan_and_budget(spark):
    g = spark.createDataFrame([("a", "k2", 50, 80, 10, "y", "ta"), ("a", "k1", 1, 40, 13, "x", "ta"), ("a", "k3", 90, 99, 3, "z", "other"), ("b", "k4", 1, 9, 3, "i", "int")], "element string, key string, start int, end int, aa int, product string, kind string")
    got = {x.element: x for x in cg.kind_scan(g, ["int", "ta", "other"], assumed="int").collect()}
    assert got["a"].ta_products == "x(13aa,1-40); y(10aa,50-80)" and (got["a"].n_int, got["a"].n_ta, got["b"].n_ta, got["b"].has_ta, got["b"].ta_products) == (1, 2, 0, False, "")
    scan = cg.kind_scan(g, ["int", "ta", "other"])
    assert [x.element for x in cg.few_extras(scan, "ta").collect()] == ["a"] and cg.few_extras(scan, "ta", most=2).count() == 0
    c = spark.createDataFrame([("RM_x", 50), (None, 10), (None, 11), ("", None)], "systems string, n int")
    assert cg.candidates(c, "systems", "^RM_", "n").count() == 2


def test_minimality(spark):
    rows = [("a", ["RM", "replication"], 0, 2, 6), ("b", ["replication"], 0, 9, None), ("c", [], 0, 0, 1), ("d", ["RM", "TA"], 0, 0, 3), ("e", ["TA", "TA"], 1, 0, 7)]
    m = cg.minimality(spark.createDataFrame(rows, "element string, classes array<string>, n_leftover int, n_ok_adj int, n_cds int"))
    got = {x.element: (x.char_class, x.n_char_classes, x.class_minimal, x.composition_minimal, x.composition_compact, x.tight) for x in m.collect()}
    assert got == {"a": ("RM", 1, True, True, True, True), "b": ("replication", 1, True, True, False, False), "c": ("", 0, False, False, False, False), "d": ("RM|TA", 2, False, False, False, False), "e": ("TA", 1, True, False, False, False)}
    f = {x.metric: x.n for x in cg.funnel(m).collect()}
    assert (f["all"], f["class_minimal"], f["composition_minimal"], f["module_plus_rep"], f["no_class"], f["several_classes"]) == (5, 3, 2, 1, 1, 1)
    assert {x.metric: x.n for x in cg.funnel(m.limit(0)).collect()}["tight"] == 0


def test_overlay_and_recount(spark):
    part = lambda t: one(spark, cg.ranked_part(F.lit(t), ["expert", "pscc", "family"], ["pfamE1:", "KO:", "EC:", "psc_vs:"]))
    best = part("family:DUF1; KO:1; pscc:abc; pscc:later")
    assert (best.source, best.text) == ("pscc", "abc")
    assert part("KO:1; EC:2") is None and part(None) is None and (part("plain; other").source, part("plain; other").text) == ("other", "plain")
    e = spark.createDataFrame([("a", ["TA", "other_defense"], 2, 0), ("b", ["TA"], 1, 1)], "element string, classes array<string>, n_ok_adj long, n_leftover long")
    c = spark.createDataFrame([("a", "AMR", True), ("a", "int", True), ("a", "leftover", False), ("a", "ok_adj", False)], "element string, role string, resolved boolean")
    got = {x.element: (x.classes, x.n_ok_adj, x.n_leftover, x.added, x.n_overlay, x.n_unresolved) for x in cg.recount(e, c, ["AMR"]).collect()}
    assert got == {"a": (["AMR", "TA"], 0, 1, "AMR", 4, 2), "b": (["TA"], 1, 1, "", 0, 0)}


def test_imputation_and_plates(spark):
    rows = [("a", "k1", 300, "unresolved", "RM"), ("a", "k2", 390, "unresolved", "RM"), ("a", "k3", 700, "unresolved", "RM"), ("b", "k1", 90, "unresolved", "TA"), ("b", "k2", 80, "module", "TA"), ("b", "k3", 400, "int", "TA"), ("c", "k1", 100, "unresolved", "X")]
    g = cg.imputed_roles(spark.createDataFrame(rows, "element string, key string, aa int, role string, char string").repartition(3), ["RM"])
    assert {(x.element, x.key): x.role for x in g.collect()} == {("a", "k1"): "unresolved", ("a", "k2"): "int", ("a", "k3"): "module", ("b", "k1"): "accessory", ("b", "k2"): "module", ("b", "k3"): "int", ("c", "k1"): "unresolved"}
    m = {x.element: (x.module_minimal, x.module_pending, x.n_extras) for x in cg.module_flags(g).collect()}
    assert m == {"a": (False, True, 2), "b": (True, False, 2), "c": (False, False, 1)}
    d = cg.module_flags(g).withColumn("char_class", F.when(F.col("element") == "c", "").otherwise("RM")).withColumn("n_char_classes", F.lit(1))
    p = spark.createDataFrame([("c", "TA")], "element string, plate string")
    out = {x.element: (x.char_class, x.compact_minimal) for x in cg.compact(d, p, spark.createDataFrame([("a",)], "element string")).collect()}
    assert out == {"a": ("RM", False), "b": ("RM", True), "c": ("TA", True)}
