"""Core operators on small cases: fixtures of the survey, random checks against plain Python, defined edge cases."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import stats
from brindle.functions import text as tx
from brindle.functions.bitmaps import RangeBitmap
from brindle.operators import intervals as iv
from brindle.operators import matrix as mx
from brindle.operators import rules
from brindle.operators.cascade import all_matches, cascade, first_match
from brindle.operators.graph import connected_components
from brindle.operators.orphans import References, orphan_references
from brindle.operators.topk import collapse_runs, first_wins, top1, topk, with_other

codes = st.lists(st.integers(0, 200_000), max_size=300)


@settings(max_examples=60, deadline=None)
@given(codes, codes, st.booleans())
def test_bitmaps(a, b, dense):
    if dense:
        a, b = a + list(range(0, 12_000, 2)), b + list(range(5_000, 16_000))
    x, y = RangeBitmap.of(np.array(a, dtype=np.int64)), RangeBitmap.of(np.array(b, dtype=np.int64))
    assert set(x.and_not(y).decode().tolist()) == set(a) - set(b)
    assert set(x.union(y).decode().tolist()) == set(a) | set(b)
    assert len(x) == len(set(a)) and x.nbytes() <= 8192 * len(x.containers)


def stamp(minutes):
    return None if minutes is None else np.datetime64("2025-01-01T00:00:00", "us") + np.timedelta64(int(minutes), "m")


def test_orphans_against_brute_force(spark):
    r = random.Random(9)
    keys = [f"k{i}" for i in range(12)]
    parents = [(r.choice(keys), r.choice([None, 1]) and r.randint(0, 120_000), None, "x") for _ in range(8)]
    for _ in range(25):
        a = r.randint(0, 120_000)
        parents.append((r.choice(keys), a, r.choice([None, a + r.randint(-5, 60_000), a + r.randint(1, 3_000)]), "x"))
    parents += parents[:5]
    dirty = lambda k: r.choice([k, f" {k}\t", f"{k}|sample=S", f"{k}.0"])
    refs = [(dirty(r.choice(keys + ["gone"])), r.choice([None, *[r.randint(0, 130_000)] * 30]), "x") for _ in range(600)] + [(x, 5, "x") for x in (None, " ", "nan", "None", "<NA>")]
    ts = lambda m: None if m is None else stamp(m).astype("datetime64[us]").item()
    p = spark.createDataFrame([(k, ts(a), ts(b), z) for k, a, b, z in parents], "id string, since timestamp_ntz, until timestamp_ntz, key string")
    q = spark.createDataFrame([(k, ts(t), z) for k, t, z in refs], "ref string, at timestamp_ntz, month string").repartition(4)
    want = set()
    for k, t, _ in refs:
        k = (k or "").strip().split("|sample=")[0].strip()
        k = k[:-2] if k.endswith(".0") else k
        if k in ("", "nan", "None", "<NA>") or t is None:
            continue
        if not any(i == k and a is not None and a <= t and (b is None or b > t) for i, a, b, _ in parents):
            want.add(("t", k, str(stamp(t))[:7]))
    got = {tuple(x) for x in orphan_references([References("t", q, "ref", "at", "rep", True)], p, {"rep": "id"}, "since", "until").collect()}
    assert got == want
    assert orphan_references([References("t", q.limit(0), "ref", "at", "rep")], p, {"rep": "id"}, "since", "until").count() == 0
    assert orphan_references([References("t", q, "ref", "at", "rep")], p.limit(0), {"rep": "id"}, "since", "until").count() > 0


def test_interval_union_and_range_join(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), i, r.randint(1, 60_000), 0) for i in range(250)]
    rows = [(c, i, s, s + r.choice([0, 5, 40, 30_000])) for c, i, s, _ in rows] + [("c", 900, None, 4), ("c", 901, 9, 3), ("d", 902, 1, 5), ("d", 903, 6, 9)]
    df = spark.createDataFrame(rows, "contig string, key long, start long, end long")
    got = {(x.contig, x.start, x.end) for x in iv.interval_union(df, ["contig"], "start", "end").collect()}
    want = set()
    for c in "abd":
        last = None
        for s, e in sorted((s, e) for k, _, s, e in rows if k == c and s is not None and e >= s):
            if last and s <= last[1] + 1:
                last[1] = max(last[1], e)
            else:
                last and want.add((c, *last))
                last = [s, e]
        want.add((c, *last))
    assert got == want and ("d", 1, 9) in got
    for width in (700, 20_000):
        assert {(x.contig, x.start, x.end) for x in iv.interval_union(df, ["contig"], "start", "end", width).collect()} == want
    again = iv.interval_union(iv.interval_union(df, ["contig"], "start", "end"), ["contig"], "start", "end")
    assert {(x.contig, x.start, x.end) for x in again.collect()} == want
    right = df.select("contig", F.col("key").alias("k2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    ok = [x for x in rows if x[2] is not None and x[3] >= x[2]]
    pairs = [(x.key, x.k2) for x in iv.range_join(df.where("end >= start"), right.where("e2 >= s2"), ["contig"], ("start", "end"), ("s2", "e2")).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(x[1], y[1]) for x, y in itertools.product(ok, ok) if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3]}


def test_overlap_classes(spark):
    sites = spark.createDataFrame([("a", 1, 500, 520), ("a", 2, 590, 610), ("a", 3, 610, 620), ("b", 4, 1, 9)], "contig string, site long, s long, e long")
    cds = spark.createDataFrame([("a", 600, 700)], "contig string, f long, g long")
    got = {x.site: x.overlap_class for x in iv.overlap_class(sites, cds, ["contig"], ("s", "e"), ("f", "g"), ["site"]).collect()}
    assert got == {1: "intergenic", 2: "partial_CDS", 3: "fully_inside_CDS", 4: "no_cds_on_contig"}


def test_regions(spark):
    x = spark.createDataFrame([("o_1:ctg:9:200-100|sample=S",), ("nothing",)], "t string").select(iv.parse_region(F.col("t")).alias("r")).collect()
    assert tuple(x[0].r) == ("ctg:9", 100, 200) and tuple(x[1].r) == (None, None, None)


def test_cascade_names_the_first_failure(spark):
    df = spark.createDataFrame([(1, 5, None), (2, None, 1), (3, 1, 1), (4, 9, 9)], "id int, a int, b int")
    out = {x.id: x for x in cascade(df, [("a", F.col("a") > 3, "small_a"), ("b", F.col("b") > 3, "small_b")], stop_after=1).collect()}
    assert [out[i].reject_reason for i in (1, 2, 3, 4)] == ["small_b", "small_a", "small_a", ""]
    assert [out[i].passed_b for i in (1, 2, 3, 4)] == [False, False, False, True] and out[4].passed


def test_first_and_all_matches(spark):
    df = spark.createDataFrame([("xa",), ("a",), (None,)], "t string")
    r = [(F.col("t").startswith("x"), "one"), (F.col("t").contains("a"), "two")]
    assert [tuple(x) for x in df.select(first_match(r, "none"), all_matches(r, "none")).collect()] == [("one", ["one", "two"]), ("two", ["two"]), ("none", ["none"])]


def test_top_rows(spark):
    df = spark.createDataFrame([("g", 2, "b"), ("g", 2, "a"), ("h", 1, "c"), ("g", 1, "z")], "g string, s int, t string")
    assert {tuple(x) for x in top1(df, ["g"], [F.desc("s"), F.col("t")]).collect()} == {("g", 2, "a"), ("h", 1, "c")}
    assert topk(df, ["g"], [F.desc("s"), F.col("t")], 2).count() == 3
    a, b = df.select("t", "s"), df.select("t", "g")
    assert {(x.t, x.s) for x in first_wins([a.where("s = 2"), b], ["t"], [F.col("t")]).collect()} == {("a", 2), ("b", 2), ("c", None), ("z", None)}
    assert {x.bin for x in with_other(df, "g", 1).collect()} == {"g", "Other"}
    runs = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "x")], "i int, v string").withColumn("k", F.lit(1))
    assert [x.i for x in collapse_runs(runs, ["k"], [F.col("i")], "v").orderBy("i").collect()] == [1, 3, 5]


def lcp(a, b):
    return len(list(itertools.takewhile(lambda x: x[0] == x[1], zip(a, b))))


def test_anchored_run(spark):
    r = random.Random(6)
    rows = [("AACCGGTTAACCGGTTACGT", "NNNNAACCGGTTAACCGGTTACGT", "+"), ("", "A", "+"), ("", "", "-")]
    rows += [("".join(r.choices("ACG", k=r.randint(0, 14))), "".join(r.choices("ACG", k=r.randint(0, 14))), r.choice("+-")) for _ in range(200)]
    got = [x[0] for x in spark.createDataFrame(rows, "x string, y string, s string").coalesce(1).select(tx.anchored_run(F.col("x"), F.col("y"), F.col("s"))).collect()]
    for (x, y, s), g in zip(rows, got):
        x, y = (x[::-1], y[::-1]) if s == "+" else (x, y)
        assert g == max(max(lcp(x[k:], y), lcp(x, y[k:])) for k in range(4))
    assert got[0] == 20


def test_text_functions(spark):
    x = spark.createDataFrame([("GCA_12.1_x", "/d/bin_1.fa.gz", " nan ", "AACGN")], "a string, p string, n string, q string")
    got = x.select(tx.accession(F.col("a")), tx.sample_name(F.col("p")), tx.absent(F.col("n")), tx.reverse_complement(F.col("q")), tx.slice_oriented(F.col("q"), F.lit(2), F.lit(3), F.lit("+")), tx.protein_length(F.lit(1000), F.lit(1902))).first()
    assert tuple(got) == ("GCA_12.1", "bin_1", None, "NCGTT", "AC", 301)


def test_tail_probabilities():
    for k, m in [(0, 3), (1, 0.5), (5, 2.5), (3, 9.0), (40, 5.0), (900, 850.0)]:
        want = 1 - math.fsum(math.exp(i * math.log(m) - m - math.lgamma(i + 1)) for i in range(k)) if k < 60 and k <= 3 * m + 9 else None
        if want is not None and want > 1e-9:
            assert abs(stats.poisson_sf(k, m) - want) < 1e-9
    assert stats.log_poisson_sf(2_000, 1.0) < -10_000 and stats.poisson_sf(1, 0) == 0.0
    r = random.Random(1)
    for _ in range(60):
        a, b, c, d = (r.randint(0, 7) for _ in range(4))
        n, row, col = a + b + c + d, a + b, a + c
        want = sum(math.comb(row, x) * math.comb(n - row, col - x) for x in range(a, min(row, col) + 1) if col - x <= n - row) / math.comb(n, col)
        assert abs(stats.fisher_greater(a, b, c, d) - want) < 1e-9
    k, m = [3, 0, 900, 2_000_000], [2.0, 4.0, 850.0, 1_999_000.0]
    assert [float(x) for x in stats.poisson_sf(k, m)] == [float(stats.poisson_sf(a, b)[0]) for a, b in zip(k, m)]
    assert stats.fisher_greater([5, 2], [1, 2], [0, 2], [9, 2]).shape == (2,)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from brindle import session

    class Context:
        master = "spark://somewhere"
        _jsc = type("J", (), {"sc": lambda self: type("C", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Session:
        sparkContext = Context()
        conf = type("F", (), {"get": lambda self, key, default=None: default})()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_false_discovery(spark):
    p = [0.01, 0.04, 0.03, 0.03, 0.5, None, float("nan")]
    got = {x.i: x.q for x in stats.false_discovery(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").collect()}
    v = sorted(1.0 if x is None or math.isnan(x) else x for x in p)
    for i, x in enumerate(p):
        x = 1.0 if x is None or math.isnan(x) else x
        assert abs(got[i] - min(1, min(y * len(v) / (len(v) - v[::-1].index(y)) for y in v if y >= x))) < 1e-12


def test_components_and_agreement(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "src long, dst long")
    got = {x.node: x.component for x in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(e.limit(0)).count() == 0
    lab = spark.createDataFrame([(i % 3, i % 3 + 5) for i in range(30)], "a int, b int")
    x = mx.agreement(lab, "a", "b").first()
    assert abs(x.ari - 1) < 1e-12 and abs(x.nmi - 1) < 1e-12


def test_blocks_of_a_hot_feature_change_nothing(spark, monkeypatch):
    r = random.Random(12)
    rows = [(i, "hot", 1.0) for i in range(60)] + [(i, f"f{r.randint(0, 9)}", float(r.randint(1, 3))) for i in range(60) for _ in range(3)]
    df = spark.createDataFrame(rows, "r int, f string, v double").repartition(3)
    show = lambda: sorted((x.i, x.j, round(x.jaccard, 9)) for x in mx.weighted_jaccard(df, "r", "f", "v").collect())
    whole = show()
    monkeypatch.setattr(mx, "BLOCK", 7)
    assert len(whole) == 60 * 59 // 2 and show() == whole


def test_knn_edges_are_symmetric_and_folds_are_spelled_out(spark):
    long = spark.createDataFrame([(i, f, 1.0) for i in range(8) for f in range(i % 3, i % 3 + 4)], "row long, feature long, value double")
    pairs = mx.weighted_jaccard(long, "row", "feature", "value")
    e = mx.knn_edges(pairs, 2).collect()
    assert all(x.src < x.dst and 0 < x.weight <= 1 for x in e)
    f = [x[0] for x in spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (0.0, 0.0)], "a double, b double").select(mx.fold(F.col("a"), F.col("b"))).collect()]
    assert f[0] == 0.5 and f[1] == math.inf and math.isnan(f[2])
    p = mx.permutation_test(spark.createDataFrame([(0, 1), (2, 3)], "src long, dst long"), spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "n long, l string"), "n", "l", 50).collect()
    assert sum(x.observed for x in p) == 2 and all(0 < x.p <= 1 for x in p)


def test_marker_matching_and_doubled_backslashes(spark):
    m = rules.load({"markers": {"int": {"category": "integrase", "weight": 1.0, "pfam": ["PF00589"], "regex": ["integrase"]}, "zot": {"category": "phage", "regex": [r"\\bZot\\b"]}}})
    g = spark.createDataFrame([(1, "phage Integrase", ["PF00589"]), (2, "an integrase", []), (3, "Zot protein", None)], "g int, t string, acc array<string>")
    got = {(x.g, x.key, x.via) for x in rules.marker_hits(g, m, "t", "acc").collect()}
    assert got == {(1, "int", "pfam:PF00589"), (2, "int", "regex")}  # a doubled backslash never matches plain text
    s = rules.module_scores(rules.marker_hits(g, m, "t", "acc"), "g", m, 1.22).collect()
    assert {(x.g, x.score_integrase, x.has_int) for x in s} == {(1, round(1 / 1.22, 9), True), (2, round(1 / 1.22, 9), True)}
    b = spark.range(1).select(rules.boosted(F.lit(0.8), F.lit(True), F.lit(True), F.lit(True))).first()[0]
    assert b == 1.0
    k = spark.range(1).select(rules.runner_up({"a": F.lit(0.2), "b": F.lit(0.9), "c": F.lit(0.9)}, 2)).first()[0]
    assert k == ["b", "c"]


@pytest.mark.parametrize("name", ["grf15_permutation", "sta1_mixing", "sta5_class_enrichment"])
def test_queries_without_sql_run(spark, name):
    import __spark_entry__ as entry

    rows = entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(0 <= x.p <= 1 for x in rows)
