"""Fallback joins, overlays, communities and deduplication."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import communities as cm
from brindle.operators import lookups as lk
from brindle.operators import matrix as mx


@pytest.mark.parametrize("small", [lk.SMALL, 0])
def test_name_lookup(spark, monkeypatch, small):
    monkeypatch.setattr(lk, "SMALL", small)
    df = spark.createDataFrame([("1", 1), ("ctg", 2), ("long_ctg_9", 3), ("zz", 4), (None, 5), ("", 6)], "contig string, i int")
    names = spark.createDataFrame([("01", "a"), ("1", "b"), ("my_ctg_2", "c"), ("my_ctg_1", "d"), ("ctg_9", "e")], "name string, v string")
    got = {x.i: x.v for x in lk.name_lookup(df, names, "contig", "name", [F.col("name")]).collect()}
    assert got == {1: "b", 2: "e", 3: "e", 4: None, 5: None, 6: None}
    p = spark.createDataFrame([("a|s=2", 2), ("a|s=1", 1), ("ab|s=1", 3)], "cid string, n int")
    assert {x.contig: x.n for x in lk.prefix_lookup(spark.createDataFrame([("a",), ("b",)], "contig string"), p, "contig", "cid", "|", [F.col("cid")]).collect()} == {"a": 1, "b": None}


def test_hits_go_to_one_gene(spark):
    genes = spark.createDataFrame([("e", 0, "L1", 1, 90), ("e", 1, "L2", 100, 190), ("f", 0, "L1", 1, 9)], "element string, gene int, locus_tag string, start int, end int")
    hits = spark.createDataFrame([("e", 1, "L2", None, 1, 5), ("e", 2, "x", "L1", None, None), ("e", 3, None, None, 150, 80), ("e", 4, None, None, 500, 510)], "element string, hit int, locus string, hit_id string, lo int, hi int")
    assert {x.hit: (x.gene, x.via) for x in lk.assign_hits(hits, genes).collect()} == {1: (1, "locus"), 2: (0, "hit_id"), 3: (0, "overlap"), 4: (None, None)}
    spans = spark.createDataFrame([("e", 1, 60, "rm"), ("e", 150, 170, "ta")], "element string, s int, e int, label string")
    g = genes.withColumn("kind", F.when(F.col("gene") == 1, "rm0").otherwise("other"))
    out = {(x.element, x.gene): x.kind for x in lk.overlay_spans(g, spans, ["element"], ("start", "end"), ("s", "e"), ["element", "gene"], "kind", "label", keep=["rm0"]).collect()}
    assert out == {("e", 0): "rm", ("e", 1): "rm0", ("f", 0): "other"}


def test_small_helpers(spark):
    a = spark.createDataFrame([("x", "y", 0.5), ("y", "x", 0.7)], "src string, dst string, weight double")
    b = spark.createDataFrame([("x", "y", 0.1), ("z", "y", 0.2)], "src string, dst string, weight double")
    assert {tuple(r) for r in lk.merge_edges(a, b).collect()} == {("x", "y", 0.7, 0.1, 0.7, "both"), ("y", "z", None, 0.2, 0.2, "b")}
    f = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "a"), ("d1", "z")], "d string, f string")
    assert [r.d for r in lk.complete_groups(f, "d", "f", ["a", "b"]).collect()] == ["d1"]
    t = spark.createDataFrame([("Rel(E) toxin(90aa,5-277); bad; y(1aa,1-3)", "RM_II|CBASS; x"), (None, None)], "t string, k string")
    rows = t.select(lk.blob_items(F.col("t")).alias("b"), lk.tokens(F.col("k")).alias("k")).collect()
    assert [(x.name, x.aa, x.start, x.end) for x in rows[0].b] == [("Rel(E) toxin", 90, 5, 277), ("y", 1, 1, 3)] and rows[0].k == ["RM_II", "CBASS", "x"]
    assert rows[1].b == [] and rows[1].k == []


def test_communities_are_seeded_and_beat_chance(spark):
    r = random.Random(8)
    e = [(i, j, 1.0) for g in range(4) for i in range(g * 10, g * 10 + 10) for j in range(i + 1, g * 10 + 10) if r.random() < 0.7] + [(0, 10, 0.5), (20, 30, 0.5), (50, 51, 1.0)]
    df = spark.createDataFrame(e, "src long, dst long, weight double")
    one = {x.node: x.community for x in cm.communities(df).collect()}
    two = {x.node: x.community for x in cm.communities(df.repartition(7)).collect()}
    assert one == two and one[50] == one[51] == -1
    assert all(len({one[i] for i in range(g * 10, g * 10 + 10)}) == 1 for g in range(4)) and len(set(one.values())) == 5
    s, d, w = (np.array(x) for x in zip(*e))
    nodes = np.unique(np.r_[s, d])
    lab = cm.louvain(len(nodes), np.searchsorted(nodes, s), np.searchsorted(nodes, d), w)
    assert cm.modularity(np.searchsorted(nodes, s), np.searchsorted(nodes, d), w, lab) > 0.6
    assert cm.communities(df.limit(0)).count() == 0


def test_deduplicate(spark):
    r = random.Random(3)
    base = ["".join(r.choices("ACGT", k=r.randint(120, 200))) for _ in range(12)]
    rows = []
    for i, b in enumerate(base):
        rows.append((f"{i:02d}a", b))
        rows.append((f"{i:02d}b", b.lower()))
        m = list(b[: len(b) - 10])
        m[50] = "A" if m[50] != "A" else "C"
        rows.append((f"{i:02d}c", "".join(m)))
    rows += [("short", "ACG"), ("none", None), ("empty", "")]
    got = {x.key: x.representative for x in cm.deduplicate(spark.createDataFrame(rows, "key string, seq string"), "key", "seq").collect()}
    assert got == {**{f"{i:02d}{c}": f"{i:02d}a" for i in range(12) for c in "abc"}, "short": "short", "empty": "empty"}


def test_deduplicate_is_the_whole_greedy_pass(spark, monkeypatch):
    """Shared boilerplate, and texts whose longest partner follows another one: as the pass over all pairs, in any number of rounds."""
    r = random.Random(5)
    parts = ["".join(r.choices("ACDEFGHIKLMNPQRSTVWY", k=r.randint(30, 60))) for _ in range(25)]
    texts = ["".join(r.sample(parts, r.randint(1, 6))) + "".join(r.choices("ACGT", k=r.randint(0, 80))) for _ in range(180)]
    rows = [(f"{i:03d}", t) for i, t in enumerate([*texts, *texts[:9], "ACGT", ""])]
    first: dict[str, str] = {}
    for i, t in rows:
        first.setdefault(t, i)
    word = {t: {t[j : j + 12] for j in range(len(t) - 11)} for t in first}
    heads, rep = [], {}
    for t in sorted(first, key=lambda t: (-len(t), first[t])):
        rep[t] = next((h for h in heads if word[t] and len(word[t] & word[h]) >= 0.9**12 * len(word[t])), t)
        heads += [t] if rep[t] == t else []
    want = {i: first[rep[t]] for i, t in rows}
    df = spark.createDataFrame(rows, "key string, seq string").repartition(5)
    assert {x.key: x.representative for x in cm.deduplicate(df, "key", "seq").collect()} == want
    monkeypatch.setattr(cm, "BLOCK", 16)
    assert {x.key: x.representative for x in cm.deduplicate(df, "key", "seq").collect()} == want


def test_communities_above_the_driver_bound_are_coarsened(spark, monkeypatch):
    r = random.Random(6)
    e = [(i, j, 1.0) for g in range(12) for i in range(g * 10, g * 10 + 10) for j in range(i + 1, g * 10 + 10) if r.random() < 0.7]
    e += [(g * 10, (g * 10 + 10) % 120, 0.5) for g in range(12)] + [(500, 501, 1.0)] + [(600, i, 1.0) for i in range(601, 640)]
    df = spark.createDataFrame(e, "src long, dst long, weight double")
    s, d, w = (np.array(x) for x in zip(*e))
    nodes = np.unique(np.r_[s, d])
    a, b = np.searchsorted(nodes, s), np.searchsorted(nodes, d)
    whole = cm.modularity(a, b, w, cm.louvain(len(nodes), a, b, w))
    for most in (60, 0):  # the driver ends the work, and rounds alone
        monkeypatch.setattr(cm, "GRAPH", most)
        one = {x.node: x.community for x in cm.communities(df, least=1).collect()}
        assert one == {x.node: x.community for x in cm.communities(df.repartition(7), least=1).collect()}
        assert set(one) == set(nodes.tolist())
        assert cm.modularity(a, b, w, np.array([one[n] for n in nodes.tolist()])) > 0.93 * whole
    assert {x.node for x in cm.communities(df).where("community = -1").collect()} >= {500, 501}


def test_permutation_test_holds_no_graph(spark, monkeypatch):
    monkeypatch.setattr(mx, "GRAPH", 10, raising=False)  # a graph of any size
    n, reps = 301, 400
    r = random.Random(9)
    lab = {i: "abc"[min(2, i % 4)] for i in range(n)}
    e = [(r.randrange(n), r.randrange(n)) for _ in range(500)] + [(i, i + 4) for i in range(0, 120, 4)]
    edges = spark.createDataFrame(e, "src long, dst long").repartition(5)
    got = {(x.a, x.b): x for x in mx.permutation_test(edges, spark.createDataFrame(list(lab.items()), "n long, l string"), "n", "l", reps).collect()}
    code = np.array(["abc".index(lab[i]) for i in range(n)])
    s, d = np.array(e).T
    cells = lambda c: np.bincount(np.minimum(c[s], c[d]) * 3 + np.maximum(c[s], c[d]), minlength=9)
    hit = np.mean([cells(np.random.default_rng(i).permutation(code)) >= cells(code) for i in range(4000)], axis=0)
    for (a, b), x in got.items():
        c = "abc".index(a) * 3 + "abc".index(b)
        assert x.observed == cells(code)[c] and abs(x.p - hit[c]) < 0.09
    assert len(got) == (cells(code) > 0).sum()
    for k in (1, 2, 5, 17, 300):
        assert sorted(mx.shuffled(np.arange(k), k, 1, 2).tolist()) == list(range(k))
