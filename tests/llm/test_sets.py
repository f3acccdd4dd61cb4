"""Set joins and chain clusters against brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest

from brindle.llm import cf, setjoin


def make(seed, n=160):
    r = random.Random(seed)
    vocab = [f"t{i}" for i in range(150)]
    sets, base = {}, []
    for i in range(n):
        if base and r.random() < 0.6:
            s = set(r.choice(base))
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                s.discard(r.choice(sorted(s)))
                s.add(r.choice(vocab))
        else:
            s = set(r.sample(vocab, r.randint(1, 14)))
        s |= {"hot"} if r.random() < 0.8 else set()
        base.append(s)
        sets[f"k{i:03d}é" if i % 9 == 0 else f"k{i:03d}"] = s
    rows = [(k, t, "x") for k, s in sets.items() for t in s]
    rows += rows[:40] + [(None, "t1", "x"), ("k001", None, "x")]
    return sets, rows


def alike(sets, num, den, least):
    keys = sorted(k for k, s in sets.items() if len(s) >= least)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}


@pytest.mark.parametrize("num,den,least,cap,bound", [(3, 4, 6, 1500, 16384), (3, 5, 1, 7, 20), (4, 5, 3, 3, 5)])
def test_similar_pairs(spark, monkeypatch, num, den, least, cap, bound):
    sets, rows = make(num * 10 + den)
    monkeypatch.setattr(setjoin, "CELL", cap)
    df = spark.createDataFrame(rows, "genome string, acc string, key string")
    monkeypatch.setattr(setjoin.join_cells, "__defaults__", (False, cap))
    monkeypatch.setattr(setjoin.sample_pivots, "__defaults__", (bound,))
    got = [tuple(x) for x in setjoin.similar_pairs(df, "genome", "acc", Fraction(num, den), least).collect()]
    assert len(got) == len(set(got))
    assert set(got) == alike(sets, num, den, least)


def test_chain_clusters(spark):
    sets, rows = make(77, 200)
    least = 5
    group = {k: k for k, s in sets.items() if len(s) >= least}
    pairs = alike(sets, 3, 5, least)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(group[a], group[b])
            if group[a] != m or group[b] != m:
                group[a] = group[b] = m
                changed = True
    sizes = {}
    for v in group.values():
        sizes[v] = sizes.get(v, 0) + 1
    want = {(k, v) for k, v in group.items() if sizes[v] > 1}
    df = spark.createDataFrame(rows, "key string, feature string, cluster_key string").repartition(9)
    assert {tuple(x) for x in cf.cluster_members(setjoin.sets(df, "key", "feature", least), Fraction(3, 5)).collect()} == want
    profiles = cf.cluster_profiles(setjoin.sets(df, "key", "feature", least), Fraction(3, 5)).collect()
    assert {(x.cluster_key, x["size"]) for x in profiles} == {(v, n) for v, n in sizes.items() if n > 1}
    assert all(set(x.typical) <= {k for k, v in want if v == x.cluster_key} and 1 <= len(x.typical) <= 3 for x in profiles)


def test_a_third_of_all_keys_in_one_class(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "MEMBERS", 16)
    rows = [(f"h{i:03d}", f"t{j}") for i in range(90) for j in range(8)] + [(f"n{i:03d}", f"t{j}") for i in range(40) for j in range(7)]
    rows += [(f"x{i:03d}", f"{i}.{j}") for i in range(140) for j in range(8)]
    df = spark.createDataFrame(rows, "key string, t string").repartition(5)
    got = [tuple(x) for x in setjoin.similar_pairs(df, "key", "t", Fraction(3, 4), 2).collect()]
    names = [f"h{i:03d}" for i in range(90)] + [f"n{i:03d}" for i in range(40)]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in names for b in names if a < b}
    pairs, members, groups = setjoin.similar_sets(df, "key", "t", Fraction(3, 4), 2)
    assert pairs.count() == 1 and members.count() == 270 and groups.count() == 142


def test_pivot_cells_give_nearly_all_pairs(spark):
    """The named method, alone: pairs that meet in pivot cells, against all pairs."""
    r = random.Random(6)
    rows = []
    for f in range(160):
        base = r.sample(range(4000), r.randint(12, 24))
        for m in range(r.choice([1, 2, 3, 5])):
            mine = [t if r.random() > 0.06 else r.randint(0, 4000) for t in base]
            rows += [(f"{f}.{m}", t) for t in set(mine)]
    groups = setjoin.cut_table(setjoin.classes(setjoin.sets(spark.createDataFrame(rows, "key string, t int"), "key", "t", 6)))
    n, e = groups.count(), Fraction(3, 4)
    placed = setjoin.cut_table(setjoin.place(groups, setjoin.sample_pivots(groups, n, 0.25), setjoin.frequent_tokens(groups, n), e, 0.5))
    every, alone = setjoin.join_cells(placed, e).count(), setjoin.join_cells(setjoin.cut_table(placed.where("kind = 0")), e).count()
    print(f"pivot cells alone: {alone} of {every} pairs")
    assert every > 100 and alone >= 0.95 * every


def test_empty(spark):
    df = spark.createDataFrame([], "k string, t string")
    assert setjoin.similar_pairs(df, "k", "t", Fraction(3, 4), 2).count() == 0
    assert cf.cluster_members(setjoin.sets(df, "k", "t", 2), Fraction(3, 5)).count() == 0


def test_leaves_merge_adds_features():
    """Leaves of two partitions, merged, hold the sums of all vectors; copies and near copies share a leaf."""
    r = random.Random(8)
    hashed = lambda v: np.array(sorted(hash(("t", x)) for x in v), dtype=np.int64)
    base = [[f"{i}.{j}" for j in range(20)] for i in range(30)]
    records = [hashed(r.sample(base[i % 30], 18)) for i in range(600)]
    parts = []
    for half in (records[:300], records[300:]):
        leaves = cf.Leaves(64)
        leaves.add(half, [np.ones(len(t)) for t in half], np.full(len(half), 2))
        parts.append(leaves.rows())
    merged = cf.Leaves(64)
    for p in parts:
        merged.add(p["tokens"].tolist(), p["counts"].tolist(), p["n"].to_numpy())
    rows = merged.rows()
    assert len(rows) <= 34 and rows["n"].sum() == 1200  # thirty groups, hardly one of them split
    total = {}
    for tokens, counts in zip(rows["tokens"], rows["counts"]):
        for t, c in zip(tokens.tolist(), counts.tolist()):
            total[t] = total.get(t, 0) + c
    want = {}
    for x in records:
        for t in x.tolist():
            want[t] = want.get(t, 0) + 1
    assert total == want


def test_a_bounded_list_keeps_the_heaviest_leaves():
    leaves = cf.Leaves(5)
    sets = [np.arange(i * 100, i * 100 + 10, dtype=np.int64) * 0x9E3779B97F4A7 for i in range(40)]
    for i, t in enumerate(sets):
        leaves.add([t], [np.ones(10)], np.array([100 - i]))
    rows = leaves.rows()
    assert len(rows) == 5 and rows["n"].max() == 100 and rows["n"].sum() >= 100 + 99 + 98
    assert len(cf.Leaves(5).rows()) == 0


def test_thinned_pivots_are_apart():
    r = random.Random(5)
    sets = []
    for _ in range(300):
        if sets and r.random() < 0.6:
            x = set(r.choice(sets)) - {r.randint(0, 200)} | {r.randint(0, 200)}
        else:
            x = set(r.sample(range(200), r.randint(3, 12))) | {1000}
        sets.append(np.array(sorted(x), dtype=np.int64))
    sets = [np.array(x, dtype=np.int64) for x in dict.fromkeys(tuple(s.tolist()) for s in sets)]
    for apart in (0.25, 0.4, 0.5, 0.7):
        kept, want = setjoin.thin(sets, apart), []
        for x in map(set, (s.tolist() for s in sets)):
            if all(1 - len(x & y) / len(x | y) > apart + 1e-12 for y in want):
                want.append(x)
        assert [set(k.tolist()) for k in kept] == want
    assert setjoin.thin([], 0.25) == []


def test_pivot_distances_are_exact():
    r = random.Random(4)
    sets = [np.array(sorted(r.sample(range(60), r.randint(2, 12)) + [1000]), dtype=np.int64) for _ in range(300)]
    p = setjoin.Pivots(sets[:200], np.arange(200))
    for x in sets[200:]:
        found, d = p.near(x, 0.9)
        want = {i: 1 - len(set(s) & set(x)) / len(set(s) | set(x)) for i, s in enumerate(sets[:200])}
        assert {i for i, v in want.items() if v <= 0.9} == set(found.tolist())
        assert all(abs(want[i] - v) < 1e-12 for i, v in zip(found.tolist(), d.tolist()))
