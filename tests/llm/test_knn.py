"""Neighbours by the k-means tree against brute force."""

import random

import numpy as np
import pytest

from brindle.llm import knn


def data(n=420, seed=2):
    r = random.Random(seed)
    rows, base = [], []
    for i in range(n):
        if base and r.random() < 0.75:
            v = {f: x * r.choice([1, 1, 1.1, 0.8]) for f, x in r.choice(base).items()}
            if len(v) > 3 and r.random() < 0.5:
                v.pop(r.choice(sorted(v)))
        else:
            v = {f"f{r.randint(0, 400)}": r.random() + 0.1 for _ in range(r.randint(3, 14))}
        base.append(v)
        rows += [(f"e{i:03d}", f, x, "x") for f, x in v.items()]
    for i in range(9):  # copies beyond k
        rows += [(f"c{i}", f"f{j}", 1.0, "x") for j in range(6)]
    rows += rows[:30] + [("e001", "f1", None, "x"), ("e001", "f2", float("nan"), "x"), ("e001", "f3", -2.0, "x"), (None, "f1", 1.0, "x"), ("e002", None, 1.0, "x")]
    return rows


def brute(rows, k, least, n):
    vec = {}
    for key, f, x, _ in rows:
        if key and f and x is not None and x > 0:
            vec.setdefault(key, {})[f] = max(x, vec.get(key, {}).get(f, 0))
    vec = {a: v for a, v in vec.items() if len(v) >= n}
    feats = sorted({f for v in vec.values() for f in v})
    m = np.array([[v.get(f, 0) for f in feats] for v in vec.values()])
    m /= np.sqrt((m * m).sum(1))[:, None]
    s, keys = np.round(m @ m.T, 6), list(vec)
    out = set()
    for i, a in enumerate(keys):
        near = sorted((-s[i, j], b) for j, b in enumerate(keys) if j != i and s[i, j] >= least)[:k]
        out |= {(a, b, -x) for x, b in near}
    return out


@pytest.mark.parametrize("cell", [1200, 40])
def test_recall_and_ties(spark, monkeypatch, cell):
    monkeypatch.setattr(knn, "CELL", cell)
    rows = data()
    want = brute(rows, 3, 0.8, 4)
    df = spark.createDataFrame(rows, "ie string, feature string, value double, cls string").repartition(5)
    got = {(a, b, s) for a, b, s in knn.neighbours(df, "ie", "feature", "value", 3, 0.8, 4).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    copies = {(a, b) for a, b, _ in want if a.startswith("c")}
    assert {(a, b) for a, b, _ in got if a.startswith("c")} == copies


def test_empty(spark):
    df = spark.createDataFrame([], "ie string, feature string, value double")
    assert knn.neighbours(df, "ie", "feature", "value", 3, 0.8, 4).count() == 0


def popped(tree, x, margin):
    """Best bin first with a queue, one node at a time."""
    import heapq

    gap = lambda v: float(np.sqrt(((x.astype(float) - tree.c[v]) ** 2).sum()))
    queue, out, first = [(-1.0, 0)], [], None
    while queue:
        key, v = heapq.heappop(queue)
        if first is not None and key > first + margin:
            break
        if tree.leaf[v] >= 0:
            first = key if first is None else first
            out.append(tree.leaf[v])
        else:
            for w in tree.children[v].tolist():
                heapq.heappush(queue, (max(key, gap(w) - (knn.SLACK if tree.leaf[w] < 0 else 0)), w))
    return out


@pytest.mark.parametrize("margin", [0.0, 0.3, 1.0])
def test_search_visits_what_a_queue_pops(margin):
    x = np.random.default_rng(1).normal(size=(900, knn.DIMS)).astype("float32") / 8
    tree = knn.Tree(x, 4)
    assert tree.leaves > knn.BRANCH
    q, leaf, home = tree.search(x[:40], margin)
    for i in range(40):
        want = popped(tree, x[i], margin)
        assert set(leaf[q == i].tolist()) == set(want) and leaf[(q == i) & home].tolist() == want[:1]


def test_needed_margin_is_where_a_pair_meets():
    x = np.random.default_rng(4).normal(size=(600, knn.DIMS)).astype("float32") / 8
    tree = knn.Tree(x, 10)
    a, b = x[:60], x[60:120]
    need = tree.needed(a, b)

    def meet(margin):
        out = []
        for i in range(60):
            q, leaf, home = tree.search(np.stack([a[i], b[i]]), margin[i])
            out.append(leaf[home & (q == 1)][0] in leaf[q == 0] or leaf[home & (q == 0)][0] in leaf[q == 1])
        return np.array(out)

    assert meet(need + 1e-5).all() and not meet(np.where(need > 1e-4, need - 1e-4, -1))[need > 1e-4].any()


@pytest.mark.parametrize("part", [3, 8])
def test_recall_with_a_sample_of_a_part_of_the_data(spark, monkeypatch, part):
    """The tree sees a third or an eighth of the vectors; the recall over all of them is what calibration promised."""
    rows = data(2400, 5)
    want = brute(rows, 3, 0.8, 4)
    monkeypatch.setattr(knn, "SAMPLE", 2400 // part)
    monkeypatch.setattr(knn, "LEAST_SAMPLE", 1)
    monkeypatch.setattr(knn, "OCCUPANCY", 64)
    told = []
    monkeypatch.setattr(knn, "fit", lambda *a, f=knn.fit: told.append(f(*a)) or told[-1])
    df = spark.createDataFrame(rows, "ie string, feature string, value double, cls string").repartition(5)
    got = {(a, b, s) for a, b, s in knn.neighbours(df, "ie", "feature", "value", 3, 0.8, 4).collect()}
    assert told[0].tree.leaves > 10 and told[0].pairs > 200 and told[0].recall >= knn.RECALL
    assert len(got & want) >= 0.95 * len(want)


def test_names(spark):
    """Keys may have several names; keys without a name take no part."""
    df = spark.createDataFrame([(k, f"f{j}", 1.0 + (k == 3) * j / 9) for k in (1, 2, 3) for j in range(5)], "ie int, feature string, value double")
    names = spark.createDataFrame([(1, "b"), (1, "a"), (3, "c"), (3, "c"), (4, "d")], "key int, name string")
    got = {(a, b) for a, b, _ in knn.neighbours_of(knn.vectors(df, "ie", "feature", "value", 2), 2, 0.5, names).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")}


def test_a_third_of_all_rows_are_copies_and_no_list_is_broadcast(spark, monkeypatch):
    rows = data(300, 11)
    rows += [(f"h{i:04d}", f"f{j}", 2.0 + j, "x") for i in range(150) for j in range(6)]
    want = brute(rows, 3, 0.8, 4)
    monkeypatch.setattr(knn, "LISTED", 0)
    df = spark.createDataFrame(rows, "ie string, feature string, value double, cls string").repartition(5)
    got = {(a, b, s) for a, b, s in knn.neighbours(df, "ie", "feature", "value", 3, 0.8, 4).collect()}
    assert len(got & want) >= 0.97 * len(want) and {x for x in got if x[0][0] == "h"} == {x for x in want if x[0][0] == "h"}
