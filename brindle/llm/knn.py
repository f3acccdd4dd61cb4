"""The most similar vectors of every sparse vector, by a hierarchical k-means tree searched best bin first.

Vectors are projected to DIMS dimensions (the sign of a dimension is a bit of the feature's hash). The tree is
fitted on a bounded sample (at most SAMPLE classes of equal vectors, a quarter of them if that is less); every vector
is indexed in the leaf it reaches first and, as a query, visits further leaves in the order of a priority queue
over node distances until the distance exceeds that of its first leaf by a margin. An inner node enters the queue
with its distance less SLACK, because its leaves may be nearer than its centre.

The margin is what widens the visits until the wanted recall is reached, and it is calibrated on held-out vectors: QUERIES
classes are kept out of the tree's sample, one exact pass over all classes finds their true neighbours, and for each
true pair the margin is computed at which the two would meet. The smallest margin that covers RECALL of these pairs is
taken; no number of visits caps it. ``fit`` returns the recall with the tree and logs it. Within a leaf
similarities are exact.

Equal vectors are one class (told apart by 64-bit hashes). A class keeps its k + 1 smallest names, which are all that can
be among anybody's first k, so a hot group of copies costs no more than one vector until the last step, where each copy gets
its own list. A leaf of more than CELL vectors is split into blocks and each pair of blocks is a task of its own, so
nothing is lost beyond SAMPLE / LEAF * CELL vectors, but from there on the work in leaves grows faster than the data.

Defined cases: values that are null, NaN or not above zero are no features; of several values of one feature the
largest counts; vectors of fewer than ``least`` features take no part; ties go by the smaller name; similarities
are rounded to 6 decimals before they are compared; empty tables give an empty result.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.cells import LISTED, block_pairs
from brindle.session import cut_table, partitions

DIMS = 128
SAMPLE = 131_072  # classes the tree is fitted on, at most
LEAST_SAMPLE = 8_192  # and at least, where there are so many
OCCUPANCY = 256  # vectors wanted in a leaf
LEAF = 8  # sample vectors in a leaf, at least
BRANCH = 32
SLACK = 0.1  # by how much a leaf may be nearer than the node above it
RECALL = 0.985
CELL = 1_500
CHUNK = 1_000  # vectors that are projected or searched at once
QUERIES = 1_000  # held-out classes whose true neighbours calibrate the margin
UNKNOWN = 0.03  # the margin where no held-out class has a neighbour

log = logging.getLogger(__name__)


def project(features: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """Unit vectors times random signs: one row of DIMS numbers each. Chunks keep the intermediate rows of signs small."""
    parts = [_project(features[i : i + CHUNK], values[i : i + CHUNK]) for i in range(0, len(features), CHUNK)]
    return np.concatenate(parts) if parts else np.zeros((0, DIMS), np.float32)


def signs(features: np.ndarray) -> np.ndarray:
    """Rows of DIMS bits: the feature's hash, mixed anew for each further 64 dimensions."""
    words = [features]
    while 64 * len(words) < DIMS:
        x = words[-1].view(np.uint64) ^ (words[-1].view(np.uint64) >> np.uint64(31))
        x = x * np.uint64(0x9E3779B97F4A7C15)
        words.append((x ^ (x >> np.uint64(29))).view(np.int64))
    bits = [np.unpackbits(np.ascontiguousarray(w).view(np.uint8).reshape(-1, 8), axis=1) for w in words]
    return np.concatenate(bits, axis=1)[:, :DIMS]


def _project(features: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(f) for f in features], dtype=np.int64)
    flat, w = np.concatenate(features), np.concatenate(values).astype(np.float64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    norm = np.sqrt(np.add.reduceat(w * w, starts))
    w = (w / np.repeat(norm, sizes)).astype(np.float32)
    uniq, code = np.unique(flat, return_inverse=True)
    plus = (2 * signs(uniq).astype(np.float32) - 1) / np.sqrt(DIMS, dtype=np.float32)
    return np.add.reduceat(plus[code] * w[:, None], starts, axis=0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = (x @ centres.T * -2 + (centres * centres).sum(1)).argmin(1)
        count = np.bincount(at, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
    at = (x @ centres.T * -2 + (centres * centres).sum(1)).argmin(1)
    used = np.unique(at)
    return centres[used], np.searchsorted(used, at)


class Tree:
    """Nodes with centres; a node is inner (``children``) or a leaf (``leaf`` >= 0)."""

    def __init__(self, x: np.ndarray, leaf_size: int, seed: int = 7):
        self.centres, self.children, self.leaf, self.leaves = [np.zeros(DIMS, np.float32)], [None], [-1], 0
        self._grow(0, x, leaf_size, np.random.default_rng(seed))
        self.c = np.array(self.centres, dtype=np.float32)
        self.square = (self.c**2).sum(1)
        self.at = np.flatnonzero(np.array(self.leaf) >= 0)
        self.at = self.at[np.argsort(np.array(self.leaf)[self.at])]  # the node of each leaf
        self.inner = np.array(self.leaf) < 0
        parent, depth = np.full(len(self.c), -1), np.zeros(len(self.c), dtype=np.int64)
        for v, k in enumerate(self.children):  # parents come before their children
            if k is not None:
                parent[k], depth[k] = v, depth[v] + 1
        self.parent, self.levels = parent, [np.flatnonzero(depth == d) for d in range(1, int(depth.max()) + 1)]
        del self.centres

    def _grow(self, v: int, x: np.ndarray, leaf_size: int, rng: np.random.Generator) -> None:
        k = min(BRANCH, -(-len(x) // max(1, leaf_size)))
        if k > 1:
            centres, at = kmeans(x, k, rng)
            if len(centres) > 1:
                kids = list(range(len(self.centres), len(self.centres) + len(centres)))
                for c in centres:
                    self.centres.append(c), self.children.append(None), self.leaf.append(-1)
                self.children[v] = np.array(kids)
                for i, kid in enumerate(kids):
                    self._grow(kid, x[at == i], leaf_size, rng)
                return
        self.leaf[v] = self.leaves
        self.leaves += 1

    def keys(self, x: np.ndarray) -> np.ndarray:
        """The key with which each leaf leaves the queue of each query, one row a query.

        A node enters the queue when its parent has left it, so leaves come out in the order of the largest key on
        their path. That is all a search needs to know of the queue; it is computed for many queries at once, level by level.
        """
        key = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * (x @ self.c.T) + self.square))
        key[:, self.inner] -= SLACK
        key[:, 0] = -np.inf
        for level in self.levels:
            key[:, level] = np.maximum(key[:, level], key[:, self.parent[level]])
        return key[:, self.at]

    def search(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, home) of the leaves that each query visits: those whose key exceeds the first one's by at most ``margin``."""
        step = max(1, min(CHUNK, 16_000_000 // len(self.c)))
        out = []
        for i in range(0, len(x), step):
            key = self.keys(x[i : i + step])
            first = key.argmin(1)
            q, leaf = np.nonzero(key <= key[np.arange(len(key)), first][:, None] + margin)
            out.append((q + i, leaf, leaf == first[q]))
        return tuple(np.concatenate(p) for p in zip(*out))

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The margin from which on the vectors a[i] and b[i] meet: one of them visits the other's home."""
        ka, kb = self.keys(a), self.keys(b)
        i, ha, hb = np.arange(len(a)), ka.argmin(1), kb.argmin(1)
        return np.minimum(ka[i, hb] - ka[i, ha], kb[i, ha] - kb[i, hb])


class Held:
    """Held-out query vectors with an inverted index."""

    def __init__(self, names: np.ndarray, features: list[np.ndarray], values: list[np.ndarray]):
        self.names, self.x = names, project(features, values)
        flat = np.concatenate(features)
        owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
        w = np.concatenate([v / np.sqrt((v * v).sum()) for v in values])
        order = np.argsort(flat, kind="stable")
        self.owner, self.w = owner[order], w[order]
        self.features, self.start = np.unique(flat[order], return_index=True)
        self.count = np.diff(np.r_[self.start, len(flat)])

    def similar(self, names: np.ndarray, features: list[np.ndarray], values: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, similarity) of all rows with a similarity of ``least`` or more, the query itself left out."""
        flat, w = np.concatenate(features), np.concatenate([v / np.sqrt((v * v).sum()) for v in values])
        row = np.repeat(np.arange(len(features)), [len(f) for f in features])
        f = np.minimum(np.searchsorted(self.features, flat), len(self.features) - 1)
        ok = self.features[f] == flat
        f, w, row = f[ok], w[ok], row[ok]
        n = self.count[f]
        at = np.repeat(self.start[f] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        width = len(self.names)
        score = np.bincount(np.repeat(row, n) * width + self.owner[at], np.repeat(w, n) * self.w[at], len(features) * width)
        hit = np.flatnonzero(score >= least - 5e-7)
        row, q = hit // width, hit % width
        ok = names[row] != self.names[q]
        return q[ok], row[ok], score[hit[ok]]


@dataclass
class Fitted:
    """A tree with the margin that its held-out pairs ask for, and the share of these pairs that it lets meet."""

    tree: Tree
    margin: float
    recall: float
    pairs: int


def fit(groups: DataFrame, n: int, k: int, least: float, recall: float = RECALL) -> Fitted | None:
    """The tree and the calibrated margin for a written table (cls, features, vals) of about n classes; None if there are none."""
    spark = groups.sparkSession
    held_step = max(4, n // QUERIES)
    held = F.pmod(F.xxhash64("cls", F.lit(9)), F.lit(held_step)) == 0
    size = max(1, min(SAMPLE, max(LEAST_SAMPLE, n // 4)))
    step = max(1, n // size)
    chosen = groups.where(~held & (F.pmod(F.xxhash64("cls", F.lit(5)), F.lit(step)) == 0)).select("features", "vals").limit(2 * size).toArrow().to_pandas()
    if not len(chosen):
        chosen = groups.select("features", "vals").limit(LEAST_SAMPLE).toArrow().to_pandas()  # a few classes, all of them held
    if not len(chosen):
        return None
    x = project([np.array(f) for f in chosen["features"]], [np.array(v) for v in chosen["vals"]])
    tree = Tree(x, max(LEAF, OCCUPANCY * len(x) // max(1, n)))
    del chosen, x
    if tree.leaves == 1:
        return Fitted(tree, 0.0, 1.0, 0)
    queries = groups.where(held).select("cls", "features", "vals").limit(2 * QUERIES).toArrow().to_pandas()
    if not len(queries):
        return Fitted(tree, UNKNOWN, 0.0, 0)
    known = spark.sparkContext.broadcast((tree, Held(queries["cls"].to_numpy(), [np.array(f) for f in queries["features"]], [np.array(v) for v in queries["vals"]])))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, held = known.value
        best = None
        for b in batches:
            for i in range(0, len(b), CHUNK):
                c = b.iloc[i : i + CHUNK]
                names, fs, vs = c["cls"].to_numpy(), c["features"].to_numpy(), c["vals"].to_numpy()
                q, row, sim = held.similar(names, fs.tolist(), vs.tolist(), least)
                new = pd.DataFrame({"q": q, "other": names[row], "sim": np.round(sim, 6), "features": fs[row], "vals": vs[row]})
                best = (new if best is None else pd.concat([best, new])).sort_values(["q", "sim", "other"], ascending=[True, False, True], kind="stable")
                best = best[best.groupby("q").cumcount() < k]
        if best is not None and len(best):
            need = [tree.needed(held.x[best["q"].to_numpy()[i : i + CHUNK]], project(best["features"].tolist()[i : i + CHUNK], best["vals"].tolist()[i : i + CHUNK])) for i in range(0, len(best), CHUNK)]
            yield best[["q", "other", "sim"]].assign(need=np.concatenate(need))

    pairs = groups.select("cls", "features", "vals").mapInPandas(exact, "q int, other long, sim double, need double")
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "other"))).where(F.col("r") <= k)
    need = np.sort(first.select("need").toPandas()["need"].to_numpy(dtype=float))
    known.unpersist()
    if not len(need):
        return Fitted(tree, UNKNOWN, 0.0, 0)
    margin = float(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1e-6
    out = Fitted(tree, margin, float((need <= margin).mean()), len(need))
    log.info("%d leaves, margin %.4f, recall %.4f of %d held-out pairs", tree.leaves, out.margin, out.recall, out.pairs)
    return out


def vectors(rows: DataFrame, key: str, feature: str, value: str, least: int) -> DataFrame:
    """(key, features, vals): the features of each key by hash, with their values."""
    v = F.col(f"`{value}`").cast("double")
    ok = rows.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{feature}`").isNotNull() & v.isNotNull() & ~F.isnan(v) & (v > 0))
    one = ok.select(F.col(f"`{key}`").alias("key"), F.struct(F.xxhash64(F.col(f"`{feature}`")).alias("f"), v.alias("v")).alias("p")).groupBy("key").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    last = F.filter("ps", lambda p, i: (i + 1 >= F.size("ps")) | (F.get("ps", i + 1)["f"] != p["f"]))
    one = one.withColumn("ps", last).where(F.size("ps") >= least)
    return one.select("key", F.transform("ps", lambda p: p["f"]).alias("features"), F.transform("ps", lambda p: p["v"]).alias("vals"))


def _cell(features: list[np.ndarray], values: list[np.ndarray], home: np.ndarray, side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of the pairs of a leaf with one at home, i < j."""
    n = len(features)
    sizes = np.array([len(f) for f in features])
    uniq, code, holders = np.unique(np.concatenate(features), return_inverse=True, return_counts=True)
    w = np.concatenate(values)
    row = np.repeat(np.arange(n), sizes)
    w = w / np.sqrt(np.bincount(row, w * w))[row]
    several = holders > 1  # a feature of one vector alone adds to no pair
    column = np.cumsum(several) - 1
    shared = several[code]
    width = max(1, int(several.sum()))
    m = np.bincount(row[shared] * width + column[code[shared]], w[shared], n * width).astype(np.float32).reshape(n, width)
    ok = m @ m.T >= least - 1e-4
    ok &= home[:, None] | home[None, :]
    if side is not None:
        ok &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(ok, 1))
    del m, ok
    starts = np.r_[0, np.cumsum(sizes)]
    sim = np.empty(len(i))
    scratch = np.zeros(len(uniq))
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
    for a, b in zip(first, np.r_[first[1:], len(i)] if len(i) else []):
        q = i[a]
        at = slice(starts[q], starts[q + 1])
        scratch[code[at]] = w[at]
        for p in range(a, b):
            o = slice(starts[j[p]], starts[j[p] + 1])
            sim[p] = np.dot(scratch[code[o]], w[o])
        scratch[code[at]] = 0
    sim = np.round(np.minimum(sim, 1.0), 6)
    keep = sim >= least
    return i[keep], j[keep], sim[keep]


def neighbours(rows: DataFrame, key: str, feature: str, value: str, k: int, least_similarity: float, least_features: int) -> DataFrame:
    """(key, other, similarity): for every key the k most similar others of at least ``least_similarity``."""
    return neighbours_of(vectors(rows, key, feature, value, least_features), k, least_similarity).withColumnRenamed("key", key)


def distinct_vectors(vecs: DataFrame) -> DataFrame:
    """One row for each class of a written table (key, cls, features, vals). Only keys and class numbers are shuffled for
    that; the vectors stay where they are unless there are more than LISTED copies."""
    keys = vecs.select("cls", "key")
    several = cut_table(keys.groupBy("cls").agg(F.min("key").alias("_rep"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("cls", "_rep"))
    few = several.count() <= LISTED
    copies = cut_table(keys.join(F.broadcast(several) if few else several, "cls").where(F.col("key") != F.col("_rep")).select("key"))
    n = copies.count()
    if not n:
        return vecs
    return vecs.join(F.broadcast(copies) if n <= LISTED else copies, "key", "left_anti")


def neighbours_of(vecs: DataFrame, k: int, least: float, names: DataFrame | None = None) -> DataFrame:
    """As ``neighbours``, for a table (key, features, vals) with one row a key. With ``names`` (key, name) the result speaks of names
    instead of keys; a key may have several names, and keys without one take no part."""
    spark = vecs.sparkSession
    sc = spark.sparkContext
    if names is not None:
        vecs = vecs.join(names.select("key"), "key", "left_semi")
    vecs = cut_table(vecs.withColumn("cls", F.xxhash64("features", "vals")))
    members = vecs.select("cls", F.col("key").alias("name")) if names is None else cut_table(vecs.select("cls", "key").join(names, "key").select("cls", "name").distinct())
    groups = distinct_vectors(vecs)
    fitted = fit(groups, vecs.count(), k, least)
    if fitted is None:
        return members.limit(0).select(F.col("name").alias("key"), F.col("name").alias("other"), F.lit(0.0).alias("similarity"))
    known = sc.broadcast((fitted.tree, fitted.margin))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, margin = known.value
        for b in batches:
            if not len(b):
                continue
            at, leaf, home = tree.search(project(b["features"].tolist(), b["vals"].tolist()), margin)
            short = [f.astype(np.int32) for f in b["features"]]  # the low 32 bits: within one pair of vectors two features hardly ever share them
            yield pd.DataFrame({"cls": b["cls"].to_numpy()[at], "features": [short[i] for i in at], "vals": b["vals"].to_numpy()[at], "cell": leaf, "home": home})

    placed = groups.select("cls", "features", "vals").mapInPandas(place, "cls long, features array<int>, vals array<double>, cell int, home boolean")
    rows = cut_table(placed)
    rows = block_pairs(rows, ["cell"], "cls", CELL)

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        cls, fs, vs, homes = pdf["cls"].to_numpy(), pdf["features"].to_numpy(), pdf["vals"].to_numpy(), pdf["home"].to_numpy()
        own, lo, hi = pdf["own"].to_numpy(), pdf["lo"].to_numpy(), pdf["hi"].to_numpy()
        out = []
        for at in pdf.groupby(["cell", "lo", "hi"], sort=False).indices.values():
            if len(at) < 2 or not homes[at].any():
                continue
            side = own[at] if lo[at[0]] != hi[at[0]] else None
            i, j, sim = _cell([fs[p] for p in at], [vs[p] for p in at], homes[at], side, least)
            if not len(i):
                continue
            two = pd.DataFrame({"a": cls[at[np.r_[i, j]]], "b": cls[at[np.r_[j, i]]], "sim": np.r_[sim, sim]})
            two = two.sort_values(["a", "sim", "b"], ascending=[True, False, True], kind="stable")
            out.append(two[two.groupby("a").cumcount() < k])
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"a": [], "b": [], "sim": []}, dtype=object)

    key = F.pmod(F.xxhash64("cell", "lo", "hi"), F.lit(4 * partitions(spark))).cast("int")
    found = rows.groupBy(key.alias("bucket")).applyInPandas(bucket, "a long, b long, sim double").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    # the k nearest classes of each class, their first names, and the class's own
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("r") <= k)
    named = members.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("name"))).where(F.col("r") <= k + 1).select("cls", "name")
    others = near.join(named.withColumnRenamed("cls", "b"), "b").select(F.col("a").alias("cls"), "name", "sim")
    first = others.unionByName(named.withColumn("sim", F.lit(1.0))).withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("sim"), "name"))).where(F.col("r") <= k + 1)
    lists = first.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name", "sim"))), lambda p: F.struct(p["name"].alias("name"), p["sim"].alias("sim"))).alias("l"))
    mine = F.slice(F.filter("l", lambda p: p["name"] != F.col("me")), 1, k)
    return members.withColumnRenamed("name", "me").join(lists, "cls").select(F.col("me").alias("key"), F.explode(mine).alias("p")).select("key", F.col("p.name").alias("other"), F.col("p.sim").alias("similarity"))
