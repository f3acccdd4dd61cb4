"""Similarity clusters of records with sets of features.

Cluster features (count, sum of the member vectors) are built for each partition, merged by levels of a tree
reduction into one bounded list of leaves and agglomerated by Ward's criterion. One pass then assigns every
record. Records that fit no leaf of the bounded list are kept aside as outliers and not forced into one.

What the method can't give alone: a cluster here is a chain of alike pairs, and neither a leaf threshold nor a
Ward cut follows chains. So the leaves' majority sets serve as pivots, the Ward groups as cells and the
assignment pass places a record at home in one group and as a visitor in all those that the triangle inequality
asks for (see setjoin; outliers go to the cells of their rarest tokens); alike pairs are then checked exactly
within cells and the chains closed by connected components. No alike pair is lost.

Centroids of inner tree nodes would be sums of unrelated sparse vectors, so leaves are found by comparing projections
with all of them at once and not by descending through such nodes. There is a leaf for every SHARE classes, up to LEAVES;
beyond, more records are outliers, at the price of more rows in token cells and not of lost pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.knn import DIMS, project
from brindle.llm.setjoin import Pivots, classes, frequent_tokens, join_cells, place
from brindle.operators.graph import connected_components
from brindle.session import cut_table

LEAVES = 32_768  # leaves of a tree, at most
SHARE = 8  # records for each leaf wanted, while there are fewer leaves than that
WARD_LEAVES = 2_048  # heaviest leaves that Ward's criterion looks at; the others stay groups of their own
ABSORB = 0.72  # cosine to a leaf's centroid from which it takes a record
BATCH = 512  # records that are compared at once
FAN_IN = 8  # trees merged by one task
WARD_CUT = 0.5  # squared distance of unit centroids up to which leaves are agglomerated


class Leaves:
    """A bounded list of cluster features that takes batches of records or of other leaves.

    Leaves and records are compared by their projections (see knn.project), so a batch is one product; a record that no
    leaf takes opens one, and the rest of its batch is compared with that too. The sums stay exact.
    """

    def __init__(self, cap: int):
        self.cap = cap
        self.n = np.zeros(0, dtype=np.int64)
        self.p = np.zeros((0, DIMS), dtype=np.float32)  # projected sums
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (leaf, token, weight) as they came

    def add(self, tokens: list[np.ndarray], weights: list[np.ndarray], n: np.ndarray) -> None:
        for i in range(0, len(tokens), BATCH):
            self._add(tokens[i : i + BATCH], weights[i : i + BATCH], np.asarray(n[i : i + BATCH], dtype=np.int64))
            if len(self.n) > 2 * self.cap:
                self.trim()

    def _add(self, tokens: list[np.ndarray], weights: list[np.ndarray], n: np.ndarray) -> None:
        x = project(tokens, weights)
        x /= np.maximum(np.sqrt((x * x).sum(1))[:, None], 1e-12)
        at = np.full(len(x), -1)
        m = len(self.n)
        if m:
            cos = x @ (self.p / np.maximum(np.sqrt((self.p**2).sum(1))[:, None], 1e-12)).T
            best = cos.argmax(1)
            at = np.where(cos[np.arange(len(x)), best] >= ABSORB, best, -1)
        open_ = np.flatnonzero(at < 0)
        alike = x[open_] @ x[open_].T >= ABSORB
        taken = np.zeros(len(open_), dtype=bool)
        for i in range(len(open_)):
            if not taken[i]:
                mine = np.flatnonzero(alike[i] & ~taken)
                at[open_[mine]] = m
                taken[mine] = taken[i] = True
                at[open_[i]] = m
                m += 1
        self.n = np.r_[self.n, np.zeros(m - len(self.n), dtype=np.int64)]
        self.p = np.concatenate([self.p, np.zeros((m - len(self.p), DIMS), dtype=np.float32)])
        size = np.array([np.sqrt((w * w).sum()) for w in weights], dtype=np.float32)
        np.add.at(self.n, at, n)
        np.add.at(self.p, at, x * size[:, None])
        self.held.append((np.repeat(at, [len(t) for t in tokens]), np.concatenate(tokens), np.concatenate(weights)))

    def trim(self) -> None:
        """Keeps the heaviest leaves; the rest are outliers."""
        keep = np.sort(np.lexsort((np.arange(len(self.n)), -self.n))[: self.cap])
        new = np.full(len(self.n), -1)
        new[keep] = np.arange(len(keep))
        leaf, token, weight = self._sums()
        ok = new[leaf] >= 0
        self.held = [(new[leaf[ok]], token[ok], weight[ok])]
        self.n, self.p = self.n[keep], self.p[keep]

    def _sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        leaf, token, weight = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((token, leaf))
        leaf, token, weight = leaf[order], token[order], weight[order]
        start = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (token[1:] != token[:-1])])
        return leaf[start], token[start], np.add.reduceat(weight, start)

    def rows(self) -> pd.DataFrame:
        if not len(self.n):
            return pd.DataFrame({"n": [], "tokens": [], "counts": []}, dtype=object)
        if len(self.n) > self.cap:
            self.trim()
        leaf, token, weight = self._sums()
        cuts = np.flatnonzero(np.r_[leaf[1:] != leaf[:-1]]) + 1
        return pd.DataFrame({"n": self.n, "tokens": np.split(token, cuts), "counts": np.split(weight, cuts)}, dtype=object)


def leaf_summaries(groups: DataFrame, cap: int) -> pd.DataFrame:
    """The leaves of all partitions, tree-reduced to at most ``cap`` rows."""
    fields = "part int, n long, tokens array<bigint>, counts array<double>"

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tree = Leaves(cap)
        for b in batches:
            tokens = b["tokens"].tolist()
            tree.add(tokens, [np.ones(len(t)) for t in tokens], b["n"].to_numpy())
        yield tree.rows().assign(part=TaskContext.get().partitionId())[["part", "n", "tokens", "counts"]]

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Leaves(cap)
        pdf = pdf.sort_values(["n", "part"], ascending=[False, True], kind="stable")
        tree.add(pdf["tokens"].tolist(), pdf["counts"].tolist(), pdf["n"].to_numpy())
        return tree.rows().assign(part=int(key[0]))[["part", "n", "tokens", "counts"]]

    width = groups.rdd.getNumPartitions()
    leaves = groups.select("tokens", "n").mapInPandas(build, fields)
    while width > 1:
        width = -(-width // FAN_IN)
        leaves = leaves.groupBy(F.floor(F.col("part") / FAN_IN).cast("int").alias("g")).applyInPandas(merge, fields)
    return leaves.toPandas().sort_values("n", ascending=False, kind="stable").reset_index(drop=True)


def ward(leaves: pd.DataFrame, cut_at: float = WARD_CUT) -> np.ndarray:
    """The Ward group of each leaf: leaves with close centroids, agglomerated in order of the variance a merge adds."""
    everyone, leaves = len(leaves), leaves.head(WARD_LEAVES)
    m = len(leaves)
    if not m:
        return np.array([], dtype=np.int64)
    posts: dict[int, list[tuple[int, float]]] = {}
    for i, (tokens, counts) in enumerate(zip(leaves["tokens"], leaves["counts"])):
        c = np.array(counts, dtype=float)
        c /= np.sqrt((c * c).sum())
        for t, w in zip(tokens, c.tolist()):
            posts.setdefault(int(t), []).append((i, w))
    dot = np.zeros((m, m), dtype=np.float32)
    for p in posts.values():
        at, w = np.array([i for i, _ in p]), np.array([w for _, w in p], dtype=np.float32)
        dot[np.ix_(at, at)] += w[:, None] * w[None, :]
    size = leaves["n"].to_numpy(dtype=float)
    d2 = np.maximum(0, 2 - 2 * dot)
    del dot
    group, alive = np.arange(m), np.ones(m, dtype=bool)
    cost = np.where(d2 <= cut_at, d2 * (size[:, None] * size[None, :] / (size[:, None] + size[None, :])), np.inf)
    np.fill_diagonal(cost, np.inf)
    best = cost.argmin(axis=1)
    low = cost[np.arange(m), best]
    while True:
        a = int(low.argmin())
        if not np.isfinite(low[a]):
            break
        b = int(best[a])
        a, b = min(a, b), max(a, b)
        na, nb = size[a], size[b]
        # Lance-Williams for the squared distance of centroids
        d2[a] = (na * d2[a] + nb * d2[b]) / (na + nb) - na * nb * d2[a, b] / (na + nb) ** 2
        d2[:, a] = d2[a]
        size[a] += nb
        alive[b] = False
        group[group == b] = a
        row = np.where(alive & (d2[a] <= cut_at), np.maximum(d2[a], 0) * size[a] * size / (size[a] + size), np.inf)
        row[a] = np.inf
        cost[a], cost[:, a], cost[b], cost[:, b] = row, row, np.inf, np.inf
        stale = np.flatnonzero((best == a) | (best == b) | (np.arange(m) == a) | (row < low))
        stale = stale[alive[stale]]
        best[stale] = cost[stale].argmin(axis=1)
        low[stale] = cost[stale, best[stale]]
        low[b] = np.inf
    groups = np.unique(group, return_inverse=True)[1]
    return np.r_[groups, np.arange(groups.max() + 1, groups.max() + 1 + everyone - m)]


def assigned(groups: DataFrame, threshold: Fraction) -> DataFrame:
    """Every class placed in the Ward groups of the leaves (see setjoin.place)."""
    n = groups.count()
    leaves = leaf_summaries(groups, max(64, min(LEAVES, n // SHARE)))
    held = [(np.array(sorted(t for t, c in zip(tokens, counts) if 2 * c >= n), dtype=np.int64), w) for tokens, counts, n, w in zip(leaves["tokens"], leaves["counts"], _records(leaves), ward(leaves))]
    held = [(s, w) for s, w in held if len(s)]
    pivots = Pivots([s for s, _ in held], np.array([w for _, w in held], dtype=np.int64))
    return place(groups, pivots, frequent_tokens(groups, n), threshold, 0.45)


def _records(leaves: pd.DataFrame) -> list[float]:
    """How many vectors each leaf sums up (n counts equal records too, its sums do not)."""
    return [max(c) if len(c) else 0 for c in leaves["counts"]]


def chain_clusters(records: DataFrame, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """(records, labels) of a table (key, tokens): labels has (rep, name, n, cluster_key, size) of each class in a cluster of two or more."""
    records = cut_table(records)
    groups = cut_table(classes(records))
    links = cut_table(join_cells(cut_table(assigned(groups, threshold)), threshold, links_only=True))
    parts = connected_components(links, "a", "b")
    labels = groups.select("rep", "name", "n").join(parts, groups.rep == parts.node, "left").select("rep", "name", "n", F.coalesce("component", "rep").alias("component"))
    keys = labels.groupBy("component").agg(F.min("name").alias("cluster_key"), F.sum("n").alias("size")).where("size > 1")
    return records, labels.join(keys, "component").select("rep", "name", "n", "cluster_key", "size")


def cluster_members(records: DataFrame, threshold: Fraction) -> DataFrame:
    """(key, cluster_key) of every record, of a table (key, tokens) as ``setjoin.sets`` gives it, in a cluster of two or more."""
    records, labels = chain_clusters(records, threshold)
    return records.select("key", F.xxhash64("tokens").alias("rep")).join(labels.select("rep", "cluster_key"), "rep").select("key", "cluster_key")


def cluster_profiles(records: DataFrame, threshold: Fraction, typical: int = 3) -> DataFrame:
    """(cluster_key, size, n_distinct, typical): size and the members nearest to the centroid, equal ones by smaller key."""
    records, labels = chain_clusters(records, threshold)
    labels = cut_table(labels)
    held = labels.join(records.select(F.xxhash64("tokens").alias("rep"), "tokens").dropDuplicates(["rep"]), "rep")
    long = held.select("cluster_key", "name", "n", F.size("tokens").alias("k"), F.explode("tokens").alias("t"))
    centroid = long.groupBy("cluster_key", "t").agg(F.sum("n").alias("c"))
    near = long.join(centroid, ["cluster_key", "t"]).groupBy("cluster_key", "name").agg((F.sum("c") / F.sqrt(F.first("k"))).alias("score"))
    order = Window.partitionBy("cluster_key").orderBy(F.desc(F.round("score", 6)), "name")
    top = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= typical)
    top = top.groupBy("cluster_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("typical"))
    size = labels.groupBy("cluster_key").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n_distinct"))
    return size.join(top, "cluster_key").select("cluster_key", "size", "n_distinct", "typical")
