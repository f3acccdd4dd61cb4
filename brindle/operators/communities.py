"""Community detection and greedy deduplication of sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.topk import top1
from brindle.session import cut_table, drop_table

GRAPH = 500_000  # edges of a graph that is clustered on the driver; a larger one is coarsened first
BLOCK = 4096  # sequences that are settled in a round, and
LETTERS = 4_000_000  # their letters together


def modularity(src: np.ndarray, dst: np.ndarray, w: np.ndarray, label: np.ndarray) -> float:
    total = w.sum()
    if not total:
        return 0.0
    degree = np.bincount(label[src], w, label.max() + 1) + np.bincount(label[dst], w, label.max() + 1)
    return float(w[label[src] == label[dst]].sum() / total - ((degree / (2 * total)) ** 2).sum())


def louvain(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, seed: int = 42, resolution: float = 1.0) -> np.ndarray:
    """Labels of n nodes by greedy modularity moves and aggregation, in a seeded order of nodes."""
    rng, label = np.random.default_rng(seed), np.arange(n)
    while True:
        near: list[dict[int, float]] = [{} for _ in range(n)]
        loops = np.zeros(n)
        for a, b, x in zip(src.tolist(), dst.tolist(), w.tolist()):
            if a == b:
                loops[a] += 2 * x
            else:
                near[a][b] = near[a].get(b, 0.0) + x
                near[b][a] = near[b].get(a, 0.0) + x
        degree = np.array([sum(d.values()) for d in near]) + loops
        total, own, mass = degree.sum(), np.arange(n), degree.copy()
        if total == 0:
            return label
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in rng.permutation(n).tolist():
                links: dict[int, float] = {}
                for u, x in near[v].items():
                    links[own[u]] = links.get(own[u], 0.0) + x
                mass[own[v]] -= degree[v]
                gain = lambda c: links.get(c, 0.0) - resolution * degree[v] * mass[c] / total  # noqa: E731, B023
                best = max(sorted(links), key=gain, default=own[v])
                if gain(best) > gain(own[v]) + 1e-12:
                    own[v] = best
                    moved = moved_any = True
                mass[own[v]] += degree[v]
        names, own = np.unique(own, return_inverse=True)
        label = own[label]
        if not moved_any or len(names) == n:
            return np.unique(label, return_inverse=True)[1]
        src, dst, n = own[src], own[dst], len(names)


def coarsen(edges: DataFrame, resolution: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(edges, labels): nodes of a large graph merged in distributed rounds until at most ``GRAPH`` edges are left or no merge gains.

    A node proposes to the neighbour of its greatest gain; a seeded coin of each round makes one of them move and the other
    stay. One that stays takes its proposers, best first, while each still gains over the degrees of all before it, so
    every round raises the modularity. Weights are summed as decimals: the result doesn't depend on partitions.
    """
    kind = "decimal(28,12)"
    e = cut_table(edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum(F.col("weight").cast(kind)).cast(kind).alias("weight")))
    labels = cut_table(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().select("node", F.col("node").alias("label")))
    turn = 0
    while e.count() > GRAPH:
        both = e.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight").unionByName(e.select(F.col("dst").alias("u"), F.col("src").alias("v"), "weight"))
        degree = cut_table(both.groupBy("u").agg(F.sum("weight").cast("double").alias("d")))  # a loop is listed twice
        total = degree.agg(F.sum(F.col("d").cast(kind)).cast("double")).first()[0]
        x = both.where("u <> v").join(degree, "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
        gain = lambda mass: F.col("weight").cast("double") - resolution * F.col("d") * mass / total  # noqa: E731, B023
        x = x.withColumn("gain", gain(F.col("dv"))).where("gain > 1e-12")
        best = cut_table(top1(x, ["u"], [F.desc("gain"), F.col("v")]))
        if not best.limit(1).count():
            drop_table(best), drop_table(degree)
            break
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(turn)), F.lit(2))  # noqa: E731, B023
        before = Window.partitionBy("v").orderBy(F.desc("gain"), "u").rowsBetween(Window.unboundedPreceding, -1)
        moves = best.where((coin("u") == 1) & (coin("v") == 0)).withColumn("mass", F.col("dv") + F.coalesce(F.sum("d").over(before), F.lit(0.0)))
        moves = cut_table(moves.where(gain(F.col("mass")) > 1e-12).select(F.col("u").alias("old"), F.col("v").alias("new")))
        to = lambda df, c: df.join(moves.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")  # noqa: E731, B023
        new = to(to(e, "src"), "dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").cast(kind).alias("weight"))
        old, e, names, labels = e, cut_table(new), labels, cut_table(to(labels, "label").select("node", "label"))
        for t in (old, names, degree, best, moves):
            drop_table(t)
        turn += 1
    return e.withColumn("weight", F.col("weight").cast("double")), labels


def communities(edges: DataFrame, least: int = 5, seed: int = 42, resolution: float = 1.0) -> DataFrame:
    """(node, community) of an edge table (src, dst, weight): seeded modularity communities, numbered by size, then smallest node;
    those of fewer than ``least`` nodes are -1. A graph above ``GRAPH`` edges is first coarsened in distributed rounds."""
    kind, labels = dict(edges.dtypes)["src"], None
    edges = cut_table(edges.select("src", "dst", "weight"))
    if edges.count() > GRAPH:
        edges, labels = coarsen(edges, resolution, seed)
    if labels is None or edges.count() <= GRAPH:
        rows = edges.toPandas().sort_values(["src", "dst"], kind="stable")
        nodes = np.unique(np.concatenate([rows["src"].to_numpy(), rows["dst"].to_numpy()])) if len(rows) else np.array([])
        if not len(nodes):
            return edges.sparkSession.createDataFrame([], f"node {kind}, community int")
        a, b = np.searchsorted(nodes, rows["src"].to_numpy()), np.searchsorted(nodes, rows["dst"].to_numpy())
        label = louvain(len(nodes), a, b, rows["weight"].to_numpy(dtype=float), seed, resolution)
        names = nodes[np.unique(label, return_index=True)[1]]
        found = edges.sparkSession.createDataFrame(list(zip(nodes.tolist(), names[label].tolist())), f"label {kind}, name {kind}")
        labels = found.select(F.col("label").alias("node"), F.col("name").alias("label")) if labels is None else labels.join(found, "label").select("node", F.col("name").alias("label"))
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    large = size.where(F.col("n") >= least)  # only these are numbered
    rank = large.select("label", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("community"))
    return labels.join(rank, "label", "left").select("node", F.coalesce("community", F.lit(-1)).alias("community"))


def kmers(texts: list[str], k: int, seed: int = 42) -> list[np.ndarray]:
    """Distinct k-mers of each text, as sorted 64-bit hashes (a polynomial over code points, equal on every machine)."""
    mult = np.random.default_rng(seed).integers(1, 1 << 62, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for t in texts:
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        h = np.zeros(max(0, len(c) - k + 1), dtype=np.uint64)
        for i in range(k if len(h) else 0):
            h += (c[i : i + len(h)] + np.uint64(1)) * mult[i]
        h ^= h >> np.uint64(32)
        out.append(np.unique(h))
    return out


class KmerIndex:
    """Sequences by k-mer, numbered in the given order."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        own = np.repeat(np.arange(self.n, dtype=np.int32), [len(s) for s in sets])
        every = np.concatenate(sets) if sets else np.array([], dtype=np.uint64)
        order = np.argsort(every, kind="stable")
        self.own = own[order]
        self.km, start = np.unique(every[order], return_index=True)
        self.start = np.append(start, len(every))

    def shared(self, km: np.ndarray) -> np.ndarray:
        """How many of these distinct k-mers each sequence of the index has."""
        at = np.searchsorted(self.km, km)
        at = at[at < len(self.km)]
        at = at[self.km[at] == km[: len(at)]]  # km is sorted: what lies beyond the index is its end
        lo, n = self.start[at], self.start[at + 1] - self.start[at]
        rows = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        return np.bincount(self.own[rows], minlength=self.n)


def greedy(sets: list[np.ndarray], share: float) -> list[int]:
    """Of k-mer sets, longest first: the number of the first representative that has ``share`` of the set's k-mers, or its own."""
    index, heads, out = KmerIndex(sets), np.zeros(len(sets), dtype=bool), []
    for i, km in enumerate(sets):
        first = np.flatnonzero((index.shared(km) >= share * len(km)) & heads)
        out.append(int(first[0]) if len(first) else i)
        heads[i] = not len(first)
    return out


def deduplicate(seqs: DataFrame, key: str, seq: str, k: int = 12, identity: float = 0.9) -> DataFrame:
    """(key, representative): greedy, longest first, equal lengths by smaller key: a sequence joins the first representative
    before it that has ``identity`` ** k of its k-mers, and is one itself if there is none.

    Exact, no pair is left out: in each round the ``BLOCK`` first open sequences are settled among themselves on the driver, and
    the index of their representatives is held against every open sequence. A sequence that gets no representative in its
    round stays open, so it meets all of them in order. Equal sequences are one; those shorter than k stay alone.
    Rounds and work grow with the number of representatives: sequences times representatives in the worst case.
    """
    x = seqs.select(F.col(key).alias("key"), F.upper(F.col(seq)).alias("s")).where("key is not null and s is not null")
    same = x.groupBy("s").agg(F.min("key").alias("rep"))
    sc, share = seqs.sparkSession.sparkContext, identity**k
    state = same.select(F.col("rep").alias("id"), F.length("s").alias("n"), "s")
    state = cut_table(state.select("id", "n", F.when(F.col("n") >= k, F.col("s")).alias("s"), F.when(F.col("n") < k, F.col("id")).alias("representative")))
    while True:
        rest = state.where("representative is null")
        head = rest.select("n", "id").orderBy(F.desc("n"), "id").limit(BLOCK).collect()
        if not head:
            break
        last = head[max(1, int(np.searchsorted(np.cumsum([r.n for r in head]), LETTERS, "right"))) - 1]
        block = rest.where((F.col("n") > last.n) | ((F.col("n") == last.n) & (F.col("id") <= F.lit(last.id)))).orderBy(F.desc("n"), "id").select("id", "s").toArrow()
        ids, sets = block["id"].to_pylist(), kmers(block["s"].to_pylist(), k)
        of = greedy(sets, share)
        heads = [i for i, r in enumerate(of) if i == r]
        held = sc.broadcast(({i: ids[r] for i, r in zip(ids, of)}, [ids[i] for i in heads], KmerIndex([sets[i] for i in heads])))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            settled, names, index = held.value
            for b in batches:
                own, text, rep = b["id"].to_pylist(), b["s"].to_pylist(), b["representative"].to_pylist()
                for i, t in enumerate(text):
                    if rep[i] is None:
                        rep[i] = settled.get(own[i])
                    if rep[i] is None:
                        km = kmers([t], k)[0]
                        first = np.flatnonzero(index.shared(km) >= share * len(km))
                        rep[i] = names[first[0]] if len(first) else None
                    if rep[i] is not None:
                        text[i] = None  # settled sequences carry no text into the next round
                yield pa.RecordBatch.from_arrays([b["id"], b["n"], pa.array(text, b["s"].type), pa.array(rep, b["id"].type)], ["id", "n", "s", "representative"])

        before, state = state, cut_table(state.mapInArrow(run, state.schema))
        drop_table(before)
        held.destroy()
    return x.join(same, "s").select("key", F.col("rep").alias("id")).join(state.select("id", "representative"), "id").select("key", "representative")
