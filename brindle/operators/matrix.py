"""Similarity, graph and statistics operators over long matrices and edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.stats import fisher_greater_udf, poisson_sf_udf
from brindle.operators.topk import topk
from brindle.session import cut_table, partitions

BLOCK = 2_000  # rows of a feature that meet in one place


def weighted_jaccard(long: DataFrame, row: str, feature: str, value: str) -> DataFrame:
    """(i, j, jaccard), i < j, of rows that share a feature: sum(v_i v_j) / (r_i + r_j - that), r the row's sum of squares.

    On a 0/1 matrix this is the Jaccard index of the sets. Repeated (row, feature) values are added first. A feature of more than
    BLOCK rows is split into blocks of rows, and a pair of blocks is joined on its own, so no feature is one task.
    """
    x = long.groupBy(F.col(row).alias("r"), F.col(feature).alias("f")).agg(F.sum(value).cast("double").alias("v"))
    size = x.groupBy("r").agg(F.sum(F.col("v") * F.col("v")).alias("s"))
    hot = x.groupBy("f").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_k")).where("_k > 1")
    x = x.join(hot, "f", "left").withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64("r", F.lit(17)), F.col("_k")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    a = x.select(F.col("r").alias("i"), "f", F.col("v").alias("vi"), F.col("_own").alias("_p"), every.alias("_q"))
    b = x.select(F.col("r").alias("j"), "f", F.col("v").alias("vj"), every.alias("_p"), F.col("_own").alias("_q"))
    pairs = a.join(b, ["f", "_p", "_q"]).where("i < j").groupBy("i", "j").agg(F.sum(F.col("vi") * F.col("vj")).alias("dot"))
    out = pairs.join(size.select(F.col("r").alias("i"), F.col("s").alias("si")), "i").join(size.select(F.col("r").alias("j"), F.col("s").alias("sj")), "j")
    return out.select("i", "j", (F.col("dot") / (F.col("si") + F.col("sj") - F.col("dot"))).alias("jaccard"))


def knn_edges(pairs: DataFrame, k: int, weight: str = "jaccard") -> DataFrame:
    """(src, dst, weight), src < dst: union of every row's k best partners of positive weight, equal ones by smaller id."""
    both = pairs.select("i", "j", F.col(weight).alias("w")).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col(weight).alias("w"))).where("w > 0")
    best = topk(both, ["i"], [F.desc("w"), F.col("j")], k)
    return best.groupBy(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(F.max("w").alias("weight"))


def prune_small(labels: DataFrame, label: str, least: int, noise: int = -1) -> DataFrame:
    """Labels of fewer than ``least`` members become noise."""
    n = labels.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return labels.join(n, label).withColumn(label, F.when(F.col("_n") < least, F.lit(noise)).otherwise(F.col(label))).drop("_n").select(*labels.columns)


def cluster_edges(edges: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """(a, b, n_edges, weight), a <= b: edges within and between clusters; nodes without a label are left out."""
    l = lambda side: labels.select(F.col(node).alias(side), F.col(label).alias(f"c_{side}"))
    e = edges.join(l("src"), "src").join(l("dst"), "dst")
    return e.groupBy(F.least("c_src", "c_dst").alias("a"), F.greatest("c_src", "c_dst").alias("b")).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("weight"))


def mixing(cross: DataFrame, sizes: DataFrame) -> DataFrame:
    """Observed against expected cross edges: M n_a n_b / T over all pairs of clusters; fold, log2 fold, z, Poisson tail."""
    total = sizes.agg(F.sum("n").alias("n_all"), F.sum(F.col("n") * F.col("n")).alias("n_sq"))
    edges = cross.where("a < b").agg(F.sum("n_edges").alias("m_all"))
    s = lambda c: sizes.select(F.col("label").alias(c), F.col("n").alias(f"n_{c}"))
    x = cross.where("a < b").join(s("a"), "a").join(s("b"), "b").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(edges))
    expected = F.col("m_all") * F.col("n_a") * F.col("n_b") / ((F.col("n_all") * F.col("n_all") - F.col("n_sq")) / 2)
    x = x.withColumn("expected", expected).withColumn("p", poisson_sf_udf(F.col("n_edges").cast("double"), F.col("expected")))
    return x.select("a", "b", "n_edges", "expected", (F.col("n_edges") / F.col("expected")).alias("fold"), F.log2((F.col("n_edges") + 0.5) / (F.col("expected") + 0.5)).alias("log2_fold"), ((F.col("n_edges") - F.col("expected")) / F.sqrt("expected")).alias("z"), "p")


def shuffled(v: np.ndarray, n: int, seed: int, rep: int, rounds: int = 10) -> np.ndarray:
    """Places of the numbers v in a seeded permutation of 0 .. n - 1, without the others: v is a cell of a table of about
    sqrt(n) rows whose rows and columns are turned by random amounts in turn; what leaves the numbers goes on until it is back."""
    rng, high = np.random.default_rng([seed, rep]), max(1, int(np.ceil(np.sqrt(n))))
    low = -(-n // high)
    turns = [(rng.integers(0, high, low), rng.integers(0, low, high)) for _ in range(rounds)]
    out = np.array(v, dtype=np.int64)
    open_ = np.arange(len(out))
    while len(open_):
        a, b = out[open_] // low, out[open_] % low
        for over, along in turns:
            a += over[b]
            a -= high * (a >= high)
            b += along[a]
            b -= low * (b >= low)
        out[open_] = a * low + b
        open_ = open_[out[open_] >= n]
    return out


def permutation_test(edges: DataFrame, labels: DataFrame, node: str, label: str, reps: int, seed: int = 42) -> DataFrame:
    """(a, b, observed, at_least, p): labels are permuted ``reps`` times over the nodes; p = (at_least + 1) / (reps + 1).

    Nodes are numbered label by label, so a node's label in a replicate follows from its permuted number and the sizes of
    the labels, which are all that tasks hold. One pass over the edges, whatever the size of the graph; a replicate's
    permutation follows from its seed, so the result doesn't depend on partitions.
    """
    x = labels.where(F.col(label).isNotNull() & F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(label).alias("label"))
    size = x.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("label")
    size = cut_table(size.select("label", (F.row_number().over(order) - 1).cast("long").alias("code"), "n", (F.sum("n").over(order) - F.col("n")).alias("start")))
    # numbers within a label by the ranks of hash buckets, so that no task orders a whole label
    width = partitions(edges.sparkSession)
    x = x.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(width)))
    per = x.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("k"))
    per = per.select("label", "bucket", (F.sum("k").over(Window.partitionBy("label").orderBy("bucket")) - F.col("k")).alias("base"))
    x = x.withColumn("at", F.row_number().over(Window.partitionBy("label", "bucket").orderBy("node")) - 1)
    numbered = cut_table(x.join(per, ["label", "bucket"]).join(size, "label").select("node", "code", (F.col("start") + F.col("base") + F.col("at")).alias("number")))
    side = lambda c: numbered.select(F.col("node").alias(c), F.col("code").alias(f"c_{c}"), F.col("number").alias(f"n_{c}"))
    e = cut_table(edges.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst").select("c_src", "c_dst", "n_src", "n_dst"))
    seen = cut_table(e.groupBy(F.least("c_src", "c_dst").alias("i"), F.greatest("c_src", "c_dst").alias("j")).agg(F.count(F.lit(1)).alias("observed")))
    ends = edges.sparkSession.sparkContext.broadcast(np.cumsum([r.n for r in size.select("code", "n").orderBy("code").collect()]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = ends.value
        k = len(last)
        for b in batches:
            nodes, at = np.unique(np.concatenate([b["n_src"], b["n_dst"]]), return_inverse=True)
            src, dst = at[: len(b)], at[len(b) :]
            for rep in range(reps):
                lab = np.searchsorted(last, shuffled(nodes, int(last[-1]), seed, rep), "right")
                i, j = lab[src], lab[dst]
                cell, n = np.unique(np.minimum(i, j) * k + np.maximum(i, j), return_counts=True)
                yield pd.DataFrame({"rep": rep, "i": cell // k, "j": cell % k, "n": n})

    drawn = e.select("n_src", "n_dst").mapInPandas(run, "rep long, i long, j long, n long").groupBy("rep", "i", "j").agg(F.sum("n").alias("n"))
    hits = drawn.join(seen, ["i", "j"]).where(F.col("n") >= F.col("observed")).groupBy("i", "j").agg(F.count(F.lit(1)).alias("at_least"))
    name = lambda c, to: size.select(F.col("code").alias(c), F.col("label").alias(to))
    out = seen.join(hits, ["i", "j"], "left").join(name("i", "a"), "i").join(name("j", "b"), "j").withColumn("at_least", F.coalesce("at_least", F.lit(0)))
    return out.select("a", "b", "observed", "at_least", ((F.col("at_least") + 1) / (reps + 1)).alias("p"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information of two labellings, from their contingency table."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    ra, rb = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"))
    two = lambda c: c * (c - 1) / 2
    n = t.agg(F.sum("n").alias("n_all"), F.sum(two(F.col("n"))).alias("ij"))
    sa = ra.agg(F.sum(two(F.col("na"))).alias("sa"), F.sum(F.col("na") * F.ln("na")).alias("ha"))
    sb = rb.agg(F.sum(two(F.col("nb"))).alias("sb"), F.sum(F.col("nb") * F.ln("nb")).alias("hb"))
    mi = t.join(ra, "a").join(rb, "b").agg(F.sum(F.col("n") * (F.ln("n") - F.ln("na") - F.ln("nb"))).alias("m"))
    x = n.crossJoin(sa).crossJoin(sb).crossJoin(mi)
    exp = F.col("sa") * F.col("sb") / two(F.col("n_all"))
    h = lambda c: F.ln("n_all") - F.col(c) / F.col("n_all")
    ari = (F.col("ij") - exp) / ((F.col("sa") + F.col("sb")) / 2 - exp)
    nmi = (F.col("m") / F.col("n_all") + F.ln("n_all")) / ((h("ha") + h("hb")) / 2)
    return x.select(ari.alias("ari"), nmi.alias("nmi"))


def marker_enrichment(presence: DataFrame, cluster: str, row: str, feature: str, eps: float = 1e-3) -> DataFrame:
    """(cluster, feature, count_in, p_in, p_out, enrichment, score): share of a cluster's rows with a feature against the rest."""
    x = presence.select(F.col(cluster).alias("cluster"), F.col(row).alias("row"), F.col(feature).alias("feature")).distinct()
    rows = x.select("cluster", "row").distinct()
    size = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    every = rows.agg(F.count(F.lit(1)).alias("n_all"))
    total = x.groupBy("feature").agg(F.count(F.lit(1)).alias("n_feature"))
    y = x.groupBy("cluster", "feature").agg(F.count(F.lit(1)).alias("count_in")).join(size, "cluster").join(total, "feature").crossJoin(F.broadcast(every))
    p_in = F.col("count_in") / F.col("size")
    p_out = F.when(F.col("n_all") > F.col("size"), (F.col("n_feature") - F.col("count_in")) / (F.col("n_all") - F.col("size"))).otherwise(0.0)
    y = y.withColumn("p_in", p_in).withColumn("p_out", p_out).withColumn("enrichment", (F.col("p_in") + eps) / (F.col("p_out") + eps))
    return y.select("cluster", "feature", "count_in", "size", "p_in", "p_out", "enrichment", (F.log2("enrichment") * F.sqrt("p_in")).alias("score"))


def fold(inside: Column, outside: Column) -> Column:
    """inside / outside: infinite where only the outside is empty, NaN where both are."""
    return F.when(outside > 0, F.try_divide(inside, outside)).when(inside > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))


def class_enrichment(t: DataFrame) -> DataFrame:
    """Adds densities per Mb, fold, pseudo-count fold and Fisher's p to (n_in, n_out, len_in, len_out, all_in, all_out)."""
    rin, rout = F.col("n_in") / (F.col("len_in") / 1e6), F.col("n_out") / (F.col("len_out") / 1e6)
    t = t.withColumn("density_in", rin).withColumn("density_out", rout)
    pseudo = ((F.col("n_in") + 0.5) / F.col("len_in")) / ((F.col("n_out") + 0.5) / F.col("len_out"))
    rest = lambda a, n: F.greatest(F.lit(0), F.col(a) - F.col(n)).cast("long")
    p = fisher_greater_udf(F.col("n_in"), rest("all_in", "n_in"), F.col("n_out"), rest("all_out", "n_out"))
    return t.withColumn("fold", fold(F.col("density_in"), F.col("density_out"))).withColumn("fold_pseudo", pseudo).withColumn("p", p)


def diversity(df: DataFrame, by: str, value: str, unknown: str | None = None, least: int = 1) -> DataFrame:
    """Per group: n, purity, top value, Shannon entropy in bits and nats, effective number. Nulls are dropped, or named ``unknown``."""
    v = F.coalesce(F.col(value), F.lit(unknown)) if unknown is not None else F.col(value)
    n = df.select(F.col(by).alias("grp"), v.alias("v")).where("grp is not null and v is not null").groupBy("grp", "v").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("grp").agg(F.sum("n").alias("total"), F.max("n").alias("top_n"), F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"), F.sum(F.col("n") * F.ln("n")).alias("nln"), F.count(F.lit(1)).alias("n_values"))
    nats = F.ln("total") - F.col("nln") / F.col("total")
    return g.where(F.col("total") >= least).select("grp", "total", "n_values", "top", (F.col("top_n") / F.col("total")).alias("purity"), (nats / np.log(2.0)).alias("bits"), nats.alias("nats"), F.exp(nats).alias("effective"))
