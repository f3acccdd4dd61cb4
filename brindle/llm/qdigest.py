"""Percentiles of very large numeric columns by mergeable quantile digests.

Values are quantised to a bounded ordered universe of 2**20 codes (binary exponent and 12 bits of mantissa:
relative error below 1/4096, whole numbers up to 8192 are exact), counted per (group, day, code) in the JVM,
and the counts compressed into a dyadic tree: a node is folded into its parent while node, sibling and parent
together hold at most n/k values. Digests of days or partitions are merged by adding the counts of equal
nodes and compressing again. A rank is off by at most LEVELS * n / k, whatever the data are.

Defined cases: null, NaN, infinite and negative values are no measurements; zero is one only where
``zero_counts``; a null group is the group null; rows without a day are the day null; repeated rows are
measurements of their own; empty input gives an empty result. All rows are counted, a hot group too: what
one task holds is bounded by the universe and not by the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import partitions

LEVELS = 20
MANTISSA = 4096
BIAS = 126  # of the exponent: values below 2**-126 share code 0
LEAF = 1 << LEVELS


def quantise(value: Column) -> Column:
    """The code of a value >= 0, order preserved."""
    e = F.floor(F.log2(value))
    m = F.floor((value / F.pow(F.lit(2.0), e) - 1) * MANTISSA)
    code = (e + BIAS) * MANTISSA + F.greatest(F.lit(0), F.least(F.lit(MANTISSA - 1), m)) + 1
    return F.when(value <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(LEAF - 1), code))).cast("int")


def restore(code: np.ndarray) -> np.ndarray:
    """The smallest value of a code."""
    c = np.asarray(code, dtype="int64") - 1
    return np.where(c < 0, 0.0, np.ldexp(1 + (c % MANTISSA) / MANTISSA, (c // MANTISSA - BIAS).astype("int32")))


def compress(nodes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The digest property restored: bottom-up, children fold into the parent while the three hold at most n // k."""
    limit = int(counts.sum()) // k
    if not limit:
        return nodes, counts
    kept_n, kept_c = [], []
    order = np.argsort(nodes, kind="stable")
    nodes, counts = nodes[order], counts[order]
    for level in range(LEVELS, 0, -1):
        here = nodes >= (1 << level)
        cur_n, cur_c, up_n, up_c = nodes[here], counts[here], nodes[~here], counts[~here]
        if not len(cur_n):
            continue
        parents = cur_n >> 1
        uniq, back = np.unique(parents, return_inverse=True)
        at = np.searchsorted(up_n, uniq)
        own = np.where((at < len(up_n)) & (up_n[np.minimum(at, max(len(up_n) - 1, 0))] == uniq), up_c[np.minimum(at, max(len(up_n) - 1, 0))], 0) if len(up_n) else np.zeros(len(uniq), "int64")
        below = np.zeros(len(uniq), "int64")
        np.add.at(below, back, cur_c)
        fold = (below + own) <= limit
        stay = ~fold[back]
        kept_n.append(cur_n[stay])
        kept_c.append(cur_c[stay])
        nodes = np.concatenate([up_n, uniq[fold]])
        counts = np.concatenate([up_c, below[fold]])
        nodes, inv = np.unique(nodes, return_inverse=True)
        total = np.zeros(len(nodes), "int64")
        np.add.at(total, inv, counts)
        counts = total
    kept_n.append(nodes)
    kept_c.append(counts)
    n, c = np.concatenate(kept_n), np.concatenate(kept_c)
    n, inv = np.unique(n, return_inverse=True)
    total = np.zeros(len(n), "int64")
    np.add.at(total, inv, c)
    return n, total


def percentile(nodes: np.ndarray, counts: np.ndarray, q: list[float]) -> tuple[np.ndarray, int]:
    """Values at the ranks ceil(q n), and the largest rank error that this digest can have."""
    level = np.floor(np.log2(nodes)).astype("int64")
    shift = LEVELS - level
    lo, hi = (nodes << shift) - LEAF, ((nodes + 1) << shift) - 1 - LEAF
    order = np.lexsort((-lo, hi))
    cum, n = np.cumsum(counts[order]), int(counts.sum())
    ranks = np.maximum(1, np.ceil(np.asarray(q) * n - 1e-9))
    at = np.minimum(np.searchsorted(cum, ranks), len(cum) - 1)
    inner = level < LEVELS
    error = 0
    if inner.any():  # the heaviest path of inner nodes from the root down
        weight = dict(zip(nodes[inner].tolist(), counts[inner].tolist()))
        path: dict[int, int] = {}
        for v in sorted(weight):
            p = v >> 1
            while p and p not in path:
                p >>= 1
            path[v] = weight[v] + path.get(p, 0)
        error = max(path.values())
    return restore(hi[order][at]), error


def digests(df: DataFrame, groups: list[str], value: str, day: str, k: int = 4000, zero_counts: bool = False) -> DataFrame:
    """(groups, day, node, cnt): the compressed digest of each group and day."""
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*[F.col(f"`{g}`").alias(g) for g in groups], F.to_date(F.col(f"`{day}`")).alias("day"), v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") < float("inf")) & ((F.col("v") >= 0) if zero_counts else (F.col("v") > 0)))
    codes = rows.groupBy(*groups, "day", (quantise(F.col("v")) + LEAF).cast("long").alias("node")).agg(F.count(F.lit(1)).alias("cnt"))
    return _compressed(codes, [*groups, "day"], k)


def merge(digest: DataFrame, groups: list[str], k: int = 4000) -> DataFrame:
    """The digests of each group joined: counts of equal nodes added, then compressed."""
    return _compressed(digest.groupBy(*groups, "node").agg(F.sum("cnt").alias("cnt")), groups, k)


def _bucketed(codes: DataFrame, keys: list[str], each, extra: str) -> DataFrame:
    """``each(nodes, counts)`` of every group, called bucket by bucket: groups are many and small, a call of Python for each would cost more than its work."""
    fields = {f.name: f.dataType.simpleString() for f in codes.schema}

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        group = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(group, kind="stable")
        nodes, counts, group = pdf["node"].to_numpy("int64")[order], pdf["cnt"].to_numpy("int64")[order], group[order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        made, first, sizes = [], [], []
        for a, b in zip(starts, np.r_[starts[1:], len(group)]):
            made.append(each(nodes[a:b], counts[a:b]))
            first.append(order[a])
            sizes.append(len(made[-1][next(iter(made[-1]))]))
        out = pdf.loc[np.repeat(first, sizes), keys].reset_index(drop=True)
        return out.assign(**{c: np.concatenate([m[c] for m in made]) for c in made[0]})

    at = F.pmod(F.xxhash64(*keys), F.lit(2 * partitions(codes.sparkSession))).cast("int")
    return codes.groupBy(at.alias("bucket")).applyInPandas(bucket, ", ".join(f"`{g}` {fields[g]}" for g in keys) + ", " + extra)


def _compressed(codes: DataFrame, keys: list[str], k: int) -> DataFrame:
    return _bucketed(codes, keys, lambda n, c: dict(zip(("node", "cnt"), compress(n, c, k))), "node long, cnt long")


def percentiles(digest: DataFrame, groups: list[str], q: list[float], k: int = 4000) -> DataFrame:
    """(groups, n, q, value, max_rank_error) of each group, over all its digests."""

    def one(nodes: np.ndarray, counts: np.ndarray) -> dict:
        nodes, counts = compress(nodes, counts, k)
        values, error = percentile(nodes, counts, q)
        return {"n": np.full(len(q), counts.sum()), "q": np.array(q), "value": values, "max_rank_error": np.full(len(q), error)}

    return _bucketed(digest.groupBy(*groups, "node").agg(F.sum("cnt").alias("cnt")), groups, one, "n long, q double, value double, max_rank_error long")
