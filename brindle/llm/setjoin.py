"""All pairs of records whose sets overlap above a Jaccard threshold, by metric pivot partitioning.

Jaccard distance is a metric, so with e = 1 - threshold and pivots p the following lose no pair:

* a record within RHO of a pivot is at home in the cell of its nearest pivot and visits every other cell i with
  ``d(x, p_i) <= min(d(x, nearest) + 2 e, RHO + e)`` (triangle inequality);
* a record farther than RHO from every pivot is at home in the cells of its rarest tokens, as many as a set must
  share one of with any similar set (a token is the pivot {token}; all of them are equally far, so the tie is
  broken by rarity); records with ``d(x, nearest) > RHO - e`` visit these cells too.

Pairs with at least one record at home are compared exactly within a cell. Pivots come from a bounded sample
(half of the classes, up to ``SAMPLE``), thinned so that no two are close; every record is placed. Equal sets are one class,
compared once. A cell of more than ``CELL`` records is split into blocks, and each pair of blocks is a task of its own, so no
group is held whole by one task; where all pairs of keys are asked for, classes are expanded by blocks of ``MEMBERS`` keys. Tokens and sets are told apart by their 64-bit hashes.

Defined cases: null keys and tokens are left out, repeated tokens count once, sets below ``least`` tokens take no
part, empty tables give an empty result, columns other than key and token are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.cells import LISTED, block_pairs
from brindle.session import cut_table, partitions

SAMPLE = 131_072  # sets of which pivots are chosen, at most
LEAST_SAMPLE = 16_384  # and at least, where there are so many
MEMBERS = 1_000  # keys of a class that are expanded at once
FREQUENT = 4_096  # tokens known as frequent, at most
CELL = 1_500  # records that are compared at once


def sets(tokens: DataFrame, key: str, token: str, least: int) -> DataFrame:
    """(key, tokens): the distinct tokens of each key as sorted hashes."""
    rows = tokens.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{token}`")).alias("t"), F.col(f"`{token}`").isNotNull().alias("ok")).where(F.col("ok") & F.col("key").isNotNull())
    return rows.groupBy("key").agg(F.sort_array(F.collect_set("t")).alias("tokens")).where(F.size("tokens") >= least)


def classes(records: DataFrame) -> DataFrame:
    """(rep, tokens, name, n): one row for each distinct set, numbered by its hash and named by its smallest key."""
    return records.groupBy("tokens").agg(F.min("key").alias("name"), F.count(F.lit(1)).alias("n")).withColumn("rep", F.xxhash64("tokens"))


@dataclass
class Pivots:
    """Pivot sets with an inverted index. ``cells`` groups pivots into cells (each its own by default)."""

    sets: list[np.ndarray]
    cells: np.ndarray

    def __post_init__(self):
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        flat = np.concatenate(self.sets) if self.sets else np.array([], dtype=np.int64)
        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order].astype(np.int32)
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.array([], dtype=int)
        self.posts = {int(flat[a]): owner[a:b] for a, b in zip(starts, np.r_[starts[1:], len(flat)])}
        common = max(64, len(self.sets) // 50)
        self.wide = {t: np.isin(np.arange(len(self.sets)), p) for t, p in self.posts.items() if len(p) > common}

    def near(self, tokens: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Pivots within distance ``most`` of a set, and their distances."""
        posts, wide = [], []
        for t in tokens.tolist():
            if (p := self.posts.get(t)) is not None:
                (wide if t in self.wide else posts).append((t, p))
        # pivots that share frequent tokens only are looked at where those alone could reach the distance
        alone = len(wide) >= (1 - most) * len(tokens)
        held = [p for _, p in posts] + ([p for _, p in wide] if alone else [])
        if not held:
            return np.array([], dtype=np.int64), np.array([])
        found, shared = np.unique(np.concatenate(held), return_counts=True)
        if not alone:
            for t, _ in wide:
                shared = shared + self.wide[t][found]
        d = 1 - shared / (len(tokens) + self.sizes[found] - shared)
        ok = d <= most + 1e-9
        return found[ok], d[ok]


def thin(candidates: list[np.ndarray], apart: float) -> list[np.ndarray]:
    """The candidates, in order, that are farther than ``apart`` from every one kept before.

    Two sets that near share two of their rarest tokens, as many as a set may lack and two more (one for distances from 0.5);
    sets are looked up by these pairs, which few others have.
    """
    if not candidates:
        return []
    flat = np.concatenate(candidates)
    uniq, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(uniq), dtype=np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(uniq))
    k = 2 if apart < 0.5 else 1
    ranks = np.split(rank[code], np.cumsum([len(c) for c in candidates])[:-1])
    keys, ends = array("q"), []
    for n, mine in zip(map(len, ranks), ranks):
        mine.sort()
        rare = mine[: n - int(np.ceil((1 - apart) * n - 1e-9)) + k].tolist()
        keys.extend((a << 32 | b for a, b in combinations(rare, 2)) if k == 2 else rare)
        ends.append(len(keys))
    keys = np.array(keys, dtype=np.int64)
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    number = np.where(count[number] > 1, number, -1)  # a key of one set alone leads to nobody
    kept: list[int] = []
    posts: dict[int, list[int]] = {}
    for c, (start, end) in enumerate(zip([0, *ends], ends)):
        mine = number[start:end]
        mine = mine[mine >= 0].tolist()
        near = {i for x in mine for i in posts.get(x, ())}
        n = len(candidates[c])
        if near:
            all_ = set(candidates[c].tolist())
            if any(1 - shared / (n + len(candidates[i]) - shared) <= apart for i in near for shared in [len(all_.intersection(candidates[i].tolist()))]):
                continue
        for x in mine:
            posts.setdefault(x, []).append(c)
        kept.append(c)
    return [candidates[c] for c in kept]


def sample_pivots(groups: DataFrame, n: int, apart: float) -> Pivots:
    """Pivots from half of the n classes, within the bounds, taken by the hash of their name."""
    bound = min(SAMPLE, max(LEAST_SAMPLE, n // 2))
    step = max(1, n // bound)
    rows = groups.where(F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(step)) == 0).select("tokens").limit(2 * bound).toArrow().to_pandas()
    kept = thin([np.asarray(t, dtype=np.int64) for t in rows["tokens"]], apart)
    return Pivots(kept, np.arange(len(kept)))


def frequent_tokens(groups: DataFrame, n: int, bound: int = FREQUENT) -> dict[int, int]:
    """Counts of the tokens that more than a thousandth of all sets hold, at most ``bound`` of them."""
    rows = groups.select(F.explode("tokens").alias("t")).groupBy("t").count().where(F.col("count") > max(8, n // 1000))
    return {int(r["t"]): int(r["count"]) for r in rows.orderBy(F.desc("count"), "t").limit(bound).collect()}


def place(groups: DataFrame, pivots: Pivots, frequent: dict[int, int], threshold: Fraction, rho: float) -> DataFrame:
    """(rep, tokens, kind, cell, home): every class at home in its cells and as a visitor where the bounds ask for it."""
    sc = groups.sparkSession.sparkContext
    known = sc.broadcast((pivots, frequent))
    e = float(1 - threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piv, freq = known.value
        for b in batches:
            at, kind, cell, home = [], [], [], []
            for i, tokens in enumerate(b["tokens"]):
                found, d = piv.near(tokens, rho + e)
                near = d.min() if len(d) else 2.0
                if near <= rho:
                    mine = int(piv.cells[found[np.lexsort((found, d))[0]]])
                    for c in set(piv.cells[found[d <= near + 2 * e + 1e-9]].tolist()):
                        at.append(i), kind.append(0), cell.append(c), home.append(c == mine)
                else:
                    for c in set(piv.cells[found].tolist()):
                        at.append(i), kind.append(0), cell.append(c), home.append(False)
                if near > rho - e - 1e-9:
                    keep = len(tokens) - int(-(-threshold.numerator * len(tokens) // threshold.denominator)) + 1
                    for t in sorted(tokens.tolist(), key=lambda t: (freq.get(t, 0), t))[:keep]:
                        at.append(i), kind.append(1), cell.append(t), home.append(near > rho)
            at = np.array(at, dtype=np.int64)
            yield pd.DataFrame({"rep": b["rep"].to_numpy()[at], "tokens": b["tokens"].to_numpy()[at], "kind": kind, "cell": cell, "home": home})

    kinds = dict(groups.dtypes)
    return groups.select("rep", "tokens").mapInPandas(run, f"rep {kinds['rep']}, tokens array<bigint>, kind int, cell bigint, home boolean")


def cell_pairs(tokens: list[np.ndarray], home: np.ndarray, threshold: Fraction, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, shared) with i < j of one cell's similar pairs with a record at home; with ``side`` only pairs across the two sides."""
    n = len(tokens)
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    _, code = np.unique(np.concatenate(tokens), return_inverse=True)
    m = np.zeros((n, int(code.max()) + 1), dtype=np.float32)
    m[np.repeat(np.arange(n), sizes), code] = 1
    shared = np.rint(m @ m.T).astype(np.int64)
    ok = threshold.denominator * shared >= threshold.numerator * (sizes[:, None] + sizes[None, :] - shared)
    ok &= home[:, None] | home[None, :]
    if side is not None:
        ok &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(ok, 1))
    return i, j, shared[i, j]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


def join_cells(placed: DataFrame, threshold: Fraction, links_only: bool = False, cap: int = CELL) -> DataFrame:
    """Distinct (a, b, shared) of similar classes. With ``links_only`` a cell gives, instead of all its pairs, links that
    join the same records (shared is 0 then)."""
    spark = placed.sparkSession
    rows = block_pairs(placed, ["kind", "cell"], "rep", cap)
    kind = dict(placed.dtypes)["rep"]

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, toks, homes = pdf["rep"].to_numpy(), pdf["tokens"].to_numpy(), pdf["home"].to_numpy()
        own, lo, hi = pdf["own"].to_numpy(), pdf["lo"].to_numpy(), pdf["hi"].to_numpy()
        a, b, s = [], [], []
        for at in pdf.groupby(["kind", "cell", "lo", "hi"], sort=False).indices.values():
            home = homes[at]
            if len(at) < 2 or not home.any():
                continue
            side = own[at] if lo[at[0]] != hi[at[0]] else None
            i, j, n = cell_pairs([toks[x] for x in at], home, threshold, side)
            if not len(i):
                continue
            if links_only:
                root = _roots(len(at), i, j)
                i = np.flatnonzero(root != np.arange(len(at)))
                j, n = root[i], np.zeros(len(i), dtype=np.int64)
            x, y = rep[at[i]], rep[at[j]]
            swap = np.array([p > q for p, q in zip(x, y)], dtype=bool)
            a.append(np.where(swap, y, x)), b.append(np.where(swap, x, y)), s.append(n)
        if not a:
            return pd.DataFrame({"a": [], "b": [], "shared": []}, dtype=object)
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "shared": np.concatenate(s)}).drop_duplicates()

    key = F.pmod(F.xxhash64("kind", "cell", "lo", "hi"), F.lit(4 * partitions(spark))).cast("int")
    return rows.groupBy(key.alias("bucket")).applyInPandas(bucket, f"a {kind}, b {kind}, shared int").distinct()


def similar_classes(groups: DataFrame, threshold: Fraction, rho: float = 0.5) -> DataFrame:
    """Distinct (a, b, shared) of the similar pairs of classes."""
    n = groups.count()
    pivots = sample_pivots(groups, n, float(1 - threshold))
    placed = cut_table(place(groups, pivots, frequent_tokens(groups, n), threshold, rho))
    return join_cells(placed, threshold)


def similar_sets(tokens: DataFrame, key: str, token: str, threshold: Fraction, least: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, members, groups): pairs (a, b, shared) of similar classes of equal sets, members (rep, key), groups (rep, name, n).
    Copies are not expanded into pairs: two keys are similar if they share a class or their classes are a pair."""
    records = cut_table(sets(tokens, key, token, least))
    groups = cut_table(classes(records))
    return similar_classes(groups, threshold), records.select(F.xxhash64("tokens").alias("rep"), "key"), groups.select("rep", "name", "n")


def expand(pairs: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of the keys of similar classes and of each class by itself. A class of more than MEMBERS keys is
    split into blocks, so what meets in one place is a block with a block."""
    crowded = cut_table(groups.where(F.col("n") > MEMBERS).select("rep", F.ceil(F.col("n") / MEMBERS).cast("int").alias("blocks")))
    few = crowded.count() <= LISTED

    def blocks(df: DataFrame, rep: str, out: str) -> DataFrame:
        c = crowded.select(F.col("rep").alias(rep), F.col("blocks").alias(out))
        return df.join(F.broadcast(c) if few else c, rep, "left").withColumn(out, F.coalesce(out, F.lit(1)))

    both = pairs.select("a", "b").unionByName(groups.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    both = blocks(blocks(both, "a", "na"), "b", "nb")
    both = both.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(0), F.col("nb") - 1)))
    held = blocks(members, "rep", "n").select("rep", F.pmod(F.xxhash64("key", F.lit(13)), F.col("n")).cast("int").alias("block"), "key")
    one = both.join(held.select(F.col("rep").alias("a"), F.col("block").alias("i"), F.col("key").alias("x")), ["a", "i"])
    two = one.join(held.select(F.col("rep").alias("b"), F.col("block").alias("j"), F.col("key").alias("y")), ["b", "j"])
    two = two.where((F.col("a") != F.col("b")) | (F.col("i") != F.col("j")) | (F.col("x") < F.col("y")))
    return two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_pairs(tokens: DataFrame, key: str, token: str, threshold: Fraction, least: int = 1) -> DataFrame:
    """Distinct (a, b), a < b, of all keys whose sets have at least ``least`` tokens and a Jaccard similarity of ``threshold`` or more."""
    return expand(*similar_sets(tokens, key, token, threshold, least))
