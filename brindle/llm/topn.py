"""Top N items within every group, by a loser-tree merge of sorted runs.

Each input partition is turned into sorted runs of bounded size, ordered by (group, score downwards, item
upwards); an item counts once per run with its highest score and a run keeps only the first N of a group, so
what a hot group sends through the shuffle is at most N rows a run, however many rows it has. Runs of one
bucket of groups are merged by a tournament tree of losers that seeks to the next group in every run as soon
as N items of the current one are out. Above ``FAN_IN`` input partitions the merge has two levels.

Defined cases: rows with a null group, item or score, or a NaN score, take no part; equal scores go by item
upwards (code points); repeated rows count once; a group with fewer than N items gives all; an empty input
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import partitions

RUN_ROWS = 400_000
FAN_IN = 512


class LoserTree:
    """Multiway merge. ``heads[i]`` is the current key of run i, or None when it is exhausted."""

    def __init__(self, heads: list):
        self.heads = heads
        self.k = max(1, len(heads))
        self.tree = [-1] * self.k  # losers; tree[0] is the winner
        for i in range(len(heads)):
            self.replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def replay(self, i: int) -> None:
        """Plays run i from its leaf to the root; an empty place on the way takes the player (while the tree fills)."""
        at = (i + self.k) >> 1
        while at > 0:
            other = self.tree[at]
            if other < 0:
                self.tree[at] = i
                return
            if self._beats(other, i):
                self.tree[at], i = i, other
            at >>= 1
        self.tree[0] = i

    def winner(self) -> int:
        return self.tree[0]


def sorted_run(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """One run: sorted, an item once per group with its best score, the first n of each group."""
    rows = rows.sort_values(["grp", "score", "item"], ascending=[True, False, True], kind="stable")
    rows = rows.drop_duplicates(["grp", "item"])
    return rows[rows.groupby("grp").cumcount() < n]


def merge_runs(runs: list[tuple[list, list, list]], n: int) -> list[tuple]:
    """(groups, scores, items) of each sorted run -> (group, item, score, place) of the first n of every group."""
    ends = []  # for each run: position -> start of the next group
    for groups, _, _ in runs:
        g = pd.Series(groups)
        starts = np.flatnonzero((g != g.shift()).to_numpy())
        ends.append(np.repeat(np.r_[starts[1:], len(g)], np.diff(np.r_[starts, len(g)])))
    at = [0] * len(runs)

    def key(i: int):
        groups, scores, items = runs[i]
        return (groups[at[i]], -scores[at[i]], items[at[i]]) if at[i] < len(groups) else None

    if not runs:
        return []
    tree = LoserTree([key(i) for i in range(len(runs))])
    out, group, seen = [], None, set()
    while tree.heads[(i := tree.winner())] is not None:
        g, neg, item = tree.heads[i]
        if not out or g != group:
            group, seen = g, set()
        if len(seen) < n and item not in seen:
            seen.add(item)
            out.append((g, item, -neg, len(seen)))
        at[i] = int(ends[i][at[i]]) if len(seen) >= n else at[i] + 1
        tree.heads[i] = key(i)
        tree.replay(i)
    return out


def top_n(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(group, item, score, place) of the n items of each group with the highest score."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{group}`").alias("grp"), F.col(f"`{item}`").alias("item"), F.col(f"`{score}`").cast("double").alias("score"))
    rows = rows.where(F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    kinds = dict(rows.dtypes)
    fields = f"grp {kinds['grp']}, item {kinds['item']}, score double"

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= RUN_ROWS:
                yield sorted_run(pd.concat(held), n).assign(run=part * 100_000 + number)
                held, size, number = [], 0, number + 1
        if size:
            yield sorted_run(pd.concat(held), n).assign(run=part * 100_000 + number)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["run", "grp", "score", "item"], ascending=[True, True, False, True], kind="stable")
        parts = [(r["grp"].tolist(), r["score"].tolist(), r["item"].tolist()) for _, r in pdf.groupby("run", sort=False)]
        return pd.DataFrame(merge_runs(parts, n), columns=["grp", "item", "score", "place"])

    made = rows.mapInPandas(runs, fields + ", run long")
    bucket = F.pmod(F.xxhash64("grp"), F.lit(2 * partitions(spark))).cast("int")
    if rows.rdd.getNumPartitions() > FAN_IN:
        block = F.floor(F.col("run") / (100_000 * FAN_IN))
        made = made.groupBy(bucket.alias("bucket"), block.alias("block")).applyInPandas(lambda key, pdf: merge(pdf)[["grp", "item", "score"]].assign(run=int(key[1])), fields + ", run long")
    out = made.groupBy(bucket.alias("bucket")).applyInPandas(merge, fields + ", place int")
    return out.select(F.col("grp").alias(group), F.col("item").alias(item), F.col("score").alias(score), "place")
