"""Clusters at a glance: members' scores, markers and roles as short texts, overlays of many attribute tables.

Attribute tables are reduced to one row a key before they are joined, so an overlay never multiplies rows; the small sides are
left to the optimizer. Every "top" has a total order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.cascade import first_match, regex_rules
from brindle.operators.topk import top1, topk


def overlay_all(base: DataFrame, key: str, tables: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """``base`` with the columns of each table (one row a key) beside it; the dictionary says what stands where a key is missing."""
    out = base
    for df, defaults in tables:
        clash = [c for c in df.columns if c != key and c in out.columns]
        if clash:
            raise ValueError(f"columns {clash} are there already")
        out = out.join(df, key, "left")
        out = out.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})
    return out


def status(found: Column, checked: Column) -> Column:
    """not_checked, none or found: a key that was never looked at is not one that has nothing."""
    return F.when(F.coalesce(found, F.lit(False)), "found").when(F.coalesce(checked, F.lit(False)), "none").otherwise("not_checked")


def top_text(df: DataFrame, by: str, item: str, weight: Column, k: int, sep: str = "; ", out: str = "top", show: Column | None = None) -> DataFrame:
    """(by, out): the k items of greatest weight as one text, equal ones by name; ``show`` is what is written of each."""
    rows = df.select(by, F.col(item).alias("_item"), weight.alias("_w"), (F.col(item) if show is None else show).alias("_show")).where("_item is not null and _w is not null")
    best = topk(rows, [by], [F.desc("_w"), F.col("_item")], k, "_r")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_r", "_show"))), lambda x: x["_show"])
    return best.groupBy(by).agg(F.array_join(texts, sep).alias(out))


def seen_first(df: DataFrame, by: str, item: str, order: list[str], k: int, out: str, sep: str = "|") -> DataFrame:
    """(by, out): distinct items in the order they are first seen, at most k."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_x"))))
    return df.where(F.col(item).isNotNull()).groupBy(by).agg(F.array_join(F.slice(F.array_distinct(F.transform(rows, lambda r: r["_x"])), 1, k), sep).alias(out))


def role(accession: Column, clan: Column, name: Column, manual: dict[str, str], clans: dict[str, str], patterns: list[tuple[str, str]], default: str = "other") -> Column:
    """Role of a family: by its accession, else its clan, else the first pattern that its name fits."""
    pick = lambda c, known: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in known.items()], F.lit(None).cast("string")) if known else F.lit(None).cast("string")
    return F.coalesce(pick(accession, manual), pick(clan, clans), first_match(regex_rules(F.coalesce(name, F.lit("")), patterns)), F.lit(default))


def recombinase(model: Column, tyrosine: tuple[str, ...], serine: tuple[str, ...] = ()) -> Column:
    """Class of a model by the beginning of its accession; null stays null."""
    starts = lambda xs: reduce(lambda a, b: a | b, [model.startswith(x) for x in xs], F.lit(False))
    return F.when(model.isNull(), F.lit(None)).when(starts(tyrosine), "tyrosine").when(starts(serine), "serine").otherwise("other")


def presence(members: DataFrame, signals: list[DataFrame], cluster: str, key: str, item: str) -> DataFrame:
    """(cluster, item, n_with, share, mean): how many members show an item, of the greater of several signals (key, item, n).

    ``share`` is of all members of the cluster; ``mean`` counts members without the item as zero.
    """
    every = reduce(lambda a, b: a.unionByName(b), [s.select(key, item, F.col("n").cast("double").alias("n")) for s in signals])
    most = every.where("n > 0").groupBy(key, item).agg(F.max("n").alias("n"))
    size = members.groupBy(cluster).agg(F.count_distinct(key).alias("n_members"))
    per = members.select(cluster, key).distinct().join(most, key).groupBy(cluster, item).agg(F.count(F.lit(1)).alias("n_with"), F.sum("n").alias("_sum"))
    return per.join(size, cluster).select(cluster, item, "n_with", "n_members", (F.col("n_with") / F.col("n_members")).alias("share"), (F.col("_sum") / F.col("n_members")).alias("mean"))


def matrix(rows: DataFrame, cluster: str, item: str, value: str, items: list[str]) -> DataFrame:
    """One row a cluster and one column an item, zero where a cluster lacks it. The columns are given, so no pass looks for them."""
    return rows.groupBy(cluster).pivot(item, items).agg(F.max(value)).fillna(0.0, items)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of a key by the given columns, nulls first; rows that are alike in them go by their whole content."""
    return top1(df, key, [*[F.desc_nulls_last(c) for c in order], F.xxhash64(*df.columns)])


def aligned(labels: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows with their label; a row without one is an error, raised when it is met."""
    out = rows.join(labels, key, "left")
    label = [c for c in labels.columns if c != key][0]
    return out.withColumn(label, F.when(F.col(label).isNull(), F.raise_error(F.concat(F.lit("no label for "), F.col(key).cast("string")))).otherwise(F.col(label)))
