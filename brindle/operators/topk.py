"""Best, first and ranked rows per key. Every call takes a total order, so ties have one answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of every key. Spark cuts each partition to k rows a key before the shuffle (WindowGroupLimit)."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def top1(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return topk(df, by, order, 1)


def first_wins(parts: list[DataFrame], by: list[str], order: list[Column]) -> DataFrame:
    """Union of parts; of the rows of a key that of the earliest part is kept."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return top1(out, by, [F.col("_part"), *order]).drop("_part")


def with_other(df: DataFrame, value: str, k: int, other: str = "Other", out: str = "bin") -> DataFrame:
    """The k most frequent values (then by value) under their own name, the rest as ``other``."""
    count = df.where(F.col(value).isNotNull()).groupBy(value).count()
    kept = count.orderBy(F.desc("count"), value).limit(k).select(value, F.col(value).alias(out))
    return df.join(F.broadcast(kept), value, "left").withColumn(out, F.coalesce(out, F.lit(other)))


def collapse_runs(df: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    return df.withColumn("_keep", first | ~F.col(value).eqNullSafe(before)).where("_keep").drop("_keep")


def resolve(members: DataFrame, mapping: DataFrame, key: str, target: str) -> DataFrame:
    """Representative of each member: the mapped one, else the member itself if others map to it, else itself."""
    heads = mapping.select(F.col(target).alias(key)).distinct().withColumn("_head", F.lit(True))
    out = members.join(mapping.select(key, target), key, "left").join(heads, key, "left")
    return out.withColumn(target, F.coalesce(F.col(target), F.col(key))).drop("_head")
