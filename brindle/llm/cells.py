"""Cells that hold too many rows, split into blocks whose pairs are tasks of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import cut_table

LISTED = 200_000  # crowded cells that are broadcast; more of them are joined


def block_pairs(rows: DataFrame, cell: list[str], key: str, cap: int) -> DataFrame:
    """rows with own, lo and hi: a row of block ``own`` is listed for every pair of blocks lo <= hi that its block is part of.

    A cell of at most ``cap`` rows has the one block 0. ``rows`` must be written already: it is read twice, the first
    time for the counts of the cells alone, so the rows themselves are not shuffled here.
    """
    crowded = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap)
    crowded = cut_table(crowded.select(*cell, F.ceil(F.col("_n") / cap).cast("int").alias("_blocks")))
    n = crowded.count()
    if n:
        rows = rows.join(F.broadcast(crowded) if n <= LISTED else crowded, cell, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    else:
        rows = rows.withColumn("_blocks", F.lit(1))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(key, F.lit(11)), F.col("_blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("lo"), F.greatest(k, F.col("own")).alias("hi")))
    return rows.withColumn("_bp", F.explode(pairs)).select("*", "_bp.lo", "_bp.hi").drop("_bp", "_blocks")
