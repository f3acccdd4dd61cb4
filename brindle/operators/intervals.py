"""Stranded intervals, 1-based and inclusive: range joins, unions, overlap classes, windows.

A range join bins the positions of one side: a long interval is listed under every bin it touches, the other side
under the bins of its own (short) extent, and a pair is reported only in the bin where the later of the two starts,
so nothing is repeated and nothing needs a distinct. Contig and bin together are the equi key, which keeps a contig
of millions of features from becoming one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 14
REGION = 1 << 20  # positions that one task sorts


def effective_position(strand: Column, start: Column, end: Column) -> Column:
    """The 3' end: end on the plus strand, start on the minus strand, null for anything else."""
    s = strand.cast("string")
    return F.when(s.isin("+", "1"), end).when(s.isin("-", "-1"), start)


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def range_join(left: DataFrame, right: DataFrame, on: list[str], lspan: tuple[str, str], rspan: tuple[str, str], how: str = "inner", width: int = BIN) -> DataFrame:
    """Pairs with equal ``on`` columns whose closed intervals overlap; columns of the sides must differ apart from ``on``. ``how``: inner or left."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(a), F.col(b)) / width)))
    lw = left.withColumn("_id", F.monotonically_increasing_id()) if how == "left" else left
    l, r = lw.withColumn("_bin", bins(*lspan)), right.withColumn("_bin", bins(*rspan))
    hit = (F.col(lspan[0]) <= F.col(rspan[1])) & (F.col(rspan[0]) <= F.col(lspan[1]))
    once = F.col("_bin") == F.floor(F.greatest(F.col(lspan[0]), F.col(rspan[0])) / width)
    keys = [*on, "_bin"]
    r = r.select(*[F.col(c).alias(f"_r_{c}") for c in keys], *[c for c in right.columns if c not in on])
    cond = hit & once
    for c in keys:
        cond = cond & (F.col(c) == F.col(f"_r_{c}"))
    pairs = l.join(r, cond, "inner").drop("_bin", *[f"_r_{c}" for c in keys])
    if how == "inner":
        return pairs
    matched = pairs.select(*[c for c in lw.columns], *[c for c in right.columns if c not in on])
    lost = lw.join(matched.select("_id").distinct(), "_id", "left_anti")
    return matched.unionByName(lost, allowMissingColumns=True).drop("_id")


def interval_union(df: DataFrame, by: list[str], start: str, end: str, width: int = REGION) -> DataFrame:
    """Merged intervals per key; overlapping and adjacent ones (start <= last end + 1) are joined. Rows without a start or
    end, or that end before they start, are left out. Repeated intervals are dropped map-side before anything is sorted.

    A task sorts one region of ``width`` positions and not a whole key: how far earlier regions reach into one, and which island is
    open there, are running maxima over the regions of a key, which are few.
    """
    rows = df.select(*by, F.col(start).alias("start"), F.col(end).alias("end")).where("start is not null and end is not null and end >= start")
    rows = rows.groupBy(*by, "start").agg(F.max("end").alias("end")).withColumn("_region", F.floor(F.col("start") / width))
    keys = [*by, "_region"]
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in keys])
    side = lambda df: df.select(*[F.col(c).alias(f"_r{c}") for c in keys], *[c for c in df.columns if c not in keys])
    earlier = Window.partitionBy(*by).orderBy("_region").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys).agg(F.max("end").alias("_e")).withColumn("_carry", F.max("_e").over(earlier)).drop("_e")
    inside = Window.partitionBy(*keys).orderBy("start")
    x = rows.join(side(carry), same).select(*keys, "start", "end", "_carry")
    reach = F.greatest(F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    x = x.withColumn("_first", F.when(reach.isNull() | (F.col("start") > reach + 1), F.col("start")))
    x = x.withColumn("_island", F.last("_first", True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = x.groupBy(*keys, "_island").agg(F.max("end").alias("end"))
    # what begins before the first island of its region belongs to the last island of the regions before it
    opened = parts.groupBy(*keys).agg(F.max("_island").alias("_i")).withColumn("_open", F.max("_i").over(earlier)).drop("_i")
    rest = parts.where("_island is null").join(side(opened), same).select(*by, F.col("_open").alias("_island"), "end")
    every = parts.where("_island is not null").select(*by, "_island", "end").unionByName(rest)
    return every.groupBy(*by, F.col("_island").alias("start")).agg(F.max("end").alias("end"))


def covered_length(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    return interval_union(df, by, start, end).groupBy(*by).agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered"), F.count(F.lit(1)).alias("n_islands"))


def overlap_class(sites: DataFrame, features: DataFrame, on: list[str], site: tuple[str, str], feature: tuple[str, str], key: list[str]) -> DataFrame:
    """Per site the best overlap with a feature of its contig: intergenic, partial_CDS, fully_inside_CDS, or
    no_cds_on_contig where the contig has none; with the overlapping share of the site."""
    n = overlap_length(F.col(site[0]), F.col(site[1]), F.col("_fs"), F.col("_fe"))
    f = features.select(*on, F.col(feature[0]).alias("_fs"), F.col(feature[1]).alias("_fe"))
    best = range_join(sites.select(*on, *key, *site).distinct(), f, on, site, ("_fs", "_fe")).groupBy(*key).agg(F.max(n).alias("_best"))
    have = features.select(*on).distinct().withColumn("_has", F.lit(True))
    out = sites.join(best, key, "left").join(have, on, "left")
    length = F.col(site[1]) - F.col(site[0]) + 1
    share = F.coalesce(F.col("_best"), F.lit(0)) / length
    label = F.when(F.col("_has").isNull(), "no_cds_on_contig").when(F.coalesce("_best", F.lit(0)) <= 0, "intergenic").when(F.col("_best") >= length, "fully_inside_CDS").otherwise("partial_CDS")
    return out.withColumn("overlap_class", label).withColumn("overlap_share", share).drop("_best", "_has")


def downstream_partners(anchors: DataFrame, partners: DataFrame, on: list[str], most: int) -> DataFrame:
    """Anchor x partner on the same contig and opposite strands whose effective position lies 0..most downstream of the anchor's.

    Sides have key, strand, start, end; columns come out as a_* and p_*, with ``distance``. Positions are binned by
    ``most``, so an anchor is compared with the partners of its own and one neighbouring bin only.
    """
    a = anchors.select(*on, *[F.col(c).alias(f"a_{c}") for c in ("key", "strand", "start", "end")]).withColumn("a_pos", effective_position(F.col("a_strand"), F.col("a_start"), F.col("a_end")))
    p = partners.select(*[F.col(c).alias(f"_p_{c}") for c in on], *[F.col(c).alias(f"p_{c}") for c in ("key", "strand", "start", "end")]).withColumn("p_pos", effective_position(F.col("p_strand"), F.col("p_start"), F.col("p_end")))
    width = max(1, most)
    down = F.when(F.col("a_strand").isin("+", "1"), 1).otherwise(-1)
    a = a.withColumn("_b", F.floor(F.col("a_pos") / width)).withColumn("_bin", F.explode(F.array(F.col("_b"), F.col("_b") + down))).drop("_b")
    p = p.withColumn("_p_bin", F.floor(F.col("p_pos") / width))
    cond = (F.col("_bin") == F.col("_p_bin")) & (F.col("a_strand") != F.col("p_strand"))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"_p_{c}"))
    d = (F.col("p_pos") - F.col("a_pos")) * F.when(F.col("a_strand").isin("+", "1"), 1).otherwise(-1)
    out = a.join(p, cond).withColumn("distance", d).where(f"distance between 0 and {int(most)}")
    return out.drop("_bin", "_p_bin", *[f"_p_{c}" for c in on])


def point_owner(points: DataFrame, spans: DataFrame, on: list[str], point: str, span: tuple[str, str], order: list[Column], key: list[str]) -> DataFrame:
    """The first span by ``order`` that holds each point; points without one keep nulls."""
    p = points.withColumn("_p0", F.col(point)).withColumn("_p1", F.col(point))
    hits = range_join(p, spans, on, ("_p0", "_p1"), span, "left").drop("_p0", "_p1")
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def midpoint(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2)


def clip(start: Column, end: Column, cap: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(1), start), F.least(cap, end)


def search_window(strand: Column, start: Column, end: Column, size: int) -> tuple[Column, Column]:
    """The window of ``size`` downstream of a stranded interval, not below 1."""
    plus = strand.isin("+", "1")
    return F.when(plus, end).otherwise(F.greatest(F.lit(1), start - size)), F.when(plus, end + size).otherwise(start)


def flip(start0: Column, end0: Column, length: Column) -> tuple[Column, Column]:
    """0-based half-open coordinates on the reverse complement."""
    return length - end0, length - start0


def parse_region(text: Column) -> Column:
    """``x:contig:a-b`` -> struct(contig, lo, hi) with ordered ends; null parts where it doesn't fit. A tail after ``|`` is ignored."""
    body = F.substring_index(text, "|", 1)
    a, b = (F.regexp_extract(body, r":(\d+)-(\d+)$", i) for i in (1, 2))
    a, b = F.nullif(a, F.lit("")).cast("bigint"), F.nullif(b, F.lit("")).cast("bigint")
    return F.struct(F.nullif(F.regexp_extract(body, r"^[^:]*:(.+):\d+-\d+$", 1), F.lit("")).alias("contig"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def near_in_order(genes: DataFrame, element: str, index: str, first: Column, second: Column, within: int) -> DataFrame:
    """Per element whether a gene of ``first`` and one of ``second`` lie at most ``within`` genes apart: one window pass, no self-join."""
    w = Window.partitionBy(element).orderBy(index).rangeBetween(-within, within)
    rows = genes.withColumn("_a", first).withColumn("_b", second)
    return rows.withColumn("_near", F.col("_a") & F.max("_b").over(w)).groupBy(element).agg(F.coalesce(F.max("_near"), F.lit(False)).alias("near"))
