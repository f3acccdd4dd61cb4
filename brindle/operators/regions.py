"""Element regions between an attachment hit and a tRNA: extent, sequence, orientation and local coordinates.

Coordinates are 1-based and inclusive unless a name ends in 0. Sequences are cut where the contig rows lie; several regions of
one contig meet its sequence in one join, so the sequence is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import reverse_complement
from brindle.operators.intervals import flip
from brindle.operators.topk import top1


def element_regions(hits: DataFrame, trna: DataFrame) -> DataFrame:
    """(key, contig, start, end, trna_strand) of each tRNA row that has a hit: from the tRNA's start to the hit's end on the plus
    strand, from the hit's end to the tRNA's end on the minus strand. Other strands have no region.

    Hits: key, contig, hit_end, one row a key (of several the last by hit_end). trna: key, trna_start, trna_end, trna_strand.
    """
    strand = F.trim(F.col("trna_strand").cast("string"))
    h = top1(hits, ["key"], [F.desc("hit_end"), F.desc("contig")]).select("key", "contig", "hit_end")
    start = F.when(strand == "+", F.col("trna_start")).when(strand == "-", F.col("hit_end"))
    end = F.when(strand == "+", F.col("hit_end")).when(strand == "-", F.col("trna_end"))
    return trna.join(h, "key").select("key", "contig", start.alias("start"), end.alias("end"), strand.alias("trna_strand")).where("start is not null and end is not null")


def region_id(key: Column, contig: Column, start: Column, end: Column) -> Column:
    """``key:contig:start-end``."""
    return F.concat(key, F.lit(":"), contig, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def window_slice(seq: Column, start: Column, end: Column) -> Column:
    """The part of a sequence within a window that is clamped to it; empty where nothing is left."""
    lo = F.greatest(F.lit(1), start)
    return F.substring(seq, lo.cast("int"), F.greatest(F.lit(0), F.least(F.length(seq), end) - lo + 1).cast("int"))


def region_sequences(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """regions with seq, cut from contigs (contig, seq); names match exactly, as text. Regions without a contig are left out."""
    c = contigs.select("contig", F.col("seq").alias("_seq"))
    return regions.join(c, "contig").withColumn("seq", window_slice(F.col("_seq"), F.col("start"), F.col("end"))).drop("_seq")


def oriented(regions: DataFrame) -> DataFrame:
    """Regions turned so that the tRNA lies at the left end of plus-strand elements: reverse complement where its strand is plus.

    Needs seq, start, trna_strand, trna_len, att_len, int_start, int_end. Adds seq (turned), the half-open 0-based sites
    attl_start0.. (hit) and attr_start0.. (tRNA) and the integrase's local place int_start0.., int_end0, int_strand. Both ends of
    the integrase are shifted by the region's start, so its half-open end is one short; that is kept.
    """
    n, plus = F.length("seq"), F.col("trna_strand") == "+"
    a, b = F.col("int_start") - F.col("start"), F.col("int_end") - F.col("start")
    fa, fb = flip(a, b, n)
    turned = F.when(plus, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return regions.select(
        *[c for c in regions.columns if c != "seq"], turned.alias("seq"),
        F.when(plus, n - F.col("att_len")).otherwise(0).alias("attl_start0"), F.when(plus, n).otherwise(F.col("att_len")).alias("attl_end0"),
        F.when(plus, 0).otherwise(n - F.col("trna_len")).alias("attr_start0"), F.when(plus, F.col("trna_len")).otherwise(n).alias("attr_end0"),
        F.when(plus, fa).otherwise(a).alias("int_start0"), F.when(plus, fb).otherwise(b).alias("int_end0"), F.when(plus, -1).otherwise(1).alias("int_strand"),
    )


def annotation_rows(regions: DataFrame, trna: DataFrame, integrases: DataFrame, hits: DataFrame) -> DataFrame:
    """Regions with their tRNA (trna_len), first integrase row (int_start, int_end) and the hit of the smallest E-value (att_len).

    trna: key, trna_len. integrases: key, int_start, int_end. hits: key, evalue, length. A region that lacks one is left out; of
    equal E-values the longest hit counts.
    """
    best = top1(hits, ["key"], [F.asc_nulls_last("evalue"), F.desc("length")]).select("key", F.col("length").alias("att_len"))
    one = top1(integrases, ["key"], [F.col("int_start"), F.col("int_end")]).select("key", "int_start", "int_end")
    return regions.join(trna.select("key", "trna_len"), "key").join(one, "key").join(best, "key")
