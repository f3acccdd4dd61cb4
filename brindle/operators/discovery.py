"""Anchored duplications next to a gene: hit selection and the audited gate cascade over candidates.

Candidates: candidate_id, contig, strand (of the anchor gene), anchor_start, anchor_end, gene_start, gene_end,
element_len, element_has_n, and the sequences site_seq and anchor_seq. Hits: candidate_id, qstart, qend, sstart, send,
length, mismatch, wstart. Everything is joins, windows and column expressions; no candidate is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import anchored_run, protein_length
from brindle.operators.cascade import cascade
from brindle.operators.intervals import overlap_class
from brindle.operators.topk import top1


@dataclass(frozen=True)
class Limits:
    """Thresholds of the cascade. ``strict_shift`` makes the anchor tolerance what its name says (shift bases, not shift - 1)."""

    shift: int = 3
    candidate: int = 8
    exact: int = 14
    relaxed: int = 17
    gene_aa: int = 300
    element_nt: int = 0
    reject_gaps: bool = True
    reject_n: bool = False
    strict_shift: bool = False


def anchored_hits(hits: DataFrame, candidates: DataFrame, limits: Limits) -> DataFrame:
    """Hits that end at the anchor's 3' end and run with its strand, with absolute coordinates and spans."""
    c = candidates.select("candidate_id", "strand", (F.abs(F.col("anchor_end") - F.col("anchor_start")) + 1).alias("anchor_len"))
    forward = F.col("sstart") < F.col("send")
    near = F.col("qend") >= F.col("anchor_len") - limits.shift + (0 if limits.strict_shift else 1)
    kept = hits.join(c, "candidate_id").where(near & F.when(F.col("strand") == "+", forward).otherwise(F.col("sstart") > F.col("send")))
    lo, hi = F.least("sstart", "send"), F.greatest("sstart", "send")
    span = lambda a, b: F.abs(F.col(b) - F.col(a)) + 1
    return kept.select("candidate_id", "qstart", "qend", "length", "mismatch", (F.col("wstart") + lo - 1).alias("site_lo"), (F.col("wstart") + hi - 1).alias("site_hi"), ((F.col("length") != span("qstart", "qend")) | (F.col("length") != span("sstart", "send"))).alias("has_gap"))


def best_hits(hits: DataFrame, candidates: DataFrame, limits: Limits) -> DataFrame:
    """The longest anchored hit of each candidate (then the leftmost, then the one of fewer mismatches), and how many there were."""
    kept = anchored_hits(hits, candidates, limits).where(F.col("length") >= limits.candidate)
    n = kept.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_hits"))
    return top1(kept, ["candidate_id"], [F.desc("length"), F.col("site_lo"), F.col("mismatch"), F.col("qstart")]).join(n, "candidate_id")


def audit(candidates: DataFrame, hits: DataFrame, cds: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per candidate with its measures, a flag per gate, and the first failure as ``reject_reason``.

    A candidate without any hit, or without an anchored one, fails there and all later flags are false.
    """
    raw = hits.select("candidate_id").distinct().withColumn("_raw", F.lit(True))
    x = candidates.join(best_hits(hits, candidates, limits), "candidate_id", "left").join(raw, "candidate_id", "left")
    sites = x.where("site_lo is not null").select("contig", "candidate_id", "site_lo", "site_hi")
    label = overlap_class(sites, cds.select("contig", F.col("start").alias("_cs"), F.col("end").alias("_ce")), ["contig"], ("site_lo", "site_hi"), ("_cs", "_ce"), ["candidate_id"])
    x = x.join(label.select("candidate_id", "overlap_class", "overlap_share"), "candidate_id", "left")
    run = F.when(F.col("site_lo").isNotNull(), F.coalesce(anchored_run(F.upper("site_seq"), F.upper("anchor_seq"), F.col("strand"), limits.shift), F.lit(0))).otherwise(0)
    x = x.withColumn("exact_run", run).withColumn("gene_aa", protein_length(F.col("gene_start"), F.col("gene_end")))
    exact, relaxed = F.col("exact_run") >= limits.exact, F.col("length") >= limits.relaxed
    gates = [
        ("raw", F.col("_raw").isNotNull(), "v3ps_no_raw_blast"),
        ("anchored", F.col("site_lo").isNotNull(), "v3ps_no_strict_hit"),
        ("candidate", F.col("exact_run") >= limits.candidate, "exact_run_too_short"),
        ("gene_len", F.col("gene_aa") > limits.gene_aa, "integrase_too_short"),
        ("intergenic", F.col("overlap_class") == "intergenic", F.concat(F.lit("cds_"), F.coalesce("overlap_class", F.lit("")))),
        ("site_len", exact | relaxed, "attl_too_short"),
        ("no_gap", ~F.col("has_gap") if limits.reject_gaps else F.lit(True), "attl_gapped"),
        ("no_n", ~F.coalesce("element_has_n", F.lit(True)) if limits.reject_n else F.lit(True), "ambiguous_n"),
        ("element_len", F.coalesce(F.col("element_len"), F.lit(0)) >= limits.element_nt, "ie_too_short"),
    ]
    tier = F.when(F.col("site_lo").isNull(), "").when(exact, "exact").when(relaxed, "relaxed").otherwise("")
    return cascade(x.withColumn("tier", tier), gates, stop_after=2).drop("_raw")
