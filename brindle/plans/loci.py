"""Interval queries over ``events`` as stranded loci: contig = user, start = seconds since 2024, end by value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import intervals as iv
from brindle.operators.cascade import cascade
from brindle.operators.topk import collapse_runs, top1
from brindle.session import table

EPOCH = 1_704_067_200  # 2024-01-01
REACH = 86_400


def loci(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    start = F.unix_seconds(F.col("ts").cast("timestamp")) - EPOCH
    return e.select(F.col("user_id").alias("contig"), F.col("event_id").alias("key"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"), start.alias("start"), (start + F.floor(F.col("value") * 600)).alias("end"), F.col("value"))


LOCI = """loci AS (SELECT user_id AS contig, event_id AS key, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
  CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS start, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 + CAST(floor(value * 600) AS BIGINT) AS "end", value FROM events)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    x = loci(spark, d)
    return iv.downstream_partners(x.where("kind = 'purchase'"), x.where("kind = 'signup'"), ["contig"], REACH)


PAIRS = f"""pairs AS (SELECT a.contig, a.key AS a_key, p.key AS p_key, a.start AS a_start, a."end" AS a_end, a.strand AS a_strand,
    (CASE WHEN p.strand = '+' THEN p."end" ELSE p.start END - CASE WHEN a.strand = '+' THEN a."end" ELSE a.start END) * CASE WHEN a.strand = '+' THEN 1 ELSE -1 END AS distance
  FROM loci a JOIN loci p ON a.contig = p.contig AND a.strand <> p.strand WHERE a.kind = 'purchase' AND p.kind = 'signup'),
near AS (SELECT * FROM pairs WHERE distance BETWEEN 0 AND {REACH})"""


def partners(spark: SparkSession, d: str) -> DataFrame:
    """JN1, FLT1-2: anchors with every downstream partner on the opposite strand."""
    return _pairs(spark, d).select("contig", "a_key", "p_key", "distance")


def nearest(spark: SparkSession, d: str) -> DataFrame:
    """WIN1-2: the nearest partner of each anchor, equal distances by smaller partner."""
    return top1(_pairs(spark, d), ["a_key"], [F.col("distance"), F.col("p_key")]).select("contig", "a_key", "p_key", "distance")


def discovery(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: range join, nearest partner, ordered cascade with the first failure as reason, counts by reason (JN1, WIN1, JN3, FLT5)."""
    x = loci(spark, d)
    anchors = x.where("kind = 'purchase'").select("contig", "key", "strand", "start", "end")
    sites = iv.overlap_class(anchors.withColumn("s1", F.col("start")).withColumn("s2", F.col("start") + 20), x.where("kind in ('view', 'click')").select("contig", F.col("start").alias("f1"), F.col("end").alias("f2")), ["contig"], ("s1", "s2"), ("f1", "f2"), ["key"])
    best = nearest(spark, d).select(F.col("a_key").alias("key"), "distance")
    rows = sites.join(best, "key", "left")
    gates = [
        ("partner", F.col("distance").isNotNull(), "no_partner"),
        ("length", (F.col("end") - F.col("start") + 1) / 3 > 300, "integrase_too_short"),
        ("intergenic", F.col("overlap_class") == "intergenic", F.concat(F.lit("cds_"), F.col("overlap_class"))),
        ("distance", F.col("distance") <= 43_200, "too_far"),
    ]
    return cascade(rows, gates, stop_after=1).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("passed_length").cast("long")).alias("n_length"), F.sum(F.col("passed_intergenic").cast("long")).alias("n_intergenic"))


SITES = """feats AS (SELECT contig, start AS f1, "end" AS f2 FROM loci WHERE kind IN ('view', 'click')),
sites AS (SELECT a.contig, a.key, a.start, a."end", CASE WHEN max(f.f1) IS NULL AND NOT bool_or(f.contig IS NOT NULL) THEN 'no_cds_on_contig'
     WHEN coalesce(max(greatest(0, least(a.start + 20, f.f2) - greatest(a.start, f.f1) + 1)), 0) <= 0 THEN 'intergenic'
     WHEN max(greatest(0, least(a.start + 20, f.f2) - greatest(a.start, f.f1) + 1)) >= 21 THEN 'fully_inside_CDS' ELSE 'partial_CDS' END AS overlap_class
  FROM loci a LEFT JOIN feats f ON f.contig = a.contig WHERE a.kind = 'purchase' GROUP BY ALL)"""

DISCOVERY = f"""WITH {LOCI}, {PAIRS}, {SITES},
best AS (SELECT a_key, min(distance) AS distance FROM near GROUP BY 1),
rows AS (SELECT s.*, b.distance, (s."end" - s.start + 1) / 3 > 300 AS long_enough FROM sites s LEFT JOIN best b ON b.a_key = s.key),
flags AS (SELECT *, CASE WHEN distance IS NULL THEN 'no_partner' WHEN NOT long_enough THEN 'integrase_too_short' WHEN overlap_class <> 'intergenic' THEN 'cds_' || overlap_class
  WHEN distance > 43200 THEN 'too_far' ELSE '' END AS reject_reason FROM rows)
SELECT reject_reason, count(*) AS n, sum(CASE WHEN distance IS NOT NULL AND long_enough THEN 1 ELSE 0 END) AS n_length,
  sum(CASE WHEN distance IS NOT NULL AND overlap_class = 'intergenic' THEN 1 ELSE 0 END) AS n_intergenic FROM flags GROUP BY 1"""


def union(spark: SparkSession, d: str) -> DataFrame:
    """INT2: merged intervals per contig and strand."""
    return iv.interval_union(loci(spark, d), ["contig", "strand"], "start", "end")


UNION_BODY = f"""{LOCI}, o AS (SELECT contig, strand, start, "end", max("end") OVER (PARTITION BY contig, strand ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM loci WHERE "end" >= start),
g AS (SELECT *, sum(CASE WHEN r IS NULL OR start > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY contig, strand ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM o),
u AS (SELECT contig, strand, min(start) AS start, max("end") AS "end" FROM g GROUP BY contig, strand, i)"""


def covered(spark: SparkSession, d: str) -> DataFrame:
    """INT3, INT7: covered and uncovered length per contig and strand."""
    c = iv.covered_length(loci(spark, d), ["contig", "strand"], "start", "end")
    return c.select("contig", "strand", "covered", "n_islands", F.greatest(F.lit(0), F.lit(31 * 86_400) - F.col("covered")).alias("rest"))


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """JN8, JN17-20, INT1: purchases x views on the contig that overlap by more than half of the shorter (G24: without + 1)."""
    x = loci(spark, d)
    p = x.where("kind = 'purchase'").select("contig", F.col("key").alias("p"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    v = x.where("kind = 'view'").select("contig", F.col("key").alias("v"), F.col("start").alias("vs"), F.col("end").alias("ve"))
    span = F.least("pe", "ve") - F.greatest("ps", "vs")
    hits = iv.range_join(p, v, ["contig"], ("ps", "pe"), ("vs", "ve"))
    return hits.where(span > 0.5 * F.least(F.col("pe") - F.col("ps"), F.col("ve") - F.col("vs"))).select("contig", "p", "v", span.alias("span"), iv.overlap_length(F.col("ps"), F.col("pe"), F.col("vs"), F.col("ve")).alias("bases"))


def compartments(spark: SparkSession, d: str) -> DataFrame:
    """JN21-22, INT4, AGG37: the first purchase or signup that holds the midpoint of each view; purchases before signups."""
    x = loci(spark, d)
    points = x.where("kind = 'view'").select("contig", "key", iv.midpoint(F.col("start"), F.col("end")).alias("mid"))
    spans = x.where("kind in ('purchase', 'signup')").select("contig", F.col("kind").alias("owner"), F.col("key").alias("owner_key"), F.col("start").alias("s"), F.col("end").alias("e"))
    got = iv.point_owner(points, spans, ["contig"], "mid", ("s", "e"), [F.col("owner").asc_nulls_last(), F.col("s"), F.col("owner_key")], ["key"])
    return got.select("key", F.coalesce("owner", F.lit("chrom")).alias("compartment"), "owner_key")


def windows(spark: SparkSession, d: str) -> DataFrame:
    """FLT7-9, INT6, INT9: strand-aware window, clipped span and its flip, per locus."""
    x = loci(spark, d)
    lo, hi = iv.search_window(F.col("strand"), F.col("start"), F.col("end"), 40_000)
    a, b = iv.clip(F.col("start") - 1_000, F.col("end") + 1_000, F.lit(2_678_400))
    f0, f1 = iv.flip(F.col("start") - 1, F.col("end"), F.lit(2_678_400))
    return x.select("key", lo.alias("win_lo"), hi.alias("win_hi"), a.alias("clip_lo"), b.alias("clip_hi"), f0.alias("flip_start0"), f1.alias("flip_end0"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """WIN20: kinds per contig in order, runs of one kind collapsed, as one text; orientation by the first locus."""
    r = collapse_runs(loci(spark, d), ["contig"], [F.col("start"), F.col("key")], "kind")
    return r.groupBy("contig").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "key", "kind"))), lambda x: x["kind"]), ">").alias("path"), F.count(F.lit(1)).alias("n_runs"))


def histogram(spark: SparkSession, d: str) -> DataFrame:
    """AGG22: histogram of lengths with an upper clip."""
    n = F.least(F.col("end") - F.col("start"), F.lit(60_000))
    return loci(spark, d).groupBy("kind", F.floor(n / 5_000).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "discovery_cascade": discovery,
    "jn1_downstream_partners": partners,
    "win1_nearest": nearest,
    "int2_union": union,
    "int3_covered": covered,
    "jn18_overlap_fraction": overlaps,
    "jn21_compartment": compartments,
    "flt7_windows": windows,
    "win20_runs": runs,
    "agg22_histogram": histogram,
}
ORACLE = {
    "discovery_cascade": DISCOVERY,
    "jn1_downstream_partners": f"WITH {LOCI}, {PAIRS} SELECT contig, a_key, p_key, distance FROM near",
    "win1_nearest": f"WITH {LOCI}, {PAIRS} SELECT contig, a_key, p_key, distance FROM near QUALIFY row_number() OVER (PARTITION BY a_key ORDER BY distance, p_key) = 1",
    "int2_union": f"WITH {UNION_BODY} SELECT * FROM u",
    "int3_covered": f'WITH {UNION_BODY} SELECT contig, strand, sum("end" - start + 1)::BIGINT AS covered, count(*) AS n_islands, greatest(0, 2678400 - sum("end" - start + 1))::BIGINT AS rest FROM u GROUP BY ALL',
    "jn18_overlap_fraction": f"""WITH {LOCI} SELECT p.contig, p.key AS p, v.key AS v, least(p."end", v."end") - greatest(p.start, v.start) AS span, greatest(0, least(p."end", v."end") - greatest(p.start, v.start) + 1) AS bases
  FROM loci p JOIN loci v ON p.contig = v.contig AND p.start <= v."end" AND v.start <= p."end" WHERE p.kind = 'purchase' AND v.kind = 'view'
  AND least(p."end", v."end") - greatest(p.start, v.start) > 0.5 * least(p."end" - p.start, v."end" - v.start)""",
    "jn21_compartment": f"""WITH {LOCI} SELECT v.key, coalesce(s.kind, 'chrom') AS compartment, s.key AS owner_key FROM loci v LEFT JOIN loci s ON s.contig = v.contig AND s.kind IN ('purchase', 'signup')
  AND (v.start + v."end") // 2 BETWEEN s.start AND s."end" WHERE v.kind = 'view' QUALIFY row_number() OVER (PARTITION BY v.key ORDER BY s.kind NULLS LAST, s.start, s.key) = 1""",
    "flt7_windows": f"""WITH {LOCI} SELECT key, CASE WHEN strand = '+' THEN "end" ELSE greatest(1, start - 40000) END AS win_lo, CASE WHEN strand = '+' THEN "end" + 40000 ELSE start END AS win_hi,
  greatest(1, start - 1000) AS clip_lo, least(2678400, "end" + 1000) AS clip_hi, 2678400 - "end" AS flip_start0, 2678400 - (start - 1) AS flip_end0 FROM loci""",
    "win20_runs": f"""WITH {LOCI}, l AS (SELECT *, lag(kind) OVER (PARTITION BY contig ORDER BY start, key) AS b FROM loci)
  SELECT contig, string_agg(kind, '>' ORDER BY start, key) AS path, count(*) AS n_runs FROM l WHERE b IS NULL OR b <> kind GROUP BY 1""",
    "agg22_histogram": f"""WITH {LOCI} SELECT kind, CAST(floor(least("end" - start, 60000) / 5000) AS BIGINT) AS bin, count(*) AS n FROM loci GROUP BY ALL""",
}
