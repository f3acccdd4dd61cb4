"""Chains of joins and picks over the driver's tables: orders as elements, events as loci, genomes with accessions as systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import chains as ch
from brindle.operators.intervals import midpoint, point_owner
from brindle.plans.loci import LOCI, loci
from brindle.session import table


def located(spark: SparkSession, d: str) -> DataFrame:
    """JN2, 4, SNK9: parts with a place (first line item) and the length of their brand; what lacks one is kept with the reason."""
    p = table(spark, d, "part").select(F.concat_ws("_", "p_brand", F.col("p_partkey").cast("string")).alias("orf"), F.col("p_type").alias("model"))
    l = table(spark, d, "lineitem").where("l_quantity > 45").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    places = l.groupBy(F.concat_ws("_", "p_brand", F.col("l_partkey").cast("string")).alias("orf")).agg(F.min("l_orderkey").alias("start"), F.max("l_orderkey").alias("end"), F.lit("+").alias("strand"))
    lengths = table(spark, d, "part").where("p_size > 40 and p_brand not like '%5'").groupBy(F.col("p_brand").alias("contig")).agg(F.count(F.lit(1)).alias("length"))
    found, missed = ch.located(p, places, lengths)
    return found.select("orf", "start", "end", "contig_length", F.lit("").alias("missing")).unionByName(missed.select("orf", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("long").alias("contig_length"), "missing"))


def systems(spark: SparkSession, d: str) -> DataFrame:
    """AGG25-26, AUX36, 39: accessions of genomes as systems, special ones apart, per group of genomes."""
    rows = table(spark, d, "parsed_cds").where("genome_id is not null and pfam_id is not null").select(F.substring("genome_id", -1, 1).alias("grp"), "genome_id", F.upper("pfam_id").alias("pfam_id"))
    return ch.split_systems(rows, "grp", "genome_id", "pfam_id", "^pf[0-9]*[0-4]0")


def compartments(spark: SparkSession, d: str) -> DataFrame:
    """AGG37, INT6-7: lengths of a contig under purchases, under all spans and free, and views by the span that owns them."""
    x = loci(spark, d)
    spans = x.where("kind in ('purchase', 'signup')").select("contig", "kind", F.col("start"), F.col("end"))
    views = x.where("kind = 'view'").select("contig", "key", midpoint(F.col("start"), F.col("end")).alias("mid"))
    owned = point_owner(views, spans.select("contig", F.col("kind").alias("owner"), F.col("start").alias("s"), F.col("end").alias("e")), ["contig"], "mid", ("s", "e"), [F.asc_nulls_last("owner"), F.col("s"), F.col("e")], ["key"])
    total = x.select("contig").distinct().withColumn("length", F.lit(2_678_400).cast("long"))
    return ch.compartments(spans, owned, "contig", "purchase", total).select("contig", "len_first", "len_all", "len_rest", "n_points", "n_first", "n_other", "n_rest")


def picks(spark: SparkSession, d: str) -> DataFrame:
    """AUX26-28, SET9, JN32, SCL12: one order a customer, urgent ones first, with the nation's name; customers without orders as stubs."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"), "o_totalprice")
    one = ch.preferred(o, ["key"], "urgent", [F.desc("o_totalprice"), F.col("o_orderkey")]).select("key", "o_orderkey", "urgent")
    every = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("n_nationkey"))
    rows = ch.with_stubs(one, every, "key", {"o_orderkey": F.lit(None).cast("long"), "urgent": F.lit(False)})
    names = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select("n_nationkey", "n_name")
    return ch.described(rows.join(every, "key"), names, "n_nationkey", "n_name").select("key", F.col("o_orderkey").cast("long").alias("o_orderkey"), "urgent", "n_name")


def triples(spark: SparkSession, d: str) -> DataFrame:
    """INT12-13, CLS21-22, AUX15-17: contigs with a view, a purchase and an error in this order within five loci of one another; three-way test of names."""
    from pyspark.sql import Window

    x = loci(spark, d).withColumn("idx", F.row_number().over(Window.partitionBy("contig").orderBy("start", "key")))
    t = ch.ordered_triple(x, "contig", "idx", F.col("kind") == "signup", F.col("kind") == "purchase", F.col("kind") == "error", 5)
    u = x.groupBy("contig").agg(F.array_join(F.array_sort(F.collect_set("kind")), " ").alias("kinds"))
    flags = ch.tests_of(F.col("kinds"), {"pays": ["PURCHASE", "refund"], "fails": ["error"]})
    return t.join(u, "contig").select("contig", "found", ch.three_way(F.col("kinds"), "refund", "error", "view|click").alias("meant"), *[c.alias(n) for n, c in flags.items()])


def lists(spark: SparkSession, d: str) -> DataFrame:
    """AGG6, WIN14-15, 18-19: lengths of each sample's genes ranked by number, the label at the first rank of a group only."""
    rows = table(spark, d, "parsed_cds").where("genome_id is not null and locus_tag is not null and cds_start is not null and cds_end is not null").select("genome_id", "locus_tag", "cds_start", "cds_end").distinct()
    n = ch.lengths_by(rows, "genome_id", F.col("cds_start"), F.col("cds_end")).withColumn("grp", F.substring("genome_id", -2, 2)).withColumn("label", F.concat(F.lit("group "), F.col("grp")))
    return ch.shown_once(n, "grp", "label", [F.desc("n"), F.desc("total"), F.col("genome_id")]).select("genome_id", "n", "total", F.md5("lengths").alias("lengths"), "label", "rank")


QUERIES = {"jn2_located": located, "agg26_systems": systems, "agg37_compartments": compartments, "aux26_picks": picks, "int12_triples": triples, "agg6_lengths": lists}
_UNION = lambda name, where: f"""{name}o AS (SELECT contig, start, "end", max("end") OVER (PARTITION BY contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM loci WHERE {where} AND "end" >= start),
  {name}g AS (SELECT *, sum(CASE WHEN r IS NULL OR start > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM {name}o), {name} AS (SELECT contig, sum(e - s + 1)::BIGINT AS n FROM (SELECT contig, i, min(start) AS s, max("end") AS e FROM {name}g GROUP BY 1, 2) GROUP BY 1)"""  # noqa: E731
ORACLE = {
    "jn2_located": """WITH p AS (SELECT p_brand || '_' || p_partkey AS orf, p_brand AS contig FROM part), l AS (SELECT p_brand || '_' || l_partkey AS orf, min(l_orderkey) AS start, max(l_orderkey) AS "end" FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45 GROUP BY 1),
  c AS (SELECT p_brand AS contig, count(*) AS length FROM part WHERE p_size > 40 AND p_brand NOT LIKE '%5' GROUP BY 1), r AS (SELECT p.orf, start, "end", length, CASE WHEN start IS NULL THEN 'no coordinates' WHEN length IS NULL THEN 'no contig length' ELSE '' END AS missing FROM p LEFT JOIN l USING (orf) LEFT JOIN c USING (contig))
SELECT orf, CASE WHEN missing = '' THEN start END AS start, CASE WHEN missing = '' THEN "end" END AS "end", CASE WHEN missing = '' THEN length END AS contig_length, missing FROM r""",
    "agg26_systems": r"""WITH x AS (SELECT DISTINCT right(genome_id, 1) AS grp, genome_id, unnest(regexp_split_to_array(upper(pfam_id), '[|;,\s]+')) AS s FROM parsed_cds WHERE genome_id IS NOT NULL AND pfam_id IS NOT NULL),
  y AS (SELECT *, regexp_matches(lower(s), '^pf[0-9]*[0-4]0') AS z FROM x WHERE s <> ''), n AS (SELECT grp, s, z, count(*) AS n FROM y GROUP BY ALL),
  a AS (SELECT grp, s AS top_special FROM n WHERE z QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, s) = 1), b AS (SELECT grp, s AS top_other FROM n WHERE NOT z QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, s) = 1)
SELECT y.grp, count(DISTINCT CASE WHEN z THEN genome_id END) AS n_special, count(DISTINCT CASE WHEN NOT z THEN genome_id END) AS n_other, sum(z::INT)::BIGINT AS rows_special, sum((NOT z)::INT)::BIGINT AS rows_other, any_value(top_special) AS top_special, any_value(top_other) AS top_other
  FROM y LEFT JOIN a ON a.grp = y.grp LEFT JOIN b ON b.grp = y.grp GROUP BY 1""",
    "agg37_compartments": f"""WITH {LOCI}, {_UNION("f", "kind = 'purchase'")}, {_UNION("u", "kind IN ('purchase', 'signup')")},
  v AS (SELECT v.contig, v.key, s.kind AS owner FROM loci v LEFT JOIN loci s ON s.contig = v.contig AND s.kind IN ('purchase', 'signup') AND (v.start + v."end") // 2 BETWEEN s.start AND s."end" WHERE v.kind = 'view' QUALIFY row_number() OVER (PARTITION BY v.key ORDER BY s.kind NULLS LAST) = 1),
  c AS (SELECT contig, count(*) AS n_points, sum(coalesce(owner = 'purchase', false)::INT)::BIGINT AS n_first, sum(coalesce(owner <> 'purchase', false)::INT)::BIGINT AS n_other FROM v GROUP BY 1)
SELECT t.contig, coalesce(f.n, 0) AS len_first, coalesce(u.n, 0) AS len_all, greatest(0, 2678400 - coalesce(u.n, 0)) AS len_rest, coalesce(n_points, 0) AS n_points, coalesce(n_first, 0) AS n_first, coalesce(n_other, 0) AS n_other, greatest(0, coalesce(n_points - n_first - n_other, 0)) AS n_rest
  FROM (SELECT DISTINCT contig FROM loci) t LEFT JOIN f USING (contig) LEFT JOIN u USING (contig) LEFT JOIN c USING (contig)""",
    "aux26_picks": """WITH o AS (SELECT o_custkey AS key, o_orderkey, o_orderpriority = '1-URGENT' AS urgent FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT' DESC, o_totalprice DESC, o_orderkey) = 1)
SELECT c_custkey AS key, o_orderkey, coalesce(urgent, false) AS urgent, CASE WHEN c_nationkey % 5 <> 0 THEN n_name ELSE c_nationkey::VARCHAR END AS n_name FROM customer LEFT JOIN o ON o.key = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "int12_triples": f"""WITH {LOCI}, x AS (SELECT contig, kind, row_number() OVER (PARTITION BY contig ORDER BY start, key) AS i FROM loci), u AS (SELECT contig, bool_or(kind = 'error') AS fails, bool_or(kind IN ('purchase', 'refund')) AS pays, bool_or(kind = 'refund') AS r, bool_or(kind IN ('view', 'click')) AS v FROM x GROUP BY 1)
SELECT contig, EXISTS (SELECT 1 FROM x a JOIN x b ON b.contig = a.contig AND b.i - a.i BETWEEN 1 AND 5 JOIN x c ON c.contig = b.contig AND c.i - b.i BETWEEN 1 AND 5 WHERE a.contig = u.contig AND a.kind = 'signup' AND b.kind = 'purchase' AND c.kind = 'error') AS found,
  CASE WHEN r THEN true WHEN fails THEN false ELSE v END AS meant, pays, fails FROM u""",
    "agg6_lengths": """WITH r AS (SELECT DISTINCT genome_id, locus_tag, abs(cds_end - cds_start) + 1 AS n FROM parsed_cds WHERE genome_id IS NOT NULL AND locus_tag IS NOT NULL AND cds_start IS NOT NULL AND cds_end IS NOT NULL), g AS (SELECT genome_id, count(*) AS n, sum(n)::BIGINT AS total, md5(string_agg(n::VARCHAR, ',' ORDER BY n)) AS lengths FROM r GROUP BY 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY right(genome_id, 2) ORDER BY n DESC, total DESC, genome_id) AS rank FROM g) SELECT genome_id, n, total, lengths, CASE WHEN rank = 1 THEN 'group ' || right(genome_id, 2) ELSE '' END AS label, rank::INT AS rank FROM k""",
}
