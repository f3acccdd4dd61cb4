"""Scalar formats over customers, parts and orders, and regions over ``events`` as hits and tRNAs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import formats as f
from brindle.operators import regions as rg
from brindle.plans.loci import LOCI, loci
from brindle.session import table


def texts(spark: SparkSession, d: str) -> DataFrame:
    """SCL4-5, 10, 12, 15, 20-24, 26-27, 30-32, 36: identifiers and numbers as text, over parts."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.col("p_retailprice").cast("double").alias("price"))
    key = F.col("p_partkey")
    header = F.concat_ws(" ", F.concat(F.lit("P#"), key.cast("string")), F.col("p_name"), F.when(key % 2 == 0, F.concat(F.lit("sample=S_"), F.col("p_size").cast("string"), F.lit("|x"))).otherwise(F.lit("last;")))
    name = F.when(key % 5 == 0, F.concat(F.lit("uncultured f__"), "p_name")).when(key % 7 == 0, F.substring_index("p_name", " ", 1)).otherwise(F.col("p_name"))
    place = F.concat(F.lit("join("), key.cast("string"), F.lit(".."), (key + F.col("p_size")).cast("string"), F.lit(",5..9)"))
    place = F.when(key % 2 == 0, F.concat(F.lit("complement("), place, F.lit(")"))).otherwise(place)
    product = F.when(key % 3 == 0, "Hypothetical protein").when(key % 3 == 1, F.concat("p_type", F.lit(" domain-containing protein"))).otherwise(F.col("p_type"))
    loc, org = f.location(place), f.organism(name)
    return p.select(
        key.alias("key"), f.capped(F.col("p_name"), 20).alias("capped"), f.int_text(F.col("price")).alias("whole"), f.int_text(F.col("p_brand")).alias("kept"), f.cluster_text(F.concat(F.col("p_size").cast("string"), F.lit(".0"))).alias("cluster"),
        f.cluster_number((F.col("p_size") - 20).cast("string")).alias("number"), f.attribute_name(F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_brand")).alias("attr"), f.query_id(F.col("p_brand"), F.col("p_type"), key, key + F.col("p_size"), F.lit("+")).alias("query"),
        f.element_of_query(F.concat("p_brand", F.lit(":1-2:-"))).alias("element"), f.member_id(F.col("p_brand"), F.col("p_type")).alias("member"), org["genus"].alias("genus"), org["species"].alias("species"), f.product_name(product).alias("product"),
        f.unknown_family(F.col("p_name"), F.concat(F.lit("x DUF"), F.col("p_size").cast("string"))).alias("duf"), loc["start"].alias("lo"), loc["end"].alias("hi"), loc["strand"].alias("strand"), f.header_sample(header).alias("sample"), f.safe_text(header).alias("safe"),
        f.dbxref_families(F.concat(F.lit("GO:1, PFAM:PF"), F.lpad(F.col("p_size").cast("string"), 5, "0"), F.lit(".3,pf00001"))).alias("pfam"), f.system_token(F.col("p_brand"), F.when(key % 2 == 0, F.col("p_size")), F.lit(None).cast("string")).alias("token"),
    )


def visuals(spark: SparkSession, d: str) -> DataFrame:
    """SCL33-35, CLS48, AUX33: edges between suppliers and parts with visual attributes, folds as text."""
    e = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_tax").groupBy("l_suppkey").agg(F.avg(F.col("l_quantity").cast("double")).alias("q"), F.avg(F.col("l_discount").cast("double")).alias("dc"), F.count(F.lit(1)).alias("n"))
    most = e.agg(F.max("n").alias("most"))
    e = e.crossJoin(F.broadcast(most))  # one row
    z, fold, p = F.col("q") - 24, F.col("n") / 10.0, F.pow(F.lit(10.0), -F.col("n") % 40)
    v = f.edge_visuals(z, fold, p) | f.node_visuals(F.col("n").cast("double"), F.col("most").cast("double"))
    sig = f.edge_significance(F.when(F.col("l_suppkey") % 3 == 0, "core"), F.when(F.col("l_suppkey") % 2 == 0, 0.5), p)
    return e.select("l_suppkey", *[(F.floor(c).cast("double") if k == "edge_strength" else F.round(c, 2)).alias(k) for k, c in v.items() if k not in ("node_area", "edge_opacity")], sig.alias("significance"), f.fold_text(F.floor(fold).cast("double")).alias("fold"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    """FLT10, JN9-10, INT10: regions between the last hit of a contig and each tRNA, with turned local coordinates."""
    x = loci(spark, d)
    hits = x.where("kind = 'view'").groupBy(F.col("contig").alias("key")).agg(F.max("end").alias("hit_end")).withColumn("contig", F.col("key").cast("string"))
    trna = x.where("kind = 'purchase'").select(F.col("contig").alias("key"), F.col("start").alias("trna_start"), F.col("end").alias("trna_end"), F.col("strand").alias("trna_strand"))
    r = rg.element_regions(hits, trna).where("end >= start")
    r = r.withColumn("seq", F.repeat(F.lit("ACGTTG"), (F.pmod(F.col("end") - F.col("start"), F.lit(17)) + 5).cast("int")))
    r = r.withColumns({"trna_len": F.lit(7), "att_len": F.lit(5), "int_start": F.col("start") + 3, "int_end": F.col("start") + 12})
    out = rg.oriented(r)
    return out.select(rg.region_id(F.col("key").cast("string"), F.col("contig"), F.col("start"), F.col("end")).alias("id"), "trna_strand", F.substring("seq", 1, 9).alias("head"), "attl_start0", "attl_end0", "attr_start0", "attr_end0", "int_start0", "int_end0", "int_strand")


_ORG = """CASE WHEN contains(lower(nm), 'uncultured') AND n >= 2 THEN regexp_replace(CASE WHEN lower(w[1]) = 'uncultured' THEN w[2] ELSE w[1] END, '^f__', '') WHEN n >= 2 THEN regexp_replace(w[1], '^f__', '') WHEN n = 1 THEN w[1] ELSE 'Unknown' END AS genus,
  CASE WHEN contains(lower(nm), 'uncultured') AND n >= 2 THEN CASE WHEN n > 2 THEN array_to_string(w[3:], ' ') ELSE 'bacterium' END WHEN n >= 3 THEN w[2] || ' ' || w[3] WHEN n = 2 THEN w[2] WHEN n = 1 THEN 'sp.' ELSE nm END AS species"""
QUERIES = {"scl_texts": texts, "scl33_visuals": visuals, "flt10_regions": regions}
ORACLE = {
    "scl_texts": rf"""WITH b AS (SELECT p_partkey AS key, p_name, p_brand, p_type, p_size, p_retailprice::DOUBLE AS price,
    'P#' || p_partkey || ' ' || p_name || ' ' || CASE WHEN p_partkey % 2 = 0 THEN 'sample=S_' || p_size || '|x' ELSE 'last;' END AS header,
    CASE WHEN p_partkey % 5 = 0 THEN 'uncultured f__' || p_name WHEN p_partkey % 7 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS nm,
    CASE WHEN p_partkey % 3 = 0 THEN 'Hypothetical protein' WHEN p_partkey % 3 = 1 THEN p_type || ' domain-containing protein' ELSE p_type END AS product FROM part),
  w AS (SELECT *, list_filter(regexp_split_to_array(trim(nm), '\s+'), lambda x: x <> '') AS w, len(list_filter(regexp_split_to_array(trim(nm), '\s+'), lambda x: x <> '')) AS n FROM b)
SELECT key, CASE WHEN length(p_name) > 20 THEN left(p_name, 19) || '…' ELSE p_name END AS capped, (trunc(price)::BIGINT)::VARCHAR AS whole, p_brand AS kept, p_size::VARCHAR AS cluster, CASE WHEN p_size >= 20 THEN (p_size - 20)::INT END AS number,
  '_' || p_size || '_' || replace(p_brand, '#', '_') AS attr, p_brand || ':' || p_type || ':' || key || '-' || (key + p_size) || ':+' AS query, p_brand || ':1-2' AS element, p_brand || '|sample=' || p_type AS member, {_ORG},
  CASE WHEN product = 'Hypothetical protein' THEN '' ELSE replace(lower(product), 'domain-containing protein', 'domain protein') END AS product, 'DUF' || p_size AS duf, least(key, 5) AS lo, greatest(key + p_size, 9) AS hi,
  CASE WHEN key % 2 = 0 THEN '-' ELSE '+' END AS strand, CASE WHEN key % 2 = 0 THEN 'S_' || p_size ELSE 'last' END AS sample, regexp_replace(header, '[^A-Za-z0-9|_.\-]', '', 'g') AS safe, 'PF' || lpad(p_size::VARCHAR, 5, '0') || '.3,pf00001' AS pfam,
  CASE WHEN key % 2 = 0 THEN p_brand || ' (' || p_size || ' IE)' ELSE p_brand END AS token FROM w""",
    "scl33_visuals": """WITH e AS (SELECT l_suppkey, avg(l_quantity::DOUBLE) AS q, count(*) AS n FROM lineitem GROUP BY 1), x AS (SELECT *, q - 24 AS z, n / 10.0::DOUBLE AS fold, pow(10.0::DOUBLE, -n % 40) AS p, n / max(n) OVER ()::DOUBLE AS share FROM e)
SELECT l_suppkey, round(greatest(0.0, least(z, 25.0)), 2) AS edge_width, floor(round_even(greatest(0.0, least(z, 25.0)) * 0.6 + fold * 4.0, 3)) AS edge_strength, round(round_even(sqrt(share) * 196 + 24, 2), 2) AS node_size, round(round_even(share * 1750 + 250, 1), 2) AS node_points,
  CASE WHEN l_suppkey % 3 = 0 THEN 'core' WHEN p <= 0.05 THEN 'mixing-significant' ELSE 'ns' END AS significance,
  CASE WHEN floor(fold) >= 100 THEN printf('%.0f', floor(fold)) WHEN floor(fold) >= 10 THEN printf('%.1f', floor(fold)) ELSE printf('%.2f', floor(fold)) END AS fold FROM x""",
    "flt10_regions": f"""WITH {LOCI}, h AS (SELECT contig, max("end") AS hit_end FROM loci WHERE kind = 'view' GROUP BY 1),
  r AS (SELECT t.contig, t.strand, CASE WHEN t.strand = '+' THEN t.start ELSE hit_end END AS a, CASE WHEN t.strand = '+' THEN hit_end ELSE t."end" END AS b FROM loci t JOIN h ON h.contig = t.contig WHERE t.kind = 'purchase'),
  s AS (SELECT *, repeat('ACGTTG', ((b - a) % 17 + 5)::INT) AS seq FROM r WHERE b >= a)
SELECT contig || ':' || contig || ':' || a || '-' || b AS id, strand AS trna_strand, left(CASE WHEN strand = '+' THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END, 9) AS head, CASE WHEN strand = '+' THEN length(seq) - 5 ELSE 0 END AS attl_start0, CASE WHEN strand = '+' THEN length(seq) ELSE 5 END AS attl_end0,
  CASE WHEN strand = '+' THEN 0 ELSE length(seq) - 7 END AS attr_start0, CASE WHEN strand = '+' THEN 7 ELSE length(seq) END AS attr_end0, CASE WHEN strand = '+' THEN length(seq) - 12 ELSE 3 END AS int_start0, CASE WHEN strand = '+' THEN length(seq) - 3 ELSE 12 END AS int_end0, CASE WHEN strand = '+' THEN -1 ELSE 1 END AS int_strand FROM s""",
}
