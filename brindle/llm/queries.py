"""Queries of the problems tagged llm, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fractions import Fraction

from brindle.llm import bpe, cf, knn, leakage, qdigest, setjoin, spelling, topn, truncation
from brindle.session import table


# ---- 2 and 4: features of the unknown elements ---------------------------------------------------------------
def matrix_rows(spark: SparkSession, d: str) -> DataFrame:
    """(ie_id, key): the matrix rows of the unknown elements; repeated deliveries count once."""
    return table(spark, d, "ie_rep_rows_c6960_unk").where("ie_id is not null and matrix_row is not null").select("ie_id", F.col("matrix_row").alias("key")).distinct()


def feature_sets(spark: SparkSession, d: str) -> DataFrame:
    """(key, tokens) of each unknown element; sets are built by matrix row, before the long names come in."""
    rows = table(spark, d, "feature_long").where("feat_value > 0 and not isnan(feat_value)").select("row_id", "feature_id")
    return setjoin.sets(rows, "row_id", "feature_id", 5).join(matrix_rows(spark, d), "key").select(F.col("ie_id").alias("key"), "tokens")


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """(ie_id, other, similarity): the at most 5 most similar others of each element, from 0.85 upwards."""
    rows = table(spark, d, "feature_long").where("row_id is not null").select("row_id", "feature_id", "feat_value")
    names = matrix_rows(spark, d).select("key", F.col("ie_id").alias("name"))
    return knn.neighbours_of(knn.vectors(rows, "row_id", "feature_id", "feat_value", 5), 5, 0.85, names).withColumnRenamed("key", "ie_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = p2_neighbours(spark, d)
    return pairs.select(F.least("ie_id", "other").alias("ie_a"), F.greatest("ie_id", "other").alias("ie_b")).distinct()


# ---- 3: similar genomes --------------------------------------------------------------------------------------
def accessions(spark: SparkSession, d: str) -> DataFrame:
    """(genome_id, acc): the Pfam accessions of each genome, upper case and without version."""
    rows = table(spark, d, "parsed_cds").where("genome_id is not null and pfam_id is not null").select("genome_id", "pfam_id").distinct()
    acc = F.regexp_replace(F.upper(F.regexp_replace("x", r"(?U)^\s+|\s+$", "")), r"\.\d+$", "")
    out = rows.select("genome_id", F.explode(F.split("pfam_id", "[|,;]")).alias("x")).select("genome_id", acc.alias("acc"))
    return out.where(~F.col("acc").isin("", "-", "NAN"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.similar_pairs(accessions(spark, d), "genome_id", "acc", Fraction(3, 4), 6).select(F.col("a").alias("genome_a"), F.col("b").alias("genome_b"))


P3 = r"""WITH a AS (SELECT DISTINCT genome_id AS g, regexp_replace(upper(regexp_replace(x, '^\s+|\s+$', '', 'g')), '\.\d+$', '') AS t
    FROM (SELECT genome_id, unnest(regexp_split_to_array(pfam_id, '[|,;]')) AS x FROM parsed_cds WHERE genome_id IS NOT NULL)),
  s AS (SELECT g, t FROM a WHERE t NOT IN ('', '-', 'NAN')),
  k AS (SELECT g, count(*) AS n FROM s GROUP BY g HAVING count(*) >= 6),
  o AS (SELECT x.g AS ga, y.g AS gb, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.g < y.g GROUP BY ALL)
SELECT ga AS genome_a, gb AS genome_b FROM o JOIN k p ON p.g = ga JOIN k q ON q.g = gb WHERE 4 * c >= 3 * (p.n + q.n - c)"""


# ---- 4: clusters ---------------------------------------------------------------------------------------------
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cf.cluster_members(feature_sets(spark, d), Fraction(3, 5)).select(F.col("key").alias("ie_id"), "cluster_key")


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """(cluster_key, size, n_distinct, typical): size, distinct feature sets and the three most typical members, joined by blanks."""
    return cf.cluster_profiles(feature_sets(spark, d), Fraction(3, 5)).withColumn("typical", F.array_join("typical", " "))


_P4 = """WITH RECURSIVE v AS (SELECT DISTINCT r.ie_id AS i, f.feature_id AS t FROM ie_rep_rows_c6960_unk r JOIN feature_long f ON f.row_id = r.matrix_row
    WHERE f.feat_value > 0 AND NOT isnan(f.feat_value) AND r.ie_id IS NOT NULL AND f.feature_id IS NOT NULL),
  k AS (SELECT i, count(*) AS n FROM v GROUP BY i HAVING count(*) >= 5),
  o AS (SELECT x.i AS a, y.i AS b, count(*) AS c FROM v x JOIN v y ON x.t = y.t AND x.i <> y.i GROUP BY ALL),
  e AS MATERIALIZED (SELECT a, b FROM o JOIN k p ON p.i = a JOIN k q ON q.i = b WHERE 5 * c >= 3 * (p.n + q.n - c)),
  w(i, j) AS (SELECT a, a FROM e UNION SELECT w.i, e.b FROM w JOIN e ON e.a = w.j)"""
P4 = f"{_P4} SELECT i AS ie_id, min(j) AS cluster_key FROM w GROUP BY i"
P4_CLUSTERS = f"""{_P4}, m AS (SELECT i, min(j) AS cluster_key FROM w GROUP BY i),
  s AS (SELECT i, list(t ORDER BY t) AS ts FROM v JOIN k USING (i) GROUP BY i),
  g AS (SELECT cluster_key, min(i) AS name, count(*) AS n, ts FROM m JOIN s USING (i) GROUP BY cluster_key, ts),
  l AS (SELECT cluster_key, name, n, len(ts) AS size, unnest(ts) AS t FROM g), c AS (SELECT cluster_key, t, sum(n) AS c FROM l GROUP BY ALL),
  r AS (SELECT cluster_key, name, round(sum(c) / sqrt(size), 6) AS score FROM l JOIN c USING (cluster_key, t) GROUP BY cluster_key, name, size),
  p AS (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY score DESC, name) AS q FROM r)
SELECT cluster_key, size, n_distinct, typical FROM (SELECT cluster_key, sum(n)::BIGINT AS size, count(*) AS n_distinct FROM g GROUP BY 1) JOIN (SELECT cluster_key, string_agg(name, ' ' ORDER BY q) AS typical FROM p WHERE q <= 3 GROUP BY 1) USING (cluster_key)"""

# ---- 5: percentiles ------------------------------------------------------------------------------------------
Q = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def p5_digests(spark: SparkSession, d: str) -> DataFrame:
    """The compressed digest of each measure, group and day."""
    parts = (("cohort_6960_atlas_join", "gtdb_phylum", "integrase_len_aa", "joined_at", False), ("ie_instance_classification", "primary_label", "ie_core_score", "classified_at", True), ("cluster_biology_summary", "leiden_cluster", "ie_len_med", "built_at", False))
    out = None
    for name, group, value, day, zero in parts:
        df = table(spark, d, name).select(F.lit(f"{name}.{value}").alias("measure"), F.col(group).cast("string").alias("grp"), F.col(value).alias("value"), F.col(day).alias("at"))
        one = qdigest.digests(df, ["measure", "grp"], "value", "at", zero_counts=zero)
        out = one if out is None else out.unionByName(one)
    return out


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return qdigest.percentiles(p5_digests(spark, d), ["measure", "grp"], Q)


# ---- 6: names ------------------------------------------------------------------------------------------------
def _named(spark: SparkSession, d: str) -> DataFrame:
    return spelling.canonical(table(spark, d, "parsed_cds"), "locus_tag", "product", table(spark, d, "product_catalog"), "product_id", "canonical_name")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("locus_tag", "product_id").distinct()


def p6_misses(spark: SparkSession, d: str) -> DataFrame:
    """(product, n): names that mean no entry, and how many loci bear them."""
    return _named(spark, d).where("product_id = -1").distinct().groupBy("product").agg(F.count(F.lit(1)).alias("n"))


# ---- 7: top N ------------------------------------------------------------------------------------------------
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "cluster_pfam_markers_c6960_unk").where("leiden_cluster <> -1")
    return topn.top_n(df, "leiden_cluster", "feature_id", "marker_score", 10).select("leiden_cluster", "feature_id")


P7 = """WITH best AS (SELECT leiden_cluster, feature_id, max(marker_score) AS s FROM cluster_pfam_markers_c6960_unk
  WHERE marker_score IS NOT NULL AND NOT isnan(marker_score) AND leiden_cluster <> -1 AND feature_id IS NOT NULL GROUP BY ALL)
SELECT leiden_cluster, feature_id FROM best QUALIFY row_number() OVER (PARTITION BY leiden_cluster ORDER BY s DESC, feature_id) <= 10"""


# ---- 8: tokens -----------------------------------------------------------------------------------------------
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text")


# ---- 9: leakage ----------------------------------------------------------------------------------------------
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


# ---- 10: truncation ------------------------------------------------------------------------------------------
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_texts(table(spark, d, "documents"))


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.report(table(spark, d, "documents"))


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours, "p3_found": p3_found, "p4_found": p4_found, "p4_clusters": p4_clusters, "p5_percentiles": p5_percentiles, "p5_digests": p5_digests, "p6_found": p6_found, "p6_misses": p6_misses, "p7_found": p7_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_spans": p9_spans, "p10_found": p10_found, "p10_report": p10_report}
ORACLE = {"p3_found": P3, "p4_found": P4, "p4_clusters": P4_CLUSTERS, "p7_found": P7}
