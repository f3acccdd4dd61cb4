"""Clusters of the unknown elements with markers, roles, scores and hosts, over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import overview as ov
from brindle.session import table

ROLES = [("recomb|inttra|xer", "integrase"), ("hth|reg", "regulator"), ("dna|hel", "replication"), ("trans|permease", "transport"), ("lys", "lysis")]
MANUAL = {"PF80857": "curated"}
TYROSINE = ("XM90017", "XM90107")


def members(spark: SparkSession, d: str) -> DataFrame:
    """(cluster, integrase_id): one cluster an element, of several the smallest; noise is left out."""
    rows = table(spark, d, "leiden_clusters_c6960_unk").where("leiden_cluster >= 0 and integrase_id is not null")
    return rows.groupBy("integrase_id").agg(F.min("leiden_cluster").alias("cluster")).select("cluster", "integrase_id")


def attributes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ie_rep_rows_c6960_unk").where("integrase_id is not null")
    return rows.groupBy("integrase_id").agg(F.min("matrix_row").alias("matrix_row"), F.max("ie_core_score").alias("core"), F.max("ie_len_nt").alias("len"), F.min("phylum").alias("phylum"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """AGG24, 27, 28, AUX32, CLS49: members, medians, classes of recombinases and hosts per cluster."""
    m = members(spark, d).join(attributes(spark, d), "integrase_id", "left")
    c = table(spark, d, "cohort_6960_atlas_join").where("integrase_id is not null").groupBy("integrase_id").agg(F.min("integrase_model").alias("model"))
    m = m.join(c, "integrase_id", "left").withColumn("kind", ov.recombinase(F.col("model"), TYROSINE, ("XM90",)))
    ok = F.when(~F.isnan("core"), F.col("core"))
    count = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).cast("long")
    return m.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.median(ok), 6).alias("core_med"), F.floor(F.median("len")).cast("long").alias("len_med"), count("tyrosine").alias("n_tyrosine"), count("serine").alias("n_serine"), F.count("kind").alias("n_known"))


def _markers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cluster_pfam_markers_c6960_unk").where("leiden_cluster >= 0 and feature_id is not null and marker_score is not null and not isnan(marker_score)")
    r = ov.role(F.col("pfam_acc"), F.lit(None).cast("string"), F.col("short_name"), MANUAL, {}, ROLES)
    rows = rows.groupBy(F.col("leiden_cluster").alias("cluster"), "feature_id").agg(F.max("marker_score").alias("score"), F.min("short_name").alias("short_name"), F.min("pfam_acc").alias("pfam_acc"), F.max("count_in").alias("count_in"))
    return rows.withColumn("role", r)


def overlay(spark: SparkSession, d: str) -> DataFrame:
    """JN26, 28, CLS45-47, AUX30, 35, 37-40, WIN15: every cluster with its markers, roles, host and last summary, one row each."""
    m, marks = members(spark, d), _markers(spark, d)
    top = ov.top_text(marks, "cluster", "feature_id", F.col("score"), 3, out="markers", show=F.concat(F.coalesce("short_name", F.lit("?")), F.lit("="), F.format_string("%.3f", F.bround("score", 3))))
    ranked = marks.withColumn("minus", -F.col("score"))
    roles = ov.seen_first(ranked, "cluster", "role", ["minus", "feature_id"], 3, "roles")
    by_role = marks.where("role <> 'other'").groupBy("cluster", "role").agg(F.sum("count_in").alias("w"))
    best = ov.top_text(by_role, "cluster", "role", F.col("w"), 1, out="top_role")
    hosts = m.join(attributes(spark, d), "integrase_id").where("phylum is not null and trim(phylum) not in ('', 'nan')").groupBy("cluster", "phylum").agg(F.count(F.lit(1)).alias("n"))
    host = ov.top_text(hosts, "cluster", "phylum", F.col("n"), 2, out="hosts", show=F.concat("phylum", F.lit(" ("), F.col("n").cast("string"), F.lit(")")))
    b = table(spark, d, "cluster_biology_summary").where("leiden_cluster is not null").groupBy(F.col("leiden_cluster").alias("cluster")).agg(F.max("build_no").alias("last_build"), F.count_distinct("build_no").alias("n_builds"))
    size = m.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit("")
    return ov.overlay_all(size, "cluster", [(top, {"markers": none}), (roles, {"roles": none}), (best, {"top_role": none}), (host, {"hosts": none}), (b, {"n_builds": F.lit(0)})])


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """JN12, 27, 30, SET9: every unknown element with its last classification, cohort row and cluster, and what was looked at."""
    e = table(spark, d, "ie_rep_rows_c6960_unk").where("ie_id is not null").groupBy("ie_id").agg(F.min("integrase_id").alias("integrase_id"))
    cls = table(spark, d, "ie_instance_classification").where("element_id is not null").groupBy(F.trim(F.regexp_replace("element_id", r"\|sample=.*$", "")).alias("ie_id"))
    cls = cls.agg(F.max_by("primary_label", F.struct("classified_at", "loaded_at", "primary_label")).alias("label"), F.count(F.lit(1)).alias("n_rows"))
    coh = table(spark, d, "cohort_6960_atlas_join").where("integrase_id is not null").groupBy("integrase_id").agg(F.min("gtdb_phylum").alias("gtdb"))
    rows = ov.overlay_all(e, "ie_id", [(cls, {"n_rows": F.lit(0)})])
    rows = ov.overlay_all(rows, "integrase_id", [(coh, {}), (members(spark, d), {})])
    return rows.select("ie_id", F.coalesce("label", F.lit("")).alias("label"), "n_rows", F.coalesce("gtdb", F.lit("")).alias("gtdb"), F.coalesce("cluster", F.lit(-1)).alias("cluster"), ov.status(F.col("n_rows") > 0, F.col("gtdb").isNotNull()).alias("status"))


def composition(spark: SparkSession, d: str) -> DataFrame:
    """AGG21, GRF19, AUX44: share and mean of roles per cluster, of the greater of feature hits and of the element's label."""
    m = members(spark, d).join(attributes(spark, d).where("matrix_row is not null"), "integrase_id").select("cluster", "integrase_id", "matrix_row")
    f = table(spark, d, "feature_long").where("feat_value > 0 and not isnan(feat_value) and feature_id is not null")
    r = ov.role(F.lit(None).cast("string"), F.lit(None).cast("string"), F.substring("feature_id", -1, 1), {}, {}, [("[0-2]", "low"), ("[3-6]", "mid"), ("[7-9]", "high")])
    hits = f.select(F.col("row_id").alias("matrix_row"), "feature_id").distinct().withColumn("role", r).groupBy("matrix_row", "role").agg(F.count(F.lit(1)).alias("n"))
    hits = hits.join(m.select("matrix_row", "integrase_id"), "matrix_row").select("integrase_id", "role", "n")
    told = attributes(spark, d).select("integrase_id", F.lit("low").alias("role"), F.when(F.col("core") > 0.5, 4).otherwise(0).alias("n"))
    out = ov.presence(m, [hits, told], "cluster", "integrase_id", "role")
    return out.select("cluster", "role", "n_with", "n_members", F.round("share", 6).alias("share"), F.round("mean", 6).alias("mean"))


_M = "m AS (SELECT min(leiden_cluster) AS cluster, integrase_id FROM leiden_clusters_c6960_unk WHERE leiden_cluster >= 0 AND integrase_id IS NOT NULL GROUP BY integrase_id)"
_A = "a AS (SELECT integrase_id, min(matrix_row) AS matrix_row, max(ie_core_score) AS core, max(ie_len_nt) AS len, min(phylum) AS phylum FROM ie_rep_rows_c6960_unk WHERE integrase_id IS NOT NULL GROUP BY 1)"
_ROLE = lambda c, rules: "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{p}') THEN '{r}'" for p, r in rules) + " ELSE 'other' END"
QUERIES = {"agg27_cluster_scores": scores, "jn28_cluster_overlay": overlay, "jn27_node_overlay": nodes, "agg21_presence": composition}
ORACLE = {
    "agg27_cluster_scores": f"""WITH {_M}, {_A}, c AS (SELECT integrase_id, min(integrase_model) AS model FROM cohort_6960_atlas_join WHERE integrase_id IS NOT NULL GROUP BY 1),
  x AS (SELECT *, CASE WHEN model IS NULL THEN NULL WHEN model LIKE 'XM90017%' OR model LIKE 'XM90107%' THEN 'tyrosine' WHEN model LIKE 'XM90%' THEN 'serine' ELSE 'other' END AS kind FROM m LEFT JOIN a USING (integrase_id) LEFT JOIN c USING (integrase_id))
SELECT cluster, count(*) AS n, round(median(CASE WHEN NOT isnan(core) THEN core END), 6) AS core_med, floor(median(len))::BIGINT AS len_med, count(CASE WHEN kind = 'tyrosine' THEN 1 END) AS n_tyrosine, count(CASE WHEN kind = 'serine' THEN 1 END) AS n_serine, count(kind) AS n_known FROM x GROUP BY 1""",
    "jn28_cluster_overlay": f"""WITH {_M}, {_A}, k0 AS (SELECT leiden_cluster AS cluster, feature_id, max(marker_score) AS score, min(short_name) AS short_name, min(pfam_acc) AS pfam_acc, max(count_in) AS count_in FROM cluster_pfam_markers_c6960_unk
    WHERE leiden_cluster >= 0 AND feature_id IS NOT NULL AND marker_score IS NOT NULL AND NOT isnan(marker_score) GROUP BY 1, 2),
  k AS (SELECT *, CASE WHEN pfam_acc = 'PF80857' THEN 'curated' ELSE {_ROLE("coalesce(short_name, '')", ROLES)} END AS role, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, feature_id) AS r FROM k0),
  t AS (SELECT cluster, string_agg(coalesce(short_name, '?') || '=' || printf('%.3f', round_even(score, 3)), '; ' ORDER BY r) AS markers FROM k WHERE r <= 3 GROUP BY 1),
  s AS (SELECT cluster, role, min(r) AS r FROM k GROUP BY 1, 2), s2 AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY r) AS q FROM s), s3 AS (SELECT cluster, string_agg(role, '|' ORDER BY r) AS roles FROM s2 WHERE q <= 3 GROUP BY 1),
  w AS (SELECT cluster, role, sum(count_in) AS w FROM k WHERE role <> 'other' GROUP BY 1, 2), w2 AS (SELECT cluster, role AS top_role FROM w WHERE w IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY w DESC, role) = 1),
  h AS (SELECT cluster, phylum, count(*) AS n FROM m JOIN a USING (integrase_id) WHERE phylum IS NOT NULL AND trim(phylum) NOT IN ('', 'nan') GROUP BY 1, 2), h2 AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, phylum) AS r FROM h),
  h3 AS (SELECT cluster, string_agg(phylum || ' (' || n || ')', '; ' ORDER BY r) AS hosts FROM h2 WHERE r <= 2 GROUP BY 1),
  b AS (SELECT leiden_cluster AS cluster, max(build_no) AS last_build, count(DISTINCT build_no) AS n_builds FROM cluster_biology_summary WHERE leiden_cluster IS NOT NULL GROUP BY 1), z AS (SELECT cluster, count(*) AS n FROM m GROUP BY 1)
SELECT cluster, n, coalesce(markers, '') AS markers, coalesce(roles, '') AS roles, coalesce(top_role, '') AS top_role, coalesce(hosts, '') AS hosts, last_build, coalesce(n_builds, 0) AS n_builds
  FROM z LEFT JOIN t USING (cluster) LEFT JOIN s3 USING (cluster) LEFT JOIN w2 USING (cluster) LEFT JOIN h3 USING (cluster) LEFT JOIN b USING (cluster)""",
    "jn27_node_overlay": rf"""WITH {_M}, e AS (SELECT ie_id, min(integrase_id) AS integrase_id FROM ie_rep_rows_c6960_unk WHERE ie_id IS NOT NULL GROUP BY 1),
  c AS (SELECT trim(regexp_replace(element_id, '\|sample=.*$', '')) AS ie_id, max_by(primary_label, {{'a': classified_at, 'b': loaded_at, 'c': primary_label}}) AS label, count(*) AS n_rows FROM ie_instance_classification WHERE element_id IS NOT NULL GROUP BY 1),
  g AS (SELECT integrase_id, min(gtdb_phylum) AS gtdb FROM cohort_6960_atlas_join WHERE integrase_id IS NOT NULL GROUP BY 1)
SELECT e.ie_id, coalesce(label, '') AS label, coalesce(n_rows, 0) AS n_rows, coalesce(gtdb, '') AS gtdb, coalesce(cluster, -1) AS cluster, CASE WHEN n_rows > 0 THEN 'found' WHEN gtdb IS NOT NULL THEN 'none' ELSE 'not_checked' END AS status
  FROM e LEFT JOIN c USING (ie_id) LEFT JOIN g USING (integrase_id) LEFT JOIN m USING (integrase_id)""",
    "agg21_presence": f"""WITH {_M}, {_A}, x AS (SELECT cluster, integrase_id, matrix_row FROM m JOIN a USING (integrase_id) WHERE matrix_row IS NOT NULL),
  f AS (SELECT DISTINCT row_id, feature_id FROM feature_long WHERE feat_value > 0 AND NOT isnan(feat_value) AND feature_id IS NOT NULL), r AS (SELECT row_id, {_ROLE("right(feature_id, 1)", [("[0-2]", "low"), ("[3-6]", "mid"), ("[7-9]", "high")])} AS role, count(*) AS n FROM f GROUP BY 1, 2),
  h AS (SELECT integrase_id, role, n FROM r JOIN x ON x.matrix_row = r.row_id UNION ALL SELECT integrase_id, 'low', CASE WHEN core > 0.5 THEN 4 ELSE 0 END FROM a), b AS (SELECT integrase_id, role, max(n) AS n FROM h WHERE n > 0 GROUP BY 1, 2),
  z AS (SELECT cluster, count(DISTINCT integrase_id) AS n_members FROM x GROUP BY 1), p AS (SELECT cluster, role, count(*) AS n_with, sum(n) AS s FROM (SELECT DISTINCT cluster, integrase_id FROM x) JOIN b USING (integrase_id) GROUP BY 1, 2)
SELECT cluster, role, n_with, n_members, round(n_with / n_members, 6) AS share, round(s / n_members, 6) AS mean FROM p JOIN z USING (cluster)""",
}
