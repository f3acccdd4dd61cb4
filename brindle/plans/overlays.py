"""Overlay, token, composition and graph-merge queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import communities as cm
from brindle.operators import lookups as lk
from brindle.operators import matrix as mx
from brindle.plans.loci import LOCI, loci
from brindle.plans.relations import KNN, MIX, LONG, _edges, mixing
from brindle.session import table


def overlay(spark: SparkSession, d: str) -> DataFrame:
    """JN18-20: kind of a view replaced by that of a purchase or signup span that covers more than half of the shorter."""
    x = loci(spark, d)
    genes = x.where("kind in ('view', 'error')").select("contig", "key", "kind", "start", "end")
    spans = x.where("kind in ('purchase', 'signup')").select("contig", F.col("start").alias("s"), F.col("end").alias("e"), F.col("kind").alias("label"))
    return lk.overlay_spans(genes, spans, ["contig"], ("start", "end"), ("s", "e"), ["key"], "kind", "label", keep=["error"]).select("key", "kind")


def merged(spark: SparkSession, d: str) -> DataFrame:
    """JN29, SET5: supplier-part edges of returned and of other lines merged on the pair."""
    l = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"), F.col("l_quantity").cast("double").alias("weight"), "l_returnflag")
    return lk.merge_edges(l.where("l_returnflag = 'R'"), l.where("l_returnflag <> 'R'"), ("ret", "oth"))


def accession_tokens(spark: SparkSession, d: str) -> DataFrame:
    """SCL13, SCL19, AGG45: accessions per family prefix: rows, distinct accessions, genomes."""
    x = table(spark, d, "parsed_cds").where("genome_id is not null").select("genome_id", F.explode(lk.tokens(F.upper("pfam_id"))).alias("t")).where("t like 'PF%'")
    x = x.withColumn("acc", F.regexp_replace("t", r"\.\d+$", ""))
    return x.groupBy(F.left("acc", F.lit(4)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("acc").alias("n_acc"), F.count_distinct("genome_id").alias("n_genomes"))


def composition(spark: SparkSession, d: str) -> DataFrame:
    """AGG20-21, AGG23, AGG25: features per cluster: elements that have one, their share, mean value; from the two largest signals."""
    u = table(spark, d, "ie_rep_rows_c6960_unk").where("matrix_row is not null and integrase_id is not null").select("integrase_id", F.col("matrix_row").alias("row_id")).distinct()
    c = table(spark, d, "leiden_clusters_c6960_unk").where("leiden_cluster >= 0 and integrase_id is not null").groupBy("integrase_id").agg(F.min("leiden_cluster").alias("cluster"))
    f = table(spark, d, "feature_long").where("feat_value > 0 and not isnan(feat_value)").select("row_id", "feature_id", "feat_value").distinct()
    e = u.join(c, "integrase_id")
    size = e.groupBy("cluster").agg(F.count_distinct("row_id").alias("size"))
    g = e.select("cluster", "row_id").distinct().join(f, "row_id").groupBy("cluster", "feature_id").agg(F.count_distinct("row_id").alias("n_with"), F.sum(F.floor(F.col("feat_value") * 10_000 + 0.5)).alias("units"), F.count(F.lit(1)).alias("k"))
    return g.join(size, "cluster").where("n_with >= 3").select("cluster", "feature_id", "n_with", "size", F.round(F.col("n_with") / F.col("size"), 6).alias("share"), F.round(F.col("units") / F.col("k") / 10_000, 9).alias("mean"))


def joined_sets(spark: SparkSession, d: str) -> DataFrame:
    """SRC40, AGG42, AGG44, AGG46: per sample the sorted distinct labels as one text, their number and the best score."""
    x = table(spark, d, "ie_instance_classification").where("sample_id is not null")
    score = F.when(~F.isnan("ie_core_score"), F.col("ie_core_score"))
    return x.groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_set("coarse_label")), "|").alias("labels"), F.count_distinct("coarse_label").alias("n_labels"), F.max(score).alias("best"), F.bool_or(F.coalesce(F.col("confidence") == "high", F.lit(False))).alias("any_high"))


def communities(spark: SparkSession, d: str) -> DataFrame:
    """GRF10: seeded modularity communities of the neighbour graph, small ones as noise."""
    return cm.communities(_edges(spark, d))


def near_copies(spark: SparkSession, d: str) -> DataFrame:
    """GRF1-4, AGG1, AGG41: texts grouped greedily, longest first, by shared 12-letter words; size of each group."""
    x = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^A-Z]", "").alias("s"))
    return cm.deduplicate(x, "doc_id", "s").groupBy("representative").agg(F.count(F.lit(1)).alias("size"))


def copies(spark: SparkSession, d: str) -> DataFrame:
    """AGG41: groups of equal texts."""
    x = table(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("representative"), F.count(F.lit(1)).alias("size"))
    return x.where("size > 1").select("representative", "size")


def tails(spark: SparkSession, d: str) -> DataFrame:
    """STA1, FLT19, CLS48: clusters that mix more than expected: fold, tier."""
    m = mixing(spark, d)
    tier = F.when((F.col("q") <= 0.001) & (F.col("fold") >= 2), "strong").when(F.col("q") <= 0.05, "significant").when(F.col("fold") >= 2, "weak").otherwise("none")
    return m.select("a", "b", "n_edges", F.round("fold", 9).alias("fold"), F.round("q", 9).alias("q"), ((F.col("n_edges") >= 1) & (F.col("n_edges") > F.col("expected")) & ((F.col("z") >= 2) | (F.col("q") <= 0.05))).alias("related"), tier.alias("tier"))


def components_of_labels(spark: SparkSession, d: str) -> DataFrame:
    """AGG39: per cluster internal and external edges and weights."""
    e = mx.cluster_edges(_edges(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("label")), "node", "label")
    both = e.select(F.col("a").alias("label"), "a", "b", "n_edges").unionByName(e.where("a < b").select(F.col("b").alias("label"), "a", "b", "n_edges"))
    own = F.col("a") == F.col("b")
    return both.groupBy("label").agg(F.sum(F.when(own, F.col("n_edges")).otherwise(0)).alias("n_internal"), F.sum(F.when(~own, F.col("n_edges")).otherwise(0)).alias("n_external"))


QUERIES = {"jn18_overlay": overlay, "jn29_merged_edges": merged, "scl19_accessions": accession_tokens, "agg20_composition": composition, "src40_joined_sets": joined_sets, "grf10_communities": communities, "grf1_near_copies": near_copies, "agg41_copies": copies, "sta3_tiers": tails, "agg39_internal_external": components_of_labels}
ORACLE = {
    "jn18_overlay": f"""WITH {LOCI}, h AS (SELECT g.key, s.kind AS label, s.start FROM loci g JOIN loci s ON s.contig = g.contig AND g.start <= s."end" AND s.start <= g."end" WHERE g.kind IN ('view', 'error') AND s.kind IN ('purchase', 'signup')
    AND least(g."end", s."end") - greatest(g.start, s.start) > 0.5 * least(g."end" - g.start, s."end" - s.start) QUALIFY row_number() OVER (PARTITION BY g.key ORDER BY s.start DESC, s.kind DESC) = 1)
  SELECT g.key, CASE WHEN h.label IS NOT NULL AND g.kind <> 'error' THEN h.label ELSE g.kind END AS kind FROM loci g LEFT JOIN h USING (key) WHERE g.kind IN ('view', 'error')""",
    "jn29_merged_edges": """WITH l AS (SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS p, l_quantity::DOUBLE AS w, l_returnflag = 'R' AS r FROM lineitem), a AS (SELECT p AS src, s AS dst, max(w) AS x FROM l WHERE r GROUP BY ALL), b AS (SELECT p AS src, s AS dst, max(w) AS y FROM l WHERE NOT r GROUP BY ALL)
  SELECT src, dst, x AS ret_weight, y AS oth_weight, greatest(coalesce(x, y), coalesce(y, x)) AS weight, CASE WHEN x IS NULL THEN 'oth' WHEN y IS NULL THEN 'ret' ELSE 'both' END AS source FROM a FULL JOIN b USING (src, dst)""",
    "scl19_accessions": r"""WITH t AS (SELECT genome_id, unnest(regexp_split_to_array(upper(pfam_id), '[|;,\s]+')) AS t FROM parsed_cds WHERE genome_id IS NOT NULL AND pfam_id IS NOT NULL), a AS (SELECT genome_id, regexp_replace(t, '\.\d+$', '') AS acc FROM t WHERE t LIKE 'PF%')
  SELECT left(acc, 4) AS prefix, count(*) AS n, count(DISTINCT acc) AS n_acc, count(DISTINCT genome_id) AS n_genomes FROM a GROUP BY 1""",
    "agg20_composition": """WITH u AS (SELECT DISTINCT integrase_id, matrix_row AS r FROM ie_rep_rows_c6960_unk WHERE matrix_row IS NOT NULL AND integrase_id IS NOT NULL), c AS (SELECT integrase_id, min(leiden_cluster) AS cluster FROM leiden_clusters_c6960_unk WHERE leiden_cluster >= 0 GROUP BY 1),
  f AS (SELECT DISTINCT row_id, feature_id, feat_value FROM feature_long WHERE feat_value > 0 AND NOT isnan(feat_value)), e AS (SELECT DISTINCT cluster, r FROM u JOIN c USING (integrase_id)), s AS (SELECT cluster, count(*) AS size FROM e GROUP BY 1)
  SELECT cluster, feature_id, count(DISTINCT r) AS n_with, size, round(count(DISTINCT r) / size, 6) AS share, round(sum(floor(feat_value * 10000 + 0.5)::BIGINT)::BIGINT / count(*) / 10000, 9) AS mean FROM e JOIN f ON row_id = r JOIN s USING (cluster) GROUP BY cluster, feature_id, size HAVING count(DISTINCT r) >= 3""",
    "src40_joined_sets": "SELECT sample_id, coalesce(string_agg(DISTINCT coarse_label, '|' ORDER BY coarse_label), '') AS labels, count(DISTINCT coarse_label) AS n_labels, max(CASE WHEN NOT isnan(ie_core_score) THEN ie_core_score END) AS best, bool_or(coalesce(confidence = 'high', false)) AS any_high FROM ie_instance_classification WHERE sample_id IS NOT NULL GROUP BY 1",
    "agg41_copies": "SELECT min(doc_id) AS representative, count(*) AS size FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "sta3_tiers": f"""WITH {LONG}, {KNN}, {MIX} SELECT a, b, n_edges, round(fold, 9) AS fold, round(q, 9) AS q, n_edges >= 1 AND n_edges > e AND (z >= 2 OR q <= 0.05) AS related, CASE WHEN q <= 0.001 AND fold >= 2 THEN 'strong' WHEN q <= 0.05 THEN 'significant' WHEN fold >= 2 THEN 'weak' ELSE 'none' END AS tier FROM w""",
    "agg39_internal_external": f"""WITH {LONG}, {KNN}, e AS (SELECT a.c_nationkey AS a, b.c_nationkey AS b FROM edges JOIN customer a ON a.c_custkey = src JOIN customer b ON b.c_custkey = dst), x AS (SELECT a AS label, a, b FROM e UNION ALL SELECT b, a, b FROM e WHERE a <> b)
  SELECT label, sum((a = b)::INT)::BIGINT AS n_internal, sum((a <> b)::INT)::BIGINT AS n_external FROM x GROUP BY 1""",
}
