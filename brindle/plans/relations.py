"""Similarity, statistics, aggregation and join queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.functions.stats import false_discovery
from brindle.operators import matrix as mx
from brindle.operators.graph import connected_components
from brindle.operators.orphans import clean_key
from brindle.operators.topk import first_wins, resolve, top1, topk, with_other
from brindle.session import table


# ---- similarity (GRF7-9, AGG38, GRF16) --------------------------------------------------------------------------
def _long(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("row"), F.col("l_partkey").alias("feature")).distinct().withColumn("value", F.lit(1.0))


LONG = """long AS (SELECT DISTINCT o_custkey AS r, l_partkey AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
size AS (SELECT r, count(*) AS s FROM long GROUP BY r),
pairs AS MATERIALIZED (SELECT i, j, n / (a.s + b.s - n) AS jaccard FROM (SELECT x.r AS i, y.r AS j, count(*) AS n FROM long x JOIN long y ON x.f = y.f AND x.r < y.r GROUP BY ALL) JOIN size a ON a.r = i JOIN size b ON b.r = j)"""
KNN = """both_ AS (SELECT i, j, jaccard AS w FROM pairs UNION ALL SELECT j, i, jaccard FROM pairs),
best AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY i ORDER BY w DESC, j) <= 3),
edges AS MATERIALIZED (SELECT least(i, j) AS src, greatest(i, j) AS dst, max(w) AS weight FROM best GROUP BY ALL)"""


def jaccard(spark: SparkSession, d: str) -> DataFrame:
    return mx.weighted_jaccard(_long(spark, d), "row", "feature", "value").where("jaccard >= 0.05")


def _edges(spark, d):
    return mx.knn_edges(mx.weighted_jaccard(_long(spark, d), "row", "feature", "value"), 3)


def knn(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(mx.weighted_jaccard(_long(spark, d), "row", "feature", "value").where("jaccard >= 0.06"), "i", "j")


def _labels(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("label"))


def cluster_edges(spark: SparkSession, d: str) -> DataFrame:
    return mx.cluster_edges(_edges(spark, d), _labels(spark, d), "node", "label").select("a", "b", "n_edges", F.round("weight", 9).alias("weight"))


def mixing(spark: SparkSession, d: str) -> DataFrame:
    sizes = _labels(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return false_discovery(mx.mixing(mx.cluster_edges(_edges(spark, d), _labels(spark, d), "node", "label"), sizes), "p")


def mixing_report(spark: SparkSession, d: str) -> DataFrame:
    """STA1-3, GRF14: observed and expected edges of each pair of clusters, with fold, z, tail probability and false-discovery value."""
    return mixing(spark, d).select("a", "b", "n_edges", *[F.round(c, 9).alias(c) for c in ("expected", "fold", "log2_fold", "z", "p", "q")])


def permutation(spark: SparkSession, d: str) -> DataFrame:
    return mx.permutation_test(_edges(spark, d), _labels(spark, d), "node", "label", 200)


def agreement(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return mx.agreement(x, "o_orderpriority", "c_mktsegment").select(F.round("ari", 9).alias("ari"), F.round("nmi", 9).alias("nmi"))


# ---- enrichment (STA4-6, AGG30-31, WIN12, WIN16) ----------------------------------------------------------------
def _class(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("cls"))
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity").join(p, "l_partkey")


def class_enrichment(spark: SparkSession, d: str) -> DataFrame:
    inside = F.col("l_returnflag") == "R"
    x = _class(spark, d)
    t = x.groupBy("cls").agg(F.sum(inside.cast("long")).alias("n_in"), F.sum((~inside).cast("long")).alias("n_out"))
    every = x.agg(F.sum(F.when(inside, F.col("l_quantity")).otherwise(0.0)).alias("len_in"), F.sum(F.when(~inside, F.col("l_quantity")).otherwise(0.0)).alias("len_out"), F.sum(inside.cast("long")).alias("all_in"), F.sum((~inside).cast("long")).alias("all_out"))
    out = false_discovery(mx.class_enrichment(t.crossJoin(F.broadcast(every))), "p")
    return out.select("cls", "n_in", "n_out", "all_in", "all_out", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("len_in", "len_out", "density_in", "density_out", "fold", "fold_pseudo")], *[F.round(c, 9).alias(c) for c in ("p", "q")])


def folds(spark: SparkSession, d: str) -> DataFrame:
    """AGG30-31: per element and class densities in and out, then median and quartiles of the folds per class."""
    inside = F.col("l_returnflag") == "R"
    g = _class(spark, d).groupBy("l_suppkey", "cls").agg(F.sum(F.when(inside, F.col("l_quantity")).otherwise(0.0)).alias("q_in"), F.sum(F.when(~inside, F.col("l_quantity")).otherwise(0.0)).alias("q_out"))
    g = g.withColumn("fold", F.try_divide(F.col("q_in"), F.col("q_out")))
    return g.groupBy("cls").agg(F.count("fold").alias("n"), F.percentile("fold", F.lit(0.25)).alias("q25"), F.percentile("fold", F.lit(0.5)).alias("median"), F.percentile("fold", F.lit(0.75)).alias("q75"), F.avg((F.col("fold") > 1).cast("double")).alias("share_above"))


def marker_enrichment(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "ie_rep_rows_c6960_unk").where("matrix_row is not null and trim(phylum) not in ('', 'nan')").select("phylum", F.col("matrix_row").alias("row_id"))
    f = table(spark, d, "feature_long").where("feat_value > 0 and not isnan(feat_value)").select("row_id", "feature_id")
    m = mx.marker_enrichment(x.join(f, "row_id"), "phylum", "row_id", "feature_id").where("count_in >= 3 and p_in >= 0.01")
    return topk(m, ["cluster"], [F.desc(F.round("score", 9)), F.col("feature")], 30, "place").select("cluster", "feature", "count_in", F.round("p_in", 9).alias("p_in"), F.round("score", 9).alias("score"), "place")


# ---- aggregates (AGG1-5, 17-19, 29, 40, 45, 47, WIN10, WIN17) ---------------------------------------------------
def biology(spark: SparkSession, d: str) -> DataFrame:
    """AGG17, AGG24: per label n, median, quartiles (truncated), number of samples."""
    x = table(spark, d, "cohort_6960_atlas_join").where("coarse_label is not null and ie_len_nt is not null")
    q = lambda p: F.percentile("ie_len_nt", F.lit(p)).cast("long")
    return x.groupBy("coarse_label").agg(F.count(F.lit(1)).alias("n"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.count_distinct("sample_id").alias("n_samples"))


def diversity(spark: SparkSession, d: str) -> DataFrame:
    x = mx.diversity(table(spark, d, "cohort_6960_atlas_join"), "coarse_label", "gtdb_phylum", "unknown", 5)
    return x.select("grp", "total", "n_values", "top", *[F.round(c, 9).alias(c) for c in ("purity", "bits", "nats", "effective")])


def crosstab(spark: SparkSession, d: str) -> DataFrame:
    """AGG29, AGG47: wide contingency table with a fixed list of columns."""
    tiers = ["high", "medium", "low"]
    x = table(spark, d, "ie_instance_classification").where("coarse_label is not null")
    return x.groupBy("coarse_label").pivot("confidence", tiers).agg(F.count(F.lit(1))).na.fill(0, tiers)


def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """AGG40, D18: per region count, distinct nations, sum, average and sorted list."""
    n, r, c = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "customer")
    x = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return x.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("n_name").alias("n_nations"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.array_join(F.array_sort(F.collect_set("n_name")), ", ").alias("nations"))


def statistics(spark: SparkSession, d: str) -> DataFrame:
    """AGG2-5: per order counts, zero-default means, comma-joined lengths in line order."""
    o, l = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    g = l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("m"), F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("q"))
    return o.join(g, o.o_orderkey == g.l_orderkey, "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_hits"), F.round(F.coalesce("m", F.lit(0.0)), 9).alias("mean"), F.coalesce(F.array_join(F.transform("q", lambda x: x["q"].cast("string")), ","), F.lit("")).alias("lengths"))


def totals(spark: SparkSession, d: str) -> DataFrame:
    """AGG4: overall totals as (metric, value)."""
    l = table(spark, d, "lineitem").agg(F.count(F.lit(1)).cast("double").alias("n_lines"), F.count_distinct("l_orderkey").cast("double").alias("n_orders"), F.round(F.avg("l_quantity"), 9).alias("mean_quantity"), F.max("l_quantity").cast("double").alias("max_quantity"))
    return l.unpivot([], ["n_lines", "n_orders", "mean_quantity", "max_quantity"], "metric", "value")


def anchored(spark: SparkSession, d: str) -> DataFrame:
    """FLT3-4, WIN3-6: anchored hits with derived span; the longest of each query, ties by mismatch and line."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.floor(F.col("l_discount") * 100 + 0.5)).alias("mismatch"), F.col("l_partkey").alias("s"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"))
    x = l.where("l_quantity >= 8").withColumn("qspan", F.col("l_quantity").cast("long")).withColumn("lo", F.when(F.col("strand") == "+", F.col("s")).otherwise(F.greatest(F.lit(1), F.col("s") - F.col("qspan") + 1)))
    best = top1(x, ["l_orderkey"], [F.desc("l_quantity"), F.col("mismatch"), F.col("l_linenumber"), F.col("s"), F.col("strand")])
    return best.select("l_orderkey", "l_linenumber", "qspan", "mismatch", "strand", "lo", (F.col("lo") + F.col("qspan") - 1).alias("hi"))


# ---- joins and sets (JN3, 5, 11, 14, 23-25, 29, 33, SET1-4, WIN7, AUX60) ----------------------------------------
def star(spark: SparkSession, d: str) -> DataFrame:
    """JN14, JN23-24, SRC39: elements with their newest classification and representative; keys cleaned, sides made unique first."""
    u = table(spark, d, "ie_rep_rows_c6960_unk").select("ie_id", "phylum", "coarse_label").where("ie_id is not null").distinct()
    c = table(spark, d, "ie_instance_classification").select(clean_key(F.col("element_id")).alias("ie_id"), F.col("coarse_label").alias("new_label"), "confidence", "classified_at", "loaded_at").where("ie_id is not null")
    c = top1(c, ["ie_id"], [F.desc_nulls_last("classified_at"), F.desc_nulls_last("loaded_at"), F.col("new_label").asc_nulls_last(), F.col("confidence").asc_nulls_last()])
    r = table(spark, d, "rep_index").groupBy("ie_id").agg(F.max("cluster_size").alias("cluster_size"))
    return u.join(c, "ie_id", "left").join(r, "ie_id", "left").select("ie_id", F.nullif(F.trim("phylum"), F.lit("nan")).alias("phylum"), F.coalesce("new_label", "coarse_label").alias("label"), F.coalesce("confidence", F.lit("")).alias("confidence"), F.coalesce("cluster_size", F.lit(0)).alias("cluster_size"))


def changes(spark: SparkSession, d: str) -> DataFrame:
    """SET4, JN29: labels of elements in two builds by full outer join: kept, lost, gained, changed."""
    def side(name, key, t, label, out):
        x = table(spark, d, name).select(clean_key(F.col(key)).alias("id"), F.col(label).alias(out), F.col(t).alias("t")).where("id is not null")
        return top1(x, ["id"], [F.desc_nulls_last("t"), F.col(out).asc_nulls_last()]).drop("t")
    a = side("cohort_6960_atlas_join", "ie_id", "joined_at", "coarse_label", "old")
    b = side("ie_instance_classification", "element_id", "classified_at", "coarse_label", "new")
    x = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "id", "full_outer")
    state = F.when(F.col("in_b").isNull(), "lost").when(F.col("in_a").isNull(), "gained").when(F.col("old").eqNullSafe(F.col("new")), "kept").otherwise("changed")
    return x.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def anti(spark: SparkSession, d: str) -> DataFrame:
    """JN33, FLT16, SET7: customers without orders."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


def first_part(spark: SparkSession, d: str) -> DataFrame:
    """SET1-3: union of parts with unequal columns, the first part wins."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    a = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("part"))
    b = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("part"))
    return first_wins([a, b], ["id"], [F.col("nation")]).select("id", "nation", "segment", "part")


def representatives(spark: SparkSession, d: str) -> DataFrame:
    """JN11, WIN7, AGG1: member -> representative with fallbacks, and the size of each."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("member"), F.col("o_custkey").alias("rep"))
    out = resolve(table(spark, d, "orders").select(F.col("o_orderkey").alias("member")), o, "member", "rep")
    return out.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))


def phylum_bins(spark: SparkSession, d: str) -> DataFrame:
    """AUX60-61: the five largest phyla by name, the rest as Other."""
    x = table(spark, d, "cohort_6960_atlas_join").where("gtdb_phylum is not null")
    return with_other(x, "gtdb_phylum", 5).groupBy("bin", "coarse_label").agg(F.count(F.lit(1)).alias("n"))


# ---- scalar functions (SCL1-36) ---------------------------------------------------------------------------------
def scalars(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "cohort_6960_atlas_join").where("ie_id is not null").select("ie_id", "integrase_model", "sample_id").distinct()
    return x.select("ie_id", tx.safe_id(F.col("ie_id")).alias("safe"), tx.accession(F.col("sample_id")).alias("acc"), F.substring_index("ie_id", ":", 1).alias("orf"), F.regexp_extract("ie_id", r"^[^:]*:(.+):\d+-\d+", 1).alias("contig"), tx.shorten(F.col("ie_id"), 20).alias("short"), F.regexp_replace(F.coalesce("integrase_model", F.lit("")), r"\.\d+$", "").alias("model"))


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """SCL1, SRC1-3: reverse complement, any-N flag and length of the A, C, G, T, N letters of each text."""
    s = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGTN]", "")
    x = table(spark, d, "documents").select("doc_id", s.alias("seq"))
    return x.select("doc_id", F.length("seq").cast("long").alias("len"), F.contains("seq", F.lit("N")).alias("has_n"), F.md5(tx.reverse_complement(F.col("seq"))).alias("rc_md5"), tx.slice_oriented(F.col("seq"), F.lit(3), F.lit(12), F.lit("-")).alias("slice"))


QUERIES = {
    "grf7_jaccard": jaccard, "grf8_knn_edges": knn, "grf9_components": components, "agg38_cluster_edges": cluster_edges, "sta1_mixing": mixing_report, "grf15_permutation": permutation, "grf13_agreement": agreement,
    "sta5_class_enrichment": class_enrichment, "agg31_folds": folds, "sta6_markers": marker_enrichment, "agg17_biology": biology, "agg18_diversity": diversity, "agg29_crosstab": crosstab, "agg40_taxonomy": taxonomy,
    "agg2_statistics": statistics, "agg4_totals": totals, "win3_anchored": anchored, "jn23_star": star, "set4_changes": changes, "jn33_anti": anti, "set2_first_part": first_part, "jn11_representatives": representatives, "aux60_phylum_bins": phylum_bins, "scl_ids": scalars, "scl1_sequences": sequences,
}
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\|sample=.*$', '', 's'), '^\s+|\s+$', '', 'g')"
_OK = "NOT IN ('', 'nan', 'None', '<NA>')"
FDR = "least(1.0, min(v) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
RANKED = "p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_TERM = "exp(i * ln(e) - e - lgamma(i + 1))"
MIX = f"""c AS (SELECT least(a.c_nationkey, b.c_nationkey) AS a, greatest(a.c_nationkey, b.c_nationkey) AS b, count(*) AS n_edges FROM edges JOIN customer a ON a.c_custkey = src JOIN customer b ON b.c_custkey = dst GROUP BY 1, 2),
  z AS (SELECT c_nationkey AS l, count(*)::DOUBLE AS n FROM customer GROUP BY 1), k AS (SELECT sum(n) AS n, sum(n * n) AS s FROM z), t AS (SELECT sum(n_edges)::DOUBLE AS m FROM c WHERE a < b),
  x AS (SELECT a, b, n_edges, t.m * p.n * q.n / ((k.n * k.n - k.s) / 2) AS e FROM c JOIN z p ON p.l = a JOIN z q ON q.l = b, k, t WHERE a < b),
  y AS (SELECT *, CASE WHEN n_edges > e THEN list_sum(list_transform(range(n_edges, n_edges + 400), lambda i: {_TERM})) ELSE 1 - list_sum(list_transform(range(0, n_edges), lambda i: {_TERM})) END AS p FROM x),
  v AS (SELECT *, {RANKED} AS v FROM y), w AS (SELECT a, b, n_edges, e, n_edges / e AS fold, log2((n_edges + 0.5) / (e + 0.5)) AS log2_fold, (n_edges - e) / sqrt(e) AS z, p, {FDR} AS q FROM v)"""
_CLS = "x AS (SELECT l_suppkey, p_type AS cls, l_returnflag = 'R' AS i, l_quantity AS q FROM lineitem JOIN part ON p_partkey = l_partkey)"
ORACLE = {
    "grf7_jaccard": f"WITH {LONG} SELECT * FROM pairs WHERE jaccard >= 0.05",
    "grf8_knn_edges": f"WITH {LONG}, {KNN} SELECT * FROM edges",
    "grf9_components": f"WITH RECURSIVE {LONG}, e AS MATERIALIZED (SELECT i AS a, j AS b FROM pairs WHERE jaccard >= 0.06 UNION ALL SELECT j, i FROM pairs WHERE jaccard >= 0.06), w(n, m) AS (SELECT a, a FROM e UNION SELECT w.n, e.b FROM w JOIN e ON e.a = w.m) SELECT n AS node, min(m) AS component FROM w GROUP BY n",
    "agg38_cluster_edges": f"WITH {LONG}, {KNN} SELECT least(a.c_nationkey, b.c_nationkey) AS a, greatest(a.c_nationkey, b.c_nationkey) AS b, count(*) AS n_edges, round(sum(weight), 9) AS weight FROM edges JOIN customer a ON a.c_custkey = src JOIN customer b ON b.c_custkey = dst GROUP BY 1, 2",
    "sta1_mixing": f"WITH {LONG}, {KNN}, {MIX} SELECT a, b, n_edges, round(e, 9) AS expected, round(fold, 9) AS fold, round(log2_fold, 9) AS log2_fold, round(z, 9) AS z, round(p, 9) AS p, round(q, 9) AS q FROM w",
    "sta5_class_enrichment": f"""WITH {_CLS}, t AS (SELECT cls, sum(i::INT)::BIGINT AS n_in, sum((NOT i)::INT)::BIGINT AS n_out FROM x GROUP BY 1), a AS (SELECT sum(CASE WHEN i THEN q ELSE 0 END)::DOUBLE AS len_in, sum(CASE WHEN NOT i THEN q ELSE 0 END)::DOUBLE AS len_out, sum(i::INT)::BIGINT AS all_in, sum((NOT i)::INT)::BIGINT AS all_out FROM x),
  f AS (SELECT *, all_in AS row_, n_in + n_out AS col_, all_in + all_out AS n FROM t, a),
  y AS (SELECT *, list_sum(list_transform(range(n_in, least(row_, col_) + 1), lambda x: exp(lgamma(row_ + 1) - lgamma(x + 1) - lgamma(row_ - x + 1) + lgamma(n - row_ + 1) - lgamma(col_ - x + 1) - lgamma(n - row_ - col_ + x + 1) - lgamma(n + 1) + lgamma(col_ + 1) + lgamma(n - col_ + 1)))) AS p FROM f),
  v AS (SELECT *, {RANKED} AS v FROM y)
SELECT cls, n_in, n_out, all_in, all_out, round(len_in, 6) AS len_in, round(len_out, 6) AS len_out, round(n_in / (len_in / 1e6), 6) AS density_in, round(n_out / (len_out / 1e6), 6) AS density_out, round(n_in / len_in / (n_out / len_out), 6) AS fold,
  round((n_in + 0.5) / len_in / ((n_out + 0.5) / len_out), 6) AS fold_pseudo, round(p, 9) AS p, round({FDR}, 9) AS q FROM v""",
    "grf13_agreement": """WITH t AS (SELECT o_orderpriority AS a, c_mktsegment AS b, count(*)::DOUBLE AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
  ra AS (SELECT a, sum(n) AS na FROM t GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM t GROUP BY b), k AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS ij FROM t), sa AS (SELECT sum(na * (na - 1) / 2) AS s, -sum(na / n * ln(na / n)) AS h FROM ra, k), sb AS (SELECT sum(nb * (nb - 1) / 2) AS s, -sum(nb / n * ln(nb / n)) AS h FROM rb, k),
  mi AS (SELECT sum(t.n / k.n * ln(t.n * k.n / na / nb)) AS m FROM t JOIN ra USING (a) JOIN rb USING (b), k)
SELECT round((ij - sa.s * sb.s / (k.n * (k.n - 1) / 2)) / ((sa.s + sb.s) / 2 - sa.s * sb.s / (k.n * (k.n - 1) / 2)), 9) AS ari, round(m / ((sa.h + sb.h) / 2), 9) AS nmi FROM k, sa, sb, mi""",
    "agg31_folds": f"WITH {_CLS}, g AS (SELECT l_suppkey, cls, sum(CASE WHEN i THEN q ELSE 0 END) / nullif(sum(CASE WHEN NOT i THEN q ELSE 0 END), 0) AS fold FROM x GROUP BY ALL) SELECT cls, count(fold) AS n, quantile_cont(fold, 0.25) AS q25, quantile_cont(fold, 0.5) AS median, quantile_cont(fold, 0.75) AS q75, avg((fold > 1)::INT) AS share_above FROM g GROUP BY 1",
    "sta6_markers": """WITH x AS (SELECT DISTINCT phylum AS c, matrix_row AS r, feature_id AS f FROM ie_rep_rows_c6960_unk JOIN feature_long ON row_id = matrix_row WHERE trim(phylum) NOT IN ('', 'nan') AND feat_value > 0 AND NOT isnan(feat_value)),
  rows_ AS (SELECT DISTINCT c, r FROM x), size AS (SELECT c, count(*) AS s FROM rows_ GROUP BY c), al AS (SELECT count(*) AS n FROM rows_), tot AS (SELECT f, count(*) AS t FROM x GROUP BY f),
  y AS (SELECT c AS cluster, f AS feature, k AS count_in, k / s AS p_in, (t - k) / (n - s) AS p_out FROM (SELECT c, f, count(*) AS k FROM x GROUP BY ALL) JOIN size USING (c) JOIN tot USING (f), al),
  z AS (SELECT cluster, feature, count_in, round(p_in, 9) AS p_in, round(log2((p_in + 1e-3) / (p_out + 1e-3)) * sqrt(p_in), 9) AS score FROM y WHERE count_in >= 3 AND y.p_in >= 0.01)
SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, feature)::INT AS place FROM z QUALIFY place <= 30""",
    "agg17_biology": "SELECT coarse_label, count(*) AS n, trunc(quantile_cont(ie_len_nt, 0.5))::BIGINT AS median, trunc(quantile_cont(ie_len_nt, 0.25))::BIGINT AS q25, trunc(quantile_cont(ie_len_nt, 0.75))::BIGINT AS q75, count(DISTINCT sample_id) AS n_samples FROM cohort_6960_atlas_join WHERE coarse_label IS NOT NULL AND ie_len_nt IS NOT NULL GROUP BY 1",
    "agg18_diversity": """WITH n AS (SELECT coarse_label AS grp, coalesce(gtdb_phylum, 'unknown') AS v, count(*) AS n FROM cohort_6960_atlas_join WHERE coarse_label IS NOT NULL GROUP BY ALL), t AS (SELECT grp, sum(n) AS total FROM n GROUP BY 1),
  h AS (SELECT grp, total::BIGINT AS total, count(*) AS n_values, arg_min(v, (-n, v)) AS top, max(n) / total AS purity, -sum(n / total * ln(n / total)) AS nats FROM n JOIN t USING (grp) GROUP BY grp, total)
SELECT grp, total, n_values, top, round(purity, 9) AS purity, round(nats / ln(2), 9) AS bits, round(nats, 9) AS nats, round(exp(nats), 9) AS effective FROM h WHERE total >= 5""",
    "agg29_crosstab": "SELECT coarse_label, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low FROM ie_instance_classification WHERE coarse_label IS NOT NULL GROUP BY 1",
    "agg40_taxonomy": "SELECT r_name, count(*) AS n, count(DISTINCT n_name) AS n_nations, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 6) AS mean, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS nations FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    "agg2_statistics": "SELECT o_orderkey, count(l_orderkey) AS n_hits, round(coalesce(avg(l_discount), 0), 9) AS mean, coalesce(string_agg(l_quantity::INT::VARCHAR, ',' ORDER BY l_linenumber, l_quantity::INT), '') AS lengths FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "agg4_totals": "WITH t AS (SELECT count(*)::DOUBLE AS n_lines, count(DISTINCT l_orderkey)::DOUBLE AS n_orders, round(avg(l_quantity), 9) AS mean_quantity, max(l_quantity)::DOUBLE AS max_quantity FROM lineitem) UNPIVOT t ON n_lines, n_orders, mean_quantity, max_quantity INTO NAME metric VALUE value",
    "win3_anchored": """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS qspan, floor(l_discount * 100 + 0.5)::BIGINT AS mismatch, l_partkey AS s, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand FROM lineitem WHERE l_quantity >= 8),
  y AS (SELECT *, CASE WHEN strand = '+' THEN s ELSE greatest(1, s - qspan + 1) END AS lo FROM x QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY qspan DESC, mismatch, l_linenumber, s, strand) = 1) SELECT l_orderkey, l_linenumber, qspan, mismatch, strand, lo, lo + qspan - 1 AS hi FROM y""",
    "jn23_star": f"""WITH u AS (SELECT DISTINCT ie_id, phylum, coarse_label FROM ie_rep_rows_c6960_unk WHERE ie_id IS NOT NULL), c0 AS (SELECT {_CLEAN.format('element_id')} AS ie_id, coarse_label AS l, confidence, classified_at, loaded_at FROM ie_instance_classification),
  c AS (SELECT * FROM c0 WHERE ie_id {_OK} QUALIFY row_number() OVER (PARTITION BY ie_id ORDER BY classified_at DESC NULLS LAST, loaded_at DESC NULLS LAST, l NULLS LAST, confidence NULLS LAST) = 1), r AS (SELECT ie_id, max(cluster_size) AS s FROM rep_index GROUP BY 1)
SELECT u.ie_id, nullif(trim(phylum), 'nan') AS phylum, coalesce(l, coarse_label) AS label, coalesce(confidence, '') AS confidence, coalesce(s, 0) AS cluster_size FROM u LEFT JOIN c USING (ie_id) LEFT JOIN r USING (ie_id)""",
    "set4_changes": f"""WITH a0 AS (SELECT {_CLEAN.format('ie_id')} AS id, coarse_label AS l, joined_at AS t FROM cohort_6960_atlas_join), b0 AS (SELECT {_CLEAN.format('element_id')} AS id, coarse_label AS l, classified_at AS t FROM ie_instance_classification),
  a AS (SELECT * FROM a0 WHERE id {_OK} QUALIFY row_number() OVER (PARTITION BY id ORDER BY t DESC NULLS LAST, l NULLS LAST) = 1), b AS (SELECT * FROM b0 WHERE id {_OK} QUALIFY row_number() OVER (PARTITION BY id ORDER BY t DESC NULLS LAST, l NULLS LAST) = 1)
SELECT CASE WHEN b.id IS NULL THEN 'lost' WHEN a.id IS NULL THEN 'gained' WHEN a.l IS NOT DISTINCT FROM b.l THEN 'kept' ELSE 'changed' END AS state, count(*) AS n FROM a FULL JOIN b ON a.id = b.id GROUP BY 1""",
    "jn33_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "set2_first_part": "WITH p AS (SELECT s_suppkey AS id, s_nationkey AS nation, NULL::VARCHAR AS segment, 'supplier' AS part, 0 AS o FROM supplier UNION ALL SELECT c_custkey, c_nationkey, c_mktsegment, 'customer', 1 FROM customer) SELECT id, nation, segment, part FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY o, nation) = 1",
    "jn11_representatives": """WITH m AS (SELECT o_orderkey AS member, o_custkey AS rep FROM orders WHERE o_orderstatus <> 'F') SELECT coalesce(m.rep, o_orderkey) AS rep, count(*) AS size FROM orders LEFT JOIN m ON m.member = o_orderkey GROUP BY 1""",
    "aux60_phylum_bins": "WITH k AS (SELECT gtdb_phylum FROM cohort_6960_atlas_join WHERE gtdb_phylum IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) SELECT CASE WHEN gtdb_phylum IN (FROM k) THEN gtdb_phylum ELSE 'Other' END AS bin, coarse_label, count(*) AS n FROM cohort_6960_atlas_join WHERE gtdb_phylum IS NOT NULL GROUP BY ALL",
    "scl_ids": r"""SELECT DISTINCT ie_id, left(regexp_replace(ie_id, '[^A-Za-z0-9_]', '_', 'g'), 180) AS safe, nullif(regexp_extract(sample_id, 'GCA_\d+\.\d+'), '') AS acc, split_part(ie_id, ':', 1) AS orf, regexp_extract(ie_id, '^[^:]*:(.+):\d+-\d+', 1) AS contig,
  CASE WHEN length(ie_id) > 20 THEN left(ie_id, 19) || '…' ELSE ie_id END AS short, regexp_replace(coalesce(integrase_model, ''), '\.\d+$', '') AS model FROM cohort_6960_atlas_join WHERE ie_id IS NOT NULL""",
    "scl1_sequences": """WITH x AS (SELECT doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGTN]', '', 'g') AS seq FROM documents)
SELECT doc_id, length(seq) AS len, contains(seq, 'N') AS has_n, md5(translate(reverse(seq), 'ACGT', 'TGCA')) AS rc_md5, translate(reverse(substr(seq, 3, 10)), 'ACGT', 'TGCA') AS slice FROM x""",
}
