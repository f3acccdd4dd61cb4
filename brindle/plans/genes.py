"""Rule queries over ``lineitem`` x ``part`` as elements with genes: element = supplier, gene = part, text = name, type, brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators import rules
from brindle.operators.cascade import all_matches, first_match, regex_rules
from brindle.operators.intervals import near_in_order
from brindle.session import table


def genes(spark: SparkSession, d: str) -> DataFrame:
    """(element, locus, idx, product): idx numbers the genes of an element by locus (WIN9); the text is joined after the pairs are distinct."""
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("element"), F.col("l_partkey").alias("locus")).distinct()
    text = table(spark, d, "part").select(F.col("p_partkey").alias("locus"), F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("product"))
    idx = F.row_number().over(Window.partitionBy("element").orderBy("locus")) - 1
    return pairs.join(text, "locus").select("element", "locus", idx.alias("idx"), "product")


GENES = """pairs AS (SELECT DISTINCT l_suppkey AS element, l_partkey AS locus FROM lineitem),
genes AS (SELECT element, locus, row_number() OVER (PARTITION BY element ORDER BY locus) - 1 AS idx, lower(concat_ws(' ', p_name, p_type, p_brand)) AS product FROM pairs JOIN part ON p_partkey = locus)"""

MARKERS = [
    rules.Marker("alpha", "first", 0.9, patterns=("brand#1[1-3]", "standard")),
    rules.Marker("beta", "first", 0.6, patterns=("brand#2",)),
    rules.Marker("gamma", "second", 0.8, patterns=("promo|small",)),
    rules.Marker("delta", "third", 0.5, patterns=("economy", "brand#55")),
    rules.Marker("omega", "third", 1.1, patterns=(r"\b1\b",)),
]


def _case(m) -> str:
    return " OR ".join(f"regexp_matches(product, '{p}')" for p in m.patterns)


HITS = "hits AS (" + " UNION ALL ".join(f"SELECT element, locus, idx, '{m.key}' AS key, '{m.category}' AS category, CAST({m.weight} AS DOUBLE) AS weight FROM genes WHERE {_case(m)}" for m in MARKERS) + ")"


def marker_hits(spark: SparkSession, d: str) -> DataFrame:
    """CLS1-2: marker hits of every gene, one per marker."""
    return rules.marker_hits(genes(spark, d), MARKERS, "product").select("element", "locus", "key", "category", "weight")


def module_scores(spark: SparkSession, d: str) -> DataFrame:
    """AGG7-14: module scores of unique marker weights, flags and counts per element."""
    return rules.module_scores(rules.marker_hits(genes(spark, d), MARKERS, "product"), "element", MARKERS, scale=1.22)


def labels(spark: SparkSession, d: str) -> DataFrame:
    """CLS4, CLS7-8: first-match label, confidence tier and secondary flags."""
    s = module_scores(spark, d)
    lab = first_match([((F.col("score_first") >= 0.9) & F.col("has_gamma"), "conj.full"), (F.col("score_second") >= 0.6, "phage.part"), (F.col("score_third") >= 0.4, "rep.only")], "other")
    top = F.greatest("score_first", "score_second", "score_third")
    tier = first_match([(top >= 0.9, "high"), (top >= 0.5, "medium")], "low")
    flags = all_matches([(F.col("has_alpha"), "a"), (F.col("has_beta"), "b"), (F.col("n_omega") > 2, "many_omega")])
    return s.select("element", lab.alias("label"), tier.alias("confidence"), F.array_join(flags, "|").alias("flags"))


SCORES = "scores AS (SELECT element, " + ", ".join(f"round(least(1.0, sum(CASE WHEN category = '{c}' THEN weight ELSE 0 END) / 1.22), 9) AS score_{c}" for c in ("first", "second", "third")) + ", " + ", ".join(f"bool_or(key = '{m.key}') AS has_{m.key}, sum(CASE WHEN key = '{m.key}' THEN n ELSE 0 END)::BIGINT AS n_{m.key}" for m in MARKERS) + ", count(*) AS n_keys FROM (SELECT element, key, category, weight, count(*) AS n FROM hits GROUP BY ALL) GROUP BY element)"


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    """INT11: whether two marker sets lie within eight genes of each other."""
    a, b = F.col("product").rlike("brand#11"), F.col("product").rlike("brand#55")
    return near_in_order(genes(spark, d), "element", "idx", a, b, 8)


CARGO = [("standard.*brand#1", "rm_part"), ("promo", "ta_part"), ("economy", "metal"), ("small|medium", "amr"), (r"brand#5\d", "ok_adj")]


def cargo(spark: SparkSession, d: str) -> DataFrame:
    """CLS17-20, AGG32-35: ordered cargo tags, class sets and minimality per element, then counts per class set."""
    tag = first_match(regex_rules(F.col("product"), CARGO), "leftover")
    per = genes(spark, d).withColumn("tag", tag).groupBy("element").agg(F.array_sort(F.collect_set(F.when(~F.col("tag").isin("ok_adj", "leftover"), F.col("tag")))).alias("classes"), F.sum((F.col("tag") == "leftover").cast("long")).alias("n_leftover"), F.sum((F.col("tag") == "ok_adj").cast("long")).alias("n_ok_adj"), F.count(F.lit(1)).alias("n_cds"))
    n = F.size("classes")
    return per.select("element", F.array_join("classes", "|").alias("classes"), "n_leftover", "n_ok_adj", "n_cds", (n == 1).alias("class_minimal"), ((n == 1) & (F.col("n_leftover") == 0)).alias("composition_minimal"), (F.col("n_ok_adj") <= 3).alias("tight"))


CARGO_SQL = "CASE " + " ".join(f"WHEN regexp_matches(product, '{p}') THEN '{t}'" for p, t in CARGO) + " ELSE 'leftover' END"


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """AGG15, AGG36: annotated share per element, and how obligatory a family is for a class."""
    g = genes(spark, d).withColumn("family", F.regexp_extract("product", r"brand#(\d)", 1)).withColumn("cls", first_match(regex_rules(F.col("product"), CARGO), "leftover"))
    sets = g.select("cls", "element").distinct().groupBy("cls").agg(F.count(F.lit(1)).alias("n_class"))
    both = g.select("cls", "family", "element").distinct().groupBy("cls", "family").agg(F.count(F.lit(1)).alias("n_with"))
    share = F.round(F.col("n_with") / F.col("n_class"), 6)
    return both.join(sets, "cls").select("cls", "family", "n_with", "n_class", share.alias("share"), (F.col("n_with") >= 0.7 * F.col("n_class")).alias("obligatory"))


QUERIES = {"cls1_marker_hits": marker_hits, "agg9_module_scores": module_scores, "cls4_labels": labels, "int11_adjacency": adjacency, "cls17_cargo": cargo, "agg36_obligatory": coverage}
_S = f"WITH {GENES}, {HITS}, {SCORES}"
ORACLE = {
    "cls1_marker_hits": f"WITH {GENES}, {HITS} SELECT element, locus, key, category, weight FROM hits",
    "agg9_module_scores": f"{_S} SELECT * FROM scores",
    "cls4_labels": f"""{_S} SELECT element, CASE WHEN score_first >= 0.9 AND has_gamma THEN 'conj.full' WHEN score_second >= 0.6 THEN 'phage.part' WHEN score_third >= 0.4 THEN 'rep.only' ELSE 'other' END AS label,
  CASE WHEN greatest(score_first, score_second, score_third) >= 0.9 THEN 'high' WHEN greatest(score_first, score_second, score_third) >= 0.5 THEN 'medium' ELSE 'low' END AS confidence,
  concat_ws('|', CASE WHEN has_alpha THEN 'a' END, CASE WHEN has_beta THEN 'b' END, CASE WHEN n_omega > 2 THEN 'many_omega' END) AS flags FROM scores""",
    "int11_adjacency": f"""WITH {GENES} SELECT e.element, EXISTS (SELECT 1 FROM genes a JOIN genes b ON a.element = b.element AND abs(a.idx - b.idx) <= 8 WHERE a.element = e.element AND regexp_matches(a.product, 'brand#11') AND regexp_matches(b.product, 'brand#55')) AS near
  FROM (SELECT DISTINCT element FROM genes) e""",
    "cls17_cargo": f"""WITH {GENES}, t AS (SELECT element, {CARGO_SQL} AS tag FROM genes), a AS (SELECT element, coalesce(string_agg(DISTINCT CASE WHEN tag NOT IN ('ok_adj', 'leftover') THEN tag END, '|' ORDER BY CASE WHEN tag NOT IN ('ok_adj', 'leftover') THEN tag END), '') AS classes,
    count(DISTINCT CASE WHEN tag NOT IN ('ok_adj', 'leftover') THEN tag END) AS k, sum((tag = 'leftover')::INT)::BIGINT AS n_leftover, sum((tag = 'ok_adj')::INT)::BIGINT AS n_ok_adj, count(*) AS n_cds FROM t GROUP BY 1)
  SELECT element, classes, n_leftover, n_ok_adj, n_cds, k = 1 AS class_minimal, k = 1 AND n_leftover = 0 AS composition_minimal, n_ok_adj <= 3 AS tight FROM a""",
    "agg36_obligatory": f"""WITH {GENES}, t AS (SELECT element, regexp_extract(product, 'brand#([0-9])', 1) AS family, {CARGO_SQL} AS cls FROM genes),
  s AS (SELECT cls, count(DISTINCT element) AS n_class FROM t GROUP BY 1), b AS (SELECT cls, family, count(DISTINCT element) AS n_with FROM t GROUP BY ALL)
  SELECT cls, family, n_with, n_class, round(n_with / n_class, 6) AS share, n_with >= 0.7 * n_class AS obligatory FROM b JOIN s USING (cls)""",
}
