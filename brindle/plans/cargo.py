"""Cargo of genomes: ``parsed_cds`` as genes (element = genome, text = product), kinds and classes by patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import cargo as cg
from brindle.operators.cascade import first_match, regex_rules
from brindle.session import table

KINDS = [("integrase|recombinase", "int"), ("restriction|methyl|endonuclease", "rm"), ("toxin|kinase", "ta"), ("replic|helicase|primase", "rep")]
CLASSES = [("restriction|methyl", "RM"), ("toxin", "TA"), ("replic|helicase", "replication"), ("transposase", "mobile"), ("resistance|efflux", "AMR"), ("hypothetical|domain", "ok_adj")]
NAMES = [("RM", "defense"), ("TA", "maintenance"), ("replication", "base"), ("mobile", "mobile"), ("AMR", "host"), ("CRISPR", "defense")]


def genes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "parsed_cds").where("genome_id is not null and locus_tag is not null").select("genome_id", "locus_tag", "cds_start", "cds_end", "product").distinct()
    low = F.lower(F.coalesce("product", F.lit("")))
    return rows.select(F.col("genome_id").alias("element"), F.col("locus_tag").alias("key"), F.col("cds_start").alias("start"), F.col("cds_end").alias("end"), F.floor((F.abs(F.col("cds_end") - F.col("cds_start")) + 1) / 3).cast("long").alias("aa"), F.coalesce("product", F.lit("")).alias("product"), low.alias("low"))


def scan(spark: SparkSession, d: str) -> DataFrame:
    """CLS23-30, FLT12, SCL18: kinds of genes, product texts, pair status, family and composition of each genome."""
    g = genes(spark, d).withColumn("kind", first_match(regex_rules(F.col("low"), KINDS), "other"))
    s = cg.kind_scan(g, ["int", "rm", "ta", "rep", "other"], assumed="int")
    toxin = F.col("ta_products").rlike("(?i)toxin")
    pair = cg.pair_status(toxin, F.col("ta_products").rlike("(?i)antitoxin"), F.col("other_products"), F.lit(""))
    few = F.col("has_rm") & (F.col("n_rm") + F.col("n_other") <= 3)
    return s.select("element", "n_genes", "n_int", "n_rm", "n_ta", "n_rep", "n_other", "rm_products", F.when(F.col("has_ta"), pair).alias("pair"), F.when(F.col("has_ta"), cg.pair_family(F.col("ta_products"))).alias("family"), F.when(F.col("has_rm"), cg.composition(F.lit("Type II"), F.col("rm_products"))).alias("composition"), few.alias("few_extras"))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    tag = first_match(regex_rules(F.col("low"), CLASSES), "leftover")
    own = genes(spark, d).withColumn("tag", tag)
    per = own.groupBy("element").agg(F.array_sort(F.collect_set(F.when(~F.col("tag").isin("ok_adj", "leftover"), F.col("tag")))).alias("classes"), F.sum((F.col("tag") == "leftover").cast("long")).alias("n_leftover"), F.sum((F.col("tag") == "ok_adj").cast("long")).alias("n_ok_adj"), F.count(F.lit(1)).alias("n_cds"))
    # leftovers up to a tenth of the genes are looked over, so that the funnel has something at every step
    return cg.minimality(per.withColumn("n_leftover", F.floor(F.col("n_leftover") / 12)))


def minimal(spark: SparkSession, d: str) -> DataFrame:
    """CLS20, AGG32: steps of the funnel and how many genomes remain."""
    return cg.funnel(_elements(spark, d))


def inventory(spark: SparkSession, d: str) -> DataFrame:
    """AGG35, SET5: genomes per class, those that hold nothing else, and minimal ones."""
    return cg.class_inventory(_elements(spark, d), spark.createDataFrame(NAMES, "class string, layer string"))


def recounted(spark: SparkSession, d: str) -> DataFrame:
    """CLS35-40, AGG34: short genes with a family accession are looked at again and given a role; what that changes."""
    e = _elements(spark, d).select("element", "classes", "n_leftover", "n_ok_adj", "n_cds", F.col("composition_minimal").alias("was"))
    acc = table(spark, d, "parsed_cds").where("genome_id is not null and locus_tag is not null").select(F.col("genome_id").alias("element"), F.col("locus_tag").alias("key"), "pfam_id", "cds_start", "cds_end").distinct()
    dark = acc.where(F.abs(F.col("cds_end") - F.col("cds_start")) < 400)
    last = F.substring(F.trim(F.coalesce("pfam_id", F.lit(""))), -1, 1)
    role, source, done = cg.overlay([(last == "1", F.lit("AMR"), "first", F.lit(True)), (last == "2", F.lit("leftover"), "second", F.lit(True)), (last.isin("3", "4"), F.lit("ok_adj"), "third", last == "3")], "ok_adj", "dark")
    cds = dark.select("element", role.alias("role"), source.alias("source"), done.alias("resolved"))
    r = cg.minimality(cg.recount(e, cds, ["AMR", "RM", "TA"]))
    return r.select("element", F.array_join("classes", "|").alias("classes"), "char_class", "n_ok_adj", "n_leftover", "n_overlay", "n_unresolved", "added", cg.change(F.col("was"), F.col("composition_minimal"), F.col("n_char_classes"), F.col("n_leftover")).alias("delta"))


_CASE = lambda rules, other: "CASE " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{t}'" for p, t in rules) + f" ELSE '{other}' END"
_G = """rows AS (SELECT DISTINCT genome_id AS element, locus_tag AS key, cds_start AS s, cds_end AS e, product FROM parsed_cds WHERE genome_id IS NOT NULL AND locus_tag IS NOT NULL),
  g AS (SELECT element, key, s, e, (abs(e - s) + 1) // 3 AS aa, coalesce(product, '') AS product, lower(coalesce(product, '')) AS low FROM rows)"""
_BLOB = lambda k: f"coalesce(string_agg(CASE WHEN kind = '{k}' THEN product || '(' || aa || 'aa,' || s || '-' || e || ')' END, '; ' ORDER BY s, e, key), '')"
_E = f"""{_G}, t AS (SELECT element, {_CASE(CLASSES, "leftover")} AS tag FROM g),
  p0 AS (SELECT element, coalesce(list_sort(list(DISTINCT tag) FILTER (tag NOT IN ('ok_adj', 'leftover'))), []) AS classes, sum((tag = 'leftover')::INT)::BIGINT // 12 AS n_leftover, sum((tag = 'ok_adj')::INT)::BIGINT AS n_ok_adj, count(*) AS n_cds FROM t GROUP BY 1)"""


def _minimal(source: str) -> str:
    return f"""m0 AS (SELECT *, list_filter(classes, lambda x: x <> 'replication') AS cargo, list_contains(classes, 'replication') AS has_base FROM {source}),
  m1 AS (SELECT *, CASE WHEN len(cargo) > 0 THEN len(cargo) WHEN has_base THEN 1 ELSE 0 END AS n_char, CASE WHEN len(cargo) > 0 THEN array_to_string(cargo, '|') WHEN has_base THEN 'replication' ELSE '' END AS char_class FROM m0),
  m AS (SELECT *, n_char = 1 AS cm, n_char = 1 AND n_leftover = 0 AS comp, n_char = 1 AND n_leftover = 0 AND n_ok_adj <= 3 AS tight, n_cds <= 6 AS small FROM m1)"""


_METRICS = {
    "all": "count(*)", "class_minimal": "sum(cm::INT)", "composition_minimal": "sum(comp::INT)", "module_plus_rep": "sum((comp AND has_base AND char_class <> 'replication')::INT)",
    "module_or_rep_only": "sum((comp AND NOT (has_base AND char_class <> 'replication'))::INT)", "tight": "sum(tight::INT)", "composition_compact": "sum((comp AND small)::INT)", "compact": "sum((cm AND small)::INT)", "no_class": "sum((n_char = 0)::INT)", "several_classes": "sum((n_char > 1)::INT)",
}
_PAIR = " ".join(f"WHEN regexp_matches(lower(ta), '{p}') THEN '{n}'" for p, n in cg.PAIR_FAMILIES)
QUERIES = {"cls30_kind_scan": scan, "agg32_funnel": minimal, "agg35_inventory": inventory, "cls40_recount": recounted}
ORACLE = {
    "cls30_kind_scan": f"""WITH {_G}, k AS (SELECT *, {_CASE(KINDS, "other")} AS kind FROM g),
  s AS (SELECT element, count(*) AS n_genes, {", ".join(f"sum((kind = '{k}')::INT)::BIGINT AS c_{k}" for k in ("int", "rm", "ta", "rep", "other"))}, {_BLOB("rm")} AS rm, {_BLOB("ta")} AS ta, {_BLOB("other")} AS other FROM k GROUP BY 1)
SELECT element, n_genes, greatest(c_int, 1) AS n_int, c_rm AS n_rm, c_ta AS n_ta, c_rep AS n_rep, c_other AS n_other, rm AS rm_products,
  CASE WHEN c_ta > 0 THEN CASE WHEN regexp_matches(ta, '(?i)toxin') AND regexp_matches(ta, '(?i)antitoxin') THEN 'named pair' WHEN regexp_matches(ta, '(?i)toxin') AND regexp_matches(lower(other), 'helix-turn-helix|transcriptional regulator|hth |hypothetical protein\\(') THEN 'likely pair'
    WHEN regexp_matches(ta, '(?i)antitoxin') AND NOT regexp_matches(ta, '(?i)toxin') THEN 'antitoxin only' ELSE 'toxin only' END END AS pair, CASE WHEN c_ta > 0 THEN CASE {_PAIR} ELSE 'unnamed' END END AS family,
  CASE WHEN c_rm > 0 THEN CASE WHEN regexp_matches(lower(rm), 'restrict|rease') AND contains(lower(rm), 'methyl') THEN 'M+R pair' WHEN contains(lower(rm), 'methyl') THEN 'MTase only' WHEN regexp_matches(lower(rm), 'restrict|rease') THEN 'REase only' ELSE 'M+R pair' END END AS composition,
  c_rm > 0 AND c_rm + c_other <= 3 AS few_extras FROM s""",
    "agg32_funnel": f"WITH {_E}, {_minimal('p0')} " + " UNION ALL ".join(f"SELECT '{k}' AS metric, ({v})::BIGINT AS n FROM m" for k, v in _METRICS.items()),
    "agg35_inventory": f"""WITH {_E}, {_minimal("p0")}, names AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in NAMES)}) v("class", layer)), x AS (SELECT unnest(classes) AS "class", len(classes) = 1 AS only_, char_class, cm, comp, tight FROM m)
SELECT n."class", n.layer, count(x."class") AS n_with, coalesce(sum(only_::INT), 0)::BIGINT AS n_only, coalesce(sum((cm AND char_class = x."class")::INT), 0)::BIGINT AS n_class_minimal, coalesce(sum((comp AND char_class = x."class")::INT), 0)::BIGINT AS n_composition_minimal,
  coalesce(sum((tight AND char_class = x."class")::INT), 0)::BIGINT AS n_tight, CASE WHEN count(x."class") > 0 THEN 'yes' ELSE 'absent' END AS presence FROM names n LEFT JOIN x ON x."class" = n."class" GROUP BY 1, 2""",
    "cls40_recount": f"""WITH {_E}, dark AS (SELECT DISTINCT genome_id AS element, locus_tag, pfam_id, cds_start, cds_end FROM parsed_cds WHERE genome_id IS NOT NULL AND locus_tag IS NOT NULL AND abs(cds_end - cds_start) < 400),
  r AS (SELECT element, right(trim(coalesce(pfam_id, '')), 1) AS z FROM dark),
  a AS (SELECT element, count(*) AS n_overlay, sum((z NOT IN ('1', '2', '3'))::INT)::BIGINT AS n_unresolved, sum((z = '2')::INT)::BIGINT AS l, sum((z IN ('1', '2'))::INT)::BIGINT AS gone, bool_or(z = '1') AS amr FROM r GROUP BY 1),
  old AS (SELECT *, (CASE WHEN len(list_filter(classes, lambda x: x <> 'replication')) > 0 THEN len(list_filter(classes, lambda x: x <> 'replication')) WHEN list_contains(classes, 'replication') THEN 1 ELSE 0 END) = 1 AND n_leftover = 0 AS was FROM p0),
  p1 AS (SELECT element, list_sort(CASE WHEN coalesce(amr, false) AND NOT list_contains(classes, 'AMR') THEN list_append(classes, 'AMR') ELSE classes END) AS classes, n_leftover + coalesce(l, 0) AS n_leftover, greatest(0, n_ok_adj - coalesce(gone, 0)) AS n_ok_adj, n_cds, was,
    coalesce(n_overlay, 0) AS n_overlay, coalesce(n_unresolved, 0) AS n_unresolved, CASE WHEN coalesce(amr, false) AND NOT list_contains(classes, 'AMR') THEN 'AMR' ELSE '' END AS added FROM old LEFT JOIN a USING (element)), {_minimal("p1")}
SELECT element, array_to_string(classes, '|') AS classes, char_class, n_ok_adj, n_leftover, n_overlay, n_unresolved, added, CASE WHEN was AND NOT comp THEN CASE WHEN n_char > 1 THEN 'second_class' WHEN n_leftover > 0 THEN 'named_leftover' ELSE 'lost_class' END WHEN NOT was AND comp THEN 'gained' ELSE '' END AS delta FROM m""",
}
