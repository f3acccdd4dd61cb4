"""Element classification over ``orders`` as elements and ``lineitem`` x ``part`` as their genes: text = part name, type and brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import elements as el
from brindle.operators import labels as lb
from brindle.operators import rules
from brindle.session import table

MARKERS = [
    rules.Marker("integrase", "IE_core", 0.54, patterns=("brand#1",)),
    rules.Marker("terl", "phage_packaging", 0.45, patterns=("promo",)),
    rules.Marker("hk97_mcp", "phage_head", 0.5, patterns=("brand#2[1-3]",)),
    rules.Marker("relaxase", "conjugation", 0.4, patterns=("economy anodized",)),
    rules.Marker("virb4", "conjugation", 0.35, patterns=("brand#31",)),
    rules.Marker("t4cp", "conjugation", 0.3, patterns=("brand#32",)),
    rules.Marker("primpol_aep", "replication", 0.4, patterns=("small",)),
    rules.Marker("helicase", "replication", 0.3, patterns=("medium",)),
    rules.Marker("inov_zot", "inovirus", 0.5, patterns=("brand#41",)),
    rules.Marker("phage_reg", "PICI", 0.3, patterns=("large burnished",)),
    rules.Marker("tn3", "mobilome", 0.6, patterns=("brand#42",)),
    rules.Marker("is_element", "IS", 0.4, patterns=("brand#4[3-5]",)),
    rules.Marker("ta_system", "TA_island", 0.4, patterns=("large plated",)),
    rules.Marker("com", "competence", 0.5, patterns=("brand#51",)),
    rules.Marker("parA", "plasmid", 0.5, patterns=("brand#52",)),
    rules.Marker("repABC", "AICE", 0.6, patterns=("brand#53",)),
    rules.Marker("sat", "satellite", 0.35, patterns=("standard polished",)),
]


def genes(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    text = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("product"))
    start = (F.col("l_linenumber") * 1000).cast("long")
    return line.join(text, "l_partkey").select(
        F.col("l_orderkey").alias("element"), (F.col("l_linenumber") - 1).cast("int").alias("idx"), start.alias("start"), (start + F.col("l_quantity").cast("long") * 30).alias("end"),
        F.concat_ws("_", F.lit("L"), F.col("l_partkey").cast("string")).alias("locus_tag"), (F.col("l_returnflag") != "N").alias("annotated"), "product",
    )


def meta(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("element"), F.when(F.col("o_orderpriority").startswith("1"), "Leu").otherwise("").alias("trna_type"), F.when(key % 3 == 0, "L_x").otherwise("").alias("integrase_lookup"),
        (F.col("o_orderstatus") == "F").alias("has_att"), F.when(key % 2 == 0, F.floor("o_totalprice").cast("string")).otherwise(F.lit("")).alias("ie_len"),
    )


def classified(spark: SparkSession, d: str) -> DataFrame:
    """CLS1-13, AGG7-16, AUX1-12: every order as an element, from gene texts to label, confidence, flags and novelty."""
    g = genes(spark, d)
    hits = rules.marker_hits(g, MARKERS, "product").select("element", "idx", "key", "category", "weight")
    r = el.classify(hits, g, meta(spark, d))
    flat = {c: F.array_join(c, "|") for c in ("secondary_flags", "runner_up_modules", "conflict_notes")}
    alt = F.array_join(F.transform("alternates", lambda x: F.concat_ws(":", x["module"], F.coalesce(x["label"], F.lit("-")))), "|")
    return r.select("element", "primary_label", "coarse_label", "subtype", "confidence", *[e.alias(c) for c, e in flat.items()], alt.alias("alternates"), "candidate", "novel_tier", "novel_rationale", "annotation_coverage", "n_cds", "element_len", "core_score", "score_phage", "score_conj", "score_rep", "score_island", "score_ta")


def _sql(c: tuple) -> str:
    kind = c[0]
    if kind == "min":
        return f'"{c[1]}" >= {c[2]}'
    if kind == "max":
        return f'"{c[1]}" <= {c[2]}'
    if kind == "flag":
        return f'"{c[1]}"'
    if kind == "not":
        return f'NOT "{c[1]}"'
    parts = [f"({_sql(x)})" for x in c[1]]
    if kind == "count":
        return " + ".join(f"{p}::INT" for p in parts) + f" >= {c[2]}"
    return {"all": " AND ", "any": " OR ", "none": " OR "}[kind].join(parts) if kind != "none" else "NOT (" + " OR ".join(parts) + ")"


def _oracle() -> str:
    hits = " UNION ALL ".join(f"SELECT element, idx, '{m.key}' AS key, '{m.category}' AS cat, CAST({m.weight} AS DOUBLE) AS w FROM g WHERE " + " OR ".join(f"regexp_matches(product, '{p}')" for p in m.patterns) for m in MARKERS)
    by = lambda cats, keys: "cat IN (" + ", ".join(f"'{c}'" for c in cats) + ")" if cats else "key IN (" + ", ".join(f"'{k}'" for k in keys) + ")"
    sums = ", ".join(f'coalesce(sum(CASE WHEN {by(*v)} THEN w END), 0) AS "s{n}"' for n, v in el.SCORES.items())
    keys = {"terl": "terl", "hk97": "hk97_mcp", "relaxase": "relaxase", "t4cp": "t4cp", "virb4": "virb4", "integrase": "integrase", "zot": "inov_zot", "cpt": "cpt", "com": "com", "dss_anchor": "dss_anchor", "tn3": "tn3", "tn": "tn", "inti": "inti", "attc": "attc", "group2_rt": "group2_rt", "casposon": "casposon", "primpol": "primpol_aep", "pola": "dna_pol_a", "polb": "dna_pol_b"}
    flags = ", ".join(f"coalesce(bool_or(key = '{k}'), false) AS \"{n}\"" for n, k in keys.items())
    score = {n: f'least(1.0, "s{n}" / 1.22)' for n in el.SCORES}
    score |= {
        "mobilization": f"least(1.0, {score['conj']} * 0.9)",
        "aice_dss": f"least(1.0, {score['_aice']} * 1.0 + {score['_dss']} * 0.3 + {score['_repabc']} * 0.2)",
        "helicase_only": f"CASE WHEN n_pol > 0 THEN 0 ELSE {score['_helicase']} END",
        "pici": f"greatest({score['_pici']}, {score['_reg']})",
        "ta": f"greatest({score['_ta']}, {score['_ta_key']})",
        "gta": f"greatest({score['satellite']}, {score['_gta']})",
        "structural": score["_structural"],
        "plain_core": f"least(1.0, {score['_integrase']} * 1.12)",
    }
    score["island"] = f"least(1.0, {score['pai']} + {score['rm']} * 0.85 + {score['ta']} * 0.75)"
    shown = ", ".join(f'{e} AS "{n}"' for n, e in score.items() if not n.startswith("_"))
    gates = " ".join(f"WHEN {_sql(('all', gate))} THEN '{name}'" for name, gate in lb.ELEMENT_RULES)
    top = "greatest(" + ", ".join(f'"{n}"' for n in el.SPECIAL) + ")"
    strong = "(" + " + ".join(f'("{n}" >= 0.35)::INT' for n in el.SPECIAL) + ")"
    strong_names = "concat_ws(',', " + ", ".join(f"CASE WHEN \"{n}\" >= 0.35 THEN '{n}' END" for n in el.SPECIAL) + ")"
    sec = ", ".join(f"CASE WHEN \"{c}\" >= {v} THEN '{n}' END" for n, (c, v) in el.Scheme().flags.items())
    ranked = ", ".join(f"{{'s': -\"{n}\", 'i': {i}, 'n': '{n}', 'l': '{el.HINTS.get(n, '-')}'}}" for i, n in enumerate(el.RANKED))
    fam = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lb.FAMILIES.items())
    return f"""WITH g AS (SELECT l_orderkey AS element, (l_linenumber - 1)::INT AS idx, l_linenumber * 1000 AS a, l_linenumber * 1000 + floor(l_quantity)::BIGINT * 30 AS b, l_returnflag <> 'N' AS annotated,
    lower(concat_ws(' ', p_name, p_type, p_brand)) AS product FROM lineitem JOIN part ON p_partkey = l_partkey),
  hits AS ({hits}),
  one AS (SELECT element, key, cat, min_by(w, idx) AS w, count(*) AS n FROM hits GROUP BY ALL),
  per AS (SELECT element, {sums}, {flags}, count(DISTINCT CASE WHEN key LIKE 'inov_%' THEN key END) AS inovirus_markers, count(DISTINCT CASE WHEN cat LIKE 'phage%' THEN cat END) AS phage_categories,
    coalesce(sum(CASE WHEN key = 'phage_reg' THEN n END), 0) AS phage_reg_hits, coalesce(sum(CASE WHEN key = 'is_element' THEN n END), 0) AS is_hits, count(DISTINCT CASE WHEN key IN ('primpol_aep', 'dna_pol_a', 'dna_pol_b') THEN key END) AS n_pol FROM one GROUP BY 1),
  near AS (SELECT DISTINCT p.element FROM hits p JOIN hits h ON h.element = p.element AND abs(h.idx - p.idx) <= 8 WHERE p.key = 'primpol_aep' AND h.key = 'helicase'),
  size AS (SELECT element, count(*) AS n_cds, avg(annotated::INT) AS cov, max(b) - min(a) + 1 AS extent FROM g GROUP BY 1),
  e AS (SELECT o_orderkey AS element, o_orderpriority LIKE '1%' AS trna, o_orderkey % 3 = 0 AS own, o_orderstatus = 'F' AS att, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice)::BIGINT END AS told FROM orders),
  r AS (SELECT e.*, coalesce(n_cds, 0) AS n_cds, coalesce(cov, 0) AS cov, coalesce(told, extent, 0) AS element_len, near.element IS NOT NULL AS synteny, per.* EXCLUDE (element), size.element IS NOT NULL AS has_genes
    FROM e LEFT JOIN size USING (element) LEFT JOIN per USING (element) LEFT JOIN near USING (element)),
  z AS (SELECT element, trna, own AND has_genes AS own, att, n_cds, cov, element_len, synteny, {", ".join(f'coalesce("s{n}", 0) AS "s{n}"' for n in el.SCORES)}, {", ".join(f'coalesce("{n}", false) AS "{n}"' for n in keys)},
    {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("inovirus_markers", "phage_categories", "phage_reg_hits", "is_hits", "n_pol"))} FROM r),
  s AS (SELECT z.*, {shown} FROM z),
  b AS (SELECT *, least(1.0, least(1.0, least(1.0, plain_core + CASE WHEN trna THEN 0.15 ELSE 0 END) + CASE WHEN own THEN 0.1 ELSE 0 END) + CASE WHEN att THEN 0.08 ELSE 0 END) AS iec FROM s),
  l AS (SELECT *, CASE {gates} ELSE '{lb.OTHER}' END AS label0, terl AND NOT hk97 AS only_ FROM b),
  c AS (SELECT *, CASE WHEN label0 = 'phage.caudoviral.complete' AND only_ THEN 'phage.cryptic_prophage_footprint' WHEN label0 = 'phage.caudoviral.complete' AND phage_categories < 1 AND gta >= 0.12 THEN 'phage.GTA_like_or_particle_like'
      WHEN label0 = 'phage.caudoviral.complete' AND phage_categories < 1 THEN 'phage.cryptic_prophage_footprint' ELSE label0 END AS label,
    CASE WHEN label0 = 'phage.caudoviral.complete' AND (only_ OR phage_categories < 1) THEN 'medium' WHEN iec >= 0.32 AND {top} >= 0.38 THEN CASE WHEN label0 = 'phage.caudoviral.complete' AND NOT (terl AND hk97) THEN 'medium' ELSE 'high' END
      WHEN iec >= 0.22 AND {top} >= 0.18 THEN 'medium' ELSE 'low' END AS conf, list_sort([{ranked}]) AS ranks FROM l),
  n AS (SELECT *, concat_ws('; ', CASE WHEN label = '{lb.OTHER}' AND plain_core >= 0.35 AND cov >= 0.4 AND host <= 0.55 THEN 'unclassified_with_strong_IE_core_and_coverage' END,
      CASE WHEN {strong} >= 2 AND host <= 0.55 THEN 'multi_module_conflict_n=' || {strong} || '>=2' END,
      CASE WHEN label = '{lb.OTHER}' AND {top} < 0.22 AND plain_core >= 0.35 * 0.85 AND cov >= 0.35 AND host <= 0.55 THEN 'all_specialized_modules_weak' END) AS why FROM c)
SELECT element, label AS primary_label, CASE label {fam} ELSE CASE WHEN label LIKE 'conj.%' THEN 'conj' WHEN label LIKE 'rep.%' THEN 'rep' ELSE 'unclassified' END END AS coarse_label,
  CASE WHEN label LIKE 'phage.%' AND plasmid > 0.35 THEN 'phage_plasmid_like' ELSE '' END AS subtype, conf AS confidence, concat_ws('|', {sec}) AS secondary_flags, array_to_string([x.n FOR x IN ranks[1:3]], '|') AS runner_up_modules,
  concat_ws('|', CASE WHEN only_ AND phage > 0.4 THEN 'packaging_only_structural: anti_phage_overcall' END, CASE WHEN {strong} >= 2 THEN 'strong_modules:' || {strong_names} END) AS conflict_notes,
  array_to_string([x.n || ':' || x.l FOR x IN list_filter(ranks[1:6], lambda x: -x.s >= 0.08)[1:3]], '|') AS alternates, why <> '' AS candidate,
  CASE WHEN why = '' THEN 'none' WHEN plain_core >= 0.45 AND {top} <= 0.35 THEN 'high_interest' WHEN label = '{lb.OTHER}' AND plain_core >= 0.35 THEN 'medium' ELSE 'watchlist' END AS novel_tier, why AS novel_rationale,
  round_even(cov, 4) AS annotation_coverage, n_cds, element_len::DOUBLE AS element_len, round_even(plain_core, 6) AS core_score, round_even(phage, 6) AS score_phage, round_even(conj, 6) AS score_conj, round_even(rep, 6) AS score_rep,
  round_even(island, 6) AS score_island, round_even(ta, 6) AS score_ta FROM n"""


QUERIES = {"cls3_classified": classified}
ORACLE = {"cls3_classified": _oracle()}
