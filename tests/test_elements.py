"""Element classification: scores, fallbacks, caps, error records, detector hits."""

from pyspark.sql import functions as F

from brindle.operators import elements as el
from brindle.operators import labels as lb

META = "element string, trna_type string, integrase_lookup string, has_att boolean, ie_len string"
HITS = "element string, idx int, key string, category string, weight double"
GENES = "element string, idx int, start int, end int, locus_tag string, annotated boolean"


def run(spark, hits, genes, meta, **how):
    return {r.element: r for r in el.classify(spark.createDataFrame(hits, HITS).repartition(3), spark.createDataFrame(genes, GENES), spark.createDataFrame(meta, META), **how).collect()}


def test_labels_flags_and_novelty(spark):
    genes = [("ice", i, 1000 * i + 1, 1000 * i + 900, f"A_{i}", i % 2 == 0) for i in range(8)] + [("cau", i, 2000 * i + 1, 2000 * i + 900, f"B_{i}", True) for i in range(7)]
    genes += [("bare", 0, 11, 400, "C_1", None), ("odd", 0, 1, 900, "D_1", True)]
    hits = [("ice", 0, "integrase", "IE_core", 0.54), ("ice", 1, "relaxase", "conjugation", 0.4), ("ice", 2, "t4cp", "conjugation", 0.4), ("ice", 3, "virb4", "conjugation", 0.4)]
    hits += [("ice", 5, "relaxase", "conjugation", 9.0)]  # a key counts once, with the weight of its first gene
    hits += [("cau", 0, "integrase", "IE_core", 0.54), ("cau", 1, "terl", "phage_packaging", 0.5), ("cau", 2, "hk97_mcp", "phage_head", 0.5)]
    hits += [("odd", 0, "integrase", "IE_core", None)]
    meta = [("ice", "Leu", "A_x", True, ""), ("cau", "", "", False, "x12"), ("bare", None, None, None, None), ("odd", "", "", False, "12.7"), ("alone", "", "", False, "500")]
    got = run(spark, hits, genes, meta)
    ice = got["ice"]
    assert (ice.primary_label, ice.coarse_label, ice.confidence) == ("conj.T4SS_ICE", "conj", "high") and ice.secondary_flags == ["has_conjugation_markers"]
    assert abs(ice.score_conj - 1.2 / 1.22) < 1e-6 and ice.annotation_coverage == 0.5 and ice.element_len == 7900.0 and ice.n_cds == 8
    assert ice.runner_up_modules[0] == "conj" and ice.alternates[0]["label"] == "conj.partial_ICE_or_CIME"
    assert (got["cau"].primary_label, got["cau"].element_len) == ("phage.caudoviral.complete", 12900.0)  # a length that is no number is none
    for e in ("bare", "alone"):
        assert (got[e].primary_label, got[e].confidence, got[e].novel_tier, got[e].candidate) == (lb.OTHER, "low", "none", False)
    assert got["alone"].n_cds == 0 and got["alone"].element_len == 500.0 and got["bare"].annotation_coverage == 0.0
    odd = got["odd"]
    assert odd.element_len == 12.0 and abs(odd.core_score - round(0.5 / 1.22 * 1.12, 6)) < 1e-9  # a null weight is 0.5
    assert odd.candidate and odd.novel_tier == "high_interest" and odd.novel_rationale == "unclassified_with_strong_IE_core_and_coverage; all_specialized_modules_weak"
    capped = run(spark, hits, genes, meta, scheme=el.Scheme(categories_for_complete=3))["cau"]
    assert (capped.primary_label, capped.confidence) == ("phage.cryptic_prophage_footprint", "medium")
    damped = run(spark, hits, genes, meta, scheme=el.Scheme(damped=True))["ice"]
    assert abs(damped.score_conj - round(1.2 / (2.5 * (1 + 7 * 0.12) ** 0.5), 6)) < 1e-6


def test_missing_inputs_detectors_and_targets(spark):
    hits = spark.createDataFrame([("a", 0, "integrase", "IE_core", 0.54), ("a", 2, "terl", "phage_packaging", 0.5)], HITS)
    genes = spark.createDataFrame([("a", i, i * 10 + 1, i * 10 + 9, f"a_{i}", True) for i in range(4)] + [("b", i, 1, 9, f"b_{i}", True) for i in range(2)], GENES)
    meta = spark.createDataFrame([(x, "", "", False, "") for x in "abc"], META)
    done = el.classify(hits, genes, meta.where("element <> 'c'"))
    lost = el.error_records(meta, done, F.lit("no_rep_index_match_for_cluster"), done)
    both = {r.element: r for r in done.unionByName(lost).collect()}
    assert set(both) == {"a", "b", "c"} and both["c"].error == "no_rep_index_match_for_cluster" and both["c"].conflict_notes == [both["c"].error] and both["c"].score_conj == 0
    assert {r.element for r in el.classify_missing(done.where("element = 'a'"), hits, genes, meta).collect()} == {"b", "c"}
    more = spark.createDataFrame([("a", 0, "integrase", "other", 9.0), ("b", 1, "virb4", "conjugation", None)], HITS)
    assert sorted(tuple(r) for r in el.add_hits(hits, more).collect()) == [("a", 0, "integrase", "IE_core", 0.54), ("a", 2, "terl", "phage_packaging", 0.5), ("b", 1, "virb4", "conjugation", 0.5)]
    assert sorted(tuple(r) for r in el.target_genes(genes, hits).collect()) == [("a", 0), ("b", 0)]
    assert sorted(tuple(r) for r in el.target_genes(genes, hits.where("key = 'terl'")).collect()) == [("a", 2), ("b", 0)]
    assert el.classify(hits.limit(0), genes.limit(0), meta.limit(0)).count() == 0
