"""Hit selection, the gate cascade and priority labels on the cases of the survey."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import labels as lb
from brindle.operators.discovery import Limits, audit, best_hits

SITE = "AACCGGTTAACCGGTTACGT"
HIT = "candidate_id string, qstart int, qend int, sstart int, send int, length int, mismatch int, wstart int"
CAND = "candidate_id string, contig string, strand string, anchor_start int, anchor_end int, gene_start int, gene_end int, element_len int, element_has_n boolean, site_seq string, anchor_seq string"


def candidate(i, strand="+", gene=(1000, 1902), site=SITE, anchor="NNNN" + SITE, at=(1, 70), length=5000, n=False):
    return (i, "c1", strand, *at, *gene, length, n, site, anchor)


def test_longest_anchored_hit(spark):
    c = spark.createDataFrame([candidate("a"), candidate("b")], CAND)
    h = spark.createDataFrame([("a", 1, 68, 100, 200, 68, 0, 1000), ("a", 1, 69, 100, 220, 85, 0, 1000), ("a", 1, 50, 100, 150, 50, 0, 1000), ("b", 1, 60, 100, 200, 60, 0, 1000)], HIT)
    assert [(x.candidate_id, x.length, x.n_hits) for x in best_hits(h, c, Limits()).collect()] == [("a", 85, 2)]
    assert best_hits(h.limit(0), c, Limits()).count() == 0


def test_cascade(spark):
    good = lambda i, n=20, **k: (i, k.get("q", 70 - n + 1), 70, 500, 500 + n - 1, n, k.get("mm", 0), 1000)
    broken = dict(site="AAAAAAAA" + SITE[8:], anchor="TTTTTTTT" + ("NNNN" + SITE)[8:])
    cands = [candidate("ok"), candidate("short", gene=(1000, 1500)), candidate("norun", site="AAAA", anchor="TTTT"), candidate("relaxed", **broken), candidate("length", **broken), candidate("gap"), candidate("nohits"), candidate("noanchor"), candidate("inside")]
    hits = [good("ok"), good("short"), good("norun"), good("relaxed", mm=5), good("length", n=16), good("gap", q=1), ("noanchor", 1, 40, 1, 40, 40, 0, 1), ("inside", 51, 70, 1100, 1119, 20, 0, 1000)]
    cds = spark.createDataFrame([("c1", 2000, 3000)], "contig string, start int, end int")
    got = {x.candidate_id: x for x in audit(spark.createDataFrame(cands, CAND), spark.createDataFrame(hits, HIT), cds).collect()}
    assert {k: v.reject_reason for k, v in got.items()} == {"ok": "", "short": "integrase_too_short", "norun": "exact_run_too_short", "relaxed": "", "length": "attl_too_short", "gap": "attl_gapped", "nohits": "v3ps_no_raw_blast", "noanchor": "v3ps_no_strict_hit", "inside": "cds_fully_inside_CDS"}
    assert got["ok"].tier == "exact" and got["relaxed"].tier == "relaxed" and got["ok"].passed and got["ok"].exact_run == 20
    assert not any(got["nohits"][f"passed_{g}"] for g in ("raw", "anchored", "candidate", "gene_len", "intergenic", "site_len", "no_gap"))


def test_no_cds_on_the_contig_is_rejected_and_options_work(spark):
    c = spark.createDataFrame([candidate("a", n=True)], CAND)
    h = spark.createDataFrame([("a", 51, 70, 500, 519, 20, 0, 1000)], HIT)
    other = spark.createDataFrame([("c2", 1, 5)], "contig string, start int, end int")
    assert audit(c, h, other).first().reject_reason == "cds_no_cds_on_contig"
    own = spark.createDataFrame([("c1", 1, 5)], "contig string, start int, end int")
    assert audit(c, h, own, Limits(reject_n=True)).first().reject_reason == "ambiguous_n"
    assert audit(c, h, own, Limits(element_nt=9000)).first().reject_reason == "ie_too_short"


MEANT = {
    "conj.T4SS_ICE": dict(relaxase=True, t4cp=True, virb4=True, integrase=True, conj=0.3, iec=0.2),
    "conj.IME_mobilizable": dict(relaxase=True, integrase=True, conj=0.25, iec=0.2),
    "conj.partial_ICE_or_CIME": dict(relaxase=True, virb4=True, conj=0.2),
    "conj.non_T4SS_machinery": dict(non_t4ss=0.3, integrase=True, iec=0.2),
    "conj.competence_island": dict(competence=0.3, com=True, iec=0.2),
    "conj.Thermus_DSS_ICETh1_like": dict(aice_dss=0.36, iec=0.2),
    "phage.caudoviral.complete": dict(hk97=True, terl=True, element_len=20_000, phage=0.4, iec=0.2, phage_categories=3),
    "phage.inovirus_like": dict(inovirus=0.3, zot=True, inovirus_markers=1, element_len=7_000, iec=0.2),
    "phage.PICI_like": dict(pici=0.2, integrase=True, cpt=True, iec=0.2),
    "phage.satellite_or_dependent": dict(satellite=0.3, phage=0.09, element_len=9_000, iec=0.11),
    "phage.GTA_like_or_particle_like": dict(gta=0.2, iec=0.2),
    "phage.cryptic_prophage_footprint": dict(integrase=True, phage=0.12, phage_categories=1, iec=0.11),
    "mob.integrative_transposon": dict(mobilome=0.3, tn3=True, iec=0.2),
    "mob.integron_like": dict(mobilome=0.22, inti=True, iec=0.2),
    "mob.IS_heavy_microisland": {"is": 0.3, "is_hits": 2, "element_len": 3_000, "iec": 0.1},
    "mob.group2_intron_casposon": dict(mobilome=0.35, casposon=True, iec=0.1),
    "island.PAI_like": dict(integrase=True, pai=0.3, iec=0.2),
    "island.RM_module": dict(integrase=True, rm=0.3, iec=0.2),
    "island.TA_rich": dict(integrase=True, ta=0.3, iec=0.2),
    "rep.AEP_PrimPol_helicase": dict(synteny=True, primpol=True, rep=0.3, iec=0.2),
    "rep.PolA_or_PolB_helicase": dict(pola=True, rep=0.6, iec=0.2),
    "rep.helicase_only": dict(helicase_only=0.2, iec=0.2),
    "other.unclassified_IE": dict(iec=0.9),
}


def test_every_label_has_a_case_that_reaches_it(spark):
    cols = lb.columns_of(lb.ELEMENT_RULES)
    rows = [(name, *[(v.get(c, 0.0) * 1.0 if k == "double" else v.get(c, False)) for c, k in cols.items()]) for name, v in MEANT.items()]
    df = spark.createDataFrame(rows, "meant string, " + ", ".join(f"`{c}` {k}" for c, k in cols.items()))
    got = {x.meant: x.label for x in lb.labelled(df, lb.ELEMENT_RULES, lb.OTHER).collect()}
    assert got == {n: n for n in MEANT}
    anchored = df.where("meant = 'conj.Thermus_DSS_ICETh1_like'").withColumn("dss_anchor", F.lit(True))
    assert lb.labelled(anchored, lb.ELEMENT_RULES, lb.OTHER).first().label == lb.OTHER  # the anchor raises the threshold
    shuffled = lb.labelled(df.orderBy(F.rand(3)).repartition(5), lb.ELEMENT_RULES, lb.OTHER).collect()
    assert {x.meant: x.label for x in shuffled} == got
    c = {x[0] for x in lb.labelled(df, lb.ELEMENT_RULES, lb.OTHER).select(lb.coarse(F.col("label"))).collect()}
    assert c == {"conj", "phage_caudoviral", "phage_inovirus", "phage_gta", "phage_pici", "mob_element", "island_module", "rep", "unclassified"}


def test_families_of_labels(spark):
    want = {
        "phage.PICI_like": "phage_pici",
        "phage.satellite_or_dependent": "phage_gta",
        " phage.caudoviral.complete ": "phage_caudoviral",
        "phage.something_new": "unclassified",
        "mob.integron_like": "mob_element",
        "mob.other": "unclassified",
        "island.TA_rich": "island_module",
        "island.x": "unclassified",
        "conj.anything": "conj",
        "rep.x": "rep",
        "other.unclassified_IE": "unclassified",
        "": "unclassified",
        None: "unclassified",
    }
    df = spark.createDataFrame([(k,) for k in want], "label string")
    assert {x.label: x.c for x in df.select("label", lb.coarse(F.col("label")).alias("c")).collect()} == want


def test_unknown_conditions_are_refused():
    with pytest.raises(ValueError):
        lb.condition(("sometimes", "x"))
