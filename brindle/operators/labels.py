"""Priority labels: a rule base of gates over score, flag and count columns, compiled into one CASE.

A gate is a list of conditions; the first label whose conditions all hold wins. Conditions are small tuples:
("min", column, value), ("max", column, value), ("flag", column), ("not", column), ("any", conditions), ("all",
conditions), ("none", conditions), ("count", conditions, least). They can come from a file as well as from code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.cascade import first_match


def condition(c: tuple) -> Column:
    kind = c[0]
    if kind == "min":
        return F.coalesce(F.col(c[1]) >= F.lit(c[2]), F.lit(False))
    if kind == "max":
        return F.coalesce(F.col(c[1]) <= F.lit(c[2]), F.lit(False))
    if kind == "flag":
        return F.coalesce(F.col(c[1]), F.lit(False))
    if kind == "not":
        return ~F.coalesce(F.col(c[1]), F.lit(False))
    if kind not in ("all", "any", "none", "count"):
        raise ValueError(f"unknown condition {kind!r}")
    parts = [condition(tuple(x)) for x in c[1]]
    if kind == "all":
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    if kind == "any":
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    if kind == "none":
        return ~reduce(lambda a, b: a | b, parts, F.lit(False))
    return sum((p.cast("int") for p in parts), F.lit(0)) >= c[2]


def labelled(df: DataFrame, rules: list[tuple[str, list[tuple]]], default: str, out: str = "label") -> DataFrame:
    return df.withColumn(out, first_match([(condition(("all", gate)), name) for name, gate in rules], default))


NO_CONJ = [("none", [("min", "conj", 0.11), ("flag", "relaxase"), ("flag", "t4cp"), ("flag", "virb4")])]
NOT_FULL = [("none", [("all", [("flag", "terl"), ("flag", "hk97")])])]
THREE = [("flag", "relaxase"), ("flag", "t4cp"), ("flag", "virb4")]
REPLICATION = [("max", "structural", 0.55), ("max", "conj", 0.92), ("min", "iec", 0.12)]

# Labels in order of priority with their thresholds. iec is the boosted core score; the anchored and the
# unanchored threshold of the sixth label stand as they are used, the higher one with an anchor.
ELEMENT_RULES: list[tuple[str, list[tuple]]] = [
    ("conj.T4SS_ICE", [("all", THREE), ("any", [("flag", "integrase"), ("min", "iec", 0.15)]), ("min", "conj", 0.27), ("min", "iec", 0.18)]),
    ("conj.IME_mobilizable", [("flag", "relaxase"), ("flag", "integrase"), ("none", [("all", [("flag", "virb4"), ("min", "conj", 0.30)])]), ("min", "conj", 0.21), ("none", [("all", [("flag", "synteny"), ("flag", "primpol"), ("min", "rep", 0.25)])]), ("min", "iec", 0.15)]),
    ("conj.partial_ICE_or_CIME", [("min", "conj", 0.11), ("any", [("all", [("count", THREE, 2), ("none", [("all", THREE)])]), ("all", [("flag", "virb4"), ("not", "relaxase")])])]),
    ("conj.non_T4SS_machinery", [("none", [("all", THREE)]), ("min", "non_t4ss", 0.24), ("max", "conj", 0.55), ("any", [("flag", "integrase"), ("min", "iec", 0.15)]), ("min", "iec", 0.12)]),
    ("conj.competence_island", [("min", "competence", 0.28), ("any", [("flag", "integrase"), ("flag", "com")]), ("min", "iec", 0.12)]),
    ("conj.Thermus_DSS_ICETh1_like", [("any", [("all", [("not", "dss_anchor"), ("min", "aice_dss", 0.35)]), ("all", [("flag", "dss_anchor"), ("min", "aice_dss", 0.45)])]), ("min", "iec", 0.12)]),
    ("phage.caudoviral.complete", [*NO_CONJ, ("flag", "hk97"), ("flag", "terl"), ("min", "element_len", 10_000), ("min", "phage", 0.20), ("min", "iec", 0.15), ("min", "phage_categories", 1)]),
    ("phage.inovirus_like", [*NO_CONJ, ("min", "inovirus", 0.20), ("flag", "zot"), ("min", "inovirus_markers", 1), ("max", "element_len", 20_000), ("min", "iec", 0.12)]),
    ("phage.PICI_like", [*NO_CONJ, *NOT_FULL, ("min", "pici", 0.18), ("flag", "integrase"), ("any", [("flag", "cpt"), ("min", "phage_reg_hits", 2)]), ("min", "iec", 0.12)]),
    ("phage.satellite_or_dependent", [*NO_CONJ, *NOT_FULL, ("min", "satellite", 0.22), ("min", "phage", 0.08), ("max", "element_len", 15_000), ("min", "iec", 0.10)]),
    ("phage.GTA_like_or_particle_like", [*NO_CONJ, *NOT_FULL, ("any", [("min", "phage", 0.14), ("min", "gta", 0.12)]), ("min", "iec", 0.12)]),
    ("phage.cryptic_prophage_footprint", [*NO_CONJ, *NOT_FULL, ("flag", "integrase"), ("min", "phage", 0.10), ("max", "phage_categories", 2), ("min", "iec", 0.10)]),
    ("mob.integrative_transposon", [("min", "mobilome", 0.24), ("max", "conj", 0.45), ("none", [("all", [("min", "is_hits", 2), ("not", "tn3")])]), ("any", [("flag", "tn3"), ("all", [("flag", "tn"), ("flag", "integrase")])]), ("min", "iec", 0.10)]),
    ("mob.integron_like", [("min", "mobilome", 0.20), ("any", [("flag", "inti"), ("all", [("flag", "attc"), ("flag", "integrase")])]), ("min", "iec", 0.10)]),
    ("mob.IS_heavy_microisland", [("not", "tn3"), ("max", "element_len", 6_000), ("min", "is", 0.22), ("max", "rep", 0.45), ("any", [("min", "is_hits", 2), ("all", [("min", "is_hits", 1), ("flag", "integrase")])]), ("min", "iec", 0.08)]),
    ("mob.group2_intron_casposon", [("min", "mobilome", 0.30), ("any", [("flag", "group2_rt"), ("flag", "casposon")]), ("min", "iec", 0.08)]),
    ("island.PAI_like", [("flag", "integrase"), ("min", "pai", 0.22), ("max", "conj", 0.40), ("max", "phage", 0.55), ("min", "iec", 0.12)]),
    ("island.RM_module", [("flag", "integrase"), ("min", "rm", 0.22), ("max", "rep", 0.40), ("max", "conj", 0.40), ("min", "iec", 0.10)]),
    ("island.TA_rich", [("flag", "integrase"), ("min", "ta", 0.22), ("max", "rep", 0.35), ("min", "iec", 0.10)]),
    ("rep.AEP_PrimPol_helicase", [*REPLICATION, ("flag", "synteny"), ("flag", "primpol"), ("min", "rep", 0.27)]),
    ("rep.PolA_or_PolB_helicase", [*REPLICATION, ("any", [("flag", "pola"), ("flag", "polb")]), ("min", "rep", 0.27), ("any", [("flag", "synteny"), ("min", "rep", 0.55)])]),
    ("rep.helicase_only", [*REPLICATION, ("none", [("flag", "primpol"), ("flag", "pola"), ("flag", "polb")]), ("min", "helicase_only", 0.17)]),
]
OTHER = "other.unclassified_IE"


def columns_of(rules: list[tuple[str, list[tuple]]]) -> dict[str, str]:
    """The columns a rule base reads: name -> ``double`` or ``boolean``."""
    out: dict[str, str] = {}

    def walk(c: tuple) -> None:
        if c[0] in ("min", "max"):
            out[c[1]] = "double"
        elif c[0] in ("flag", "not"):
            out[c[1]] = "boolean"
        else:
            for x in c[1]:
                walk(tuple(x))

    for _, gate in rules:
        for c in gate:
            walk(tuple(c))
    return out


# Family of each label; labels of the families conj and rep go by their first part.
FAMILIES = {
    "phage.caudoviral.complete": "phage_caudoviral",
    "phage.inovirus_like": "phage_inovirus",
    "phage.GTA_like_or_particle_like": "phage_gta",
    "phage.satellite_or_dependent": "phage_gta",
    "phage.cryptic_prophage_footprint": "phage_gta",
    "phage.PICI_like": "phage_pici",
    "mob.integrative_transposon": "mob_element",
    "mob.IS_heavy_microisland": "mob_element",
    "mob.integron_like": "mob_element",
    "mob.group2_intron_casposon": "mob_element",
    "island.PAI_like": "island_module",
    "island.RM_module": "island_module",
    "island.TA_rich": "island_module",
}


def coarse(label: Column) -> Column:
    """Family of a label; white space around it goes, null and unknown labels are unclassified."""
    l = F.trim(F.coalesce(label, F.lit("")))
    known = F.coalesce(*[F.when(l == name, F.lit(family)) for name, family in FAMILIES.items()])
    return F.coalesce(known, F.when(l.startswith("conj."), "conj").when(l.startswith("rep."), "rep").otherwise("unclassified"))


def confidence(core: Column, top: Column) -> Column:
    return F.when((core >= 0.32) & (top >= 0.38), "high").when((core >= 0.22) & (top >= 0.18), "medium").otherwise("low")
