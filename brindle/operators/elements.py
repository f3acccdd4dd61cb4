"""Classification of elements from end to end: genes with marker hits -> scores, flags, label, confidence, novelty.

Everything is one aggregation over (element, marker key) and column expressions over its result; rule values are data
(``Scheme``, ``labels.ELEMENT_RULES``). Genes may come in any order and repeatedly: a marker key counts once per element with
the weight of its first gene.

Defined cases: an element without genes or hits has zero scores and the default label; null weights count as 0.5; an element
whose input is missing is an error record (``error_records``); columns are read by name, others are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import labels as lb
from brindle.operators.cascade import all_matches
from brindle.operators.intervals import near_in_order
from brindle.operators.rules import runner_up
from brindle.session import cut_table

# Score -> categories and keys whose markers it sums. Public scores first, helpers begin with an underscore.
SCORES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "phage": (("phage_packaging", "phage_head", "phage_tail", "phage_connector"), ()),
    "_structural": (("phage_head", "phage_tail", "phage_connector"), ()),
    "inovirus": (("inovirus",), ()),
    "conj": (("conjugation",), ()),
    "rep": (("replication",), ()),
    "plasmid": (("plasmid",), ()),
    "host": (("host",), ()),
    "mobilome": (("mobilome",), ()),
    "is": (("IS",), ()),
    "pai": (("PAI",), ()),
    "rm": (("RM_island",), ()),
    "competence": (("competence",), ()),
    "non_t4ss": (("conj_non_t4ss",), ()),
    "satellite": (("satellite",), ()),
    "_integrase": ((), ("integrase",)),
    "_aice": (("AICE",), ()),
    "_dss": (("DSS",), ()),
    "_repabc": ((), ("repABC",)),
    "_helicase": ((), ("helicase",)),
    "_pici": (("PICI",), ()),
    "_reg": ((), ("phage_reg",)),
    "_ta": (("TA_island",), ()),
    "_ta_key": ((), ("ta_system",)),
    "_gta": ((), ("gta_marker",)),
}
POLYMERASES = ("primpol_aep", "dna_pol_a", "dna_pol_b")
PHAGE = ("phage_packaging", "phage_head", "phage_tail", "phage_connector", "phage_lysis", "phage_reg")  # categories that are counted
# Flag -> keys that raise it.
FLAGS = {
    "terl": ("terl",), "hk97": ("hk97_mcp",), "portal_or_mcp": ("portal", "mcp", "hk97_mcp"), "tail_or_connector": ("tail", "connector"), "relaxase": ("relaxase",), "t4cp": ("t4cp",), "virb4": ("virb4",),
    "integrase": ("integrase",), "zot": ("inov_zot",), "cpt": ("cpt",), "com": ("com",), "dss_anchor": ("dss_anchor",), "tn3": ("tn3",), "tn": ("tn",), "inti": ("inti",), "attc": ("attc",),
    "group2_rt": ("group2_rt",), "casposon": ("casposon",), "primpol": ("primpol_aep",), "pola": ("dna_pol_a",), "polb": ("dna_pol_b",),
}
INOVIRUS = ("inov_zot", "inov_rcr", "inov_rep", "inov_ssb", "inov_coat", "inov_assembly")
# The scores that are ranked as runners-up, in their order, and the label each would suggest.
RANKED = ("phage", "inovirus", "conj", "aice_dss", "rep", "helicase_only", "plasmid", "host", "pici", "mobilome", "island", "competence", "gta", "satellite", "is")
HINTS = {
    "phage": "phage.cryptic_prophage_footprint",
    "gta": "phage.GTA_like_or_particle_like",
    "inovirus": "phage.inovirus_like",
    "conj": "conj.partial_ICE_or_CIME",
    "competence": "conj.competence_island",
    "pici": "phage.PICI_like",
    "mobilome": "mob.integrative_transposon",
    "island": "island.PAI_like",
    "aice_dss": "conj.Thermus_DSS_ICETh1_like",
    "rep": "rep.AEP_PrimPol_helicase",
    "plasmid": "island.TA_rich",
}
SPECIAL = ("phage", "inovirus", "conj", "aice_dss", "rep", "pici", "mobilome", "island", "gta")


@dataclass(frozen=True)
class Scheme:
    """How weights become scores, and the thresholds around the label rules (fixed values, as defaults)."""

    scale: float = 1.22
    cap: float = 1.0
    damped: bool = False
    slope: float = 0.12
    divisor: float = 2.5
    core_boost: float = 1.12
    mix: tuple[float, float, float] = (1.0, 0.3, 0.2)  # of the AICE, DSS and repABC sums
    window: int = 8
    flags: dict[str, tuple[str, float]] = field(
        default_factory=lambda: {
            "has_phage_markers": ("phage", 0.12),
            "has_conjugation_markers": ("conj", 0.12),
            "has_replication_module": ("rep", 0.15),
            "has_plasmid_maintenance": ("plasmid", 0.15),
            "has_mobilome_markers": ("mobilome", 0.22),
            "has_island_module_markers": ("island", 0.22),
        }
    )
    special: tuple[str, ...] = SPECIAL
    novel_core: float = 0.35
    novel_coverage: float = 0.4
    novel_weak_coverage: float = 0.35
    novel_host: float = 0.55
    conflict_score: float = 0.35
    conflict_labels: int = 2
    weak: float = 0.22
    interest_core: float = 0.45
    interest_top: float = 0.35
    categories_for_complete: int = 1


def element_scores(hits: DataFrame, genes: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """(element, score columns, flag and count columns, n_cds, annotation_coverage) of every element of ``genes``.

    Hits: element, idx, key, category, weight. Genes: element, idx, start, end, annotated (boolean).
    """
    size = genes.groupBy("element").agg(
        F.count(F.lit(1)).alias("n_cds"),
        F.avg(F.coalesce(F.col("annotated"), F.lit(False)).cast("double")).alias("annotation_coverage"),
        (F.max("end") - F.min("start") + 1).alias("_extent"),
    )
    hits = cut_table(hits.select("element", "idx", "key", "category", "weight"))  # matching is the dear part, and both steps below need its hits
    one = hits.groupBy("element", "key", "category").agg(F.coalesce(F.min_by("weight", "idx"), F.lit(0.5)).alias("w"), F.count(F.lit(1)).alias("n"))
    key, cat = F.col("key"), F.col("category")
    total = lambda cond: F.sum(F.when(cond, F.col("w")).otherwise(F.lit(0.0)))
    sums = []
    for name, (cats, keys) in SCORES.items():
        sums.append(total(cat.isin(*cats) if cats else key.isin(*keys)).alias(f"_sum_{name}"))
    # which keys and categories an element has are the bits of one number each, not an aggregate for every flag
    known = list(dict.fromkeys([*(k for ks in FLAGS.values() for k in ks), *INOVIRUS, *POLYMERASES]))
    bits = lambda c, names: F.coalesce(F.bit_or(F.coalesce(*[F.when(c == n, F.lit(1 << i)) for i, n in enumerate(names)])), F.lit(0)).cast("long")
    mask = lambda names, of: sum(1 << of.index(n) for n in names)
    seen = lambda n: F.sum(F.when(key == n, F.col("n")).otherwise(0))
    per = one.groupBy("element").agg(*sums, bits(key, known).alias("_keys"), bits(cat, PHAGE).alias("_cats"), seen("phage_reg").alias("phage_reg_hits"), seen("is_element").alias("is_hits"))
    marks = hits.where(key.isin("helicase", *POLYMERASES)).groupBy("element", "idx").agg(F.bool_or(key.isin(*POLYMERASES)).alias("_p"), F.bool_or(key == "helicase").alias("_h"))
    near = near_in_order(marks, "element", "idx", F.col("_p"), F.col("_h"), scheme.window).withColumnRenamed("near", "synteny")
    out = size.join(per, "element", "left").join(near, "element", "left")
    out = out.fillna({f"_sum_{n}": 0.0 for n in SCORES} | {"_keys": 0, "_cats": 0, "phage_reg_hits": 0, "is_hits": 0, "synteny": False, "annotation_coverage": 0.0})
    has = lambda names: F.col("_keys").bitwiseAND(F.lit(mask(names, known))) != 0
    flags = {n: has(ks) for n, ks in FLAGS.items()}
    counts = {"inovirus_markers": F.bit_count(F.col("_keys").bitwiseAND(F.lit(mask(INOVIRUS, known)))).cast("long"), "phage_categories": F.bit_count("_cats").cast("long")}
    if scheme.damped:
        divisor = F.sqrt(1.0 + F.greatest(F.lit(0), F.col("n_cds") - 1) * scheme.slope) * scheme.divisor
        score = lambda n: F.least(F.lit(1.0), F.col(f"_sum_{n}") / divisor)
    else:
        score = lambda n: F.least(F.lit(scheme.cap), F.col(f"_sum_{n}") / scheme.scale)
    s = {n: score(n) for n in SCORES}
    s["iec"] = F.least(F.lit(1.0), s["_integrase"] * scheme.core_boost)
    s["mobilization"] = F.least(F.lit(1.0), s["conj"] * 0.9)
    s["aice_dss"] = F.least(F.lit(1.0), s["_aice"] * scheme.mix[0] + s["_dss"] * scheme.mix[1] + s["_repabc"] * scheme.mix[2])
    s["helicase_only"] = F.when(has(POLYMERASES), 0.0).otherwise(s["_helicase"])
    s["pici"] = F.greatest(s["_pici"], s["_reg"])
    s["ta"] = F.greatest(s["_ta"], s["_ta_key"])
    s["gta"] = F.greatest(s["satellite"], s["_gta"])
    s["structural"] = s["_structural"]
    s["island"] = F.least(F.lit(1.0), s["pai"] + s["rm"] * 0.85 + s["ta"] * 0.75)
    shown = {n: c for n, c in s.items() if not n.startswith("_")}
    return out.select("element", "n_cds", "annotation_coverage", "_extent", *[c.alias(n) for n, c in shown.items()], *[c.alias(n) for n, c in (flags | counts).items()], "phage_reg_hits", "is_hits", "synteny", (flags["terl"] & ~flags["hk97"]).alias("packaging_only"), s["_integrase"].alias("integrase_score"))


def element_length(told: Column, extent: Column) -> Column:
    """The length an element is told to have, else its genes' extent, else 0."""
    return F.coalesce(F.try_to_number(F.nullif(F.trim(told.cast("string")), F.lit("")), F.lit("999999999999D999999")).cast("bigint"), extent.cast("bigint"), F.lit(0).cast("bigint"))


def packaging_cap(label: Column, conf: Column, scheme: Scheme) -> tuple[Column, Column]:
    """A complete label without a capsid or with too few categories of markers falls back to a footprint or a particle."""
    complete = label == "phage.caudoviral.complete"
    only, few = complete & F.col("packaging_only"), complete & (F.col("phage_categories") < scheme.categories_for_complete)
    capped = F.when(only, "phage.cryptic_prophage_footprint").when(few & (F.col("gta") >= 0.12), "phage.GTA_like_or_particle_like").when(few, "phage.cryptic_prophage_footprint").otherwise(label)
    return capped, F.when(only | few, "medium").otherwise(conf)


def novelty(label: Column, core: Column, coverage: Column, host: Column, scores: dict[str, Column], scheme: Scheme) -> tuple[Column, Column]:
    """(tier, rationale): reasons to look at an element again; the tier is none where there is no reason."""
    plain = label == lb.OTHER
    quiet = host <= scheme.novel_host
    top = F.greatest(*scores.values())
    strong = sum((F.when(c >= scheme.conflict_score, 1).otherwise(0) for c in scores.values()), F.lit(0))
    reasons = [
        (plain & (core >= scheme.novel_core) & (coverage >= scheme.novel_coverage) & quiet, F.lit("unclassified_with_strong_IE_core_and_coverage")),
        ((strong >= scheme.conflict_labels) & quiet, F.concat(F.lit("multi_module_conflict_n="), strong.cast("string"), F.lit(f">={scheme.conflict_labels}"))),
        (plain & (top < scheme.weak) & (core >= scheme.novel_core * 0.85) & (coverage >= scheme.novel_weak_coverage) & quiet, F.lit("all_specialized_modules_weak")),
    ]
    why = F.concat_ws("; ", *[F.when(c, t) for c, t in reasons])
    tier = F.when(why == "", "none").when((core >= scheme.interest_core) & (top <= scheme.interest_top), "high_interest").when(plain & (core >= scheme.novel_core), "medium").otherwise("watchlist")
    return tier, why


def conflict_note(scores: dict[str, Column], scheme: Scheme) -> Column:
    names = F.concat_ws(",", *[F.when(c >= scheme.conflict_score, F.lit(n)) for n, c in scores.items()])
    strong = sum((F.when(c >= scheme.conflict_score, 1).otherwise(0) for c in scores.values()), F.lit(0))
    return F.when(strong >= scheme.conflict_labels, F.concat(F.lit("strong_modules:"), names)).otherwise("")


def alternate_hypotheses(scores: dict[str, Column], k: int, least: float = 0.08) -> Column:
    """Array of (module, score, label) of at most k of the 2k highest scores that reach ``least``; equal ones in the order given."""
    rows = F.array(*[F.struct((-c).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("module"), F.lit(HINTS.get(n)).alias("label")) for i, (n, c) in enumerate(scores.items())])
    top = F.filter(F.slice(F.array_sort(rows), 1, 2 * k), lambda x: -x["s"] >= least)
    return F.transform(F.slice(top, 1, k), lambda x: F.struct(x["module"].alias("module"), F.bround(-x["s"], 4).alias("score"), x["label"].alias("label")))


def classify(hits: DataFrame, genes: DataFrame, meta: DataFrame, scheme: Scheme = Scheme(), rules: list | None = None, k: int = 3) -> DataFrame:
    """One record per row of ``meta`` (element, trna_type, integrase_lookup, has_att, ie_len): label, family, confidence, flags, novelty.

    Elements without genes take part with zero scores. The boosted core score decides gates and confidence, the plain one
    is reported and decides novelty.
    """
    s = element_scores(hits, genes, scheme)
    rows = meta.select("element", "trna_type", "integrase_lookup", "has_att", "ie_len").join(s, "element", "left")
    kinds = dict(rows.dtypes)
    rows = rows.fillna({c: 0.0 for c in kinds if kinds[c] == "double" and c in s.columns} | {c: False for c in s.columns if kinds[c] == "boolean"} | {c: 0 for c in s.columns if kinds[c] in ("bigint", "int") and c != "_extent"})
    look = F.trim(F.coalesce("integrase_lookup", F.lit("")))
    near = genes.select("element", "locus_tag").join(meta.select("element", look.alias("_look")).where("_look <> ''"), "element")
    near = near.where((F.col("locus_tag") == F.col("_look")) | F.col("locus_tag").startswith(F.substring_index("_look", "_", 1))).select("element").distinct().withColumn("_own", F.lit(True))
    rows = rows.join(near, "element", "left").withColumn("element_len", element_length(F.col("ie_len"), F.col("_extent")).cast("double"))
    core = F.col("iec")
    boost = core
    for cond, add in ((F.coalesce(F.col("trna_type"), F.lit("")) != "", 0.15), (F.coalesce("_own", F.lit(False)), 0.1), (F.coalesce("has_att", F.lit(False)), 0.08)):
        boost = F.least(F.lit(1.0), boost + F.when(cond, add).otherwise(0.0))
    rows = rows.withColumn("_core", core).withColumn("iec", boost)
    rows = lb.labelled(rows, lb.ELEMENT_RULES if rules is None else rules, lb.OTHER, "_label")
    scores = {n: F.col(n) for n in RANKED}
    special = {n: F.col(n) for n in scheme.special}
    conf = lb.confidence(F.col("iec"), F.greatest(*special.values()))
    conf = F.when((F.col("_label") == "phage.caudoviral.complete") & (conf == "high") & ~(F.col("terl") & F.col("hk97")), "medium").otherwise(conf)
    label, conf = packaging_cap(F.col("_label"), conf, scheme)
    rows = rows.withColumn("primary_label", label).withColumn("confidence", conf)
    tier, why = novelty(F.col("primary_label"), F.col("_core"), F.col("annotation_coverage"), F.col("host"), special, scheme)
    flags = all_matches([(F.col(c) >= least, name) for name, (c, least) in scheme.flags.items()])
    packaging = F.when(F.col("packaging_only") & (F.col("phage") > 0.4), "packaging_only_structural: anti_phage_overcall")
    notes = F.filter(F.array(packaging, F.nullif(conflict_note(special, scheme), F.lit(""))), lambda x: x.isNotNull())
    return rows.select(
        "element", "primary_label", lb.coarse(F.col("primary_label")).alias("coarse_label"),
        F.when(F.col("primary_label").startswith("phage.") & (F.col("plasmid") > 0.35), "phage_plasmid_like").otherwise("").alias("subtype"),
        "confidence", flags.alias("secondary_flags"), (why != "").alias("candidate"), tier.alias("novel_tier"), why.alias("novel_rationale"),
        F.bround("annotation_coverage", 4).alias("annotation_coverage"), runner_up(scores, k).alias("runner_up_modules"), alternate_hypotheses(scores, k).alias("alternates"),
        notes.alias("conflict_notes"), "n_cds", "element_len", F.bround("_core", 6).alias("core_score"), *[F.bround(n, 6).alias(f"score_{n}") for n in (*RANKED, "mobilization", "pai", "rm", "ta", "non_t4ss")], F.lit("").alias("error"),
    )


def error_records(meta: DataFrame, found: DataFrame, reason: Column, like: DataFrame) -> DataFrame:
    """Records of the elements of ``meta`` that ``found`` lacks: default label, low confidence, zero scores, ``reason`` as error and note.

    ``like`` gives the columns, so the result is a ``unionByName`` away from the classified elements.
    """
    lost = meta.join(found.select("element").distinct(), "element", "left_anti").withColumn("_why", reason)
    fixed = {"primary_label": F.lit(lb.OTHER), "coarse_label": F.lit("unclassified"), "confidence": F.lit("low"), "novel_tier": F.lit("none"), "error": F.col("_why"), "conflict_notes": F.array("_why"), "candidate": F.lit(False)}
    cols = []
    for f in like.schema.fields:
        kind = f.dataType.simpleString()
        blank = F.lit("") if kind == "string" else F.lit(0).cast(kind) if not kind.startswith("array") else F.array().cast(kind)
        cols.append((F.col("element") if f.name == "element" else fixed.get(f.name, blank)).alias(f.name))
    return lost.select(*cols)


def classify_missing(done: DataFrame, hits: DataFrame, genes: DataFrame, meta: DataFrame, **how) -> DataFrame:
    """Only the elements of ``meta`` that ``done`` has no record of."""
    left = meta.join(done.select("element"), "element", "left_anti")
    ids = left.select("element").distinct()
    return classify(hits.join(ids, "element", "left_semi"), genes.join(ids, "element", "left_semi"), left, **how)


def add_hits(hits: DataFrame, detected: DataFrame) -> DataFrame:
    """Hits of external detectors (element, idx, key, category, weight) beside those of the markers; a gene keeps one hit of a key."""
    both = hits.select("element", "idx", "key", "category", "weight", F.lit(0).alias("_p")).unionByName(detected.select("element", "idx", "key", "category", F.coalesce("weight", F.lit(0.5)).alias("weight"), F.lit(1).alias("_p")))
    best = F.min_by(F.struct("category", "weight"), F.struct("_p", "category", "weight"))
    return both.groupBy("element", "idx", "key").agg(best.alias("_b")).select("element", "idx", "key", "_b.category", "_b.weight")


def target_genes(genes: DataFrame, hits: DataFrame) -> DataFrame:
    """The genes an element-level detection stands for: the first integrase gene, else the first two phage genes, else the first gene."""
    kinds = hits.groupBy("element", "idx").agg(F.bool_or(F.col("key") == "integrase").alias("_i"), F.bool_or(F.col("category").startswith("phage")).alias("_p"))
    g = genes.select("element", "idx").join(kinds, ["element", "idx"], "left").fillna(False, ["_i", "_p"])
    per = g.groupBy("element").agg(F.array_sort(F.collect_set(F.when(F.col("_i"), F.col("idx")))).alias("i"), F.array_sort(F.collect_set(F.when(F.col("_p"), F.col("idx")))).alias("p"), F.min("idx").alias("first"))
    pick = F.when(F.size("i") > 0, F.slice("i", 1, 1)).when(F.size("p") > 0, F.slice("p", 1, 2)).otherwise(F.array("first"))
    return per.select("element", F.explode(pick).alias("idx"))
