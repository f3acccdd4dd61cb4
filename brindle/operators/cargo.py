"""Cargo of elements: kinds of genes, what they add up to, minimality, overlays of later evidence and counts of the whole funnel.

Rules come as data (ordered patterns, prefixes, thresholds). Per element everything is one aggregation or a window over the
element's genes; elements hold a bounded number of genes, and nothing is gathered beyond an element.

Defined cases: elements without genes have zero counts; null texts match nothing; repeated genes are the caller's to drop;
ties go by start, end and key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.formats import gene_blob
from brindle.operators.cascade import first_match, regex_rules

# Patterns of toxin-antitoxin families, in order of priority.
PAIR_FAMILIES = [
    ("hic", "HicAB"), ("hip", "HipAB"), ("ccd", "CcdAB"), (r"phd|\bdoc\b", "Phd-Doc"), ("mqs", "MqsRA"), ("hig", "HigAB"), ("yefm|yoeb", "YefM-YoeB"), ("brn", "BrnTA"),
    ("rel|pare|yafq|addiction module", "RelBE"), ("maz|pemk", "MazEF"), ("vapc|vapb|pin family", "VapBC"), ("abie|abigii", "AbiE"),
]
PARTNER = r"helix-turn-helix|transcriptional regulator|hth |hypothetical protein\("
SINGLE = {"Type IV": "REase only", "GmrSD": "REase only", "MTase only": "MTase only", "Mixed": "mixed classes", "Type I": "M+R pair", "Type IIG": "M+R pair", "Type III": "M+R pair"}


def kind_scan(genes: DataFrame, kinds: list[str], assumed: str | None = None) -> DataFrame:
    """Per element: n_<kind>, has_<kind>, <kind>_products (texts with length and place, in order) and n_genes.

    Genes: element, key, start, end, aa, product, kind. An element without a gene of the kind ``assumed`` counts one of it.
    """
    per = genes.groupBy("element").agg(
        F.count(F.lit(1)).alias("n_genes"),
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in kinds],
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end", "key", F.col("product").alias("name"), "aa")))).alias(f"_{k}") for k in kinds],
    )
    out = per.select("element", "n_genes", *[F.greatest(F.col(f"n_{k}"), F.lit(1 if k == assumed else 0)).alias(f"n_{k}") for k in kinds], *[gene_blob(F.col(f"_{k}")).alias(f"{k}_products") for k in kinds])
    return out.withColumns({f"has_{k}": F.col(f"n_{k}") > 0 for k in kinds})


def few_extras(scan: DataFrame, kind: str, most: int = 3, other: str = "other") -> DataFrame:
    """Elements with at least one gene of ``kind`` and at most ``most`` of it and of other genes together; further kinds are free."""
    return scan.where((F.col(f"n_{kind}") >= 1) & (F.col(f"n_{kind}") + F.col(f"n_{other}") <= most))


def candidates(df: DataFrame, systems: str, pattern: str, n: str, most: int = 10) -> DataFrame:
    """Rows worth a scan: a system of that name, or few genes (an unknown number counts as many)."""
    return df.where(F.coalesce(F.col(systems), F.lit("")).rlike(pattern) | (F.coalesce(F.col(n), F.lit(99)) <= most))


def pair_status(toxin: Column, antitoxin: Column, others: Column, systems: Column, known: str = "AbiE") -> Column:
    """How complete a pair is: both named, one with a likely partner among its neighbours, or one alone."""
    near = F.lower(F.coalesce(others, F.lit(""))).rlike(PARTNER)
    told = F.contains(F.coalesce(systems, F.lit("")), F.lit(known))
    return F.when((toxin & antitoxin) | (told & (toxin | antitoxin)), "named pair").when(toxin & near, "likely pair").when(antitoxin & ~toxin, "antitoxin only").otherwise("toxin only")


def pair_family(text: Column) -> Column:
    return first_match(regex_rules(F.coalesce(text, F.lit("")), PAIR_FAMILIES), "unnamed")


def composition(cls: Column, text: Column) -> Column:
    """What a restriction system consists of: by its class, else by the words of its genes."""
    low = F.lower(F.coalesce(text, F.lit("")))
    cut, mark = low.rlike("restrict|rease"), low.rlike("methyl")
    fixed = F.coalesce(*[F.when(cls == k, F.lit(v)) for k, v in SINGLE.items()])
    return F.coalesce(fixed, F.when(cut & mark, "M+R pair").when(mark, "MTase only").when(cut, "REase only").otherwise("M+R pair"))


def merged_class(a: Column, b: Column, order: list[str]) -> Column:
    """The class of two sets: the only one, ``Mixed`` of several, the later names of ``order`` giving way to the others."""
    both = F.array_union(a, b)
    strong = F.filter(both, lambda x: ~x.isin(order)) if order else both
    pick = F.when(F.size(strong) > 1, "Mixed").when(F.size(strong) == 1, F.get(strong, F.lit(0)))
    return F.coalesce(pick, *[F.when(F.array_contains(both, o), F.lit(o)) for o in order], F.lit(""))


def minimality(df: DataFrame, classes: str = "classes", base: str = "replication") -> DataFrame:
    """Adds char_class, n_char_classes, has_base and the five minimality flags. ``base`` counts as a class only where it is alone.

    Needs the array ``classes`` and n_leftover, n_ok_adj, n_cds.
    """
    cargo = F.array_sort(F.array_except(F.array_distinct(classes), F.array(F.lit(base))))
    has = F.array_contains(classes, base)
    n = F.when(F.size(cargo) > 0, F.size(cargo)).when(has, 1).otherwise(0)
    char = F.when(F.size(cargo) > 0, F.array_join(cargo, "|")).when(has, base).otherwise("")
    small = F.coalesce(F.col("n_cds") <= 6, F.lit(False))
    one, pure = F.col("n_char_classes") == 1, F.col("n_leftover") == 0
    out = df.withColumn("char_class", char).withColumn("n_char_classes", n).withColumn("has_base", F.coalesce(has, F.lit(False)))
    return out.withColumns({"class_minimal": one, "composition_minimal": one & pure, "compact": one & small, "composition_compact": one & pure & small, "tight": one & pure & (F.col("n_ok_adj") <= 3)})


def funnel(df: DataFrame) -> DataFrame:
    """(metric, n): how many elements remain at each step, of a table with the columns of ``minimality``."""
    flag = lambda c: F.sum(c.cast("long"))
    plus = F.col("composition_minimal") & F.col("has_base") & (F.col("char_class") != "replication")
    metrics = {
        "all": F.count(F.lit(1)), "class_minimal": flag(F.col("class_minimal")), "composition_minimal": flag(F.col("composition_minimal")), "module_plus_rep": flag(plus), "module_or_rep_only": flag(F.col("composition_minimal") & ~plus),
        "tight": flag(F.col("tight")), "composition_compact": flag(F.col("composition_compact")), "compact": flag(F.col("compact")), "no_class": flag(F.col("n_char_classes") == 0), "several_classes": flag(F.col("n_char_classes") > 1),
    }
    wide = df.agg(*[F.coalesce(c, F.lit(0)).alias(k) for k, c in metrics.items()])
    return wide.unpivot([], list(metrics), "metric", "n")


def class_inventory(df: DataFrame, names: DataFrame, classes: str = "classes") -> DataFrame:
    """Per class of ``names`` (class, layer): elements that hold it, hold nothing else, and are minimal with it; whether it occurs at all."""
    rows = df.select(F.explode(F.array_distinct(classes)).alias("class"), (F.size(F.array_distinct(classes)) == 1).alias("_only"), "char_class", "class_minimal", "composition_minimal", "tight")
    own = F.col("char_class") == F.col("class")
    flag = lambda c: F.sum(c.cast("long"))
    n = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n_with"), flag(F.col("_only")).alias("n_only"), flag(own & F.col("class_minimal")).alias("n_class_minimal"), flag(own & F.col("composition_minimal")).alias("n_composition_minimal"), flag(own & F.col("tight")).alias("n_tight"))
    out = names.join(n, "class", "left").fillna(0, ["n_with", "n_only", "n_class_minimal", "n_composition_minimal", "n_tight"])
    return out.withColumn("presence", F.when(F.col("n_with") > 0, "yes").otherwise("absent"))


def ranked_part(labels: Column, prefixes: list[str], skip: list[str]) -> Column:
    """struct(rank, source, text) of the best part of ``a:x; b:y``: by the order of prefixes, then by place; parts that begin with one
    of ``skip`` count for nothing; null where none is left."""
    parts = F.filter(F.transform(F.split(F.coalesce(labels, F.lit("")), r";\s*"), lambda x: F.trim(x)), lambda x: x != "")
    if skip:
        parts = F.filter(parts, lambda x: ~reduce(lambda a, b: a | b, [x.startswith(s) for s in skip]))

    def ranked(x: Column, i: Column) -> Column:
        rank, source, text = F.lit(len(prefixes)), F.lit("other"), x
        for k, p in reversed(list(enumerate(prefixes))):
            hit = x.startswith(f"{p}:")
            rank, source, text = F.when(hit, k).otherwise(rank), F.when(hit, p).otherwise(source), F.when(hit, F.substring(x, len(p) + 2, 1 << 30)).otherwise(text)
        return F.struct(rank.alias("rank"), i.alias("at"), source.alias("source"), F.trim(text).alias("text"))

    best = F.array_min(F.transform(parts, ranked))
    return F.when(F.size(parts) > 0, F.struct(best["rank"].alias("rank"), best["source"].alias("source"), best["text"].alias("text")))


def overlay(sources: list[tuple[Column, Column, str, Column]], default: str, unresolved: str) -> tuple[Column, Column, Column]:
    """(role, source, resolved) of the first source that decides: each is (whether it decides, role, name, whether it resolves)."""
    role = F.coalesce(*[F.when(ok, r) for ok, r, _, _ in sources], F.lit(default))
    name = F.coalesce(*[F.when(ok, F.lit(n)) for ok, _, n, _ in sources], F.lit(unresolved))
    done = F.coalesce(*[F.when(ok, d) for ok, _, _, d in sources], F.lit(False))
    return role, name, done


def recount(elements: DataFrame, cds: DataFrame, cargo: list[str], ignored: str = "other_defense") -> DataFrame:
    """Elements (element, classes, n_ok_adj, n_leftover, ...) after an overlay gave their dark genes a role (element, role, resolved).

    A gene that gets a role leaves the harmless ones (never below zero); a leftover counts as one; a cargo role joins the classes.
    Adds n_unresolved, n_overlay and added (the classes that are new).
    """
    hit = F.col("role")
    per = cds.groupBy("element").agg(
        F.count(F.lit(1)).alias("n_overlay"), F.sum((~F.col("resolved")).cast("long")).alias("n_unresolved"), F.sum((hit == "leftover").cast("long")).alias("_left"),
        F.sum(hit.isin("leftover", "int", "rm_part", *cargo).cast("long")).alias("_gone"), F.collect_set(F.when(hit.isin(*cargo), hit)).alias("_new"),
    )
    rows = elements.join(per, "element", "left").fillna(0, ["n_overlay", "n_unresolved", "_left", "_gone"])
    new = F.coalesce("_new", F.array().cast("array<string>"))
    rows = rows.withColumn("added", F.array_join(F.array_sort(F.array_except(new, "classes")), "|"))
    rows = rows.withColumn("classes", F.array_sort(F.array_except(F.array_union("classes", new), F.array(F.lit(ignored)))))
    return rows.withColumn("n_ok_adj", F.greatest(F.lit(0), F.col("n_ok_adj") - F.col("_gone"))).withColumn("n_leftover", F.col("n_leftover") + F.col("_left")).drop("_left", "_gone", "_new")


def change(was: Column, now: Column, n_classes: Column, n_leftover: Column) -> Column:
    """Why an element entered or left the minimal ones."""
    lost = F.when(n_classes > 1, "second_class").when(n_leftover > 0, "named_leftover").otherwise("lost_class")
    return F.when(was & ~now, lost).when(~was & now, "gained").otherwise("")


def imputed_roles(genes: DataFrame, dark_classes: list[str], aim: int = 380, within: tuple[int, int] = (200, 550)) -> DataFrame:
    """Roles of genes (element, key, aa, role, char) with what the rest of the element implies.

    Without an integrase the unresolved gene nearest to ``aim`` residues, if within bounds, is one; a class of ``dark_classes`` without
    its module is the longest unresolved gene; beside a module of a pair (class TA) a single unresolved gene without anything unnamed is its partner.
    """
    w = Window.partitionBy("element")
    has = lambda r: F.max((F.col("role") == r).cast("int")).over(w)
    dark = F.col("role") == "unresolved"
    fits = dark & F.col("aa").between(*within)
    first = F.row_number().over(w.orderBy(F.when(fits, 0).otherwise(1), F.abs(F.col("aa") - aim), "key"))
    rows = genes.withColumn("_pick", fits & (has("int") == 0) & (first == 1)).withColumn("role", F.when(F.col("_pick"), "int").otherwise(F.col("role"))).drop("_pick")
    longest = F.row_number().over(w.orderBy(F.when(dark, 0).otherwise(1), F.desc("aa"), "key"))
    rows = rows.withColumn("_pick", dark & (has("module") == 0) & F.col("char").isin(dark_classes) & (longest == 1)).withColumn("role", F.when(F.col("_pick"), "module").otherwise(F.col("role"))).drop("_pick")
    alone = (F.sum(dark.cast("int")).over(w) == 1) & (has("module") == 1) & (has("leftover") == 0) & (has("other_class") == 0) & (F.col("char") == "TA")
    return rows.withColumn("role", F.when(dark & alone, "accessory").otherwise(F.col("role")))


def module_flags(genes: DataFrame) -> DataFrame:
    """(element, n_<role>..., module_minimal, module_pending, n_extras) of genes with imputed roles."""
    roles = ["int", "rep", "module", "accessory", "unresolved", "leftover", "other_class"]
    per = genes.groupBy("element").agg(F.count(F.lit(1)).alias("n_cds"), *[F.sum((F.col("role") == r).cast("long")).alias(f"n_{r}") for r in roles])
    clean = (F.col("n_leftover") == 0) & (F.col("n_other_class") == 0) & (F.col("n_module") + F.col("n_rep") > 0)
    extras = F.greatest(F.lit(0), F.col("n_cds") - F.col("n_int") - F.col("n_rep"))
    return per.withColumn("module_minimal", clean & (F.col("n_unresolved") == 0) & (F.col("n_int") >= 1)).withColumn("module_pending", clean & (F.col("n_unresolved") > 0)).withColumn("n_extras", extras)


def compact(df: DataFrame, plates: DataFrame, dropped: DataFrame, most: int = 3) -> DataFrame:
    """Adds compact_minimal: few extras and one class, or listed on a plate (element, plate), unless dropped (element). A plate's
    name replaces the class; of two plates the later name counts."""
    p = plates.groupBy("element").agg(F.max("plate").alias("_plate"))
    rows = df.join(p, "element", "left").join(dropped.select("element").distinct().withColumn("_out", F.lit(True)), "element", "left")
    rows = rows.withColumn("char_class", F.coalesce("_plate", "char_class"))
    ok = ((F.col("n_extras") <= most) & (F.coalesce("char_class", F.lit("")) != "") & (F.col("n_char_classes") == 1)) | F.col("_plate").isNotNull()
    return rows.withColumn("compact_minimal", ok & F.col("_out").isNull()).drop("_plate", "_out")
