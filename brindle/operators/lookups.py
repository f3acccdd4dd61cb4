"""Joins with fallbacks: exact first, theta only for what is left, then priority and order decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.intervals import range_join
from brindle.operators.topk import top1

SMALL = 10_000  # rows of a lookup side that unmatched rows may be compared with one by one; more are met by their parts
PART = 6  # letters of a part


def name_lookup(df: DataFrame, names: DataFrame, key: str, name: str, order: list[Column], both_ways: bool = True, fold: bool = False) -> DataFrame:
    """df with the columns of ``names`` whose ``name`` equals ``key``; for keys without one, the first name (by ``order``)
    that contains the key or, with ``both_ways``, is contained in it.

    Only distinct unmatched keys enter the comparison. With more than ``SMALL`` names it is an equi join: what is contained
    in a text ends with one of the parts of up to PART letters of that text.
    """
    cs = [c for c in names.columns if c != key]
    low = F.lower if fold else (lambda c: c)
    exact = df.join(top1(names, [name], order).withColumn("_n", low(F.col(name))), low(F.col(key)) == F.col("_n"), "left").drop("_n")
    lost = exact.where(F.col(name).isNull() & F.col(key).isNotNull()).select(key).distinct()
    full = (F.length(key) > 0) & (F.length(name) > 0)
    inside, around = F.contains(low(F.col(name)), low(F.col(key))), F.contains(low(F.col(key)), low(F.col(name)))
    if names.limit(SMALL + 1).count() <= SMALL:
        hits = lost.join(F.broadcast(names), (inside | around if both_ways else inside) & full)
    else:
        hits = _by_parts(names, lost, low(F.col(name)), low(F.col(key))).where(inside & full)
        if both_ways:
            hits = hits.unionByName(_by_parts(lost, names, low(F.col(key)), low(F.col(name))).where(around & full).select(*hits.columns))
    found = top1(hits, [key], [*order, F.col(name)])
    rest = exact.where(F.col(name).isNull()).select(*df.columns).join(found.select(key, *cs), key, "left")
    return exact.where(F.col(name).isNotNull()).select(*df.columns, *cs).unionByName(rest.select(*df.columns, *cs))


def _by_parts(whole: DataFrame, piece: DataFrame, text: Column, part: Column) -> DataFrame:
    """Pairs of rows whose ``part`` may be contained in ``text``: the last letters of the one are among the parts of the other."""
    starts = F.sequence(F.lit(1), F.length(text))
    all_ = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(PART)), lambda k: F.substr(text, i, k)))))
    w = whole.where(F.length(text) > 0).withColumn("_part", F.explode(all_))
    p = piece.where(F.length(part) > 0).withColumn("_part", F.right(part, F.least(F.lit(PART), F.length(part))))
    return p.join(w, "_part").drop("_part")


def prefix_lookup(df: DataFrame, rows: DataFrame, key: str, composite: str, sep: str, order: list[Column]) -> DataFrame:
    """df with the first row whose composite id starts with ``key`` followed by ``sep`` or nothing: an equi join on the part before ``sep``."""
    first = top1(rows.withColumn("_p", F.substring_index(composite, sep, 1)), ["_p"], order)
    return df.join(first, F.col(key) == F.col("_p"), "left").drop("_p")


def assign_hits(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Detector hits -> one gene of their element: by locus, else by hit id, else the first gene that overlaps the hit.

    Hits: element, hit, locus, hit_id, lo, hi. Genes: element, gene, locus_tag, start, end. ``via`` tells which way it was.
    """
    h, g = hits, genes
    one = h.join(g.select("element", F.col("locus_tag").alias("locus"), "gene", "start"), ["element", "locus"]).select("element", "hit", "gene", "start", F.lit(1).alias("p"))
    two = h.join(g.select("element", F.col("locus_tag").alias("hit_id"), "gene", "start"), ["element", "hit_id"]).select("element", "hit", "gene", "start", F.lit(2).alias("p"))
    spans = g.select("element", F.col("start").alias("g0"), F.col("end").alias("g1"), "gene")
    three = range_join(h.where("lo is not null and hi is not null").select("element", "hit", F.least("lo", "hi").alias("h0"), F.greatest("lo", "hi").alias("h1")), spans, ["element"], ("h0", "h1"), ("g0", "g1")).select("element", "hit", "gene", F.col("g0").alias("start"), F.lit(3).alias("p"))
    best = top1(one.unionByName(two).unionByName(three), ["element", "hit"], [F.col("p"), F.col("start"), F.col("gene")])
    via = F.element_at(F.array(F.lit("locus"), F.lit("hit_id"), F.lit("overlap")), F.col("p"))
    return h.join(best.select("element", "hit", "gene", via.alias("via")), ["element", "hit"], "left")


def overlay_spans(genes: DataFrame, spans: DataFrame, on: list[str], gene: tuple[str, str], span: tuple[str, str], key: list[str], kind: str, label: str, share: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Kind of a gene replaced by the label of a span that overlaps it by more than ``share`` of the shorter of the two.

    The overlap is min(end) - max(start), without one added, and the bound is strict. Of several spans the last in
    order of start and label decides; kinds in ``keep`` are not replaced.
    """
    s = spans.select(*on, F.col(span[0]).alias("_s0"), F.col(span[1]).alias("_s1"), F.col(label).alias("_label"))
    hits = range_join(genes.select(*on, *key, *gene).distinct(), s, on, gene, ("_s0", "_s1"))
    n = F.least(F.col(gene[1]), F.col("_s1")) - F.greatest(F.col(gene[0]), F.col("_s0"))
    shorter = F.least(F.col(gene[1]) - F.col(gene[0]), F.col("_s1") - F.col("_s0"))
    best = top1(hits.where(n > share * shorter), key, [F.desc("_s0"), F.desc("_label")]).select(*key, "_label")
    free = ~F.col(kind).isin(keep) if keep else F.lit(True)
    return genes.join(best, key, "left").withColumn(kind, F.when(F.col("_label").isNotNull() & free, F.col("_label")).otherwise(F.col(kind))).drop("_label")


def merge_edges(a: DataFrame, b: DataFrame, prefix: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Union of two edge tables (src, dst, weight) on the unordered pair: in which it occurs, both weights and their greatest."""
    def side(df, p):
        return df.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias(f"{p}_weight"))

    x = side(a, prefix[0]).join(side(b, prefix[1]), ["src", "dst"], "full_outer")
    wa, wb = F.col(f"{prefix[0]}_weight"), F.col(f"{prefix[1]}_weight")
    where = F.when(wa.isNull(), prefix[1]).when(wb.isNull(), prefix[0]).otherwise("both")
    return x.select("src", "dst", f"{prefix[0]}_weight", f"{prefix[1]}_weight", F.greatest(wa, wb).alias("weight"), where.alias("source"))


def complete_groups(files: DataFrame, group: str, name: str, required: list[str]) -> DataFrame:
    """Groups that hold every required name."""
    need = F.array(*[F.lit(r) for r in required])
    have = files.where(F.col(name).isin(required)).groupBy(group).agg(F.collect_set(name).alias("_have"))
    return have.where(F.size(F.array_except(need, "_have")) == 0).select(group)


def blob_items(text: Column) -> Column:
    """``name(120aa,5-360); ...`` -> array of struct(name, aa, start, end); parts that don't fit are left out."""
    part = lambda x, i: F.regexp_extract(x, r"^\s*(.*)\((\d+)aa,(\d+)-(\d+)\)\s*$", i)
    ok = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: part(x, 2) != "")
    return F.transform(ok, lambda x: F.struct(part(x, 1).alias("name"), part(x, 2).cast("int").alias("aa"), part(x, 3).cast("int").alias("start"), part(x, 4).cast("int").alias("end")))


def tokens(text: Column) -> Column:
    """Non-empty parts of a text between bars, semicolons, commas and white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[|;,\s]+"), lambda x: x != "")
