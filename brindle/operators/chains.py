"""Chains of small joins and picks: located models, detector hits by either id, stubs, splits of systems, ordered gene patterns.

All sides are reduced to one row a key where a key may come once, so no chain multiplies rows; what finds no partner comes out as
rows of its own, not as a message.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import safe_id
from brindle.operators.intervals import interval_union
from brindle.operators.topk import top1


def located(models: DataFrame, places: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missed): models (orf, model) with their place (orf, start, end, strand) and the length of their contig, whose name is the
    orf's without its last ``_`` part. missed has orf and the side that lacks it."""
    m = models.withColumn("contig", F.regexp_extract("orf", r"^(.*)_[^_]*$", 1))
    rows = m.join(places, "orf", "left").join(lengths.select("contig", F.col("length").alias("contig_length")), "contig", "left")
    why = F.when(F.col("start").isNull(), "no coordinates").when(F.col("contig_length").isNull(), "no contig length")
    return rows.where(why.isNull()), rows.where(why.isNotNull()).select("orf", why.alias("missing"))


def by_either_id(elements: DataFrame, hits: DataFrame, element: str = "element", hit_element: str = "element_id") -> DataFrame:
    """Hits of each element by its safe id (non-word letters replaced); elements without any by their raw id."""
    e = elements.select(F.col(element).alias("element"), safe_id(F.col(element)).alias("_safe"))
    h = hits.withColumnRenamed(hit_element, "_id")
    safe = e.join(h, F.col("_safe") == F.col("_id")).drop("_safe", "_id")
    raw = e.join(safe.select("element").distinct(), "element", "left_anti").where("element <> _safe")
    return safe.unionByName(raw.join(h, F.col("element") == F.col("_id")).drop("_safe", "_id"))


def appended(records: DataFrame, features: DataFrame, key: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all, lost): records with the features of known keys behind them; features of unknown keys come out on their own."""
    ids = known.select(key).distinct()
    return records.unionByName(features.join(ids, key, "left_semi"), allowMissingColumns=True), features.join(ids, key, "left_anti")


def described(rows: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """rows with a description: the first by text of a key's; the key itself where there is none."""
    one = names.groupBy(key).agg(F.min(text).alias(text))
    return rows.join(one, key, "left").withColumn(text, F.coalesce(F.nullif(F.trim(text), F.lit("")), F.col(key).cast("string")))


def with_stubs(found: DataFrame, wanted: DataFrame, key: str, fixed: dict[str, Column]) -> DataFrame:
    """found with a row for every wanted key that it lacks: fixed values, null elsewhere."""
    lost = wanted.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")
    return found.unionByName(lost.select(key, *[c.alias(n) for n, c in fixed.items()]), allowMissingColumns=True)


def id_parts(header: Column, sep: str = ":") -> Column:
    """The first part of a composite id, null for nothing."""
    return F.nullif(F.trim(F.substring_index(header, sep, 1)), F.lit(""))


def locus_of(text: Column) -> Column:
    """The ``locus=`` part of a composite description, null where there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"locus=([^|]+)", 1), F.lit(""))


def preferred(rows: DataFrame, key: list[str], flag: str, order: list[Column]) -> DataFrame:
    """One row a key: a flagged one before any other, then by order."""
    return top1(rows, key, [F.desc_nulls_last(flag), *order])


def split_systems(rows: DataFrame, group: str, element: str, systems: str, special: str = "^(cas_|crispr)") -> DataFrame:
    """Per group: elements with systems of the special kind and of others, distinct (element, system) rows of each, and the most frequent of each."""
    x = rows.select(group, element, F.explode(F.split(F.coalesce(systems, F.lit("")), r"[|;,\s]+")).alias("system")).where("system <> ''").distinct()
    x = x.withColumn("_special", F.lower("system").rlike(special))
    n = x.groupBy(group, "system", "_special").agg(F.count(F.lit(1)).alias("n"))
    tops = n.groupBy(group).agg(*[F.min_by(F.when(c, F.col("system")), F.when(c, F.struct(-F.col("n"), F.col("system")))).alias(name) for name, c in (("top_special", F.col("_special")), ("top_other", ~F.col("_special")))])
    per = x.groupBy(group).agg(
        F.count_distinct(F.when(F.col("_special"), F.col(element))).alias("n_special"), F.count_distinct(F.when(~F.col("_special"), F.col(element))).alias("n_other"),
        F.sum(F.col("_special").cast("long")).alias("rows_special"), F.sum((~F.col("_special")).cast("long")).alias("rows_other"),
    )
    return per.join(tops, group)


def compartments(spans: DataFrame, points: DataFrame, by: str, first: str, total: DataFrame) -> DataFrame:
    """Per key: union lengths of the spans (by, kind, start, end) of kind ``first``, of all, and of what is left of (by, length); points
    (by, owner) counted by the kind that owns them."""
    length = lambda df, name: interval_union(df, [by], "start", "end").groupBy(by).agg(F.sum(F.col("end") - F.col("start") + 1).alias(name))
    own = points.groupBy(by).agg(F.count(F.lit(1)).alias("n_points"), F.sum((F.col("owner") == first).cast("long")).alias("n_first"), F.sum((F.col("owner").isNotNull() & (F.col("owner") != first)).cast("long")).alias("n_other"))
    rows = total.join(length(spans.where(F.col("kind") == first), "len_first"), by, "left").join(length(spans, "len_all"), by, "left").join(own, by, "left")
    rows = rows.fillna(0, ["len_first", "len_all", "n_points", "n_first", "n_other"])
    return rows.withColumn("len_rest", F.greatest(F.lit(0), F.col("length") - F.col("len_all"))).withColumn("n_rest", F.greatest(F.lit(0), F.col("n_points") - F.col("n_first") - F.col("n_other")))


def three_way(text: Column, strong: str, exclude: str, include: str) -> Column:
    """Whether a text is meant: strong words say yes, else excluding ones no, else including ones decide."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(f"(?i){strong}"), True).when(t.rlike(f"(?i){exclude}"), False).otherwise(t.rlike(f"(?i){include}"))


def ordered_triple(genes: DataFrame, element: str, index: str, first: Column, middle: Column, last: Column, reach: int) -> DataFrame:
    """Elements with a gene of each kind in this order, each at most ``reach`` genes behind the one before: window passes, no self-joins."""
    back = Window.partitionBy(element).orderBy(index).rangeBetween(-reach, -1)
    x = genes.select(element, index, first.alias("_a"), middle.alias("_b"), last.alias("_c"))
    x = x.withColumn("_ab", F.col("_b") & F.coalesce(F.max("_a").over(back), F.lit(False)))
    x = x.withColumn("_abc", F.col("_c") & F.coalesce(F.max("_ab").over(back), F.lit(False)))
    return x.groupBy(element).agg(F.coalesce(F.max("_abc"), F.lit(False)).alias("found"))


def tests_of(text: Column, tests: dict[str, list[str]]) -> dict[str, Column]:
    """Named tests whether a text holds any of some parts, case apart."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return {n: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p.lower())) for p in parts]) for n, parts in tests.items()}


def shown_once(df: DataFrame, group: str, label: str, order: list[Column]) -> DataFrame:
    """Rows ranked within a group; the group's label stands at the first one only."""
    r = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return r.withColumn(label, F.when(F.col("rank") == 1, F.col(label)).otherwise(""))


def lengths_by(df: DataFrame, key: str, start: Column, end: Column) -> DataFrame:
    """Per key: number, sum and the list of lengths, in order, joined by commas."""
    n = (F.abs(end - start) + 1).cast("long")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(n)), lambda x: x.cast("string")), ",").alias("lengths"))
