"""Rule engine: markers, module scores and priority labels compiled into column expressions.

A marker is a literal set of accessions (matched exactly or as a prefix) and patterns; every pattern is a constant of
its own, so matching stays inside code generation, and a gene's hits are one array that is exploded, not a join of
genes with rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marker:
    key: str
    category: str
    weight: float = 0.5
    patterns: tuple[str, ...] = ()
    accessions: tuple[str, ...] = ()


def load(spec: dict) -> list[Marker]:
    """Markers of a rule file: ``{"markers": {key: {category, weight, pfam: [...], regex: [...]}}}``. Patterns are taken as
    they stand, a doubled backslash included."""
    return [Marker(k, m.get("category", ""), float(m.get("weight", 0.5)), tuple(m.get("regex") or ()), tuple(str(a).upper() for a in m.get("pfam") or ())) for k, m in (spec.get("markers") or {}).items()]


def pfam_tokens(text: Column) -> Column:
    """Distinct accessions in a text, upper case, without version."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(r"(PF\d{5})"), 1), lambda x: x))


def text_blob(*parts: Column) -> Column:
    """The non-empty parts, lower case, joined by spaced line breaks."""
    return F.lower(F.concat_ws(" \n ", *[F.nullif(F.trim(p), F.lit("")) for p in parts]))


def _begins(accession: str):
    return lambda x: x.startswith(accession)


def marker_hits(genes: DataFrame, markers: list[Marker], text: str, accessions: str | None = None) -> DataFrame:
    """Genes x the markers that match, with how: at most one hit per marker, accession before pattern."""
    hits = []
    for m in markers:
        how = []
        if accessions and m.accessions:
            for a in m.accessions:
                how.append(F.when(F.exists(F.col(accessions), _begins(a)), F.lit(f"pfam:{a}")))
        for p in m.patterns:
            how.append(F.when(F.col(text).rlike(f"(?i){p}"), F.lit("regex")))
        via = F.coalesce(*how, F.lit(None).cast("string")) if how else F.lit(None).cast("string")
        hits.append(F.when(via.isNotNull(), F.struct(F.lit(m.key).alias("key"), F.lit(m.category).alias("category"), F.lit(float(m.weight)).alias("weight"), via.alias("via"))))
    return genes.withColumn("_hit", F.explode(F.array_compact(F.array(*hits)))).select(*genes.columns, "_hit.*")


def module_scores(hits: DataFrame, element: str, markers: list[Marker], scale: float, cap: float = 1.0) -> DataFrame:
    """Per element: score of each category (weights of distinct markers / scale, capped), has_ and n_ per marker, n_keys."""
    one = hits.groupBy(element, "key", "category").agg(F.first("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    cats = list(dict.fromkeys(m.category for m in markers))
    aggs = [F.round(F.least(F.lit(cap), F.sum(F.when(F.col("category") == c, F.col("weight")).otherwise(0.0)) / scale), 9).alias(f"score_{c}") for c in cats]
    for m in markers:
        aggs += [F.bool_or(F.col("key") == m.key).alias(f"has_{m.key}"), F.sum(F.when(F.col("key") == m.key, F.col("n")).otherwise(0)).cast("long").alias(f"n_{m.key}")]
    return one.groupBy(element).agg(*aggs, F.count(F.lit(1)).alias("n_keys"))


def runner_up(scores: dict[str, Column], k: int) -> Column:
    """The names of the k highest scores, equal ones in the order given."""
    rows = F.array(*[F.struct((-c).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(scores.items())])
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda x: x["n"])


def boosted(core: Column, trna: Column, integrase: Column, att: Column) -> Column:
    """Core score with its boosts: + 0.15 with a tRNA type, + 0.10 with an integrase locus, + 0.08 with both att sites, capped at 1."""
    out = core
    for cond, add in ((trna, 0.15), (integrase, 0.10), (att, 0.08)):
        out = F.least(F.lit(1.0), out + F.when(cond, add).otherwise(0.0))
    return out
