"""Scalar formats: identifiers, numbers as text, names of organisms, visual attributes. Every helper is a column expression;
null and blank inputs give the empty text unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAP = 6000  # characters of a text attribute


def _clean(c: Column) -> Column:
    """Trimmed text, null for nothing (null, blank, ``nan`` in any case)."""
    s = F.trim(c.cast("string"))
    return F.when(F.lower(s).isin("", "nan"), F.lit(None)).otherwise(s)


def capped(c: Column, most: int = CAP) -> Column:
    """Text of at most ``most`` characters, the last one an ellipsis where it was longer."""
    s = _clean(c)
    return F.coalesce(F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s), F.lit(""))


def float_text(c: Column, digits: int, most: int = CAP) -> Column:
    """A number with fixed digits, halves to even; text that is no number stays, capped."""
    s = _clean(c)
    f = s.try_cast("double")
    return F.when(s.isNull(), "").when(f.isNull(), capped(c, most)).otherwise(F.format_string(f"%.{digits}f", F.bround(f, digits)))


def int_text(c: Column, most: int = CAP) -> Column:
    """A number without its fraction; text that is no number stays, capped."""
    s = _clean(c)
    f = s.try_cast("double")
    return F.when(s.isNull(), "").when(f.isNull(), capped(c, most)).otherwise(f.cast("bigint").cast("string"))


def cluster_text(c: Column) -> Column:
    """Canonical cluster id: ``7``, ``7.0`` and 7 are the same; other text stays; nothing is null."""
    s = _clean(c)
    f = s.try_cast("double")
    return F.when(f.isNotNull(), f.cast("bigint").cast("string")).otherwise(s)


def cluster_number(c: Column) -> Column:
    """Cluster number of a node attribute; text that is no number and negative numbers are null."""
    n = _clean(c).try_cast("double").cast("int")
    return F.when(n >= 0, n)


def attribute_name(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "x").when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)


def system_token(name: Column, n: Column, share: Column) -> Column:
    """``name (12 IE, 0.340)``; what is missing is left out."""
    parts = F.concat_ws(", ", F.concat(F.nullif(int_text(n), F.lit("")), F.lit(" IE")), F.nullif(float_text(share, 3), F.lit("")))
    return F.when(parts == "", name).otherwise(F.concat(name, F.lit(" ("), parts, F.lit(")")))


def fold_text(x: Column) -> Column:
    """NA, infinity, or a number with fewer digits the larger it is."""
    return (
        F.when(x.isNull() | F.isnan(x), "NA").when(x == float("inf"), "∞").when(x >= 100, F.format_string("%.0f", F.bround(x, 0)))
        .when(x >= 10, F.format_string("%.1f", F.bround(x, 1))).otherwise(F.format_string("%.2f", F.bround(x, 2)))
    )


def query_id(orf: Column, contig: Column, start: Column, end: Column, strand: Column) -> Column:
    """``orf:contig:start-end:strand``."""
    return F.concat(orf, F.lit(":"), contig, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), strand)


def element_of_query(c: Column) -> Column:
    """A query id without its strand."""
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), ":[+-]$", "")


def member_id(element: Column, sample: Column) -> Column:
    return F.concat(element, F.lit("|sample="), sample)


def organism(c: Column) -> Column:
    """struct(genus, species) of an organism's name: the two or three first words, ``uncultured`` and rank marks aside."""
    s = F.trim(F.replace(c, F.lit(" (bacteria)"), F.lit("")))
    w = F.filter(F.split(s, r"\s+"), lambda x: x != "")
    n, at = F.size(w), lambda i: F.get(w, i)
    wild = F.contains(F.lower(s), F.lit("uncultured")) & (n >= 2)
    bare = lambda x: F.regexp_replace(x, "^f__", "")
    genus = F.when(wild, bare(F.when(F.lower(at(0)) == "uncultured", at(1)).otherwise(at(0)))).when(n >= 2, bare(at(0))).when(n == 1, at(0)).otherwise("Unknown")
    rest = F.when(wild, F.when(n > 2, F.array_join(F.slice(w, 3, 1000), " ")).otherwise("bacterium")).when(n >= 3, F.concat_ws(" ", at(1), at(2))).when(n == 2, at(1)).when(n == 1, "sp.").otherwise(s)
    unknown = c.isNull() | (c == "") | (c == "Unknown")
    return F.struct(F.when(unknown, "Unknown").otherwise(genus).alias("genus"), F.when(unknown, "Unknown").otherwise(rest).alias("species"))


def fasta_organism(header: Column) -> Column:
    """struct(species, strain, assembly) in the description of a sequence header; nulls where there is none."""
    text = F.when(F.contains(header, F.lit(" ")), F.regexp_replace(header, "^[^ ]* ", ""))
    some = lambda x: F.nullif(x, F.lit(""))
    first = F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda x: x != ""), 1, 3), " ")
    species = F.coalesce(some(F.regexp_extract(text, r"([A-Z][a-z]+(?:\s+[a-z]+)?(?:\s+sp\.)?)", 1)), some(first), F.when(text.isNotNull(), "Unknown"))
    strain = some(F.regexp_extract(text, r"(?i)(isolate|strain)\s+([A-Za-z0-9_\-]+)", 2))
    low = F.lower(text)
    kind = F.when(F.contains(low, F.lit("whole genome shotgun")), "WGS").when(F.contains(low, F.lit("complete genome")), "Complete").when(F.contains(low, F.lit("chromosome")), "Chromosome")
    return F.struct(species.alias("species"), strain.alias("strain"), kind.alias("assembly"))


def product_name(c: Column) -> Column:
    """Product in lower case with shortened turns; hypothetical ones are empty."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.regexp_replace(F.regexp_replace(s, r"\bdomain-containing protein\b", "domain protein"), r"\bcontaining protein\b", "containing")
    return F.when(s.isin("hypothetical protein", "hypothetical", ""), "").otherwise(out)


def unknown_family(*texts: Column) -> Column:
    """``DUF1234`` of the first text that names one."""
    found = [F.nullif(F.regexp_extract(F.coalesce(t, F.lit("")), r"(?i)DUF\s*(\d+)", 1), F.lit("")) for t in texts]
    return F.coalesce(F.concat(F.lit("DUF"), F.coalesce(*found)), F.lit(""))


def location(c: Column) -> Column:
    """struct(start, end, strand) of a flat-file location: the extent of all numbers; 0, 0 without one."""
    s = F.trim(F.coalesce(c, F.lit("")))
    nums = F.transform(F.regexp_extract_all(s, F.lit(r"(\d+)"), 1), lambda x: x.cast("bigint"))
    return F.struct(F.coalesce(F.array_min(nums), F.lit(0)).alias("start"), F.coalesce(F.array_max(nums), F.lit(0)).alias("end"), F.when(s.rlike(r"^complement\(.*\)$"), "-").otherwise("+").alias("strand"))


def dbxref_families(c: Column) -> Column:
    """Family accessions of a cross-reference list, in order, joined by commas."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    held = F.filter(parts, lambda x: x.rlike(r"(?i)^(PFAM:|PF\d{5})"))
    return F.array_join(F.transform(held, lambda x: F.when(x.rlike("(?i)^PFAM:"), F.regexp_replace(x, "^[^:]*:", "")).otherwise(x)), ",")


def safe_text(c: Column) -> Column:
    """Only letters, digits and ``|_-.``."""
    return F.regexp_replace(c, r"[^A-Za-z0-9|_.\-]", "")


def header_sample(c: Column) -> Column:
    """The ``sample=`` part of a header, else its last word without closing punctuation."""
    told = F.nullif(F.regexp_extract(c, r"\bsample=([^\s|;,]+)", 1), F.lit(""))
    return safe_text(F.coalesce(told, F.regexp_replace(F.regexp_extract(F.trim(c), r"(\S+)$", 1), "[|;,]+$", "")))


def gene_blob(items: Column) -> Column:
    """``name(120aa,5-360); ...`` of an array of struct(name, aa, start, end); the inverse of ``lookups.blob_items``."""
    one = lambda x: F.concat(x["name"], F.lit("("), x["aa"].cast("string"), F.lit("aa,"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.lit(")"))
    return F.array_join(F.transform(items, one), "; ")


def edge_visuals(z: Column, fold: Column, p: Column) -> dict[str, Column]:
    """Width (z within 0..25), opacity (-log10 p over 50, at most 1) and strength of an edge; missing values count as nothing."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x)
    width = F.when(ok(z), F.greatest(F.lit(0.0), F.least(z, F.lit(25.0)))).otherwise(0.0)
    opacity = F.when(ok(p) & (p > 0), F.least(F.lit(1.0), -F.log10(F.greatest(p, F.lit(1e-300))) / 50)).otherwise(0.0)
    return {"edge_width": width, "edge_opacity": F.bround(opacity, 4), "edge_strength": F.bround(width * 0.6 + F.when(ok(fold), fold).otherwise(0.0) * 4.0, 3)}


def edge_significance(tier: Column, p_permuted: Column, p_mixing: Column) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (x <= 0.05)
    return F.when(tier.isin("core", "suggestive"), tier).when(ok(p_permuted), "perm-significant").when(ok(p_mixing), "mixing-significant").otherwise("ns")


def node_visuals(n: Column, most: Column) -> dict[str, Column]:
    """Share of the largest node and sizes that grow with its root (screen) and with itself (plot)."""
    share = n / F.when(most > 0, most).otherwise(1.0)
    return {"node_area": F.bround(share, 6), "node_size": F.bround(F.sqrt(F.greatest(share, F.lit(0.0))) * 196 + 24, 2), "node_points": F.bround(share * 1750 + 250, 1)}
