"""Text, identifier and sequence functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def absent(c: Column) -> Column:
    """Null for null, blank and ``nan``, else the trimmed text."""
    t = F.trim(c.cast("string"))
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*[absent(c) for c in cs])


def safe_id(c: Column, most: int = 180) -> Column:
    return F.left(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"), F.lit(most))


def safe_name(c: Column, most: int = 120, default: str = "unknown") -> Column:
    t = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.left(F.coalesce(F.nullif(t, F.lit("")), F.lit(default)), F.lit(most))


def accession(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"GCA_\d+\.\d+", 0), F.lit(""))


def shorten(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 1)), F.lit("…"))).otherwise(c)


def sample_name(path: Column) -> Column:
    """File stem without .gz and one of .fna, .fa, .fasta."""
    t = F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"\.gz$", "")
    return F.regexp_replace(t, r"\.(fna|fasta|fa)$", "")


def reverse_complement(c: Column) -> Column:
    """IUPAC letters, case kept."""
    return F.translate(F.reverse(c), "ACGTUMRWSYKVHDBacgtumrwsykvhdb", "TGCAAKYWSRMBDHVtgcaakywsrmbdhv")


def slice_oriented(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """Bases start..end (1-based, inclusive), reverse-complemented on the minus strand."""
    s = F.substr(seq, F.greatest(F.lit(1), start), F.greatest(F.lit(0), end - F.greatest(F.lit(1), start) + 1))
    return F.when(strand.isin("-", "-1"), reverse_complement(s)).otherwise(s)


def protein_length(start: Column, end: Column) -> Column:
    """Codons of a CDS, the stop included."""
    return F.floor((end - start + 1) / 3).cast("int")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two texts, by halving steps: some log2(n) comparisons of prefixes, not one a letter."""
    n = F.least(F.length(a), F.length(b))
    steps = F.sequence(F.ceil(F.log2(n + 1)).cast("int"), F.lit(0), F.lit(-1))
    same = lambda k: F.substr(a, F.lit(1), k) == F.substr(b, F.lit(1), k)

    def grow(k: Column, i: Column) -> Column:
        longer = (k + F.pow(F.lit(2.0), i)).cast("int")
        return F.when((longer <= n) & same(longer), longer).otherwise(k)

    return F.when(n > 0, F.aggregate(steps, F.lit(0), grow)).otherwise(0).cast("int")


def anchored_run(x: Column, y: Column, strand: Column, shift: int = 3) -> Column:
    """Longest exact run of two sites that starts within ``shift`` bases of their anchored end: the right end on the plus strand, the left on minus."""
    def best(a, b):
        terms = []
        for k in range(shift + 1):
            terms += [common_prefix(F.substr(a, F.lit(1 + k)), b), common_prefix(a, F.substr(b, F.lit(1 + k)))]
        return F.greatest(*terms)

    return F.when(strand.isin("+", "1"), best(F.reverse(x), F.reverse(y))).otherwise(best(x, y))
