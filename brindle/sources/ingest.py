"""Intake of sequence files: three layouts of folders, rejects kept apart, species of an assembly from its headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.formats import fasta_organism
from brindle.sources.formats import exists, fasta

# File patterns of the three layouts.
LAYOUTS = {"ncbi": "*_genomic.fna", "hybracter": "barcode*.fastq_final.fasta", "bins": "*.fa"}


def sample_of(layout: str, path: Column) -> Column:
    """The folder's name, the file's name up to its first point, or the file's name without ``.fa``."""
    if layout == "ncbi":
        return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.substring_index(name, ".", 1) if layout == "hybracter" else F.replace(name, F.lit(".fa"), F.lit(""))


def sequences(spark: SparkSession, roots: list[str], layouts: dict[str, str] = LAYOUTS) -> DataFrame:
    """(layout, file, sample, seq_id, description, seq) of all files below the roots that fit a layout's pattern."""
    out = None
    for layout, pattern in layouts.items():
        for root in roots:
            for depth in ("", "*/", "*/*/"):
                at = f"{root.rstrip('/')}/{depth}{pattern}"
                if exists(spark, at):
                    one = fasta(spark, at).select(F.lit(layout).alias("layout"), "file", sample_of(layout, F.col("file")).alias("sample"), "seq_id", "description", "seq")
                    out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "layout string, file string, sample string, seq_id string, description string, seq string") if out is None else out


def judged_files(records: DataFrame, reject_n: bool = True) -> DataFrame:
    """(layout, file, sample, n_seqs, has_n, accepted, reason): a file with an N in any sequence, or without a sequence, is rejected."""
    per = records.groupBy("layout", "file", "sample").agg(F.count(F.when(F.length("seq") > 0, 1)).alias("n_seqs"), F.bool_or(F.contains(F.upper("seq"), F.lit("N"))).alias("has_n"))
    why = F.when(F.col("n_seqs") == 0, "no sequence").when(F.col("has_n") & F.lit(reject_n), "ambiguous N").otherwise("")
    return per.withColumn("reason", why).withColumn("accepted", F.col("reason") == "")


def accepted(records: DataFrame, reject_n: bool = True) -> DataFrame:
    """The records of accepted files. Where several accepted files give one sample, that of the last layout and path counts."""
    good = judged_files(records, reject_n).where("accepted")
    order = Window.partitionBy("sample").orderBy(F.desc(F.array_position(F.array(*[F.lit(x) for x in LAYOUTS]), F.col("layout"))), F.desc("file"))
    chosen = good.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("file", "sample")
    return records.join(chosen, ["file", "sample"], "left_semi")


def species(records: DataFrame, first: int = 5) -> DataFrame:
    """(file, species, n_headers): the most frequent species of the first headers of each file, equal ones by name; files without one are null."""
    heads = records.select("file", "seq_id", F.col("description").alias("h"), F.monotonically_increasing_id().alias("at"))
    top = heads.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where(F.col("r") <= first)
    named = top.select("file", fasta_organism(F.col("h"))["species"].alias("species"))
    n = named.groupBy("file", "species").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("species"), F.struct(F.when(F.col("species").isNull(), 1).otherwise(0), -F.col("n"), F.col("species")))
    return n.groupBy("file").agg(best["species"].alias("species"), F.sum("n").alias("n_headers"))
