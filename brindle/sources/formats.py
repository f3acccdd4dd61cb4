"""Readers of text formats. Every table has a fixed schema, identifiers are strings, a missing or empty file is an empty table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLAST = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, integrase_id string, contig string, wstart int"
GFF = "contig string, source string, type string, start int, end int, score string, strand string, phase string, attrs string"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def tsv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = "\t", comment: str | None = None) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("enforceSchema", True)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def blast(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, BLAST, header=False)


def integrases(spark: SparkSession, path: str) -> DataFrame:
    """Typed integrase table; a trailing comma of the contig name goes."""
    df = tsv(spark, path, "orf_id string, model_accession string, start int, end int, strand string, contig_id string, contig_length int")
    return df.withColumn("contig_id", F.regexp_replace(F.trim("contig_id"), ",+$", ""))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq_id, description, seq). The header's first token is the id; line breaks in the sequence go. gz is read as it is."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^\s*>", "").alias("value")).where(F.length(F.trim("value")) > 0)
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "")
    body = F.regexp_replace(F.substr("value", F.length(F.substring_index("value", "\n", 1)) + 1), r"\s", "")
    return raw.select("file", F.regexp_extract(head, r"^(\S*)", 1).alias("seq_id"), head.alias("description"), body.alias("seq"))


def fasta_quality(records: DataFrame) -> DataFrame:
    return records.select("file", "seq_id", F.length("seq").alias("length"), F.contains(F.upper("seq"), F.lit("N")).alias("has_n"))


def gff_cds(spark: SparkSession, path: str) -> DataFrame:
    """CDS rows of a GFF file that carry an ID; rows of fewer than nine columns are left out."""
    df = tsv(spark, path, GFF, header=False, comment="#").where("type = 'CDS' and attrs is not null")
    return df.select("contig", "start", "end", "strand", F.regexp_extract("attrs", "(?:^|;)ID=([^;]*)", 1).alias("cds_id"), F.regexp_extract("attrs", "(?:^|;)locus_tag=([^;]*)", 1).alias("locus_tag"), F.regexp_extract("attrs", "(?:^|;)product=([^;]*)", 1).alias("product"), F.array_distinct(F.regexp_extract_all("attrs", F.lit(r"(?i)pfam:(PF\d{5})"), 1)).alias("pfam")).where("cds_id <> ''")


def contig_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length) of the sequence comments of a gene caller's output."""
    x = spark.read.text(path).where(F.contains("value", F.lit("seqlen=")))
    out = x.select(F.regexp_extract("value", r'seqhdr="([^"\s]+)', 1).alias("contig"), F.regexp_extract("value", r"seqlen=(\d+)", 1).cast("int").alias("length"))
    return out.where("contig <> ''").groupBy("contig").agg(F.max("length").alias("length"))


def orf_headers(records: DataFrame) -> DataFrame:
    """Coordinates in protein headers ``id # start # end # strand # attrs``; the contig is the id without its last ``_`` part."""
    p = F.split("description", " # ")
    out = records.where(F.size(p) >= 4).select(F.col("seq_id").alias("orf_id"), p[1].cast("int").alias("start"), p[2].cast("int").alias("end"), p[3].alias("strand"))
    return out.withColumn("contig", F.regexp_extract("orf_id", r"^(.*)_[^_]*$", 1))


def hmm_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, target, accession, query, evalue, bits) of a whitespace table of hits; comment lines are skipped. ``line`` orders
    the lines of a file: the start of its block and a number that rises within the block, so a file of any size is read in parts."""
    line = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), line.alias("line"), "value")
    p = F.split(F.trim("value"), r"\s+")
    return raw.where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0)).where(F.size(p) >= 6).select("file", "line", p[0].alias("target"), p[1].alias("accession"), p[2].alias("query"), p[4].cast("double").alias("evalue"), p[5].cast("double").alias("bits"))


def last_model(hits: DataFrame) -> DataFrame:
    """One model per query of a file: the last line wins."""
    w = Window.partitionBy("file", "query").orderBy(F.desc("line"))
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


_TRNA = re.compile(r"([fc]?)\[(\d+),(\d+)\]")


def _trna_lines(text: str) -> Iterator[tuple]:
    """Blocks of a header line, a line that begins with the number of records, and so many records. Lines behind the
    announced records belong to no block; a record whose third field has no coordinates is left out."""
    lines = iter(text.splitlines())
    for line in lines:
        if not line.startswith(">"):
            continue
        contig = (line[1:].split() or [""])[0]
        told = re.match(r"\s*(\d+)", next(lines, ""))
        for _ in range(int(told.group(1)) if told else 0):
            f = next(lines, "").split()
            if len(f) >= 3 and (m := _TRNA.match(f[2])):
                a, b = int(m.group(2)), int(m.group(3))
                yield contig, min(a, b), max(a, b), "-" if m.group(1) == "c" else "+", f[1]


def trna(spark: SparkSession, path: str) -> DataFrame:
    """(file, contig, start, end, strand, trna_type) of a block report: header, count line, as many numbered records with [s,e], f[s,e] or c[s,e]."""
    return _whole(spark, path, _trna_lines, "contig string, start int, end int, strand string, trna_type string")


_PLACE = re.compile(r"\d+")


def _genbank(text: str) -> Iterator[tuple]:
    """CDS features of a flat file: name of the record, extent (joins from least to greatest), strand, qualifiers."""
    record, inside, cur = "", False, None

    def done(c):
        q = c["q"]
        nums = [int(x) for x in _PLACE.findall(c["at"])]
        if nums:
            yield record, min(nums), max(nums), "-" if "complement" in c["at"] else "+", q.get("locus_tag") or q.get("protein_id") or "", q.get("product", ""), len(q.get("translation", "")), q.get("note", "")

    for line in text.splitlines():
        if line.startswith("LOCUS"):
            record, inside, cur = (line.split() + ["", ""])[1], False, None
        elif line.startswith("FEATURES"):
            inside = True
        elif line.startswith(("ORIGIN", "//", "CONTIG")):
            if cur and cur["kind"] == "CDS":
                yield from done(cur)
            inside, cur = False, None
        elif inside and line[:5] == "     " and len(line) > 5 and line[5] != " ":
            if cur and cur["kind"] == "CDS":
                yield from done(cur)
            kind, _, at = line.strip().partition(" ")
            cur = {"kind": kind, "at": at.strip(), "q": {}, "last": None}
        elif inside and cur is not None:
            s = line.strip()
            if s.startswith("/"):
                k, _, v = s[1:].partition("=")
                cur["last"] = k
                cur["q"][k] = v.strip('"')
            elif cur["last"] is None:
                cur["at"] += s
            else:
                k = cur["last"]
                cur["q"][k] += ("" if k == "translation" else " ") + s.strip('"')


def genbank_cds(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path, _genbank, "record string, start int, end int, strand string, locus_tag string, product string, aa_len int, note string")


def att_notes(spark: SparkSession, path: str) -> DataFrame:
    """(file, has_attl, has_attr): whether a file mentions each site."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lower("value").alias("t"))
    return t.select("file", F.contains("t", F.lit("attl")).alias("has_attl"), F.contains("t", F.lit("attr")).alias("has_attr"))


def padloc(spark: SparkSession, path: str, systems: str = "^(RM_|AbiE)") -> DataFrame:
    """(seqid, system, lo, hi) of a defence-system table, kept by name."""
    df = tsv(spark, path, "seqid string, system string, start int, end int", sep=",")
    return df.where(F.col("system").rlike(systems)).select("seqid", "system", F.least("start", "end").alias("lo"), F.greatest("start", "end").alias("hi"))


def with_run_status(samples: DataFrame, runs: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Status of each sample: not_run, no_systems_sample (ran, found nothing) or has_systems."""
    r, h = runs.select(key).distinct().withColumn("_run", F.lit(True)), hits.select(key).distinct().withColumn("_hit", F.lit(True))
    status = F.when(F.col("_run").isNull(), "not_run").when(F.col("_hit").isNull(), "no_systems_sample").otherwise("has_systems")
    return samples.join(r, key, "left").join(h, key, "left").withColumn("status", status).drop("_run", "_hit")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path).select(F.trim("value").alias("entry"))
    return t.where("entry <> '' and entry not like '#%'")


def files(spark: SparkSession, roots: list[str], pattern: str) -> DataFrame:
    """(path, length) of all files below the roots whose name fits; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(roots).select("path", "length")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML files; edges have src < dst and a weight (1.0 where none is given)."""
    t = spark.read.text(path, wholetext=True)
    node = t.select(F.explode(F.regexp_extract_all("value", F.lit(r'<node[^>]*?\bid="([^"]*)"'), 1)).alias("id"))
    e = t.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<edge\b[^>]*?(?:/>|>.*?</edge>))"), 1)).alias("e"))
    a, b = F.regexp_extract("e", r'source="([^"]*)"', 1), F.regexp_extract("e", r'target="([^"]*)"', 1)
    w = F.nullif(F.regexp_extract("e", r'<data key="(?:weight|w)">([^<]*)</data>', 1), F.lit("")).cast("double")
    return node, e.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.coalesce(w, F.lit(1.0)).alias("weight"))


def _whole(spark: SparkSession, path: str, parse, fields: str) -> DataFrame:
    """Rows of files that only make sense as a whole, parsed file by file where they lie."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, text in zip(b["file"], b["value"]):
                rows = pd.DataFrame(list(parse(text)), columns=names, dtype=object)
                rows.insert(0, "file", file)
                yield rows

    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.mapInPandas(run, f"file string, {fields}")
