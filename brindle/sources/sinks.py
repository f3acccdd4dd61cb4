"""Writers: TSV, FASTA, JSON lines, flattened tables, GraphML, per-key folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import cut_table


def flattened(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    complex_ = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, complex_) else F.col(f"`{f.name}`") for f in df.schema])


def write_tsv(df: DataFrame, path: str) -> None:
    flattened(df).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_fasta(df: DataFrame, path: str, key: str, seq: str) -> None:
    df.where(F.col(key).isNotNull() & F.col(seq).isNotNull()).select(F.concat(F.lit(">"), F.col(key), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def write_by(df: DataFrame, path: str, keys: list[str]) -> None:
    """One folder per key; rows of a key are brought together first, so there is no file per task and key."""
    df.repartition(*[F.col(k) for k in keys]).write.mode("overwrite").partitionBy(*keys).parquet(path)


def numbered(df: DataFrame, order: list[str], out: str = "rep_id") -> DataFrame:
    """Sequential numbers from 1 in a total order, without one task for all rows: counts of range partitions are added up first."""
    parts = cut_table(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))  # written once: both readers see the same ranges
    n = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn(out, (F.col("_local") + F.col("_before")).cast("long")).drop("_part", "_local", "_before")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML as text parts: head, nodes, edges and tail in order (00, 01, 02, 03). A cluster-level graph is meant."""
    spark = nodes.sparkSession
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">'
    esc = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    parts = [
        spark.createDataFrame([(head,)], "value string"),
        nodes.select(F.format_string('<node id="%s"/>', esc(F.col("id"))).alias("value")),
        edges.select(F.format_string('<edge source="%s" target="%s"><data key="weight">%s</data></edge>', esc(F.col("src")), esc(F.col("dst")), F.col("weight").cast("string")).alias("value")),
        spark.createDataFrame([("</graph></graphml>",)], "value string"),
    ]
    for i, p in enumerate(parts):
        p.write.mode("overwrite").text(f"{path}/{i:02d}")


def write_genbank(records: DataFrame, features: DataFrame, path: str) -> None:
    """Flat files of records (record, seq) with their CDS features (record, start, end, strand, locus_tag, product), one text row a record.

    Features are gathered by record; a record is one element and holds a bounded number of them.
    """
    place = F.concat(F.col("start").cast("string"), F.lit(".."), F.col("end").cast("string"))
    place = F.when(F.col("strand").isin("-", "-1"), F.concat(F.lit("complement("), place, F.lit(")"))).otherwise(place)
    quote = lambda name: F.when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(f'\n                     /{name}="'), F.replace(F.col(name), F.lit('"'), F.lit("'")), F.lit('"'))).otherwise("")
    text = F.concat(F.lit("     CDS             "), place, quote("locus_tag"), quote("product"))
    cds = features.groupBy("record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", text.alias("t")))), lambda x: x["t"]), "\n").alias("_cds"))
    n = F.length("seq").cast("string")
    blocks = F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1)), F.lit(60))
    line = lambda i: F.concat(F.lpad(i.cast("string"), 9, " "), F.lit(" "), F.trim(F.regexp_replace(F.lower(F.substring(F.col("seq"), i, 60)), "(.{1,10})", "$1 ")))
    lines = F.array_join(F.transform(blocks, line), "\n")
    head = F.concat(F.lit("LOCUS       "), F.col("record"), F.lit(" "), n, F.lit(" bp    DNA\nFEATURES             Location/Qualifiers\n     source          1.."), n, F.lit("\n"))
    body = records.where("record is not null and seq is not null").join(cds, "record", "left")
    body.select(F.concat(head, F.coalesce(F.concat("_cds", F.lit("\n")), F.lit("")), F.lit("ORIGIN\n"), lines, F.lit("\n//")).alias("value")).write.mode("overwrite").text(path)


def append_rejected(rejected: DataFrame, path: str, stage: str) -> None:
    """Rejected rows of a stage (key, reason) are appended to a table of its own; repeated calls with the same rows add nothing twice
    to what ``rejected_rows`` reads."""
    rejected.select(F.lit(stage).alias("stage"), F.col("key").cast("string").alias("key"), "reason").write.mode("append").partitionBy("stage").parquet(path)


def rejected_rows(df: DataFrame) -> DataFrame:
    return df.select("stage", "key", "reason").distinct()


def placeholder(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table with its columns where a stage has nothing to give, so that readers find it."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def markdown_report(title: str, tables: dict[str, DataFrame], most: int = 50) -> str:
    """A report of value counts: a heading and a table for each. At most ``most`` rows of a table are shown, and the rest is counted."""
    out = [f"# {title}"]
    for name, df in tables.items():
        n = df.count()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in row) + " |" for row in df.limit(most).collect()]
        if n > most:
            out.append(f"\n{n - most} more rows")
    return "\n".join(out) + "\n"


__all__ = ["append_rejected", "flattened", "markdown_report", "numbered", "placeholder", "rejected_rows", "write_by", "write_fasta", "write_genbank", "write_graphml", "write_jsonl", "write_tsv"]
