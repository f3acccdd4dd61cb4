"""Text formats, sinks and streams."""

from pyspark.sql import functions as F

from brindle.sources import formats as fm
from brindle.sources import sinks
from brindle.streaming import batches

GENBANK = """LOCUS       ctg_1  900 bp
FEATURES             Location/Qualifiers
     source          1..900
     CDS             complement(join(10..40,
                     60..90))
                     /locus_tag="L1"
                     /product="site-specific
                     integrase"
                     /translation="MKV
                     LL"
     CDS             100..200
                     /protein_id="P2"
                     /note="attL here"
ORIGIN
        1 acgt
//
"""


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "x.fna", ">a desc\nAC\nGT\n>b\nNNNN\n>c x > y\nATGC\n")
    rows = {x.seq_id: x for x in fm.fasta_quality(fm.fasta(spark, p)).collect()}
    assert set(rows) == {"a", "b", "c"} and rows["c"].length == 4 and fm.fasta(spark, p).where("seq_id = 'c'").first().description == "c x > y"
    assert rows["a"].length == 4 and not rows["a"].has_n and rows["b"].has_n


def test_numeric_contigs_stay_text(spark, tmp_path):
    p = put(tmp_path, "i.tsv", "orf_id\tmodel_accession\tstart\tend\tstrand\tcontig_id\tcontig_length\n01_5\tPF1\t1\t9\t1\t01,\t50\n1_5\tPF1\t1\t9\t1\t1\t50\n")
    assert {x.contig_id for x in fm.integrases(spark, p).collect()} == {"01", "1"}
    assert fm.blast(spark, str(tmp_path / "missing.tsv")).columns[0] == "qseqid" and fm.blast(spark, put(tmp_path, "e.tsv", "")).count() == 0


def test_gff_headers_and_hits(spark, tmp_path):
    g = put(tmp_path, "x.gff", "##gff\nc\tp\tCDS\t10\t90\t.\t+\t0\tID=c_1;product=an integrase;Dbxref=PFAM:PF00589\nc\tp\tgene\t10\t90\t.\t+\t0\tID=g\nshort\n")
    x = fm.gff_cds(spark, g).collect()
    assert [(y.cds_id, y.start, y.product, y.pfam) for y in x] == [("c_1", 10, "an integrase", ["PF00589"])]
    c = put(tmp_path, "c.txt", '# Sequence Data: seqnum=1;seqlen=1234;seqhdr="ctg_7 flag"\nother\n')
    assert [tuple(y) for y in fm.contig_lengths(spark, c).collect()] == [("ctg_7", 1234)]
    f = put(tmp_path, "p.faa", ">a_b_3 # 5 # 99 # -1 # ID=1\nMK\n")
    assert [tuple(y) for y in fm.orf_headers(fm.fasta(spark, f)).collect()] == [("a_b_3", 5, 99, "-1", "a_b")]
    h = put(tmp_path, "h.tbl", "# head\nInt PF1.1 q1 - 1e-5 30.0 x\nInt2 PF2.1 q1 - 1e-9 50.0 x\n")
    many = put(tmp_path, "m.tbl", "".join(f"I PF{i} q{i % 3} - 1e-5 30 x\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        assert {y.query: y.accession for y in fm.last_model(fm.hmm_table(spark, many)).collect()} == {"q0": "PF3999", "q1": "PF3997", "q2": "PF3998"}
        assert fm.fasta(spark, put(tmp_path, "big.fna", "".join(f">s{i} > d\n" + "ACGT" * 20 + "\n" for i in range(800)))).where("length(seq) = 80 and seq_id like 's%'").count() == 800
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(y.query, y.accession) for y in fm.last_model(fm.hmm_table(spark, h)).collect()] == [("q1", "PF2.1")]


def test_whole_file_formats(spark, tmp_path):
    t = put(tmp_path, "t.txt", ">ctg1 len\n2 genes found\n1   tRNA-Leu   [100,180]   35   (caa)\n2   tRNA-Arg   c[900,820]   35   (tct)\n>ctg2\n0 genes found\n")
    assert [(x.contig, x.start, x.end, x.strand, x.trna_type) for x in fm.trna(spark, t).collect()] == [("ctg1", 100, 180, "+", "tRNA-Leu"), ("ctg1", 820, 900, "-", "tRNA-Arg")]
    g = put(tmp_path, "r.gbff", GENBANK)
    x = fm.genbank_cds(spark, g).collect()
    assert [(y.record, y.start, y.end, y.strand, y.locus_tag, y.product, y.aa_len) for y in x] == [("ctg_1", 10, 90, "-", "L1", "site-specific integrase", 5), ("ctg_1", 100, 200, "+", "P2", "", 0)]
    assert fm.att_notes(spark, g).first().has_attl and not fm.att_notes(spark, g).first().has_attr
    e = put(tmp_path, "e.gbff", "")
    assert fm.genbank_cds(spark, e).count() == 0


def test_block_report_counts_and_prefixes(spark, tmp_path):
    """A forward prefix is a record like any other; lines behind the announced records, and records without coordinates, are none."""
    t = put(tmp_path, "t.txt", ">c1 x\n3 genes found\n1 tRNA-Ala f[5,80] 33 (tgc)\n2 tRNA-? nowhere 3\n3 tRNA-Gly c[90,170] 33 (gcc)\n4 tRNA-Val [200,270] 33\n>c2\nno genes\n1 tRNA-Val [1,70] 33\n>7\n1 gene found\n1 tmRNA [2,300] 1,2\n>end\n2 genes found\n1 tRNA-Leu [3,77]")
    assert [(x.contig, x.start, x.end, x.strand, x.trna_type) for x in fm.trna(spark, t).collect()] == [("c1", 5, 80, "+", "tRNA-Ala"), ("c1", 90, 170, "-", "tRNA-Gly"), ("7", 2, 300, "+", "tmRNA"), ("end", 3, 77, "+", "tRNA-Leu")]


def test_status_manifest_and_systems(spark, tmp_path):
    p = put(tmp_path, "p.csv", "seqid,system,start,end\ns,RM_type_II,90,10\ns,CBASS,1,2\n")
    assert [tuple(x) for x in fm.padloc(spark, p).collect()] == [("s", "RM_type_II", 10, 90)]
    k = lambda *v: spark.createDataFrame([(x,) for x in v], "sample string")
    got = {x.sample: x.status for x in fm.with_run_status(k("a", "b", "c"), k("a", "b"), k("a"), "sample").collect()}
    assert got == {"a": "has_systems", "b": "no_systems_sample", "c": "not_run"}
    assert [x.entry for x in fm.manifest(spark, put(tmp_path, "m.txt", "# no\n\n x/y.fna \n")).collect()] == ["x/y.fna"]
    assert fm.files(spark, [str(tmp_path)], "*.csv").count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "ACGT", [1, 2]), ("a", "GG", [])], "id string, seq string, l array<int>")
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert {x.l for x in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).collect()} == {"[1,2]", "[]"}
    sinks.write_fasta(df, str(tmp_path / "f"), "id", "seq")
    assert fm.fasta(spark, str(tmp_path / "f")).count() == 2
    sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.write_by(df, str(tmp_path / "b"), ["id"])
    assert spark.read.parquet(str(tmp_path / "b")).where("id = 'a'").count() == 1
    assert {(x.id, x.rep_id) for x in sinks.numbered(df.select("id"), ["id"]).collect()} == {("a", 1), ("b", 2)}
    sinks.write_graphml(df.select("id"), spark.createDataFrame([("b", "a", 0.5)], "src string, dst string, weight double"), str(tmp_path / "g"))
    nodes, edges = fm.graphml(spark, str(tmp_path / "g/*"))
    assert nodes.count() == 2 and [tuple(x) for x in edges.collect()] == [("a", "b", 0.5)]


def test_batches_resume_after_a_failure(spark, tmp_path):
    src, seen = tmp_path / "in", {}
    for i in range(5):
        spark.range(i, i + 1).coalesce(1).write.mode("append").parquet(str(src))

    def work(df, n):
        if n == 1 and not seen.get("failed"):
            seen["failed"] = True
            raise ValueError("stop")
        seen[n] = {x.id for x in df.collect()}

    args = (spark, str(src), "id long", str(tmp_path / "cp"), work, 2)
    try:
        batches.run_batches(*args)
        raise AssertionError("the failure was swallowed")
    except Exception as e:  # noqa: BLE001
        assert "stop" in str(e)
    assert batches.run_batches(*args) == 2
    assert set().union(*(v for k, v in seen.items() if k != "failed")) == {0, 1, 2, 3, 4}
    assert batches.run_batches(*args) == 0


def test_event_time_windows(spark, tmp_path):
    x = spark.createDataFrame([(1, "2025-01-01 00:01:00", 2.0), (1, "2025-01-01 00:04:00", 3.0), (1, "2025-01-01 03:00:00", 1.0)], "k int, at string, v double").withColumn("at", F.to_timestamp("at"))
    assert {(x.n, x.total) for x in batches.windowed(x, "at", "k", "v", "5 minutes").collect()} == {(2, 5.0), (1, 1.0)}
    assert batches.sessions(x, "at", "k", "10 minutes").count() == 2
    x.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(x.schema).parquet(str(tmp_path / "s"))
    q = batches.windowed(stream, "at", "k", "v", "5 minutes").writeStream.format("memory").queryName("w").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from w").count() == 1  # the newest window is still open
    assert batches.first_only(x.union(x), "at", ["k", "at"]).count() == 3
