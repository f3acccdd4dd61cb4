"""Scalar formats, regions, intake and the writers that came with them."""

from pyspark.sql import functions as F

from brindle.functions import formats as f
from brindle.operators import regions as rg
from brindle.sources import formats as fm
from brindle.sources import ingest, sinks


def rows(spark, values, kind, expr):
    df = spark.createDataFrame([(i, *((v,) if not isinstance(v, tuple) else v)) for i, v in enumerate(values)], "i int, " + kind)
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_numbers_as_text(spark):
    c = F.col("v")
    assert rows(spark, ["1.0625", " nan ", None, "x", "-2", "1e2"], "v string", f.float_text(c, 3)) == ["1.062", "", "", "x", "-2.000", "100.000"]
    assert rows(spark, ["7.9", "-0.5", "", "seven"], "v string", f.int_text(c)) == ["7", "0", "", "seven"]
    assert rows(spark, ["7.0", "07", "c7", "NaN", None], "v string", f.cluster_text(c)) == ["7", "7", "c7", None, None]
    assert rows(spark, ["7.0", "-1", "x", ""], "v string", f.cluster_number(c)) == [7, None, None, None]
    assert rows(spark, ["a b-c", "9x", "--", None], "v string", f.attribute_name(c)) == ["a_b_c", "_9x", "x", "x"]
    assert rows(spark, [None, float("nan"), float("inf"), 123.4, 12.34, 1.005, 0.125], "v double", f.fold_text(c)) == ["NA", "NA", "∞", "123", "12.3", f"{1.0:.2f}", "0.12"]
    assert rows(spark, ["abcdef", "abc", None], "v string", f.capped(c, 4)) == ["abc…", "abc", ""]
    t = f.system_token(F.col("a"), F.col("b"), F.col("c"))
    assert rows(spark, [("RM", "12.0", "0.34"), ("RM", None, None), ("RM", "3", "")], "a string, b string, c string", t) == ["RM (12 IE, 0.340)", "RM", "RM (3 IE)"]


def test_names(spark):
    c = F.col("v")
    o = rows(spark, ["Deinococcus radiodurans R1 (bacteria)", "uncultured f__Thermaceae bacterium x", "uncultured Thermus", "Thermus", "Unknown", None], "v string", f.organism(c))
    assert [tuple(x) for x in o] == [("Deinococcus", "radiodurans R1"), ("Thermaceae", "bacterium x"), ("Thermus", "bacterium"), ("Thermus", "sp."), ("Unknown", "Unknown"), ("Unknown", "Unknown")]
    h = rows(spark, [">NZ_1 Hafnia sp. KE98 strain A-1 whole genome shotgun sequence", ">NZ_2 MAG Limosi vaginalis isolate ERR1 complete genome", ">bare"], "v string", f.fasta_organism(c))
    assert [tuple(x) for x in h] == [("Hafnia sp", "A-1", "WGS"), ("Limosi vaginalis", "ERR1", "Complete"), (None, None, None)]
    assert rows(spark, ["Hypothetical protein", "HTH domain-containing protein", "zinc containing protein x", None], "v string", f.product_name(c)) == ["", "hth domain protein", "zinc containing x", ""]
    assert rows(spark, [("no", "DUF 12"), ("duf7", "DUF8"), (None, None)], "a string, b string", f.unknown_family(F.col("a"), F.col("b"))) == ["DUF12", "DUF7", ""]
    assert [tuple(x) for x in rows(spark, ["complement(join(5..9,20..30))", "7", "", "3..1"], "v string", f.location(c))] == [(5, 30, "-"), (7, 7, "+"), (0, 0, "+"), (1, 3, "+")]
    assert rows(spark, ["GO:1, PFAM:PF00589.5,PF12345", None], "v string", f.dbxref_families(c)) == ["PF00589.5,PF12345", ""]
    assert rows(spark, ["p1 x sample=GCA_1.1|y", "p2 last|;"], "v string", f.header_sample(c)) == ["GCA_1.1", "last"]
    assert rows(spark, ["a:c:1-9:+", "a:c:1-9", None], "v string", f.element_of_query(c)) == ["a:c:1-9", "a:c:1-9", ""]
    q = f.query_id(F.lit("1_5"), F.lit("01"), F.lit(101), F.lit(110), F.lit("+"))
    assert rows(spark, [""], "v string", q) == ["1_5:01:101-110:+"] and rows(spark, [""], "v string", f.member_id(F.lit("orf1:ctg:1-100"), F.lit("GCA_test"))) == ["orf1:ctg:1-100|sample=GCA_test"]


def test_edges_and_nodes(spark):
    df = spark.createDataFrame([(30.0, 2.5, 1e-10, "core"), (None, None, 0.0, "x"), (-3.0, float("nan"), None, None)], "z double, fold double, p double, tier string")
    got = df.select(*[c.alias(n) for n, c in f.edge_visuals(F.col("z"), F.col("fold"), F.col("p")).items()], f.edge_significance(F.col("tier"), F.lit(0.2), F.col("p")).alias("sig")).collect()
    assert [tuple(x) for x in got] == [(25.0, 0.2, 25.0, "core"), (0.0, 0.0, 0.0, "mixing-significant"), (0.0, 0.0, 0.0, "ns")]
    n = spark.createDataFrame([(100.0, 400.0), (0.0, 0.0)], "n double, m double").select(*[c.alias(k) for k, c in f.node_visuals(F.col("n"), F.col("m")).items()]).collect()
    assert [tuple(x) for x in n] == [(0.25, 122.0, 687.5), (0.0, 24.0, 250.0)]


def test_regions_keep_ids_as_text(spark):
    """Contigs 1 and 01 are different; the region of a plus tRNA runs to the hit's end."""
    left, right = "A" * 100 + "GGGCCCTTTA" + "C" * 90, "T" * 100 + "TTTTGGGGAA" + "G" * 90
    contigs = spark.createDataFrame([("1", left), ("01", right)], "contig string, seq string")
    hits = spark.createDataFrame([("1_5", "1", 180), ("01_5", "01", 20)], "key string, contig string, hit_end int")
    trna = spark.createDataFrame([("1_5", 101, 110, "+"), ("01_5", 101, 110, "-"), ("x", 1, 2, "+"), ("1_5", 5, 9, "?")], "key string, trna_start int, trna_end int, trna_strand string")
    got = {r.key: r for r in rg.region_sequences(rg.element_regions(hits, trna), contigs).collect()}
    assert set(got) == {"1_5", "01_5"} and (got["1_5"].start, got["1_5"].end, got["1_5"].seq) == (101, 180, left[100:180])
    assert (got["01_5"].start, got["01_5"].end, got["01_5"].seq) == (20, 110, right[19:110])
    ids = spark.createDataFrame([("1_5", "1", 101, 180)], "k string, c string, a int, b int").select(rg.region_id(F.col("k"), F.col("c"), F.col("a"), F.col("b"))).first()[0]
    assert ids == "1_5:1:101-180"
    w = [x[0] for x in contigs.select(rg.window_slice(F.col("seq"), F.lit(-4), F.lit(3)), "contig").orderBy("contig").collect()]
    assert w == ["TTT", "AAA"] and contigs.select(rg.window_slice(F.col("seq"), F.lit(900), F.lit(950))).first()[0] == ""


def test_orientation(spark):
    d = "key string, contig string, start int, end int, trna_strand string, seq string"
    r = spark.createDataFrame([("p", "c", 101, 140, "+", "A" * 30 + "C" * 10), ("m", "c", 101, 140, "-", "A" * 30 + "C" * 10)], d)
    trna = spark.createDataFrame([("p", 8), ("m", 8)], "key string, trna_len int")
    ints = spark.createDataFrame([("p", 111, 120), ("m", 111, 120), ("p", 130, 131)], "key string, int_start int, int_end int")
    hits = spark.createDataFrame([("p", 1e-3, 12), ("p", 1e-9, 9), ("m", 1e-3, 12)], "key string, evalue double, length int")
    got = {x.key: x for x in rg.oriented(rg.annotation_rows(r, trna, ints, hits)).collect()}
    p, m = got["p"], got["m"]
    assert p.seq == "G" * 10 + "T" * 30 and (p.attl_start0, p.attl_end0, p.attr_start0, p.attr_end0) == (31, 40, 0, 8) and (p.int_start0, p.int_end0, p.int_strand) == (21, 30, -1)
    assert m.seq == "A" * 30 + "C" * 10 and (m.attl_start0, m.attl_end0, m.attr_start0, m.attr_end0) == (0, 12, 32, 40) and (m.int_start0, m.int_end0, m.int_strand) == (10, 19, 1)


def test_intake(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)

    put("GCA_1.1/x_genomic.fna", ">a Thermus aquaticus one\nACGT\n>b Thermus aquaticus two\nACGT\n>c Deinococcus x\nAC\n")
    put("GCA_2.1/x_genomic.fna", ">a\nACGTN\n")
    put("barcode01.fastq_final.fasta", ">a\nACGTACGT\n")
    put("bins/bin_1.fa", ">a\nACGTACGT\n")
    r = ingest.sequences(spark, [str(tmp_path)])
    j = {x.sample: (x.accepted, x.reason, x.n_seqs) for x in ingest.judged_files(r).collect()}
    assert j == {"GCA_1.1": (True, "", 3), "GCA_2.1": (False, "ambiguous N", 1), "barcode01": (True, "", 1), "bin_1": (True, "", 1)}
    assert {x.sample for x in ingest.accepted(r).collect()} == {"GCA_1.1", "barcode01", "bin_1"} and ingest.judged_files(r, False).where("not accepted").count() == 0
    s = {x.file.rpartition("/")[2]: (x.species, x.n_headers) for x in ingest.species(r.where("sample = 'GCA_1.1'")).collect()}
    assert s == {"x_genomic.fna": ("Thermus aquaticus", 3)} and ingest.sequences(spark, [str(tmp_path / "none")]).count() == 0


def test_flat_files_and_reports(spark, tmp_path):
    rec = spark.createDataFrame([("e1", "ACGT" * 20), ("e2", "AC")], "record string, seq string")
    cds = spark.createDataFrame([("e1", 10, 40, "-", "L1", 'an "int"'), ("e1", 1, 9, "+", "L0", None)], "record string, start int, end int, strand string, locus_tag string, product string")
    sinks.write_genbank(rec, cds, str(tmp_path / "gb"))
    back = fm.genbank_cds(spark, str(tmp_path / "gb"))
    assert sorted((x.record, x.start, x.end, x.strand, x.locus_tag, x.product) for x in back.collect()) == [("e1", 1, 9, "+", "L0", ""), ("e1", 10, 40, "-", "L1", "an 'int'")]
    bad = spark.createDataFrame([("k1", "too short"), ("k2", None)], "key string, reason string")
    for _ in range(2):
        sinks.append_rejected(bad, str(tmp_path / "rejected"), "qc")
    assert sinks.rejected_rows(spark.read.parquet(str(tmp_path / "rejected"))).count() == 2
    sinks.placeholder(spark, str(tmp_path / "none"), "a int, b string")
    assert spark.read.parquet(str(tmp_path / "none")).columns == ["a", "b"]
    text = sinks.markdown_report("Atlas", {"labels": spark.createDataFrame([("a|b", 2), (None, 1)], "label string, n int").orderBy("n")}, most=1)
    assert "# Atlas" in text and "|  | 1 |" in text and "1 more rows" in text
