"""Names mapped to a reference list: made-up misspellings, brute-force distances, defined cases."""

import random

from brindle.llm.spelling import Dictionary, deletes, distance, within

ENTRIES = [(i + 10, n) for i, n in enumerate(["ATP-dependent helicase subunit A", "ATP-dependent helicase subunit B", "zinc-binding protein", "beta-propeller kinase class III", "cold-inducible relaxase family protein", "serine permease precursor", "hypothetical protein"])]
MEANT = {
    "atp dependent HELICASE subunit a": 10,
    "helicase su. B, ATP-dep.": 11,
    "putative zinc‑binding protein (EC 3.1.-.-), partial": 12,
    "zincbinding prtoein {ECO:12}": 12,
    "β-propeller kinase class iii [Some sp.]": 13,
    '"c0ld-inducible relaxase fam. protein"-like': 14,
    "serine_permeasep_recursor": 15,
    "serine\xa0permease\nprecuror": 15,
    "Hypothetical prot.": 16,
    "hypotheticalprotein": 16,
    "ATP-dependent helicase subunit alike": 10,
    "ATP-dependent helicase subunit C": -1,
    "beta-propeller kinase class II": -1,
    "serine archaellin precursor": -1,
    "???": -1,
    "serine permease": -1,
    "x" * 3000: -1,
}


def test_lookup():
    d = Dictionary(ENTRIES)
    assert {n: d.lookup(n) for n in MEANT} == MEANT


def test_ties_go_by_frequency_then_number():
    e = [(2, "alpha beta"), (1, "beta alpha"), (3, "beta-alpha")]
    assert Dictionary(e).lookup("Alpha Beta") == 1
    assert Dictionary(e, {"alpha beta": 5}).lookup("Alpha Beta") == 2


def test_symmetric_deletes_find_all_within_two_edits():
    r = random.Random(2)
    for _ in range(400):
        a = "".join(r.choices("abcd", k=r.randint(3, 8)))
        b = "".join(r.choices("abcd", k=r.randint(3, 8)))
        if within(a, b, 2):
            assert deletes(a, 2) & deletes(b, 2)
        assert distance(a, a) == 0 and (a == b or distance(a, b) > 0)
        assert abs(distance(a, b)) <= max(len(a), len(b)) + 1


def test_rows(spark):
    from brindle.llm.spelling import canonical

    rows = [(f"l{i}", n, "x") for i, n in enumerate(MEANT)] + [("l0", list(MEANT)[0], "x"), ("n1", None, "x"), ("n2", " \t", "x"), ("n3", "zinc-binding protein", "x"), (None, "zinc", "x")]
    df = spark.createDataFrame(rows, "locus_tag string, product string, product_id string").repartition(3)
    cat = spark.createDataFrame(ENTRIES + [(99, None)], "product_id int, canonical_name string")
    got = {(x.locus_tag, x.product_id) for x in canonical(df, "locus_tag", "product", cat, "product_id", "canonical_name").collect()}
    assert got == {(f"l{i}", v) for i, v in enumerate(MEANT.values())}
    assert canonical(df.limit(0), "locus_tag", "product", cat, "product_id", "canonical_name").count() == 0
    assert {x.product_id for x in canonical(df, "locus_tag", "product", cat.limit(0), "product_id", "canonical_name").collect()} == {-1}


def test_no_reading_is_dropped():
    """Right readings behind many others of equal cost; long names with many readings a word end at once."""
    words = ["aa" + c for c in "bcdefghij"]
    e = [(i, f"{w} kinase") for i, w in enumerate(words)] + [(50, "aac aad aae aaf aag aah aai")]
    d = Dictionary(e)
    assert len(d.readings("aa", True)) == len(words)
    assert d.lookup("aa. kinase") == 0 and Dictionary([x for x in e if x[0] in (8, 50)]).lookup("aa. kin.") == 8
    assert d.lookup("aa. " * 7) == 50 and d.lookup("aa. " * 8) == -1 and d.lookup("aa. " * 4000) == -1
    brute = Dictionary(e)
    r = random.Random(3)
    import brindle.llm.spelling as sp

    for _ in range(200):
        name = " ".join(r.choice(["aa.", "aab", "aak", "kin.", "kinsae", "putative", "aaci"]) for _ in range(r.randint(1, 4)))
        was = sp.COMBINATIONS
        try:
            sp.COMBINATIONS = 10**9
            one = brute.lookup(name)
            sp.COMBINATIONS = 0
            assert d.lookup(name) == one, name
        finally:
            sp.COMBINATIONS = was


def test_brackets():
    from brindle.llm.spelling import unbracketed

    assert unbracketed("a (b [c) d] e") == "a   d] e" and unbracketed("(" * 50000 + ")" * 50000 + "x") == " x" and unbracketed("a) (b") == "a) (b"
