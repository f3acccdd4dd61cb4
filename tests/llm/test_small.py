"""Small cases of the top-N, digest, tokenizer and leakage operators, each against a plain computation."""

import base64
import math
import random

import numpy as np
import pytest

from brindle.llm import bpe, leakage, qdigest, topn


def plain_top(rows, n):
    best = {}
    for g, i, s in rows:
        if g is None or i is None or s is None or math.isnan(s):
            continue
        best[g, i] = max(s, best.get((g, i), s))
    out = set()
    for g in {g for g, _ in best}:
        mine = sorted(((-s, i) for (h, i), s in best.items() if h == g))[:n]
        out |= {(g, i, -s, k + 1) for k, (s, i) in enumerate(mine)}
    return out


def test_top_n_ties_nulls_and_repeats(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.choice(["a", "b", "c", "é", "Z", "aa", None]), r.choice([1.0, 2.0, 2.0, float("nan"), None, -1.5]), "x") for _ in range(800)]
    df = spark.createDataFrame(rows, "g int, i string, s double, run string").repartition(7)
    got = {tuple(x) for x in topn.top_n(df, "g", "i", "s", 3).collect()}
    assert got == plain_top([x[:3] for x in rows], 3)


def test_top_n_empty(spark):
    assert topn.top_n(spark.createDataFrame([], "g int, i string, s double"), "g", "i", "s", 3).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 17])
def test_loser_tree_merges(k):
    r = random.Random(k)
    rows = [(r.randint(0, 5), str(r.randint(0, 30)), float(r.randint(0, 9))) for _ in range(400)]
    runs = [sorted(rows[i::k], key=lambda x: (x[0], -x[2], x[1])) for i in range(k)]
    got = topn.merge_runs([([x[0] for x in q], [x[2] for x in q], [x[1] for x in q]) for q in runs], 4)
    assert set(got) == plain_top([(g, i, s) for g, i, s in rows], 4)


def test_quantise_is_ordered_and_whole_numbers_exact(spark):
    v = [0.0, 1e-30, 0.001, 0.5, 0.5001, 1.0, 2.0, 3.0, 367.0, 8191.0, 8192.0, 1e5, 1e9]
    codes = [x[0] for x in spark.createDataFrame([(x,) for x in v], "v double").select(qdigest.quantise(__import__("pyspark").sql.functions.col("v"))).collect()]
    assert codes == sorted(codes)
    back = qdigest.restore(np.array(codes))
    assert all(abs(b - x) <= x / 4096 + 1e-37 for b, x in zip(back, v))
    assert [back[v.index(x)] for x in (1.0, 367.0, 8191.0, 8192.0)] == [1.0, 367.0, 8191.0, 8192.0]


def test_digest_merges_within_its_bound(spark):
    r = np.random.default_rng(3)
    rows = [(("a", "b")[i % 3 == 0], float(x), f"2025-01-{1 + i % 9:02d}") for i, x in enumerate(r.lognormal(5, 1, 20_000))]
    rows += [("a", None, "2025-01-01"), ("a", float("nan"), "2025-01-01"), ("a", -3.0, "2025-01-01"), ("a", 0.0, "2025-01-01"), (None, 5.0, None)]
    df = spark.createDataFrame(rows, "g string, v double, day string")
    df = df.withColumn("day", df.day.cast("timestamp"))
    k = 200
    d = qdigest.digests(df, ["g"], "v", "day", k)
    assert d.groupBy("g", "day").count().agg({"count": "max"}).first()[0] <= 3 * k
    merged = qdigest.merge(d, ["g"], k)
    for way in (d, merged):
        for x in qdigest.percentiles(way, ["g"], [0.01, 0.5, 0.9], k).collect():
            mine = np.sort([v for g, v, _ in rows if g == x.g and v is not None and v > 0])
            assert x.n == len(mine)
            assert x.max_rank_error <= qdigest.LEVELS * x.n / k
            rank = math.ceil(x.q * x.n)
            lo, hi = np.searchsorted(mine, x.value * (1 - 1e-9), "left"), np.searchsorted(mine, x.value * (1 + 1 / 4096), "right")
            assert lo - x.max_rank_error <= rank <= hi + x.max_rank_error + 1


def test_digest_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double, day timestamp")
    assert qdigest.percentiles(qdigest.digests(df, ["g"], "v", "day"), ["g"], [0.5]).count() == 0


TEXTS = ["", None, " ", "hello world", "It isn't the relaxase that matters <|endoftext|> here", "  a\t\tb\n\n c ", "L’élément IE-52602 — déjà vu 12345", "𝔘𝔫𝔦 👩‍👩‍👧 é", "x" * 5000, " " * 3000, "ab" * 2000 + "\x00�", "abcdefghij" * 300]


def test_bpe_equals_the_public_libraries(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.ids for x in bpe.encode(df, "doc_id", "text").collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert all(enc.decode(got[i]) == (t or "") for i, t in enumerate(TEXTS))


def test_bpe_long_piece_is_not_quadratic():
    e = bpe.Encoder()
    assert b"".join({v: k for k, v in e.ranks.items()}[i] for i in e.encode("a" * 60_000)) == b"a" * 60_000


def test_leaks_against_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["É", "½x", "naïve"]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([5, 12, 20, 30])))) for i in range(25)] + [(90, None), (91, ""), (0, "again")]
    docs = []
    for i in range(120):
        w = r.choices(vocab, k=r.randint(0, 60))
        if r.random() < 0.6:
            src = r.choice(items)[1] or ""
            s = src.split()
            a = r.randint(0, max(0, len(s) - 12))
            w[3:3] = [x.upper() for x in s[a : a + r.choice([11, 12, 15])]]
        docs.append((i, r.choice([", ", " - ", "\n"]).join(w)))
    docs += [(900, None), (901, ""), (902, items[3][1]), (903, items[3][1])]
    n = 12

    def grams(t):
        w = leakage.words(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = {(i, d) for i, t in items for d, u in docs if grams(t) & grams(u)}
    di, dd = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {tuple(x) for x in leakage.leaks(dd, di).collect()} == want
    s = {x.doc_id: x for x in leakage.spans(dd, di).collect()}
    assert set(s) == {d for _, d in want}
    assert all(x.leaked_words == sum(y["to"] - y["from"] for y in x.spans) and all(a["to"] < b["from"] for a, b in zip(x.spans, x.spans[1:])) for x in s.values())
    assert s[902].drop_document and s[902].cleaned is None
    texts = dict(docs)
    for x in s.values():
        for w, c in zip(x.spans, x.chars):
            assert leakage.words(texts[x.doc_id][c["from"] : c["to"]]) == leakage.words(texts[x.doc_id])[w["from"] : w["to"]]
        if not x.drop_document:
            assert len(leakage.words(x.cleaned)) == x.n_words - x.leaked_words
    assert leakage.leaks(dd.limit(0), di).count() == 0
    assert leakage.leaks(dd, di.limit(0)).count() == 0


def test_places_of_words():
    for t in ("Plain, words-2 here", "ﬁlament ｃhｏose e\u0301lément ½x İstanbul Σας", "한국어 \u1112\u1161\u11ab x", "", "🙂 a\u0308b"):
        w, at = leakage.words(t), leakage.word_places(t)
        assert at is not None and len(at) == len(w) and all(x in leakage.words(t[a:b]) for x, (a, b) in zip(w, at))  # one character can hold parts of two words


def test_evaluation_set_in_blocks(spark, monkeypatch):
    """Blocks whose last one is exactly full make no empty scan; all blocks give what one gives."""
    items = [(i, " ".join(f"w{i * 7 + j}" for j in range(14))) for i in range(6)]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in items], "doc_id long, text string")
    ev = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    one = {tuple(x) for x in leakage.leaks(docs, ev).collect()}
    monkeypatch.setattr(leakage, "BLOCK_WORDS", len(items[0][1]) // 2 + 1)
    assert len(list(leakage._blocks(ev, "item_id", "text"))) == 6
    assert {tuple(x) for x in leakage.leaks(docs, ev).collect()} == one and len(one) >= 6
