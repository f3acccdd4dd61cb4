"""Cut texts: held-out accuracy on texts whose cuts are known, and the length test."""

import random

from brindle.llm import truncation

SUBJECT = ["the relaxase", "a small repeat", "our second run", "the annotation group", "every marker"]
VERB = ["covers", "was moved behind", "explains", "is shorter than", "replaces"]
OBJECT = ["the left boundary", "an older contig", "two helicase genes", "the terminal repeat", "most of the cargo"]


def sentence(r):
    s = f"{r.choice(SUBJECT)} {r.choice(VERB)} {r.choice(OBJECT)} near {r.randint(1, 900)} kb"
    return s[0].upper() + s[1:] + "."


def corpus(n=1500, seed=4):
    r = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        text, source = " ".join(sentence(r) for _ in range(r.randint(3, 14))), r.choice(["mail", "feed", " FEED", "desk"])
        if r.random() < 0.3:
            text = text[:-1]  # whole, written without a closing stop
        limit = 300 if source == "mail" else 260 if "feed" in source.lower() else None
        end = text
        if limit and len(text) > limit:
            end = text[:limit]
            if limit == 260:
                end = end[: end.rindex(" ")] + r.choice(["...", "…", " (more)"])
        elif r.random() < 0.03:
            end = text[: r.randint(40, len(text) - 5)]
        body = truncation.bare(end)[0]
        if end != text and not (text[len(body) :].startswith(".") or body.endswith(".")):
            cut.add(i)
        rows.append((i, end, source, "x"))
    rows += [(9001, None, "mail", "x"), (9002, "", "mail", "x"), (9003, " \n ", None, "x"), (9004, rows[0][1], None, "x")]
    return rows, cut


def test_held_out_accuracy(spark):
    rows, cut = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, src string").repartition(6)
    got = {x.doc_id for x in truncation.cut_texts(df).collect()} - {9004}
    assert len(got & cut) >= 0.93 * len(cut)
    assert len(got - cut) <= 0.05 * len(got)
    assert not got & {9001, 9002, 9003}
    rep = {x.source: x for x in truncation.report(df).collect()}
    assert rep["mail"].n_cut_at_limit > 50 and all(x.n_cut == x.n_cut_at_limit + x.n_cut_in_transfer for x in rep.values()) and rep["desk"].n_cut_in_transfer > 0 and rep["feed"].n_docs == sum("feed" in (x[2] or "").lower() for x in rows)


def test_significant_lengths(spark):
    rows, _ = corpus(2500, 8)
    texts = [(len(t), s.strip().lower()) for _, t, s, _ in rows if t and s]
    found = {(x.src, x.len) for x in truncation.lengths(spark.createDataFrame(texts, "len int, src string")).where("prior > 0.8").collect()}
    assert ("mail", 300) in found
    near = {("mail", 300 - k) for k in range(20)} | {("feed", 275 - k) for k in range(45)}
    assert sum((s, n) in found - near for n, s in texts) <= 0.03 * len(texts)


def test_lengths_of_equal_hazard_are_not_significant(spark):
    """Every length takes a twentieth of what is left: counts fall, the hazard doesn't. A limit ends one source."""
    texts = []
    for source, limit in (("free", 400), ("limited", 60)):
        left = 20_000
        for n in range(1, limit):
            texts += [(n, source)] * round(left / 20)
            left -= round(left / 20)
        texts += [(limit, source)] * (left if source == "limited" else 0)
    found = {(x.src, x.len) for x in truncation.lengths(spark.createDataFrame(texts, "len int, src string")).collect()}
    assert ("limited", 60) in found and not {(s, n) for s, n in found if s == "free" or n < 40}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert truncation.cut_texts(df).count() == 0


def test_marks():
    assert truncation.bare("one two [...]") == ("one two", True)
    assert truncation.bare("a" * 900 + " …") == ("a" * 900, True)
    assert truncation.bare("one two… ") == ("one two", True)
    assert truncation.bare("one two (end of entry)") == ("one two (end of entry)", False)


def test_all_texts_are_counted_and_fitted(spark, monkeypatch):
    """Each text has a word of its own at a line's end; counts and weights know them all, however many fit in a part."""
    monkeypatch.setattr(truncation, "SAMPLE", 40, raising=False)
    monkeypatch.setattr(truncation, "PART", 40, raising=False)
    models, fitted = [], truncation.fitted
    monkeypatch.setattr(truncation, "fitted", lambda *a, **k: models.append(fitted(*a, **k)) or models[-1])
    r = random.Random(5)
    own = ["".join(r.choice("abcdefghijklmnoprstuvz") for _ in range(9)) for _ in range(400)]
    rows = [(i, f"{sentence(r)[:-1]} {w}\n{' '.join(sentence(r) for _ in range(1 + i % 40))}", "desk") for i, w in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    odds = [{x.doc_id: x.log_odds for x in truncation.judged(df.repartition(n), "doc_id", "text", "source").collect()} for n in (1, 7)]
    assert all(m.weights[truncation.hashed([f"w={w}"])[0]] != 0 for m in models for w in own)
    assert all(models[0].words.count(kind, w) == 1 for kind in (truncation.SEEN, truncation.LAST) for w in own)
    assert odds[0] == odds[1] and len(odds[0]) == 400


def test_an_end_does_not_speak_for_itself(spark):
    """A text that breaks off within a word stays a cut if its own end is among the counts."""
    text = sentence(random.Random(1)) + " The third tran"
    words = truncation.counted(spark.createDataFrame([(text, False)] + [(text, True)] * 2 + [("A small tran", False)], "text string, limit boolean"))
    assert words.count(truncation.SEEN, "tran") == 2 and words.count(truncation.LINES, "a small tran") == 1
    t = truncation.Text(text)
    assert truncation.signs(t, len(t.low), words, (1, 1, 1)) != truncation.signs(t, len(t.low), words)
    alone = truncation.counted(spark.createDataFrame([("A small tran", False)], "text string, limit boolean"))
    none = truncation.Words(alone.cells * 0)
    t = truncation.Text("A small tran")
    assert truncation.signs(t, 12, alone, (1, 1, 1)) == truncation.signs(t, 12, none)


def test_copies_count_once(spark, monkeypatch):
    """Copies of a cut text would show its broken word as one that others have."""
    models, fitted = [], truncation.fitted
    monkeypatch.setattr(truncation, "fitted", lambda *a, **k: models.append(fitted(*a, **k)) or models[-1])
    r = random.Random(7)
    texts = [("The third tranqx. " if i == 3 else "") + " ".join(sentence(r) for _ in range(1 + i % 30)) for i in range(60)]
    rows = [(i + 100 * k, t, "desk") for i, t in enumerate(texts) for k in range(3)]
    assert truncation.judged(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").count() == 180
    assert models[0].words.count(truncation.SEEN, "tranqx") == 1 and models[0].words.count(truncation.LAST, "tranqx") == 1
