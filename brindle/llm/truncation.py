"""Texts cut off by field limits or in transfer.

Lengths: for every source the hazard h(l) = texts of length l / texts of length l or more is computed by window
functions, for single lengths and for spans of WIDTH characters (limits that fall back to a word's end), and
tested against the hazard of the neighbouring lengths (Poisson tail, false discoveries controlled). The excess
over the neighbours is the prior probability that a text of this length was cut.

Endings: a logistic model tells whether a text stops inside a word or sentence. It labels its own examples: text
ends, line ends and sentence ends (without their stop, since many texts are written without one) are whole,
random cuts of the same texts are not. Its words are counted in all texts and it is fitted on all of them.

A text is cut if prior and ending together say so: an incomplete ending at a significant length, or a clearly
incomplete one anywhere (transfers break off at any length). A mark that stands after the cut ("...", "(more)") is
taken off before the ending is judged.

Defined cases: null, empty and blank texts are whole; sources are compared without case and outer white space, a
null source is the source ''; repeated texts are judged row by row, but count once (copies of a cut would speak for it); texts are read whole.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.stats import false_discovery, poisson_sf_udf
from brindle.session import cut_table, drop_table

PART = 16_000  # texts that are fitted together
BITS = 18
CELLS = 1 << 21  # of each table of counts
WIDTH = 14  # characters a limit may fall back to the end of a word, and a mark may add
NEAR = 60  # neighbouring lengths on either side
FDR = 0.01
LEAST = 5  # texts at a length
ELSEWHERE = 0.008  # prior share of texts that a transfer cut at any length
DOUBTFUL = -2.5  # log odds from which an end of the sample may itself be a cut
REMEMBERED = 200_000  # keys a task holds before it passes their counts on, hashes it needn't take again
SEEN, LAST, PAIRS, LINES, LONGER = range(5)

MARK = 400  # characters at the end in which a mark is looked for

# Marks that stand in place of what was lost.
MARKS = re.compile(r"\s*(?:…|\.\.\.|\[\s*(?:…|\.\.\.|more|cut|truncated|continued)\s*\]|\(\s*(?:…|\.\.\.|more|cont\.?|continued|truncated|cut)\s*\)|<\s*(?:more|cut|truncated)\s*>)\s*$", re.I)
_WORD = re.compile(r"\w++(?:[-'’.]\w++)*+", re.U)
_STOP = re.compile(r"[.!?](?=\s|$)")
_PIECE = re.compile(r"[.!?;\n]\s+|\n")
_START = re.compile(r"\W*\w*")
_DIGITS = re.compile(r"\d+")
_NUMBER = re.compile(r"\d\d+")


def source_name(c: str):
    return F.lower(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))))


def bare(text: str, marks: re.Pattern = MARKS) -> tuple[str, bool]:
    """The text without white space and mark at its end, and whether there was a mark."""
    t = text.rstrip()
    last = t[-MARK:]
    cut = t[: len(t) - len(last)] + marks.sub("", last)
    return cut.rstrip(), cut != t


class Text:
    """The form of a text whose signs are taken: runs of digits are one 9, small letters, with the places of words and
    stops (from ``start`` on)."""

    __slots__ = ("cased", "low", "starts", "ends", "stops")

    def __init__(self, text: str, start: int = 0):
        self.cased = _DIGITS.sub("9", text)
        low = self.cased.lower()
        self.low = low if len(low) == len(self.cased) else "".join(x.lower() if len(x.lower()) == 1 else x for x in self.cased)
        spans = [m.span() for m in _WORD.finditer(self.low, start)]
        self.starts, self.ends = [x for x, _ in spans], [x for _, x in spans]
        self.stops = [m.start() for m in _STOP.finditer(self.low, start)]


def crc(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


class Words:
    """How often words occur (SEEN), how often they (LAST) and their pairs (PAIRS) end a line or sentence, endings of lines
    (LINES), and what longer words begin with a word (LONGER): counts of all texts, in tables of hashed keys.

    An end is judged by what the other ends say: what it gave to the counts itself is taken off again. The last word of a
    text of a significant length, which is probably cut, isn't counted.
    """

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.tables = [memoryview(c) for c in cells]
        self.known: dict[tuple[str, int, int], tuple[int, int, list[int]]] = {}

    def __reduce__(self):
        return _unpacked, (zlib.compress(self.cells.tobytes(), 1),)

    def count(self, kind: int, key: str, less: int = 0) -> int:
        """Occurrences, without the ``less`` that the example itself gave."""
        return max(0, self.tables[kind][crc(key) & (CELLS - 1)] - less)

    def of(self, w: str, less_seen: int, less_last: int) -> tuple[int, int, list[int]]:
        """Occurrences of a last word, those at an end, and the signs that follow from it alone."""
        if (got := self.known.get((w, less_seen, less_last))) is None:
            n, end, longer = self.count(SEEN, w, less_seen), self.count(LAST, w, less_last), self.count(LONGER, w)
            f = [f"w={w}", f"n={_bucket(n)}", f"end={_bucket(end)},{_bucket(n)}", f"r={int(10 * end / (n + 1))}", f"long={_bucket(longer)},{_bucket(n)}", f"lr={int(8 * longer / (longer + n + 1))}"]
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[w, less_seen, less_last] = (n, end, hashed(f))
        return got


def _unpacked(cells: bytes) -> Words:
    return Words(np.frombuffer(zlib.decompress(cells), np.int32).reshape(5, -1))


def occurrences(text: str, limit: bool, seen: list[str], last: list[str], pairs: list[str], lines: list[str]) -> None:
    """Add what a text (without end space and mark) gives to the counts of ``Words``; without its own end if ``limit``."""
    low = _DIGITS.sub("9", text).lower()
    pieces, rows = [_WORD.findall(x) for x in _PIECE.split(low)], low.split("\n")
    if limit:
        seen += pieces.pop()[:-1]
        rows.pop()
    for w in pieces:
        if w:
            seen += w
            last.append(w[-1])
            pairs.append(" ".join(w[-2:]))
    lines += [x[-40:] for row in rows if (x := row.strip())]


def counted(texts: DataFrame, marks: re.Pattern = MARKS) -> Words:
    """The counts of a table (text, limit), all of it. Tasks count by key; the driver gets one number per filled cell."""
    schema = "kind int, cell int, word string, n long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = [Counter() for _ in (SEEN, LAST, PAIRS, LINES)]

        def told() -> pd.DataFrame:
            rows = [(kind, crc(key) & (CELLS - 1), key if kind == SEEN else None, n) for kind, c in enumerate(kinds) for key, n in c.items()]
            for c in kinds:
                c.clear()
            return pd.DataFrame(rows, columns=["kind", "cell", "word", "n"])

        for b in batches:
            found: list[list[str]] = [[] for _ in kinds]
            for x, limit in zip(b["text"], b["limit"]):
                occurrences(bare(x, marks)[0], limit, *found)
            for c, keys in zip(kinds, found):
                c.update(keys)
            if sum(len(c) for c in kinds) >= REMEMBERED:
                yield told()
        yield told()

    def beginnings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            longer: Counter = Counter()
            for w, n in zip(b["word"], b["n"]):
                for i in range(1, min(len(w), 24)):
                    longer[w[:i]] += n
            yield pd.DataFrame([(LONGER, crc(x) & (CELLS - 1), None, n) for x, n in longer.items()], columns=["kind", "cell", "word", "n"])

    found = cut_table(texts.select("text", "limit").mapInPandas(run, schema).groupBy("kind", "cell", "word").agg(F.sum("n").alias("n")))
    longer = found.where((F.col("kind") == SEEN) & (F.col("n") >= 3)).mapInPandas(beginnings, schema)
    rows = found.unionByName(longer).groupBy("kind", "cell").agg(F.sum("n").alias("n")).select("kind", "cell", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    cells = np.zeros((5, CELLS), np.int32)
    cells[rows["kind"].to_numpy(), rows["cell"].to_numpy()] = rows["n"].to_numpy()
    drop_table(found)
    return Words(cells)


def _bucket(n: int) -> int:
    return (n + 1).bit_length() - 1


def signs(t: Text, e: int, words: Words, less: tuple[int, int, int] = (0, 0, 0)) -> list[int]:
    """Hashed features of how the first ``e`` characters end. ``less``: what that end itself gave to the counts of words, ends and lines."""
    low = t.low
    at = low.rfind("\n", max(0, e - 600), e) + 1
    line = at or max(0, e - 600)
    begin = max(line, e - 160)
    prev = low[max(0, e - 600) : at].rstrip()[-1:] if at else ""
    k, first = bisect_left(t.starts, e), bisect_left(t.starts, begin)
    w1 = low[t.starts[k - 1] : min(t.ends[k - 1], e)] if k > first else ""
    if w1 and e < t.ends[k - 1]:
        w1 = w1.rstrip("-'’.")
    w2 = low[t.starts[k - 2] : t.ends[k - 2]] if k - 1 > first else ""
    tail = low[e - 1 : e] if e > begin else ""
    kind = "a" if tail.isalnum() else tail
    n, end, out = words.of(w1, less[0], less[1])
    pair = words.count(PAIRS, f"{w2} {w1}".strip(), less[1])
    if tail and tail in ".!?":
        since = 0
    else:
        s = bisect_left(t.stops, e)
        since = min(k - max(first, bisect_left(t.starts, t.stops[s - 1]) if s else 0), 12)
    start = _START.match(low, begin, e).group(0)[:12]
    f = [f"e{i}={low[max(begin, e - i) : e]}" for i in (1, 2, 3, 4, 6, 9)]
    f += (
        f"ww={w2} {w1}",
        f"in={kind == 'a' or tail == '_'}",
        f"pair={_bucket(pair)}",
        f"pair0={pair == 0},{end == 0},{n == 0}",
        f"line={_bucket(words.count(LINES, low[max(begin, e - 40) : e].lstrip() if begin + 40 >= e else low[e - 40 : e], less[2]))}",
        f"since={since}",
        f"q={low.count(chr(34), line, e) % 2},{low.count('(', line, e) > low.count(')', line, e)},{low.count('[', line, e) > low.count(']', line, e)}",
        f"prev={'a' if prev.isalnum() else prev},{kind}",
        f"start={start}",
        f"sw={start} {w1}",
        f"nl={min((e - begin) // 12, 8)},{kind}",
        f"tab={low.count(chr(9), line, e)}",
        f"case={t.cased[e - 1 : e].isupper()},{len(w1) == 1}",
    )
    return out + hashed(f)


class _Hashes(dict):
    def __missing__(self, f: str) -> int:
        x = crc(f) & ((1 << BITS) - 1)
        if len(self) < REMEMBERED:
            self[f] = x
        return x


_HASHES = _Hashes()


def hashed(features: list[str]) -> list[int]:
    return [_HASHES[f] for f in features]


def examples(text: str, words: Words, is_whole: bool, seed: int = 11) -> list[tuple[list[int], int, bool]]:
    """(features, cut or not, own end or not) of the examples that a text gives: its own end if ``is_whole``, line and sentence ends, random cuts.
    The choice depends on the text alone, not on where or when it is read."""
    r = random.Random(crc(text) ^ seed)
    out: list[tuple[list[int], int, bool]] = []
    t, size = Text(text), len(text)
    numbers = [m.span() for m in _NUMBER.finditer(text)]
    begins, lost = [x for x, _ in numbers], [0, *accumulate(y - x - 1 for x, y in numbers)]
    counted = int(is_whole)

    def example(e: int, y: int, less: tuple[int, int, int] | None = (0, 0, 0), own: bool = False) -> None:
        if e < 4:
            return
        i = bisect_left(begins, e)
        e -= lost[i] if not i or e >= numbers[i - 1][1] else lost[i - 1] + e - begins[i - 1] - 1
        if less is None:  # a cut gives nothing but its last word, if that is whole
            k = bisect_left(t.starts, e)
            less = (int(0 < k < len(t.starts) + counted and t.ends[k - 1] <= e), 0, 0)
        out.append((signs(t, e, words, less), y, own))

    if is_whole:
        example(size, 0, (1, 1, 1), True)
        out += out[-1:]  # counts twice
    ends = [m.start() for m in _STOP.finditer(text)]
    for e in r.sample(ends, min(2, len(ends))):
        stop = r.randint(0, 1)
        example(e + stop, 0, (1, 1, 0) if e + 1 < size else (counted, counted, counted * stop))
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    for e in r.sample(breaks, min(2, len(breaks))):
        example(len(text[:e].rstrip()), 0, (1, 1, 1))
    stops = set(ends) | {e + 1 for e in ends} | set(breaks)
    for _ in range(5):
        e = len(text[: r.randint(4, max(4, size - 2))].rstrip())
        if e not in stops:
            example(e, 1, None)
    return out


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11, epochs: int = 4, step: float = 0.15, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic model of hashed signs."""
    w, g2, grad = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), np.zeros(1 << BITS)
    if not len(x):
        return w, -5.0
    y, rng, b = y.astype(np.float64), np.random.default_rng(seed), 0.0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i = order[at : at + 256]
            f = x[i].ravel()
            before = w[f]
            err = (1 / (1 + np.exp(-(before.reshape(len(i), -1).sum(1) + b))) - y[i]) / len(i)
            np.add.at(grad, f, np.repeat(err, x.shape[1]))
            g = grad[f] + ridge * before
            grad[f] = 0
            g2[f] = sum2 = g2[f] + g * g  # a feature that stands in f twice gets the same value twice
            w[f] = before - step * g / np.sqrt(sum2)
            b -= 0.5 * err.sum()
    # log odds of the examples' classes are taken out: the caller adds its own prior
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    return w, float(b - np.log(share / (1 - share)))


class EndingModel:
    """Log odds that a text breaks off, of hashed signs."""

    def __init__(self, words: Words, weights: np.ndarray, offset: float):
        self.words, self.weights, self.offset = words, weights, offset

    def log_odds(self, text: str, limit: bool = False) -> float:
        """Log of the likelihood ratio that the text (without end space and mark; one of those counted) breaks off."""
        t = Text(text[-1200:], max(0, min(len(text), 1200) - 400))
        return float(self.weights[signs(t, len(t.low), self.words, (0, 0, 0) if limit else (1, 1, 1))].sum() + self.offset)


def fitted(texts: DataFrame, n: int, marks: re.Pattern = MARKS, doubtful: float = DOUBTFUL) -> EndingModel:
    """The model of a table (text, limit) of some ``n`` different texts. All rows are counted, and all are fitted: in parts of some PART
    texts where they lie. A weight is the mean over the parts, by how many examples of a part have the sign.

    The own ends of texts of a significant length (``limit``) are no examples. Some of the other texts' ends are cuts as
    well; those that look like it to a part's first fit are no examples in the second.
    """
    spark = texts.sparkSession
    words = counted(texts, marks)
    known = spark.sparkContext.broadcast(words)

    def taught(part: list[tuple[str, bool]]) -> pd.DataFrame:
        rows = [e for text, limit in part for e in examples(text, known.value, not limit)]
        x = np.array([e[0] for e in rows], np.int32).reshape(len(rows), -1)
        y, own = np.array([e[1] for e in rows], np.int8), np.array([e[2] for e in rows], bool)
        w, b = fit(x, y)
        keep = np.ones(len(rows), bool)
        keep[own] = w[x[own]].sum(1) + b < doubtful
        x, y = x[keep], y[keep]
        w, b = fit(x, y)
        mass = np.bincount(x.ravel(), minlength=1 << BITS)
        f = np.flatnonzero(mass)
        weights, mass = np.append(w[f], b), np.append(mass[f], len(x))
        # whole numbers: their sums don't depend on the order
        return pd.DataFrame({"feature": np.append(f, -1).astype(np.int32), "mass": mass, "weight": np.rint(weights * 2**24).astype(np.int64) * mass})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part: list[tuple[str, bool]] = []
        for b in batches:
            part += [(t, limit) for x, limit in zip(b["text"], b["limit"]) if len(t := bare(x, marks)[0]) >= 8]
            if len(part) >= 3 * PART:
                yield taught(part[:PART])
                part = part[PART:]
        if part:
            yield taught(part)

    spread = texts.select(F.xxhash64("text").alias("h"), "text", "limit").repartition(max(1, -(-n // PART)), "h").sortWithinPartitions("h")
    rows = spread.mapInPandas(run, "feature int, mass long, weight long").groupBy("feature").agg((F.sum(F.col("weight").cast("decimal(38,0)")).cast("double") / F.sum("mass") / 2**24).alias("w")).toArrow()
    known.unpersist()
    weights, f = np.zeros(1 << BITS), rows["feature"].to_numpy()
    w = rows["w"].to_numpy()
    weights[f[f >= 0]] = w[f >= 0]
    return EndingModel(words, weights, float(w[f < 0][0]) if (f < 0).any() else -5.0)


def lengths(docs: DataFrame) -> DataFrame:
    """(src, len, prior): the share of texts of a length in excess of what its neighbours' hazard lets expect, where significant."""
    count = docs.groupBy("src", "len").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("src").orderBy("len")
    beyond = lambda k: F.coalesce(F.sum("n").over(of.rangeBetween(k, Window.unboundedFollowing)), F.lit(0))

    def at_risk(below: int, above: int):
        """Summed over all lengths from len - below to len + above, also those no text has: the texts of that length or more."""
        frame, first = of.rangeBetween(-below, above), F.greatest(F.lit(1), F.col("len") - below)
        inside = F.sum(F.col("n") * F.col("len")).over(frame) - F.sum("n").over(frame) * (first - 1)
        return inside + beyond(above + 1) * (F.col("len") + above - first + 1)

    near = F.sum("n").over(of.rangeBetween(-NEAR, NEAR))
    span = F.sum("n").over(of.rangeBetween(-WIDTH + 1, 0))
    around = F.sum("n").over(of.rangeBetween(-NEAR - WIDTH, NEAR))
    risks = [beyond(0).alias("risk"), at_risk(NEAR, NEAR).alias("risk_near"), at_risk(WIDTH - 1, 0).alias("risk_span"), at_risk(NEAR + WIDTH, NEAR).alias("risk_around")]
    h = count.select("src", "len", "n", near.alias("near"), span.alias("span"), around.alias("around"), *risks)
    hazard = lambda k, risk: (k + 0.5) / F.greatest(risk, F.lit(1))
    h = h.withColumn("expected", hazard(F.col("near") - F.col("n"), F.col("risk_near") - F.col("risk")) * F.col("risk"))
    h = h.withColumn("expected_span", hazard(F.col("around") - F.col("span"), F.col("risk_around") - F.col("risk_span")) * F.col("risk_span"))
    tests = F.explode(F.array(F.struct(F.lit(1).alias("width"), F.col("n").alias("k"), F.col("expected").alias("mean")), F.struct(F.lit(WIDTH).alias("width"), F.col("span").alias("k"), F.col("expected_span").alias("mean"))))
    t = h.select("src", "len", tests.alias("t")).select("src", "len", "t.width", "t.k", "t.mean")
    t = t.withColumn("p", poisson_sf_udf(F.col("k").cast("double"), F.col("mean")))
    t = false_discovery(t, "p", ["src"]).where((F.col("q") <= FDR) & (F.col("k") >= LEAST) & (F.col("k") > 2 * F.col("mean"))).withColumn("prior", 1 - F.col("mean") / F.col("k"))
    reach = t.withColumn("len", F.explode(F.sequence(F.col("len") - F.col("width") + 1, F.col("len"))))
    return reach.groupBy("src", "len").agg(F.max("prior").alias("prior"))


def judged(docs: DataFrame, key: str, text: str, source: str, elsewhere: float = ELSEWHERE, marks: re.Pattern = MARKS, doubtful: float = DOUBTFUL) -> DataFrame:
    """(key, src, len, prior, mark, log_odds, is_cut) of every text.

    Texts are scanned for a narrow table of lengths, to count words, to fit the model and to be judged.
    ``elsewhere`` is the prior share of texts that a transfer cut at any length, ``marks`` what may stand in place of the loss.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("key"), source_name(source).alias("src"), F.length(F.col(f"`{text}`")).alias("len"), F.col(f"`{text}`").alias("text"))
    filled = rows.where(F.col("text").isNotNull() & (F.length(F.trim("text")) > 0))
    narrow = cut_table(filled.select("src", "len"))
    prior = cut_table(lengths(narrow))
    limits = prior.select("src", "len", F.lit(True).alias("limit"))
    texts = filled.join(limits, ["src", "len"], "left").groupBy("text").agg(F.coalesce(F.max("limit"), F.lit(False)).alias("limit"))
    texts = cut_table(texts)
    model = spark.sparkContext.broadcast(fitted(texts, texts.count(), marks, doubtful))
    drop_table(texts)
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            ends = [bare(t or "", marks) for t in b["text"]]
            odds = [m.log_odds(e[0], limit) if e[0] else -99.0 for e, limit in zip(ends, b["prior"].notna())]
            yield pd.DataFrame({"key": b["key"], "src": b["src"], "len": b["len"], "prior": b["prior"], "mark": [e[1] for e in ends], "log_odds": odds})

    out = rows.join(prior, ["src", "len"], "left").select("key", "src", "len", "prior", "text").mapInPandas(run, f"key {kind}, src string, len int, prior double, mark boolean, log_odds double")
    p = F.least(F.lit(0.98), F.greatest(F.coalesce("prior", F.lit(0.0)), F.when(F.col("mark"), F.lit(0.9)).otherwise(F.lit(elsewhere))))
    return out.withColumn("is_cut", F.col("log_odds") + F.log(p / (1 - p)) > 0).select(F.col("key").alias(key), "src", "len", "prior", "mark", "log_odds", "is_cut")


def cut_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return judged(docs, key, text, source).where("is_cut").select(key).distinct()


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per source: texts, cut texts, their share, and how many were cut at a significant length or elsewhere (in transfer)."""
    j = judged(docs, key, text, source)
    count = lambda c: F.sum(c.cast("long"))
    cut, limit = F.col("is_cut"), F.col("prior").isNotNull()
    out = j.groupBy(F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), count(cut).alias("n_cut"), count(cut & limit).alias("n_cut_at_limit"), count(cut & ~limit).alias("n_cut_in_transfer"))
    return out.withColumn("share", F.round(F.col("n_cut") / F.col("n_docs"), 6))
