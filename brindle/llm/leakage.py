"""Evaluation passages in training documents.

The n-grams of normalised evaluation words are a broadcast hash set; documents are scanned window by window
where they lie. Words are the longest runs of letters and digits of the lower-cased NFKC form. The words of
the evaluation set are dictionary-encoded, a document's other words become 0 and break every window, the
windows are hashed with array operations over a whole batch and each hit is verified word by word. An item
and a document that share n or more consecutive words share an n-gram, so nothing is missed.

The evaluation set is read in blocks of bounded size, each its own broadcast (arrays, some 30 bytes a word, and its
vocabulary), so its growth makes more scans and never a larger broadcast. ``spans`` gives what to remove, as ranges of words
and of characters of the original text, and the text without them.

Defined cases: null and empty texts have no words; items shorter than n words cannot leak; repeated documents and items give
distinct pairs; texts are scanned whole; where a word's place can't be told from the normalised form (marks that join across
letters) there are no character ranges and no cleaned text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.cells import LISTED
from brindle.session import cut_table

BLOCK_WORDS = 400_000  # evaluation words of one broadcast
_ASCII = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii():
        return _ASCII.findall(text.lower())
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFKC", text).lower())


def word_places(text: str) -> list[tuple[int, int]] | None:
    """Where each of ``words(text)`` stands in the text, [start, end); None if that can't be told."""
    if text.isascii():
        return [m.span() for m in _ASCII.finditer(text.lower())]
    import regex

    held, forms = [], []
    for m in regex.finditer(r"\X", text):
        held.append(m.span())
        forms.append(unicodedata.normalize("NFKC", m.group()))
    whole = unicodedata.normalize("NFKC", text)
    low = [f.lower() for f in forms]
    if "".join(forms) != whole or sum(map(len, low)) != len(whole.lower()):
        return None
    of = np.repeat(np.arange(len(low)), [len(x) for x in low])
    return [(held[of[m.start()]][0], held[of[m.end() - 1]][1]) for m in regex.finditer(r"[\p{L}\p{N}]+", whole.lower())]


class Grams:
    """The n-grams of a block of items: codes of their words, one after the other, and hash, place and item of each n-gram."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n = n
        self.ids: dict[str, int] = {}
        self.powers = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(n)], dtype=np.uint64)
        codes, places, owners = [], [], []
        at = 0
        for item, text in items:
            c = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            codes.append(np.array(c, dtype=np.uint32))
            places.append(np.arange(at, at + max(0, len(c) - n + 1)))
            owners += [item] * len(places[-1])
            at += len(c)
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        place = np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64)
        h = np.zeros(len(place), dtype=np.uint64)
        for j in range(n if len(place) else 0):
            h += self.codes[place + j].astype(np.uint64) * self.powers[j]
        order = np.argsort(h, kind="stable")
        self.hashes, self.place, self.item = h[order], place[order], np.array(owners)[order] if owners else np.zeros(0, np.int64)

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text number, words of the text, word position, item) of every shared n-gram."""
        n, get = self.n, self.ids.get
        codes, owner, first, size = [], [], [], []
        for t, text in enumerate(texts):
            w = [get(x, 0) for x in words(text)]
            size.append(len(w))
            first.append(len(codes))
            codes += w
            codes.append(0)
            owner.append(len(w) + 1)
        c = np.array(codes, dtype=np.uint64)
        m = len(c) - n + 1
        if m <= 0 or not len(self.hashes):
            return []
        zeros = np.r_[0, np.cumsum(c == 0)]
        full = np.flatnonzero(zeros[n:] == zeros[:-n])
        if not len(full):
            return []
        h = np.zeros(len(full), dtype=np.uint64)
        for j in range(n):
            h += c[full + j] * self.powers[j]
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        count = high - low
        at = np.repeat(full, count)  # each window with each n-gram of its hash
        gram = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        if not len(at):
            return []
        same = np.ones(len(at), dtype=bool)
        for j in range(n):
            same &= c[at + j] == self.codes[self.place[gram] + j]
        at, gram = at[same], gram[same]
        owner, first = np.repeat(np.arange(len(texts)), owner), np.array(first)
        t = owner[at]
        return list(dict.fromkeys(zip(t.tolist(), np.array(size)[t].tolist(), (at - first[t]).tolist(), self.item[gram].tolist())))


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    held, size, given = [], 0, False
    for row in items.select(F.col(f"`{key}`"), F.col(f"`{text}`")).where(F.col(f"`{text}`").isNotNull()).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1]) // 2 + 1
        if size >= BLOCK_WORDS:
            yield held
            held, size, given = [], 0, True
    if held or not given:
        yield held


def shared_grams(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, n: int) -> DataFrame:
    """(doc, item, n_words, word) of every n-gram of words that a document shares with an item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_key}`").alias("doc"), F.col(f"`{doc_text}`").alias("text"))
    kind = dict(rows.dtypes)["doc"]
    item_kind = dict(items.dtypes)[item_key]
    out = None
    for block in _blocks(items, item_key, item_text):
        grams = spark.sparkContext.broadcast(Grams(block, n))

        def run(batches: Iterator[pd.DataFrame], grams=grams) -> Iterator[pd.DataFrame]:
            for b in batches:
                doc = b["doc"].to_numpy()
                hits = grams.value.scan(b["text"].tolist())
                yield pd.DataFrame({"doc": [doc[h[0]] for h in hits], "item": [h[3] for h in hits], "n_words": [h[1] for h in hits], "word": [h[2] for h in hits]}, dtype=object)

        one = rows.mapInPandas(run, f"doc {kind}, item {item_kind}, n_words int, word int")
        out = one if out is None else out.unionByName(one)
    return out


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = 12) -> DataFrame:
    """Distinct (item, document) that share n or more consecutive words."""
    found = shared_grams(docs, items, doc_key, doc_text, item_key, item_text, n)
    return found.select(F.col("item").alias(item_key), F.col("doc").alias(doc_key)).distinct()


def spans(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = 12, whole: float = 0.5) -> DataFrame:
    """Per document: items that it gives away, leaked words, the ranges [from, to) to remove in words and in characters of the original
    text, whether the document goes as a whole (at least ``whole`` of its words leaked), and else the text without the ranges."""
    found = shared_grams(docs, items, doc_key, doc_text, item_key, item_text, n)
    per = found.groupBy("doc", "n_words").agg(F.count_distinct("item").alias("n_items"), F.sort_array(F.collect_set("word")).alias("at"))
    merged = F.aggregate(
        "at",
        F.array().cast("array<struct<from:int,to:int>>"),
        lambda acc, w: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))["to"] >= w),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["from"].alias("from"), (w + n).cast("int").alias("to")))),
        ).otherwise(F.concat(acc, F.array(F.struct(w.cast("int").alias("from"), (w + n).cast("int").alias("to"))))),
    )
    out = per.withColumn("spans", merged)
    leaked = F.aggregate("spans", F.lit(0), lambda a, s: (a + s["to"] - s["from"]).cast("int"))
    out = out.withColumn("leaked_words", leaked)
    out = cut_table(out.withColumn("drop_document", F.col("leaked_words") >= F.col("n_words") * whole))
    few = out.count() <= LISTED  # then the texts stay where they are
    texts = docs.select(F.col(f"`{doc_key}`").alias("doc"), F.col(f"`{doc_text}`").alias("text"))
    both = texts.join(F.broadcast(out) if few else out, "doc")

    @F.pandas_udf("struct<chars: array<struct<from: int, to: int>>, cleaned: string>")
    def removed(text: pd.Series, n_words: pd.Series, from_: pd.Series, to: pd.Series, drop: pd.Series) -> pd.DataFrame:
        chars, cleaned = [], []
        for x, k, a, b, gone in zip(text, n_words, from_, to, drop):
            places = word_places(x)
            if places is None or len(places) != k:
                chars.append(None), cleaned.append(None)
                continue
            cut = [(places[i][0], places[j - 1][1]) for i, j in zip(a, b)]
            chars.append([{"from": i, "to": j} for i, j in cut])
            keep = [x[i:j] for i, j in zip([0, *(j for _, j in cut)], [*(i for i, _ in cut), len(x)])]
            cleaned.append(None if gone else " ".join(keep))
        return pd.DataFrame({"chars": chars, "cleaned": cleaned})

    at = lambda end: F.transform("spans", lambda s: s[end])
    both = both.withColumn("r", removed("text", "n_words", at("from"), at("to"), "drop_document"))
    return both.select(F.col("doc").alias(doc_key), "n_items", "n_words", "leaked_words", "spans", "drop_document", "r.chars", "r.cleaned")
