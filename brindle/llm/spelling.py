"""Freely typed names mapped to the entries of a reference list, misses reported.

The words of the reference list make a symmetric-delete dictionary (every word under each of its forms with up to
two letters deleted), which is broadcast: its size depends on the list alone, and a list above ``LIST`` entries is
refused. A typed name is normalised (compatibility forms, case, dashes, Greek letters, brackets and their content,
quotes, zero for o), its words are looked up with the edit distance their length allows, also as abbreviations with
a full stop ("su.", "dom.-cont.") and as words that lost or moved their hyphen. An entry matches if it has the same
words in any order; the entry with the smallest weighted Damerau-Levenshtein distance wins, then the one that is
more frequent letter for letter, then the smaller number. Words of remark ("putative", "partial"; a parameter) cost nothing.
Every reading of every word counts: names with few readings are looked up combination by combination, for others the
entries that hold a reading of each word are fetched from an inverted index and the cheapest cover of each entry is searched.
Short words, single letters and numerals must agree exactly: they tell entries apart. A name with a word that no
entry has means no entry.

Names are mapped where their rows lie, each worker remembering what it has seen; there is no shuffle but the one that
drops repeated rows. Defined cases: null and blank names and names equal to an entry are no cases; null keys are left
out; repeated rows count once; names are read whole; empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations, product
from math import prod

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIST = 200_000  # entries of a reference list that is broadcast
REMEMBERED = 400_000  # names and words a worker remembers
COMBINATIONS = 16  # of readings that are tried one by one; beyond, the entries are asked which of them they hold

# Words of remark, Greek letters by name.
REMARKS = "putative probable possible predicted potential presumed likely partial fragment truncated like similar homolog homologue conserved".split()
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "κ": "kappa", "λ": "lambda", "σ": "sigma", "ω": "omega"}
ALIKE = {frozenset(x) for x in ("0o", "1l", "1i", "5s", "il", "uv", "mn")}

_BRACKETS = ("()", "[]", "{}")
_DASHES = re.compile(r"[‐-―−­﹘﹣－]")
_ZERO = re.compile(r"(?<=[a-z])0|0(?=[a-z])")


def unbracketed(s: str) -> str:
    """The text without what stands in closed brackets, however deep; a bracket without its partner stays."""
    for left, right in _BRACKETS:
        if left not in s or right not in s:
            continue
        out: list[str] = []
        opened: list[int] = []
        for c in s:
            if c == left:
                opened.append(len(out))
                out.append(c)
            elif c == right and opened:
                del out[opened.pop() :]
                out.append(" ")
            else:
                out.append(c)
        s = "".join(out)
    return s


def normalise(name: str) -> str:
    s = unicodedata.normalize("NFKC", name).lower()
    s = _DASHES.sub("-", s)
    for g, w in GREEK.items():
        if g in s:
            s = s.replace(g, w)
    return _ZERO.sub("o", unbracketed(s))


def distance(a: str, b: str) -> float:
    """Weighted Damerau-Levenshtein distance (adjacent transpositions): look-alike letters, doubled letters and swaps cost less."""
    prev2, prev = [], [0.0]
    for j in range(1, len(b) + 1):
        prev.append(prev[-1] + (0.6 if j > 1 and b[j - 1] == b[j - 2] else 1.0))
    for i in range(1, len(a) + 1):
        doubled = 0.6 if i > 1 and a[i - 1] == a[i - 2] else 1.0
        cur = [prev[0] + doubled]
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            cost = 0.0 if x == y else 0.4 if frozenset((x, y)) in ALIKE else 1.0
            best = min(prev[j] + doubled, cur[j - 1] + (0.6 if j > 1 and y == b[j - 2] else 1.0), prev[j - 1] + cost)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, prev2[j - 2] + 0.8)
            cur.append(best)
        prev2, prev = prev, cur
    return prev[-1]


def deletes(word: str, most: int) -> set[str]:
    out = {word}
    for k in range(1, min(most, len(word) - 1) + 1):
        for at in combinations(range(len(word)), k):
            out.add("".join(c for i, c in enumerate(word) if i not in at))
    return out


def allowed(word: str) -> int:
    """Edits a word of the list may have suffered."""
    if len(word) < 3 or re.fullmatch(r"[ivx]+|\d+", word):
        return 0
    return 1 if len(word) < 6 else 2


def within(a: str, b: str, most: int) -> bool:
    """Whether the unweighted distance with transpositions is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    prev2, prev = [], list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        cur = [i]
        for j in range(1, len(b) + 1):
            v = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, prev2[j - 2] + 1)
            cur.append(v)
        if min(cur) > most:
            return False
        prev2, prev = prev, cur
    return prev[-1] <= most


class Dictionary:
    """Reference entries by their words, and the symmetric-delete index of these words."""

    def __init__(self, entries: list[tuple[int, str]], frequency: dict[str, int] | None = None, remarks: list[str] | None = None):
        self.entries: dict[tuple, list[tuple[int, int]]] = {}
        self.words: dict[str, tuple[str, ...]] = {w: () for w in (REMARKS if remarks is None else remarks)}
        for number, name in entries:
            bag = []
            for chunk in re.findall(r"[\w-]+", normalise(name)):
                pieces = [p for p in chunk.split("-") if p]
                bag += pieces
                for p in pieces:
                    self.words[p] = (p,)
                if len(pieces) > 1:
                    self.words.setdefault("".join(pieces), tuple(pieces))
            self.entries.setdefault(tuple(sorted(bag)), []).append((-(frequency or {}).get(name, 0), number))
        self.holders: dict[str, set[tuple]] = {}
        for bag in self.entries:
            for w in bag:
                self.holders.setdefault(w, set()).add(bag)
        self.widest = max(map(len, self.entries), default=0)
        self.index: dict[str, list[str]] = {}
        for w in self.words:
            for form in deletes(w, allowed(w)):
                self.index.setdefault(form, []).append(w)
        self.starts: dict[str, list[str]] = {}
        for w in self.words:
            for k in range(2, len(w)):
                self.starts.setdefault(w[:k], []).append(w)
        self.longest = 2 * max(map(len, self.words), default=0) + 1  # no reading is possible for longer words
        self._seen: dict[tuple[str, bool], list[tuple[float, tuple[str, ...]]]] = {}

    def readings(self, word: str, short: bool) -> list[tuple[float, tuple[str, ...]]]:
        """(cost, words of the list) that a typed word may stand for; ``short``: a full stop follows it."""
        if (word, short) in self._seen:
            return self._seen[word, short]
        found: dict[tuple[str, ...], float] = {}
        if word in self.words:
            found[self.words[word]] = 0.0
        elif 1 < len(word) <= self.longest and not word.isdigit():
            for form in deletes(word, 2) if len(word) <= self.longest // 2 + 2 else ():
                for w in self.index.get(form, ()):
                    if within(word, w, allowed(w)):
                        found[self.words[w]] = min(found.get(self.words[w], 9.0), distance(word, w))
            for i in range(1, len(word)):  # two words that ran together, or a letter where their space was
                left, right, skip = self.words.get(word[:i]), self.words.get(word[i:]), self.words.get(word[i + 1 :])
                if left is not None and right is not None:
                    found.setdefault(left + right, 0.5)
                if left is not None and skip is not None and min(i, len(word) - i - 1) > 2:
                    found.setdefault(left + skip, 1.0)
        if len(word) >= (2 if short else 4):
            for w in self.starts.get(word, ()):
                found.setdefault(self.words[w], 0.3 if short else 0.9)
        out = sorted((c, w) for w, c in found.items())
        if len(self._seen) >= REMEMBERED:
            self._seen.clear()
        self._seen[word, short] = out
        return out

    def lookup(self, name: str) -> int:
        """The number of the entry a name means, or -1."""
        found = [(m.group(1), m.group(2) == ".") for m in re.finditer(r"([^\W_]+)(\.?)", normalise(name))]
        choices = []
        for w, dot in found:
            choices.append(self.readings(w, dot))
            if not choices[-1]:
                return -1
        if not choices or sum(all(words for _, words in c) for c in choices) > self.widest:
            return -1
        best = None
        if prod(len(c) for c in choices) <= COMBINATIONS:
            costs: dict[tuple, float] = {}
            for pick in product(*choices):
                bag = tuple(sorted(p for _, words in pick for p in words))
                cost = sum(c for c, _ in pick)
                if bag in self.entries and cost < costs.get(bag, 1e9):
                    costs[bag] = cost
        else:
            costs = self._covers(choices)
        for bag, cost in costs.items():
            for rank in self.entries[bag]:
                key = (round(cost, 6), *rank)
                if best is None or key < best:
                    best = key
        return best[2] if best else -1

    def _covers(self, choices: list[list[tuple[float, tuple[str, ...]]]]) -> dict[tuple, float]:
        """Cost of each entry that holds exactly one reading of every word and nothing else."""
        held: set[tuple] | None = None
        need = [c for c in choices if all(words for _, words in c)]
        for c in sorted(need, key=len):
            mine: set[tuple] = set()
            for _, words in c:
                if held is None:
                    mine |= min((self.holders.get(w, set()) for w in words), key=len)
                else:
                    mine |= {bag for bag in held if words[0] in bag}
            held = mine
            if not held:
                return {}
        out = {}
        for bag in self.entries if held is None else held:
            if len(bag) < len(need):
                continue
            inside = set(bag)
            left = [[(cost, words) for cost, words in c if inside.issuperset(words)] for c in choices]
            states = {bag: 0.0}  # what of the entry is still open -> smallest cost so far
            for c in sorted(left, key=len):
                after: dict[tuple, float] = {}
                for rest, so_far in states.items():
                    for cost, words in c:
                        open_ = _without(rest, words)
                        if open_ is not None and so_far + cost < after.get(open_, 1e9):
                            after[open_] = so_far + cost
                states = after
            if () in states:
                out[bag] = states[()]
        return out


def _without(bag: tuple, words: tuple[str, ...]) -> tuple | None:
    rest = list(bag)
    for w in words:
        if w not in rest:
            return None
        rest.remove(w)
    return tuple(rest)


def reference(rows: DataFrame, name: str, entries: DataFrame, entry_id: str, entry_name: str, remarks: list[str] | None = None) -> tuple[Dictionary, DataFrame]:
    """The dictionary of a reference list, with how often each entry occurs letter for letter in ``rows``; the distinct names (n) of the list."""
    held = entries.select(F.col(f"`{entry_id}`"), F.col(f"`{entry_name}`")).where(F.col(f"`{entry_name}`").isNotNull()).limit(LIST + 1).collect()
    if len(held) > LIST:
        raise ValueError(f"a reference list of more than {LIST} entries isn't broadcast")
    listed = entries.select(F.col(f"`{entry_name}`").alias("n")).distinct()
    count = rows.select(F.col(f"`{name}`").alias("n")).join(F.broadcast(listed), "n").groupBy("n").count()
    return Dictionary([(r[0], r[1]) for r in held], {r["n"]: r["count"] for r in count.collect()}, remarks), listed


def canonical(rows: DataFrame, key: str, name: str, entries: DataFrame, entry_id: str, entry_name: str, remarks: list[str] | None = None) -> DataFrame:
    """Distinct (key, name, entry_id) of the rows whose name is neither null, blank nor an entry letter for letter; -1: no entry."""
    words, listed = reference(rows, name, entries, entry_id, entry_name, remarks)
    known = rows.sparkSession.sparkContext.broadcast(words)
    df = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{name}`").alias("name")).where(F.col("key").isNotNull() & (F.length(F.regexp_replace("name", r"(?U)\s+", "")) > 0))
    df = df.join(F.broadcast(listed.withColumnRenamed("n", "name")), "name", "left_anti").select("key", "name")  # at most LIST names
    kind = dict(df.dtypes)["key"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen = known.value, {}
        for b in batches:
            out = []
            for n in b["name"]:
                i = seen.get(n)
                if i is None:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    i = seen[n] = words.lookup(n)
                out.append(i)
            yield b.assign(entry=out)

    out = df.mapInPandas(run, f"key {kind}, name string, entry {dict(entries.dtypes)[entry_id]}")
    return out.select(F.col("key").alias(key), F.col("name").alias(name), F.col("entry").alias(entry_id))
