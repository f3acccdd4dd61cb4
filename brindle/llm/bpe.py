"""Encoding of texts with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; each piece is merged with a segment tree over its byte positions
whose leaves hold the rank of the pair that starts there and whose nodes hold the leftmost minimum. A merge
updates three leaves (the pair itself, the one before it, the place that dies), so a piece of n bytes costs
O(n log n), also a piece of megabytes without a space. Pieces seen before come from a bounded cache of the
Python worker. Rows stay where they are: there is no shuffle. The vocabulary is read once by the driver and broadcast (a file
above LARGEST is refused), so executors need no file of their own.

Defined cases: null and empty texts give an empty list; strings that look like special tokens are ordinary
text; repeated ids are encoded row by row; every text is encoded whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 500_000  # pieces a worker remembers
CACHED_BYTES = 64  # longer pieces are not remembered
LARGEST = 64 << 20  # bytes of a vocabulary file
NONE = 1 << 62


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(0, (n - 1).bit_length())
    end = list(range(1, n + 1))  # of the live token that starts here
    prev = list(range(-1, n - 1))
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for v in range(size - 1, 0, -1):
        a, b = tree[2 * v], tree[2 * v + 1]
        tree[v] = a if a < b else b

    def put(i: int, key: int) -> None:
        v = size + i
        if tree[v] == key:
            return
        tree[v] = key
        v >>= 1
        while v:
            a, b = tree[2 * v], tree[2 * v + 1]
            low = a if a < b else b
            if tree[v] == low:
                return
            tree[v] = low
            v >>= 1

    def pair(i: int) -> int:
        j = end[i]
        if j >= n:
            return NONE
        r = ranks.get(piece[i : end[j]])
        return NONE if r is None else r << 32 | i

    while tree[1] != NONE:
        i = tree[1] & 0xFFFFFFFF
        j = end[i]
        end[i] = end[j]
        if end[i] < n:
            prev[end[i]] = i
        put(j, NONE)
        put(i, pair(i))
        if prev[i] >= 0:
            put(prev[i], pair(prev[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> dict[bytes, int]:
    if os.path.getsize(path) > LARGEST:
        raise ValueError(f"a vocabulary of more than {LARGEST} bytes isn't broadcast")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN, ranks: dict[bytes, int] | None = None):
        import regex

        self.ranks = _vocabulary(path) if ranks is None else ranks
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for word in self.split(text):
            ids = cache.get(word)
            if ids is None:
                ids = merge_piece(word.encode("utf-8", "surrogatepass"), self.ranks)
                if len(word) <= CACHED_BYTES:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[word] = ids
            out += ids
        return out


_ENCODERS: dict[tuple[int, str], Encoder] = {}  # of this worker, by broadcast and pattern


def encode(df: DataFrame, key: str, text: str, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, ids) of every row."""
    known = df.sparkSession.sparkContext.broadcast(_vocabulary(path))
    number = known._jbroadcast.id()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = _ENCODERS.get((number, pattern))
        if e is None:
            _ENCODERS.clear()  # one vocabulary at a time, with its cache of pieces
            e = _ENCODERS[number, pattern] = Encoder(pattern=pattern, ranks=known.value)
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "ids": [e.encode(t) for t in b["text"]]})

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(run, f"key {dict(rows.dtypes)['key']}, ids array<int>").withColumnRenamed("key", key)
