"""References to records that do not exist (at the time of the reference).

Keys are dictionary-encoded as integers within hash buckets, references and parents become compressed
bitmaps per key range and month, and ``reference AND NOT parent`` leaves the keys whose parent was not in
force for the whole month. Those few are then decided exactly from the first and last reference of the month
against the parent's intervals. Only the open gaps, of a month in which the parent was in force, absent and in force
again, need single references looked at: up to LISTED open gaps are sent to the references, which are not shuffled
for that; beyond, an inner join that may split either side brings them together.

Scale and skew: references are pre-aggregated per (table, key, month) before the shuffle that carries
them, so a key with a third of all rows is a handful of rows; the intervals of a key that share a dyadic
point are merged map-side too. The number of buckets follows ``spark.sql.shuffle.partitions``.

Defined cases: a null, blank, ``nan``, ``None`` or ``<NA>`` reference refers to nothing; a row without a time
belongs to no period and gives no case; a parent without a start was never in force; an interval that ends at
or before its start is empty; repeated rows count once; empty tables give empty results; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.bitmaps import RangeBitmap
from brindle.session import cut_table, partitions

LISTED = 100_000  # open gaps that are broadcast; more of them are joined
NOTHING = ("", "nan", "None", "<NA>")
OFFSET = 1 << 58  # makes every microsecond count positive
OPEN = 1 << 60  # the end of an interval that has none


@dataclass(frozen=True)
class References:
    """Rows of ``df`` whose ``key`` refers to parent keys of ``kind`` at ``time``."""

    name: str
    df: DataFrame
    key: str
    time: str
    kind: str
    numeric: bool = False


def clean_key(key: Column, numeric: bool = False) -> Column:
    """The key without surrounding white space, ``|sample=`` tail and (numeric keys) final ``.0``; null if it refers to nothing."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    out = strip(F.regexp_replace(strip(key.cast("string")), r"(?s)\|sample=.*$", ""))
    if numeric:
        out = F.regexp_replace(out, r"\.0$", "")
    return F.when(~out.isin(*NOTHING), out)


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) + F.lit(OFFSET)


def _month(time: Column) -> Column:
    return (F.year(time) * 12 + F.month(time) - 1).cast("int")


def _rows(refs: list[References]) -> DataFrame:
    out = None
    for r in refs:
        one = r.df.select(F.lit(r.name).alias("src_table"), F.lit(r.kind).alias("kind"), clean_key(F.col(f"`{r.key}`"), r.numeric).alias("key"), _month(F.col(f"`{r.time}`")).alias("month"), _micros(F.col(f"`{r.time}`")).alias("us"))
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("key").isNotNull() & F.col("us").isNotNull())


def _intervals(parents: DataFrame, keys: dict[str, str], start: str, end: str) -> DataFrame:
    """Distinct parent intervals per key; those of one key that contain the same dyadic point are merged."""
    kinds = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_replace(F.col(f"`{c}`").cast("string"), r"(?U)^\s+|\s+$", "").alias("key")) for kind, c in keys.items()]))
    rows = parents.select(kinds.alias("k"), _micros(F.col(f"`{start}`")).alias("a"), F.coalesce(_micros(F.col(f"`{end}`")), F.lit(OPEN)).alias("b")).select("k.kind", "k.key", "a", "b")
    rows = rows.where(F.col("key").isNotNull() & F.col("a").isNotNull() & (F.col("b") > F.col("a")))
    last = F.col("b") - 1
    level = F.length(F.bin(F.col("a").bitwiseXOR(last))) - 1
    point = F.when(F.col("a") == last, F.col("a")).otherwise(F.expr("shiftleft(shiftright(b - 1, level), level)"))
    rows = rows.withColumn("level", level.cast("int")).withColumn("point", point)
    return rows.groupBy("kind", "key", "point").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("point")


def _month_edges(months: np.ndarray) -> np.ndarray:
    stamps = np.array(months, dtype="int64") - 1970 * 12
    return stamps.astype("datetime64[M]").astype("datetime64[us]").astype("int64") + OFFSET


def _survivors(refs: pd.DataFrame, codes: np.ndarray, parents: pd.DataFrame, parent_codes: np.ndarray) -> np.ndarray:
    """Positions of refs whose parent was not in force through the whole month: bitmap of references AND NOT bitmap of parents."""
    keep = np.zeros(len(refs), dtype=bool)
    a, b = parents["a"].to_numpy(), parents["b"].to_numpy()
    for month, at in refs.groupby("month", sort=True).indices.items():
        lo, hi = _month_edges(np.array([month, month + 1]))
        whole = RangeBitmap.of(parent_codes[(a <= lo) & (b >= hi)])
        for _, sub in refs.iloc[at].groupby("src_table").indices.items():
            pos = at[sub]
            left = RangeBitmap.of(codes[pos]).and_not(whole).decode()
            keep[pos] = np.isin(codes[pos], left)
    return np.flatnonzero(keep)


def _bucket(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    columns = ["src_table", "kind", "key", "month", "gap_from", "gap_to"]
    if not len(refs):
        return pd.DataFrame(columns=columns)
    words = pd.concat([refs["kind"] + "\x1f" + refs["key"], parents["kind"] + "\x1f" + parents["key"]], ignore_index=True)
    codes = pd.factorize(words)[0].astype("int64")
    codes, parent_codes = codes[: len(refs)], codes[len(refs) :]
    at = _survivors(refs, codes, parents, parent_codes)
    left = refs.iloc[at].assign(code=codes[at], row=np.arange(len(at)))
    left["lo"], left["hi"] = _month_edges(left["month"].to_numpy()), _month_edges(left["month"].to_numpy() + 1)
    part = left.merge(parents[["a", "b"]].assign(code=parent_codes), on="code", how="inner")
    part = part[(part["a"] < part["hi"]) & (part["b"] > part["lo"])]
    part = part.assign(a=np.maximum(part["a"], part["lo"]), b=np.minimum(part["b"], part["hi"])).sort_values(["row", "a", "b"], kind="stable")
    # the gaps of each surviving month: before the first interval, between them, after the last one
    reach = part.groupby("row")["b"].cummax()
    before = reach.groupby(part["row"]).shift(1)
    start = before.fillna(part["lo"]).astype("int64")
    gaps = pd.DataFrame({"row": part["row"], "gap_from": start, "gap_to": part["a"]})
    tail = pd.DataFrame({"row": part["row"], "gap_from": reach, "gap_to": part["hi"]}).groupby("row", as_index=False).last()
    alone = left.loc[~left["row"].isin(part["row"]), ["row", "lo", "hi"]].rename(columns={"lo": "gap_from", "hi": "gap_to"})
    gaps = pd.concat([gaps, tail, alone], ignore_index=True)
    gaps = gaps[gaps["gap_to"] > gaps["gap_from"]].merge(left[["row", "src_table", "kind", "key", "month", "first", "last"]], on="row")
    gaps = gaps[(gaps["first"] < gaps["gap_to"]) & (gaps["last"] >= gaps["gap_from"])]
    sure = (gaps["first"] >= gaps["gap_from"]) | (gaps["last"] < gaps["gap_to"])
    found = gaps[sure].drop_duplicates("row").assign(gap_from=-1, gap_to=-1)
    open_ = gaps[~sure & ~gaps["row"].isin(found["row"])]
    return pd.concat([found, open_], ignore_index=True)[columns]


def orphan_references(refs: list[References], parents: DataFrame, keys: dict[str, str], start: str, end: str) -> DataFrame:
    """Distinct (src_table, ref_id, period) of references to keys that no parent row held in force at the row's own time.

    ``keys`` maps each kind of key to the parent's column; a parent row is in force from ``start`` until ``end`` (null: still).
    """
    spark = parents.sparkSession
    rows = _rows(refs)
    bucket = F.pmod(F.xxhash64("kind", "key"), F.lit(4 * partitions(spark))).cast("int")
    months = rows.groupBy("src_table", "kind", "key", "month").agg(F.min("us").alias("first"), F.max("us").alias("last")).withColumn("bucket", bucket)
    held = _intervals(parents, keys, start, end).withColumn("bucket", bucket)
    schema = "src_table string, kind string, key string, month int, gap_from long, gap_to long"
    found = months.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInPandas(lambda r, p: _bucket(r, p), schema)
    found = cut_table(found)
    gaps = found.where("gap_from >= 0")
    n = gaps.count()
    case = ["src_table", "key", "month"]
    hit = found.where("gap_from < 0").select(*case)
    if n:
        near = (F.broadcast(gaps) if n <= LISTED else gaps).alias("f")
        on = [F.col(f"f.{c}") == F.col(f"r.{c}") for c in ("src_table", "kind", "key", "month")]
        inside = rows.alias("r").join(near, [*on, F.col("r.us") >= F.col("f.gap_from"), F.col("r.us") < F.col("f.gap_to")])
        hit = hit.unionByName(inside.select(*[F.col(f"f.{c}").alias(c) for c in case]))
    period = F.format_string("%04d-%02d", F.floor(F.col("month") / 12).cast("int"), (F.col("month") % 12 + 1).cast("int"))
    return hit.select("src_table", F.col("key").alias("ref_id"), period.alias("period")).distinct()


def orphan_report(refs: list[References], parents: DataFrame, keys: dict[str, str], start: str, end: str) -> DataFrame:
    """Per table and month: distinct references and how many of them are orphans."""
    rows = _rows(refs).groupBy("src_table", "key", "month").agg(F.count(F.lit(1)).alias("n_rows"))
    period = F.format_string("%04d-%02d", F.floor(F.col("month") / 12).cast("int"), (F.col("month") % 12 + 1).cast("int"))
    total = rows.groupBy("src_table", period.alias("period")).agg(F.count(F.lit(1)).alias("n_refs"), F.sum("n_rows").alias("n_rows"))
    bad = orphan_references(refs, parents, keys, start, end).groupBy("src_table", "period").agg(F.count(F.lit(1)).alias("n_orphans"))
    return total.join(bad, ["src_table", "period"], "left").select("src_table", "period", "n_rows", "n_refs", F.coalesce("n_orphans", F.lit(0)).cast("long").alias("n_orphans"))
