"""Ordered gates over rows: every row stays, each gate becomes a flag, the first failure names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(df: DataFrame, gates: list[tuple[str, Column, str | Column]], reason: str = "reject_reason", stop_after: int = 0) -> DataFrame:
    """``gates``: (name, condition, reason). A null condition fails. The first ``stop_after`` gates end the evaluation: behind
    one of them that failed, all later flags are false."""
    flags, blocked = [], F.lit(False)
    for i, (name, cond, _) in enumerate(gates):
        ok = F.coalesce(cond, F.lit(False)) & ~blocked
        flags.append(ok.alias(f"passed_{name}"))
        if i < stop_after:
            blocked = blocked | ~F.coalesce(cond, F.lit(False))
    why = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), w if isinstance(w, Column) else F.lit(w)) for _, c, w in gates], F.lit(""))
    return df.select("*", *flags, why.alias(reason)).withColumn("passed", F.col(reason) == "")


def first_match(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the first condition that holds."""
    out = F.coalesce(*[F.when(c, F.lit(label)) for c, label in rules])
    return F.coalesce(out, F.lit(default)) if default is not None else out


def all_matches(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """Array of the labels of all conditions that hold, in the order of the rules."""
    hit = F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in rules]))
    return F.when(F.size(hit) == 0, F.array(F.lit(default))).otherwise(hit) if default is not None else hit


def regex_rules(text: Column, rules: list[tuple[str, str]]) -> list[tuple[Column, str]]:
    """(pattern, label) as case-insensitive conditions; each pattern is a literal, so it is compiled once."""
    return [(text.rlike(f"(?i){p}"), label) for p, label in rules]
