"""Open gaps of hot keys: references in a month in which the parent was in force, absent and in force again."""

from datetime import datetime, timedelta

import pytest

from brindle.operators import orphans
from brindle.operators.orphans import References, orphan_references


def at(day, minute=0):
    return datetime(2024, 5, day) + timedelta(minutes=minute)


@pytest.mark.parametrize("listed", [100_000, 0])
def test_a_third_of_all_rows_on_a_key_with_an_open_gap(spark, monkeypatch, listed):
    monkeypatch.setattr(orphans, "LISTED", listed)
    parents = [("hot", at(1), at(10)), ("hot", at(20), None), ("shut", at(1), at(10)), ("shut", at(20), None), ("whole", datetime(2024, 1, 1), None)]
    rows = [("hot", at(5, i % 900)) for i in range(2000)] + [("hot", at(25, i % 900)) for i in range(1000)] + [("hot", at(15))]
    rows += [("shut", at(5)), ("shut", at(25))] + [("whole", at(1 + i % 28)) for i in range(3000)] + [(f"lost{i}", at(3)) for i in range(20)] + [(None, at(3)), (" nan ", at(3)), ("hot", None)]
    p = spark.createDataFrame(parents, "id string, since timestamp, until timestamp")
    q = spark.createDataFrame(rows, "ref string, at timestamp")
    got = {tuple(x) for x in orphan_references([References("t", q, "ref", "at", "rep")], p, {"rep": "id"}, "since", "until").collect()}
    assert got == {("t", "hot", "2024-05"), *[("t", f"lost{i}", "2024-05") for i in range(20)]}
