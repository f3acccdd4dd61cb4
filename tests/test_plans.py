"""Plans: no Cartesian products, filters and columns reach the scan, top rows are cut before the shuffle."""

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def plan(spark, name):
    df = entry.queries()[name](spark, D)
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["discovery_cascade", "jn1_downstream_partners", "jn18_overlap_fraction", "jn21_compartment", "int2_union", "p1_found", "jn23_star", "cls1_marker_hits"])
def test_no_product_of_tables(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "jn18_overlap_fraction")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)" in text
    assert "props" not in text.split("== Physical Plan ==")[1]


def test_best_rows_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "win3_anchored")


def test_regex_markers_stay_in_generated_code(spark):
    assert "Python" not in plan(spark, "cls1_marker_hits")
