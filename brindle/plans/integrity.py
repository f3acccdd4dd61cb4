"""Queries of problem 1: references to representatives that rep_index did not hold at that time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.operators.orphans import References, orphan_references, orphan_report
from brindle.session import table

KEYS = {"ie": "ie_id", "integrase": "integrase_id", "rep": "rep_id"}


def _parts(spark: SparkSession, d: str):
    refs = [
        References("ie_instance_classification", table(spark, d, "ie_instance_classification"), "element_id", "classified_at", "ie"),
        References("cohort_6960_atlas_join", table(spark, d, "cohort_6960_atlas_join"), "integrase_id", "joined_at", "integrase"),
        References("ie_rep_rows_c6960_unk", table(spark, d, "ie_rep_rows_c6960_unk"), "rep_id", "built_at", "rep", True),
        References("leiden_clusters_c6960_unk", table(spark, d, "leiden_clusters_c6960_unk"), "rep_id", "built_at", "rep", True),
    ]
    return refs, table(spark, d, "rep_index"), KEYS, "indexed_at", "withdrawn_at"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(*_parts(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(*_parts(spark, d))


_REFS = r"""
WITH raw AS (
  SELECT 'ie_instance_classification' AS src_table, 'ie' AS kind, element_id AS k, classified_at AS t FROM ie_instance_classification
  UNION ALL SELECT 'cohort_6960_atlas_join', 'integrase', integrase_id, joined_at FROM cohort_6960_atlas_join
  UNION ALL SELECT 'ie_rep_rows_c6960_unk', 'rep', rep_id, built_at FROM ie_rep_rows_c6960_unk
  UNION ALL SELECT 'leiden_clusters_c6960_unk', 'rep', rep_id, built_at FROM leiden_clusters_c6960_unk),
s1 AS (SELECT src_table, kind, t, regexp_replace(regexp_replace(k, '^\s+|\s+$', '', 'g'), '\|sample=.*$', '', 's') AS k FROM raw),
s2 AS (SELECT src_table, kind, t, regexp_replace(k, '^\s+|\s+$', '', 'g') AS k FROM s1),
refs AS (SELECT src_table, kind, t, CASE WHEN kind = 'rep' THEN regexp_replace(k, '\.0$', '') ELSE k END AS ref_id, strftime(t, '%Y-%m') AS period FROM s2),
good AS (SELECT * FROM refs WHERE ref_id NOT IN ('', 'nan', 'None', '<NA>') AND t IS NOT NULL),
held AS (SELECT 'ie' AS kind, ie_id AS k, indexed_at AS a, withdrawn_at AS b FROM rep_index
  UNION ALL SELECT 'integrase', integrase_id, indexed_at, withdrawn_at FROM rep_index
  UNION ALL SELECT 'rep', CAST(rep_id AS VARCHAR), indexed_at, withdrawn_at FROM rep_index),
bad AS (SELECT DISTINCT src_table, ref_id, period FROM good g WHERE NOT EXISTS (
  SELECT 1 FROM held h WHERE h.kind = g.kind AND h.k = g.ref_id AND h.a <= g.t AND (h.b IS NULL OR h.b > g.t)))
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
ORACLE = {
    "p1_found": _REFS + "SELECT src_table, ref_id, period FROM bad",
    "p1_report": _REFS
    + """, tot AS (SELECT src_table, period, count(*) AS n_rows, count(DISTINCT ref_id) AS n_refs FROM good GROUP BY ALL),
  b AS (SELECT src_table, period, count(*) AS n_orphans FROM bad GROUP BY ALL)
SELECT src_table, period, n_rows, n_refs, coalesce(n_orphans, 0) AS n_orphans FROM tot LEFT JOIN b USING (src_table, period)""",
}
