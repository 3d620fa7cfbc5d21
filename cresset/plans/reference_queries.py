"""Queries for references that fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cresset.operators import references
from cresset.sources.tables import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    verdicts = table(spark, folder, "verdicts", "row_id", "catalog", "match_id", "judged_at")
    labels = table(spark, folder, "human_labels_201", "row_id", "catalog", "cand_1_id", "labeled_at")
    refs = verdicts.select(F.lit("verdicts").alias("table_name"), "row_id", F.col("catalog").alias("scope"), F.col("match_id").alias("key"), F.col("judged_at").alias("at"))
    refs = refs.union(labels.select(F.lit("human_labels_201"), "row_id", "catalog", "cand_1_id", "labeled_at"))
    parents = table(spark, folder, "catalog", "catalog", "item_id", "added_at", "removed_at").toDF("scope", "key", "since", "until")
    return references.orphan_references(refs, parents)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("table_name", "row_id")


def p2_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """Failing references per table, month and reason."""
    months = references.orphans_by_period(_orphans(spark, folder))
    return months.select("table_name", F.date_format("period", "yyyy-MM").alias("month"), "reason", "n")


_REFS = """
WITH refs AS (
  SELECT 'verdicts' AS table_name, row_id, catalog, lower(trim(match_id, E' \\t\\n\\r')) AS k, judged_at AS t FROM verdicts
  UNION ALL
  SELECT 'human_labels_201', row_id, catalog, lower(trim(cand_1_id, E' \\t\\n\\r')), labeled_at FROM human_labels_201),
parents AS (SELECT catalog, lower(trim(item_id, E' \\t\\n\\r')) AS k, added_at, removed_at FROM catalog),
orphans AS (
  SELECT * FROM refs r WHERE k <> '' AND NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.catalog = r.catalog AND p.k = r.k AND (p.added_at IS NULL OR p.added_at <= r.t) AND (p.removed_at IS NULL OR p.removed_at > r.t)))
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_by_month)}
ORACLE = {
    "p2_found": _REFS + "SELECT table_name, row_id FROM orphans",
    "p2_by_month": _REFS
    + """, reasons AS (
  SELECT o.table_name, o.t, CASE WHEN count(p.k) = 0 THEN 'missing' WHEN min(CASE WHEN p.added_at IS NULL OR p.added_at <= o.t THEN 0 ELSE 1 END) = 0 THEN 'deleted' ELSE 'late' END AS reason
  FROM orphans o LEFT JOIN parents p ON p.catalog = o.catalog AND p.k = o.k GROUP BY o.table_name, o.row_id, o.t)
SELECT table_name, strftime(t, '%Y-%m') AS month, reason, count(*) AS n FROM reasons GROUP BY ALL""",
}
