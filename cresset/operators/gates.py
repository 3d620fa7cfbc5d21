"""Checks that a result must pass: a table of what failed, empty if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cresset.operators import audit

_SUPERSEDED = "SUPERSEDED"


def integrity(titles: DataFrame, verdicts: DataFrame, catalog: DataFrame, cell: list[str]) -> DataFrame:
    """(check, subject, n_bad): titles without verdict, changed verdicts, matches that no entry has."""
    subject = F.concat_ws("/", *cell)
    uncovered = audit.coverage(titles, verdicts, cell).where("n_missing > 0").select(F.lit("coverage").alias("check"), subject.alias("subject"), F.col("n_missing").alias("n_bad"))
    changed = audit.conflicts(verdicts, cell).select(F.lit("conflict"), subject, "n_changes")
    dangling = audit.dangling_matches(verdicts, catalog).groupBy("catalog").agg(F.count("*").alias("n")).select(F.lit("dangling"), "catalog", "n")
    return reduce(DataFrame.union, [uncovered, changed, dangling])


def require(checks: DataFrame) -> None:
    """Raises ValueError naming the first failed checks."""
    failed = checks.limit(20).collect()
    if failed:
        raise ValueError("failed: " + "; ".join(f"{r.check} {r.subject} {r.n_bad}" for r in failed))


def stale(now: DataFrame, committed: DataFrame) -> DataFrame:
    """Lines of one output that the other lacks: (value, side)."""
    return now.select("value").exceptAll(committed.select("value")).withColumn("side", F.lit("now")).union(committed.select("value").exceptAll(now.select("value")).withColumn("side", F.lit("committed")))


def claims(texts: DataFrame, patterns: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """Lines of whole texts that match retracted patterns: (path, line, pattern); texts marked as superseded in their first six lines are exempt."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 6), "\n")
    lines = texts.where(~head.contains(_SUPERSEDED)).select(path, F.posexplode(F.split(text, "\n")).alias("at", "_line"))
    named = F.explode(F.array(*(F.when(F.col("_line").rlike(p), F.lit(p)) for p in patterns)))
    return lines.select(path, (F.col("at") + 1).alias("line"), named.alias("pattern")).where("pattern is not null")
