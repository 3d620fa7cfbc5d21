"""Queries that audit the verdict log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cresset.operators import audit, gates, judging, restoring
from cresset.sources.tables import table

CELL = ["catalog", "model"]
PER_ARM = 500


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts with their place in their cell in order of their ids; the column pos of the table may repeat."""
    rows = table(spark, folder, "verdicts", "row_id", "catalog", "model", "title", "in_catalog", "judged", "match_title")
    return audit.in_log_order(rows, CELL, [F.col("row_id").asc()])


def verdict_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return audit.conflicts(_log(spark, folder), CELL)


def allout_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return audit.blocks(_log(spark, folder), CELL)


def _arms(spark: SparkSession, folder: str) -> DataFrame:
    return audit.arms(_log(spark, folder), CELL)


def audit_arms(spark: SparkSession, folder: str) -> DataFrame:
    return _arms(spark, folder).select("row_id", "arm")


def _sampled(spark: SparkSession, folder: str) -> DataFrame:
    return audit.sample_per_group(_arms(spark, folder), "arm", PER_ARM, F.col("row_id") * 2654435761 % 4294967296, "row_id")


def audit_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _sampled(spark, folder).select("row_id", "arm")


def _flips(spark: SparkSession, folder: str) -> DataFrame:
    again = F.when(F.col("row_id") % 13 == 0, ~F.col("in_catalog")).otherwise(F.col("in_catalog"))
    return audit.flip_rates(_sampled(spark, folder).select("arm", F.col("in_catalog").alias("was"), again.alias("now")))


def flip_rates(spark: SparkSession, folder: str) -> DataFrame:
    """A second judgement that differs on every thirteenth row, per arm."""
    return _flips(spark, folder).select("arm", "n", "n_flipped", F.round("rate", 6).alias("rate"), F.round("excess", 6).alias("excess"), "is_excess")


def two_proportion_test(spark: SparkSession, folder: str) -> DataFrame:
    rates = _flips(spark, folder).where("arm in ('B', 'C')").agg(*(F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{a}_{c}") for a in "BC" for c in ("rate", "n")))
    found = audit.two_proportions(F.col("B_rate"), F.col("B_n"), F.col("C_rate"), F.col("C_n"))
    return rates.select(*(F.round(v, 6).alias(k) for k, v in found.items()))


def audit_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Unanswered rows of the audit sample, and how many that makes of all verdicts."""
    return audit.audit_totals(_sampled(spark, folder), table(spark, folder, "verdicts", "row_id"), "row_id")


def unanswered_by_arm(spark: SparkSession, folder: str) -> DataFrame:
    return audit.unanswered_by(_arms(spark, folder), "arm")


def coverage_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Labeled titles of each catalog that have no judged verdict."""
    titles = table(spark, folder, "human_labels_201", "catalog", F.col("generated_title").alias("title"))
    return audit.coverage(titles, table(spark, folder, "verdicts", "catalog", "title", "judged"), ["catalog"])


def dangling_matches(spark: SparkSession, folder: str) -> DataFrame:
    return audit.dangling_matches(table(spark, folder, "verdicts", "catalog", "match_title", "in_catalog"), table(spark, folder, "catalog", "catalog", "title"))


def last_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "verdicts", "row_id", "catalog", "model", "title", "in_catalog").where("title is not null")
    return judging.last_verdicts(rows, [*CELL, "title"], "row_id")


def integrity_gate(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    titles = table(spark, folder, "human_labels_201", "catalog", F.lower(F.trim("model")).alias("model"), F.col("generated_title").alias("title"))
    return gates.integrity(titles, log, table(spark, folder, "catalog", "catalog", "title"), CELL)


_SLOTS = [f"cand_{k}" for k in range(1, 9)]


def restored_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of the labels with withheld titles filled from their ids."""
    rows = table(spark, folder, "human_labels_201", "row_id", "catalog", *_SLOTS, *(f"{c}_id" for c in _SLOTS))
    slots = restoring.long_slots(rows, ["row_id", "catalog"], _SLOTS, [f"{c}_id" for c in _SLOTS])
    filled = restoring.restore(slots, table(spark, folder, "catalog", "row_id", "catalog", "item_id", "title"), "catalog", "title", "id")
    return filled.select("row_id", "slot", "title", "was_withheld")


def restored_wide(spark: SparkSession, folder: str) -> DataFrame:
    return restoring.wide_slots(restored_titles(spark, folder), ["row_id"], "title", _SLOTS)


#: Catalogs whose titles are withheld.
RESTRICTED = ["movielens", "yelp"]


def _known(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "catalog", "row_id", "catalog", "item_id", "title", "popularity_quartile")


def restored_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of restricted catalogs with withheld titles and quartiles of their matches filled."""
    rows = table(spark, folder, "verdicts", "row_id", "catalog", "match_title", "match_id", "match_quartile")
    filled = restoring.restore(rows, _known(spark, folder), "catalog", "match_title", "match_id", also={"match_quartile": "popularity_quartile"}, restricted=RESTRICTED)
    return filled.select("row_id", "match_title", "match_quartile", "was_withheld")


def restored_frame(spark: SparkSession, folder: str) -> DataFrame:
    """The same for the sampling frame, whose catalogs are spelt in several ways."""
    rows = table(spark, folder, "sampling_frame_1200", "row_id", F.lower(F.trim("catalog")).alias("catalog"), "llm_match_title", "llm_match_id", "llm_match_quartile")
    filled = restoring.restore(rows, _known(spark, folder), "catalog", "llm_match_title", "llm_match_id", also={"llm_match_quartile": "popularity_quartile"}, restricted=RESTRICTED)
    return filled.select("row_id", "llm_match_title", "llm_match_quartile", "was_withheld")


_LOG = "WITH log AS (SELECT *, row_number() OVER (PARTITION BY catalog, model ORDER BY row_id) - 1 AS place FROM verdicts), bad AS (SELECT catalog, model, place // 10 AS block FROM log GROUP BY ALL HAVING count(*) = 10 AND NOT bool_or(coalesce(in_catalog, false))), arms AS (SELECT l.*, CASE WHEN coalesce(in_catalog, false) THEN 'C' WHEN b.block IS NOT NULL THEN 'A' ELSE 'B' END AS arm FROM log l LEFT JOIN bad b ON l.catalog = b.catalog AND l.model = b.model AND l.place // 10 = b.block), "
_SAMPLE = _LOG + f"sampled AS (SELECT * FROM arms QUALIFY row_number() OVER (PARTITION BY arm ORDER BY row_id * 2654435761 % 4294967296, row_id) <= {PER_ARM}), flips AS (SELECT arm, count(*) AS n, count(*) FILTER (row_id % 13 = 0) AS n_flipped, count(*) FILTER (row_id % 13 = 0) / count(*) AS rate FROM sampled WHERE in_catalog IS NOT NULL GROUP BY 1) "
_CONFLICTS = "changes AS (SELECT catalog, model, in_catalog, lag(in_catalog) OVER (PARTITION BY catalog, model, title ORDER BY row_id) AS b FROM verdicts WHERE in_catalog IS NOT NULL AND title IS NOT NULL), conflicts AS (SELECT catalog, model, count(*) AS n_changes FROM changes WHERE b <> in_catalog GROUP BY ALL)"
_COVERED = "wanted AS (SELECT DISTINCT catalog, {model}generated_title AS title FROM human_labels_201 WHERE generated_title IS NOT NULL), judged AS (SELECT DISTINCT catalog, {own}title, true AS j FROM verdicts WHERE judged), coverage AS (SELECT catalog, {own}count(*) AS n_titles, count(j) AS n_judged, count(*) - count(j) AS n_missing FROM wanted LEFT JOIN judged USING (catalog, {own}title) GROUP BY ALL)"
_COVERAGE, _COVERAGE_BY_MODEL = _COVERED.format(model="", own=""), _COVERED.format(model="lower(trim(model)) AS model, ", own="model, ")
_DANGLING = "dangling AS (SELECT DISTINCT catalog, match_title FROM verdicts v WHERE in_catalog AND match_title <> '' AND NOT EXISTS (SELECT 1 FROM catalog c WHERE c.catalog = v.catalog AND c.title = v.match_title))"
_KNOWN = "known AS (SELECT catalog, item_id, arg_max(title, row_id) AS k FROM catalog WHERE title IS NOT NULL GROUP BY ALL)"
_LONG = "slots AS (" + " UNION ALL ".join(f"SELECT row_id, catalog, {k} AS slot, cand_{k} AS title, cand_{k}_id AS id FROM human_labels_201" for k in range(1, 9)) + "), filled AS (SELECT row_id, slot, CASE WHEN coalesce(title, '') = '' AND coalesce(id, '') <> '' THEN coalesce(k, '') ELSE title END AS title, coalesce(title, '') = '' AND coalesce(id, '') <> '' AS was_withheld FROM slots s LEFT JOIN known n ON n.catalog = s.catalog AND n.item_id = s.id)"

def _restored(rows: str, name: str) -> str:
    fill = f"coalesce({name}_title, '') = '' AND coalesce({name}_id, '') <> '' AND coalesce(v.catalog IN ('movielens', 'yelp'), false)"
    known = "SELECT catalog, item_id, arg_max(title, row_id) AS k, arg_max(popularity_quartile, row_id) AS q FROM catalog WHERE title IS NOT NULL GROUP BY ALL"
    return f"WITH known AS ({known}), v AS ({rows}) SELECT row_id, CASE WHEN {fill} THEN coalesce(k, '') ELSE {name}_title END AS {name}_title, CASE WHEN {fill} THEN coalesce(q, '') ELSE {name}_quartile END AS {name}_quartile, {fill} AS was_withheld FROM v LEFT JOIN known n ON n.catalog = v.catalog AND n.item_id = v.{name}_id"


ORACLE: dict[str, str] = {
    "verdict_conflicts": f"WITH {_CONFLICTS} SELECT * FROM conflicts",
    "allout_blocks": _LOG + "x AS (SELECT 1) SELECT catalog, model, block FROM bad",
    "audit_arms": _LOG + "x AS (SELECT 1) SELECT row_id, arm FROM arms",
    "audit_sample": _SAMPLE + "SELECT row_id, arm FROM sampled",
    "flip_rates": _SAMPLE + "SELECT arm, n, n_flipped, round(rate, 6) AS rate, round(rate - (SELECT rate FROM flips WHERE arm = 'C'), 6) AS excess, rate - (SELECT rate FROM flips WHERE arm = 'C') >= 0.02 AS is_excess FROM flips",
    "audit_totals": _SAMPLE + "SELECT count(*) AS n, count(*) FILTER (NOT judged) AS n_unanswered, count(DISTINCT row_id // 10) FILTER (NOT judged) AS partial_batches, CAST(ceil(count(*) / 10) AS BIGINT) AS total_batches, CAST(round((SELECT count(*) FROM verdicts) * (count(*) FILTER (NOT judged)) / count(*)) AS BIGINT) AS affected_estimate FROM sampled",
    "two_proportion_test": _SAMPLE + """, r AS (SELECT max(rate) FILTER (arm = 'B') AS a, max(n) FILTER (arm = 'B') AS na, max(rate) FILTER (arm = 'C') AS b, max(n) FILTER (arm = 'C') AS nb FROM flips),
s AS (SELECT *, a - b AS d, 1.96 * sqrt(a * (1 - a) / na + b * (1 - b) / nb) AS half, (a * na + b * nb) / (na + nb) AS pooled FROM r),
t AS (SELECT *, CASE WHEN pooled * (1 - pooled) > 0 THEN d / sqrt(pooled * (1 - pooled) * (1.0 / na + 1.0 / nb)) ELSE 0.0 END AS z FROM s),
u AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x FROM t)
SELECT round(d, 6) AS difference, round(d - half, 6) AS low, round(d + half, 6) AS high, round(z, 6) AS z,
  round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda k: CASE WHEN x = 0 THEN 0.0 ELSE (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(x) - lgamma(k + 1)) / (2 * k + 1) END)), 6) AS p_value FROM u""",
    "unanswered_by_arm": _LOG + "x AS (SELECT 1) SELECT arm, count(*) AS n_unanswered FROM arms WHERE NOT judged GROUP BY 1",
    "coverage_gap": f"WITH {_COVERAGE} SELECT * FROM coverage",
    "dangling_matches": f"WITH {_DANGLING} SELECT * FROM dangling",
    "last_verdicts": "SELECT catalog, model, title, max(row_id) AS row_id, arg_max(in_catalog, row_id) AS in_catalog FROM verdicts WHERE title IS NOT NULL GROUP BY ALL",
    "integrity_gate": f"WITH {_CONFLICTS}, {_COVERAGE_BY_MODEL}, {_DANGLING} SELECT 'coverage' AS \"check\", concat_ws('/', catalog, model) AS subject, n_missing AS n_bad FROM coverage WHERE n_missing > 0 UNION ALL SELECT 'conflict', catalog || '/' || model, n_changes FROM conflicts UNION ALL SELECT 'dangling', catalog, count(*) FROM dangling GROUP BY catalog",
    "restored_titles": f"WITH {_KNOWN}, {_LONG} SELECT * FROM filled",
    "restored_wide": f"WITH {_KNOWN}, {_LONG} SELECT row_id, " + ", ".join(f"max(title) FILTER (slot = {k}) AS cand_{k}" for k in range(1, 9)) + " FROM filled GROUP BY 1",
    "restored_matches": _restored("SELECT row_id, catalog, match_title, match_id, match_quartile FROM verdicts", "match"),
    "restored_frame": _restored("SELECT row_id, lower(trim(catalog)) AS catalog, llm_match_title, llm_match_id, llm_match_quartile FROM sampling_frame_1200", "llm_match"),
}

QUERIES = {
    f.__name__: f
    for f in (
        verdict_conflicts, allout_blocks, audit_arms, audit_sample, flip_rates, two_proportion_test, audit_totals, unanswered_by_arm, coverage_gap, dangling_matches, last_verdicts, integrity_gate,
        restored_titles, restored_wide, restored_matches, restored_frame,
    )
}
