"""Queries that hold instruments against human labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cresset.operators import publishing, resampling, scoring
from cresset.plans import sql as Q
from cresset.sources.tables import table

TERMS = ["meadow", "lantern", "kettle", "(19"]
RELABELED = 7


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """Decided labels, first row of each key, with the judge's answer as a boolean."""
    rows = table(spark, folder, "human_labels_201", "row_id", "catalog", "model", "generated_title", "llm_says", "same_item", "human_in", "llm_dep", "llm_in", "llm8_in", "tset_in", "tsort_in", "surf_in")
    says = F.upper(F.trim("llm_says"))
    shown = F.when(says == "IN", True).when(says == "OUT", False)
    return scoring.decided(rows).withColumns({"says": shown, "model": F.lower(F.trim("model")), "human_in": F.col("same_item") > 0})


_INSTRUMENTS = {"judge8": "llm8_in", "judge20": "llm_in", "token_set": "tset_in", "token_sort": "tsort_in", "surface": "surf_in", "always_in": F.lit}


def _instruments() -> dict:
    return {k: F.lit(True) if v is F.lit else v for k, v in _INSTRUMENTS.items()}


def _all_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The instruments of the labels, and beside them equality of folded titles with any candidate."""
    exact = candidate_instruments(spark, folder).select("row_id", "exact")
    labels = _labels(spark, folder).join(exact, "row_id")
    return scoring.long_predictions(labels, _instruments() | {"exact": "exact"}, "human_in", "catalog", "generated_title")


def instrument_kappa(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of every instrument with the labels beyond chance."""
    found = scoring.kappa(_all_predictions(spark, folder), "predicted", "human", "instrument")
    return found.select("instrument", "n", "n_disagree", *(F.round(c, 6).alias(c) for c in ("agreement", "kappa")))


def instrument_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """F1, kappa and bias of every instrument with intervals by resampling."""
    return resampling.bootstrap_all(_all_predictions(spark, folder))


def f1_without_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Errors and F1 of every instrument, with and without titles that hold given terms."""
    from cresset.functions.text import contains_any

    found = scoring.without(_predictions(spark, folder), contains_any("generated_title", TERMS))
    return found.select("instrument", "n", "fp", "fn", F.round("f1", 6).alias("f1"), "n_overlapping", F.round("f1_without", 6).alias("f1_without"))


def previous_run(spark: SparkSession, folder: str) -> DataFrame:
    """How many labels have the instruments of the last label of their catalog and title."""
    rows = table(spark, folder, "human_labels_201", "row_id", "catalog", "generated_title", "tset_in", "tsort_in", "surf_in").where("generated_title is not null")
    return scoring.reproduced(rows, rows, ["catalog", "generated_title"], ["tset_in", "tsort_in", "surf_in"], "row_id")


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.long_predictions(_labels(spark, folder), _instruments(), "human_in", "catalog", "model", "says", "generated_title")


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.confusion(_predictions(spark, folder))


_RATES = ("precision", "recall", "f1", "accuracy", "in_rate", "human_rate", "bias")


def confusion_by_instrument(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(spark, folder).select("instrument", "catalog", "tp", "fp", "fn", "tn", "n", *(F.round(c, 6).alias(c) for c in _RATES))


def instrument_agreement(spark: SparkSession, folder: str) -> DataFrame:
    found = scoring.kappa(_labels(spark, folder), "llm8_in", "tset_in", "catalog")
    return found.select("catalog", "n", "n_disagree", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


def _frame(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sampling_frame_1200", "catalog", "llm_in_catalog").select(F.lower(F.trim("catalog")).alias("catalog"), F.col("llm_in_catalog").alias("says")).where("catalog is not null")


def _weights(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.strata(_labels(spark, folder), _frame(spark, folder), "says")


def stratum_weights(spark: SparkSession, folder: str) -> DataFrame:
    return _weights(spark, folder).select("catalog", "says", "n_sample", "n_frame", F.round("share", 9).alias("share"), F.round("weight", 9).alias("weight"))


def reweighted_rates(spark: SparkSession, folder: str) -> DataFrame:
    rates = scoring.reweighted(_predictions(spark, folder), _weights(spark, folder), "says")
    return rates.select("instrument", "catalog", *(F.round(c, 6).alias(c) for c in ("rate", "human_rate", "raw_rate")))


def paired_sign_test(spark: SparkSession, folder: str) -> DataFrame:
    found = scoring.sign_test(_labels(spark, folder), "llm8_in", "tset_in", "human_in", "catalog")
    return found.select("catalog", "a_only", "b_only", F.round("p_value", 6).alias("p_value"))


def minimax_bias(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.worst_bias(_metrics(spark, folder)).select("instrument", F.round("max_abs_bias", 6).alias("max_abs_bias"))


def instrument_span(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.spans(_metrics(spark, folder), "amazon", ["judge20"]).select(F.round("f1_span", 6).alias("f1_span"), F.round("bias_span", 6).alias("bias_span"))


def _corrected(spark: SparkSession, folder: str) -> DataFrame:
    judged = table(spark, folder, "verdicts", "catalog", "model", "in_catalog", "judged").where("judged")
    cells = judged.groupBy("catalog", "model").agg((1 - F.avg(F.col("in_catalog").cast("double"))).alias("ood"))
    return scoring.corrected_rates(cells, _metrics(spark, folder), "judge8")


def corrected_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = scoring.corrected_summary(_corrected(spark, folder))
    return found.select("catalog", "n_cells", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n_out_of_range")


def rate_correction(spark: SparkSession, folder: str) -> DataFrame:
    found = _corrected(spark, folder)
    return found.select("catalog", "model", *(F.round(c, 6).alias(c) for c in ("ood", "sens", "spec", "corrected")), "in_range")


def subgroup_error(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of the judge by catalog and model, with and without titles that hold given terms."""
    from cresset.functions.text import contains_any

    own = _predictions(spark, folder).where("instrument = 'judge8' and predicted is not null").withColumn("has_term", contains_any("generated_title", TERMS))
    found = scoring.error_by(own, "catalog", "model", "has_term")
    return found.select("catalog", "model", "has_term", "n", F.round("error_rate", 6).alias("error_rate"), F.round("signed_error", 6).alias("signed_error"))


def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    own = _predictions(spark, folder).where("instrument = 'judge8'")
    return resampling.interval(resampling.bootstrap(own))


def permutation_p(spark: SparkSession, folder: str) -> DataFrame:
    own = _predictions(spark, folder).where("instrument = 'judge8' and predicted is not null")
    rows = own.select((F.col("predicted") != F.col("human")).cast("double").alias("error"), (F.col("catalog") == "amazon").alias("group"))
    return resampling.permutation_p(rows, "error", "group")


def posterior_interval(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.posterior_rates(_labels(spark, folder).where("says is not null"), _frame(spark, folder), "says", "human_in")


def candidate_instruments(spark: SparkSession, folder: str) -> DataFrame:
    """The rule instruments computed from titles and candidates of all labels."""
    from cresset.plans.catalog_queries import kind_of

    names = [f"cand_{k}" for k in range(1, 9)]
    rows = table(spark, folder, "human_labels_201", "row_id", "catalog", "generated_title", *names)
    labels = rows.select("row_id", F.col("generated_title").alias("title"), kind_of(F.col("catalog")).alias("kind"), F.array(*names).alias("candidates"))
    return scoring.candidate_instruments(labels, ["row_id"])


def full_catalog_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted and plain rates by token sets and by sorted tokens, on the shortlist and on the whole catalog, beside those of the labels."""
    from cresset.plans.catalog_queries import full_catalog_best

    labels = _labels(spark, folder).where("generated_title is not null").withColumn("query", F.concat_ws("|", "catalog", "generated_title"))
    joined = labels.join(full_catalog_best(spark, folder), "query", "left")
    instruments = {"token_set": "tset_in", "token_sort": "tsort_in"} | {f"{c}_full": F.coalesce(c, F.lit(False)) for c in ("token_set", "token_sort")}
    predictions = scoring.long_predictions(joined, instruments, "human_in", "catalog", "says")
    rates = scoring.reweighted(predictions, _weights(spark, folder), "says")
    return rates.select("instrument", "catalog", *(F.round(c, 6).alias(c) for c in ("rate", "human_rate", "raw_rate")))


def label_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Labels corrected by the judged verdicts on the same catalog and title."""
    rows = _labels(spark, folder)
    key = ["catalog", "generated_title"]
    fixes = table(spark, folder, "verdicts", "row_id", "catalog", "title", "in_catalog", "judged").where("judged and title is not null").select("catalog", F.col("title").alias("generated_title"), F.col("in_catalog").alias("human_in"), F.col("row_id").alias("at"))
    return scoring.with_overrides(rows, fixes, key).select("row_id", "human_in")


def blind_relabel(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of odd ids as a second labeling of those of even ids."""
    names = [f"cand_{k}" for k in range(1, 9)]
    rows = table(spark, folder, "human_labels_201", "row_id", "catalog", "model", "llm_says", "same_item", *names).withColumn("shown", F.upper(F.trim("llm_says")) == "IN").withColumn("group", F.floor(F.col("row_id") / 2))
    odd = F.col("row_id") % 2 == 1
    found = scoring.relabel_agreement(rows.where(odd), rows.where(~odd), ["catalog", "group"], "row_id", names)
    return found.select("n_matched", "n_disagree", "slots_identical", "disagreement_slots", "all_behind", *(F.round(c, 6).alias(c) for c in ("agreement", "hinted_agrees", "blind_agrees", "anchoring")))


def labels_with_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with the last verdict of their catalog and model."""
    rows = _labels(spark, folder).where("model is not null")
    log = table(spark, folder, "verdicts", "row_id", "catalog", "model", "in_catalog")
    return scoring.joined_verdicts(rows.select("row_id", "catalog", "model").withColumnRenamed("row_id", "label_id"), log, ["catalog", "model"], "row_id")


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cell metrics of verdicts: the share in the catalog as confidence against the labels' share."""
    judged = table(spark, folder, "verdicts", "catalog", "model", "in_catalog", "judged").where("judged")
    conf = judged.groupBy("catalog", "model").agg(F.avg(F.col("in_catalog").cast("double")).alias("conf"), F.count("*").alias("n"))
    truth = _labels(spark, folder).groupBy("catalog", "model").agg(F.avg(F.col("human_in").cast("double")).alias("member_rate"), F.avg((F.col("llm8_in") != F.col("human_in")).cast("double")).alias("brier"))
    joined = conf.join(truth, ["catalog", "model"]).withColumn("gap", F.col("member_rate") - F.col("conf"))
    return joined.withColumn("ece", F.abs("gap"))


def cell_metric_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = publishing.cell_summary(_cells(spark, folder))
    doubles = {c for c, t in found.dtypes if t == "double"}
    return found.select(*(F.round(c, 6).alias(c) if c in doubles else F.col(c) for c in found.columns))


def variance_of_means(spark: SparkSession, folder: str) -> DataFrame:
    return publishing.variance_of_means(_cells(spark, folder), ["catalog", "model"], "conf").select("grouping", "n_groups", F.round("variance", 9).alias("variance"))


def rate_reductions(spark: SparkSession, folder: str) -> DataFrame:
    found = publishing.reductions(_cells(spark, folder), "conf", ["member_rate", "brier"])
    return found.select("n", *(F.round(c, 6).alias(c) for c in ("largest", "median")), "n_worse")


def metric_long_form(spark: SparkSession, folder: str) -> DataFrame:
    return publishing.long_metrics(_metrics(spark, folder), ["instrument", "catalog"], ["tp", "fp", "fn", "tn"], "labels")


def metric_lines(spark: SparkSession, folder: str) -> DataFrame:
    return publishing.macro_lines(publishing.provenance(publishing.long_metrics(_metrics(spark, folder), ["instrument", "catalog"], ["f1", "bias"]), "labels", signed=True))


def cost_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """The price of judging all verdicts, by the prompts of single labels."""
    from cresset.operators import judging
    from cresset.plans.catalog_queries import label_items

    items = label_items(spark, folder).select(judging.item_lines(F.lit(1), "title", F.transform("candidates", lambda c: c["title"])).alias("prompt"))
    found = publishing.cost(items, table(spark, folder, "verdicts", "row_id"), len(judging.SYSTEM))
    return found.select("n_verdicts", "n_calls", "tokens_out", *(F.round(c, 6).alias(c) for c in ("mean_chars", "tokens_in", "price")))


_LABELS = """
WITH labels AS (
  SELECT row_id, catalog, lower(trim(model)) AS model, generated_title, try_cast(try_cast(same_item AS DOUBLE) AS INT) > 0 AS human_in, llm8_in, llm_in, tset_in, tsort_in, surf_in,
         CASE upper(trim(llm_says)) WHEN 'IN' THEN true WHEN 'OUT' THEN false END AS says
  FROM human_labels_201 WHERE try_cast(try_cast(same_item AS DOUBLE) AS INT) IS NOT NULL),
predictions AS (
  SELECT catalog, model, says, generated_title, human_in AS h, unnest([{'i': 'judge8', 'p': llm8_in}, {'i': 'judge20', 'p': llm_in}, {'i': 'token_set', 'p': tset_in}, {'i': 'token_sort', 'p': tsort_in}, {'i': 'surface', 'p': surf_in}, {'i': 'always_in', 'p': true}], recursive := true) FROM labels),
counts AS (
  SELECT i AS instrument, catalog, count(*) FILTER (p AND h) AS tp, count(*) FILTER (p AND NOT h) AS fp, count(*) FILTER (NOT p AND h) AS fn, count(*) FILTER (NOT p AND NOT h) AS tn
  FROM predictions WHERE p IS NOT NULL AND h IS NOT NULL GROUP BY GROUPING SETS ((i), (i, catalog))),
metrics AS (
  SELECT *, tp + fp + fn + tn AS n, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, (tp + tn) / (tp + fp + fn + tn) AS accuracy, (tp + fp) / (tp + fp + fn + tn) AS in_rate, (tp + fn) / (tp + fp + fn + tn) AS human_rate FROM counts),
scored AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1, in_rate - human_rate AS bias FROM metrics)
"""
_WEIGHTS = """, frame AS (SELECT lower(trim(catalog)) AS catalog, llm_in_catalog AS says FROM sampling_frame_1200 WHERE catalog IS NOT NULL),
cells AS (SELECT catalog, unnest([true, false]) AS says, count(*) AS n_all, count(*) FILTER (says) AS n_in, count(*) FILTER (NOT says) AS n_out, count(*) OVER () AS levels FROM frame GROUP BY catalog),
sized AS (SELECT c.catalog, c.says, CASE WHEN c.says THEN n_in ELSE n_out END AS n_frame, CASE WHEN c.says THEN n_in ELSE n_out END / n_all / levels AS share, (SELECT count(*) FROM labels l WHERE l.catalog = c.catalog AND l.says = c.says) AS n_sample FROM cells c),
weights AS (SELECT catalog, says, n_sample, n_frame, share, CASE WHEN n_sample > 0 THEN share / n_sample / (SELECT sum(share) FROM sized WHERE n_sample > 0) END AS weight FROM sized)
"""
_CELLS = """, conf AS (SELECT catalog, model, avg(in_catalog::INT) AS conf, count(*) AS n FROM verdicts WHERE judged GROUP BY ALL),
truth AS (SELECT catalog, model, avg(human_in::INT) AS member_rate, avg((llm8_in <> human_in)::INT) AS brier FROM labels GROUP BY ALL),
cells AS (SELECT *, member_rate - conf AS gap, abs(member_rate - conf) AS ece FROM conf JOIN truth USING (catalog, model))
"""
_CORRECTED = """, cells AS (SELECT catalog, model, 1 - avg(in_catalog::INT) AS ood FROM verdicts WHERE judged GROUP BY ALL),
own AS (SELECT catalog, tp / nullif(tp + fn, 0) AS sens, tn / nullif(tn + fp, 0) AS spec FROM scored WHERE instrument = 'judge8' AND catalog IS NOT NULL),
c AS (SELECT *, CASE WHEN sens + spec - 1 > 0 THEN 1 - ((1 - ood) + spec - 1) / (sens + spec - 1) END AS corrected FROM cells LEFT JOIN own USING (catalog))
"""
_SLOTS = ", ".join(f"cand_{k}" for k in range(1, 9))
_PARTS = Q.token_set_parts("t", "c")
_INSTRUMENTS_SQL = f"""
WITH slots AS (SELECT row_id, catalog, generated_title AS title, unnest([{_SLOTS}]) AS cand FROM human_labels_201),
given AS (SELECT row_id, catalog, title, cand, CASE WHEN title IS NULL THEN '' ELSE {Q.fold_sql('title')} END AS t, {Q.fold_sql('cand')} AS c FROM slots WHERE cand <> ''),
compared AS (SELECT *, {Q.sort_sql('t')} AS x, {Q.sort_sql('c')} AS y, {_PARTS['shared']} AS shared, {_PARTS['rest_a']} AS rest_a, {_PARTS['rest_b']} AS rest_b, {Q.forms_sql('cand', Q.KIND)} AS forms FROM given),
ratios AS (SELECT row_id, t, x, cand, title, catalog, forms, t = c AND t <> '' AS exact, {Q.token_set_sql('(' + Q.common_sql('rest_a', 'rest_b') + ')')} >= 90 AS by_set, {Q.ratio_sql('x', 'y', '(' + Q.common_sql('x', 'y') + ')')} >= 90 AS by_sort FROM compared),
each AS (SELECT row_id, t, x, unnest(forms) AS f FROM ratios WHERE t <> '' AND NOT (catalog = 'movielens' AND coalesce({Q.year_sql('title')} <> {Q.year_sql('cand')}, false))),
surfaces AS (SELECT DISTINCT row_id FROM (SELECT row_id, x, {Q.sort_sql('f')} AS f FROM each WHERE NOT ({Q.short_sql('t', 'f')})) WHERE {Q.ratio_sql('x', 'f', '(' + Q.common_sql('x', 'f') + ')')} >= 90),
instruments AS (SELECT h.row_id, coalesce(bool_or(exact), false) AS exact, coalesce(bool_or(by_set), false) AS token_set, coalesce(bool_or(by_sort), false) AS token_sort, h.row_id IN (FROM surfaces) AS surface FROM human_labels_201 h LEFT JOIN ratios r USING (row_id) GROUP BY 1)
"""
_EXACT = _LABELS + f""", slots AS (SELECT row_id, {Q.fold_sql('generated_title')} AS t, unnest([{_SLOTS}]) AS cand FROM human_labels_201),
same AS (SELECT DISTINCT row_id FROM slots WHERE cand <> '' AND t <> '' AND t = {Q.fold_sql('cand')}),
every AS (SELECT i, p, h FROM predictions UNION ALL SELECT 'exact', row_id IN (FROM same), human_in FROM labels)
"""
_R = ", ".join(f"round({c}, 6) AS {c}" for c in _RATES)

ORACLE: dict[str, str] = {
    "confusion_by_instrument": _LABELS + f"SELECT instrument, catalog, tp, fp, fn, tn, n, {_R} FROM scored",
    "instrument_agreement": _LABELS + """, s AS (SELECT catalog, count(*) AS n, count(*) FILTER (llm8_in <> tset_in) AS n_disagree, avg(llm8_in::INT) AS a, avg(tset_in::INT) AS b FROM labels WHERE llm8_in IS NOT NULL AND tset_in IS NOT NULL GROUP BY 1)
SELECT catalog, n, n_disagree, round(1 - n_disagree / n, 6) AS agreement, CASE WHEN a * b + (1 - a) * (1 - b) < 1 THEN round((1 - n_disagree / n - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) END AS kappa FROM s""",
    "stratum_weights": _LABELS + _WEIGHTS + "SELECT catalog, says, n_sample, n_frame, round(share, 9) AS share, round(weight, 9) AS weight FROM weights",
    "reweighted_rates": _LABELS + _WEIGHTS + """SELECT i AS instrument, catalog, round(sum(weight * p::INT) / sum(weight), 6) AS rate, round(sum(weight * h::INT) / sum(weight), 6) AS human_rate, round(avg(p::INT), 6) AS raw_rate
FROM predictions JOIN weights USING (catalog, says) WHERE weight IS NOT NULL AND p IS NOT NULL AND h IS NOT NULL GROUP BY GROUPING SETS ((i), (i, catalog))""",
    "paired_sign_test": _LABELS + """, s AS (SELECT catalog, count(*) FILTER (llm8_in = human_in AND tset_in <> human_in) AS a_only, count(*) FILTER (tset_in = human_in AND llm8_in <> human_in) AS b_only FROM labels GROUP BY 1),
t AS (SELECT *, a_only + b_only AS m, unnest(range(0, least(a_only, b_only) + 1)) AS i FROM s)
SELECT catalog, a_only, b_only, CASE WHEN m > 0 THEN round(least(1, 2 * sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2)))), 6) END AS p_value FROM t GROUP BY catalog, a_only, b_only, m""",
    "minimax_bias": _LABELS + "SELECT instrument, round(max(abs(bias)), 6) AS max_abs_bias FROM scored WHERE catalog IS NOT NULL GROUP BY 1",
    "instrument_span": _LABELS + "SELECT round(max(f1) FILTER (catalog IS NULL) - min(f1) FILTER (catalog IS NULL), 6) AS f1_span, round(max(bias) FILTER (catalog = 'amazon') - min(bias) FILTER (catalog = 'amazon'), 6) AS bias_span FROM scored WHERE instrument <> 'judge20'",
    "rate_correction": _LABELS + _CORRECTED + """SELECT catalog, model, round(ood, 6) AS ood, round(sens, 6) AS sens, round(spec, 6) AS spec, round(corrected, 6) AS corrected, coalesce(corrected BETWEEN 0 AND 1, false) AS in_range FROM c""",
    "subgroup_error": _LABELS + """SELECT catalog, model, coalesce(lower(generated_title) LIKE '%meadow%' OR lower(generated_title) LIKE '%lantern%' OR lower(generated_title) LIKE '%kettle%' OR lower(generated_title) LIKE '%(19%', false) AS has_term,
count(*) AS n, round(avg(abs(p::INT - h::INT)), 6) AS error_rate, round(avg(p::INT - h::INT), 6) AS signed_error FROM predictions WHERE i = 'judge8' AND p IS NOT NULL GROUP BY ALL""",
    "instrument_kappa": _EXACT + """SELECT instrument, n, n_disagree, round(1 - n_disagree / n, 6) AS agreement, CASE WHEN a * b + (1 - a) * (1 - b) < 1 THEN round((1 - n_disagree / n - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) END AS kappa
FROM (SELECT i AS instrument, count(*) AS n, count(*) FILTER (p <> h) AS n_disagree, avg(p::INT) AS a, avg(h::INT) AS b FROM every WHERE p IS NOT NULL AND h IS NOT NULL GROUP BY 1)""",
    "f1_without_overlaps": _LABELS + f""", marked AS (SELECT i, p, h, {' OR '.join(f"coalesce(contains(lower(generated_title), '{t}'), false)" for t in TERMS)} AS o FROM predictions WHERE p IS NOT NULL AND h IS NOT NULL),
s AS (SELECT i AS instrument, count(*) AS n, count(*) FILTER (p AND NOT h) AS fp, count(*) FILTER (NOT p AND h) AS fn, count(*) FILTER (p AND h) AS tp, count(*) FILTER (o) AS n_overlapping,
  count(*) FILTER (p AND NOT h AND NOT o) AS fp2, count(*) FILTER (NOT p AND h AND NOT o) AS fn2, count(*) FILTER (p AND h AND NOT o) AS tp2 FROM marked GROUP BY 1)
SELECT instrument, n, fp, fn, CASE WHEN tp > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END AS f1, n_overlapping, CASE WHEN tp2 > 0 THEN round(2 * tp2 / (2 * tp2 + fp2 + fn2), 6) END AS f1_without FROM s""",
    "previous_run": "WITH rows AS (SELECT * FROM human_labels_201 WHERE generated_title IS NOT NULL), last AS (SELECT catalog, generated_title, max(row_id) AS row_id FROM rows GROUP BY ALL), j AS (SELECT r.*, o.tset_in AS a, o.tsort_in AS b, o.surf_in AS c FROM rows r LEFT JOIN last l ON l.catalog = r.catalog AND l.generated_title = r.generated_title LEFT JOIN rows o ON o.row_id = l.row_id) "
    + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", count(*) AS n, count(*) FILTER (coalesce({n}, false) = coalesce({o}, false)) AS n_same FROM j" for n, o in (("tset_in", "a"), ("tsort_in", "b"), ("surf_in", "c"))),
    "corrected_summary": _LABELS + _CORRECTED + "SELECT catalog, count(*) AS n_cells, round(min(corrected), 6) AS low, round(max(corrected), 6) AS high, count(*) FILTER (NOT coalesce(corrected BETWEEN 0 AND 1, false)) AS n_out_of_range FROM c GROUP BY 1",
    "candidate_instruments": _INSTRUMENTS_SQL + "SELECT * FROM instruments",
    "full_catalog_rates": _LABELS + _WEIGHTS + f""", full_best AS (SELECT * FROM full_catalog_best_here),
j AS (SELECT l.catalog, says, human_in AS h, unnest([{{'i': 'token_set', 'p': tset_in}}, {{'i': 'token_sort', 'p': tsort_in}}, {{'i': 'token_set_full', 'p': coalesce(b.token_set, false)}}, {{'i': 'token_sort_full', 'p': coalesce(b.token_sort, false)}}], recursive := true)
  FROM labels l LEFT JOIN full_best b ON b.query = l.catalog || '|' || generated_title WHERE generated_title IS NOT NULL)
SELECT i AS instrument, catalog, round(sum(weight * p::INT) / sum(weight), 6) AS rate, round(sum(weight * h::INT) / sum(weight), 6) AS human_rate, round(avg(p::INT), 6) AS raw_rate
FROM j JOIN weights USING (catalog, says) WHERE weight IS NOT NULL AND p IS NOT NULL AND h IS NOT NULL GROUP BY GROUPING SETS ((i), (i, catalog))""",
    "metric_lines": _LABELS + """, x AS (SELECT instrument, catalog, unnest([{'m': 'f1', 'value': f1}, {'m': 'bias', 'value': bias}], recursive := true) FROM scored)
SELECT '\\newcommand{\\' || regexp_replace(concat_ws('.', m, instrument, coalesce(catalog, 'all')), '[^A-Za-z]', '', 'g') || '}{' || format('{:+.3f}', value) || '}  % labels' AS value FROM x WHERE value IS NOT NULL""",
    "label_overrides": _LABELS + ", fixes AS (SELECT catalog, title AS generated_title, arg_max(in_catalog, row_id) AS f FROM verdicts WHERE judged AND title IS NOT NULL GROUP BY ALL) SELECT row_id, coalesce(f, human_in) AS human_in FROM labels l LEFT JOIN fixes x ON l.catalog = x.catalog AND l.generated_title = x.generated_title",
    "blind_relabel": "WITH numbered AS (SELECT *, row_id // 2 AS g, coalesce(try_cast(try_cast(same_item AS DOUBLE) AS INT), 0) AS pick, upper(trim(llm_says)) = 'IN' AS shown FROM human_labels_201), j AS (SELECT a.pick AS pa, b.pick AS pb, b.shown, "
    + ", ".join(f"a.cand_{k} IS NOT DISTINCT FROM b.cand_{k} AS s{k}" for k in range(1, 9))
    + " FROM numbered a JOIN numbered b ON a.catalog = b.catalog AND a.g = b.g AND a.row_id % 2 = 1 AND b.row_id % 2 = 0), s AS (SELECT count(*) AS n_matched, count(*) FILTER ((pa > 0) <> (pb > 0)) AS n_disagree, "
    + " + ".join(f"bool_and(s{k})::INT" for k in range(1, 9))
    + """ AS slots_identical, list_sort(list_distinct(list_filter(flatten(list([pa, pb]) FILTER ((pa > 0) <> (pb > 0))), lambda x: x > 0))) AS picks, avg(((pa > 0) = (pb > 0))::INT) AS agreement, avg(((pb > 0) = shown)::INT) AS hinted_agrees, avg(((pa > 0) = shown)::INT) AS blind_agrees FROM j)
SELECT n_matched, n_disagree, slots_identical, array_to_string(picks, ',') AS disagreement_slots, len(picks) > 0 AND coalesce(list_min(picks) > slots_identical, false) AS all_behind, round(agreement, 6) AS agreement, round(hinted_agrees, 6) AS hinted_agrees, round(blind_agrees, 6) AS blind_agrees, round(hinted_agrees - blind_agrees, 6) AS anchoring FROM s""",
    "labels_with_verdicts": _LABELS + "SELECT catalog, l.model, row_id AS label_id, v.in_catalog FROM labels l JOIN (SELECT catalog, model, arg_max(in_catalog, row_id) AS in_catalog FROM verdicts GROUP BY ALL) v USING (catalog, model)",
    "cell_metric_summary": _LABELS + _CELLS + """SELECT count(*) AS n_cells, count(*) FILTER (gap > 0.02) AS n_under, count(*) FILTER (gap < -0.02) AS n_over, count(*) FILTER (gap BETWEEN -0.02 AND 0.02) AS n_flat, round(avg(ece), 6) AS mean_ece, round(avg(brier), 6) AS mean_brier, sum(n)::BIGINT AS total,
round(min(conf), 6) AS conf_low, round(max(conf), 6) AS conf_high, round(max(member_rate) / nullif(min(member_rate), 0), 6) AS member_ratio, round(max(member_rate) - min(member_rate), 6) AS member_swing, count(*) FILTER (abs(ece - abs(gap)) < 5e-4) AS n_ece_is_gap FROM cells""",
    "variance_of_means": _LABELS + _CELLS + "SELECT 'catalog' AS grouping, count(*) AS n_groups, round(var_pop(m), 9) AS variance FROM (SELECT avg(conf) AS m FROM cells GROUP BY catalog) UNION ALL SELECT 'model', count(*), round(var_pop(m), 9) FROM (SELECT avg(conf) AS m FROM cells GROUP BY model)",
    "rate_reductions": _LABELS + _CELLS + ", r AS (SELECT unnest([conf - member_rate, conf - brier]) AS r FROM cells) SELECT count(r) AS n, round(max(r), 6) AS largest, round(median(r), 6) AS median, count(*) FILTER (r < 0) AS n_worse FROM r WHERE r IS NOT NULL",
    "metric_long_form": _LABELS + ", x AS (SELECT instrument, catalog, unnest([{'m': 'tp', 'value': tp}, {'m': 'fp', 'value': fp}, {'m': 'fn', 'value': fn}, {'m': 'tn', 'value': tn}], recursive := true) FROM counts) SELECT concat_ws('.', 'labels', m, instrument, coalesce(catalog, 'all')) AS name, value::DOUBLE AS value FROM x",
}

QUERIES = {
    f.__name__: f
    for f in (
        confusion_by_instrument, instrument_agreement, stratum_weights, reweighted_rates, paired_sign_test, minimax_bias, instrument_span, rate_correction, subgroup_error, bootstrap_ci, permutation_p,
        posterior_interval, instrument_kappa, instrument_intervals, f1_without_overlaps, previous_run, corrected_summary, candidate_instruments, full_catalog_rates, label_overrides, blind_relabel, labels_with_verdicts, cell_metric_summary, variance_of_means, rate_reductions, metric_long_form, metric_lines, cost_estimate,
    )
}
