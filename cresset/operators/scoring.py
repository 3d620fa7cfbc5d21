"""Instruments that decide membership, and how they stand against human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cresset.functions import similarity
from cresset.functions.numbers import binomial_tail
from cresset.functions.text import folded, short_conflict, sort_key, usable, with_forms, year_of

CUTOFF = 90.0


def pair_scores(pairs: DataFrame, key: list[str], query: str = "query", title: str = "title", kind: str = "kind") -> DataFrame:
    """(*key, score) of each query and title: the best ratio of sorted tokens over the title's forms.

    Null for an unusable query, one that folds to nothing; 0 where years of both film titles differ, where short
    titles rule all forms out, or where there is no title. Repeated keys are one pair.
    """
    asked = pairs.select(*key, query, title, kind, folded(query).alias("_q"))
    clash = (F.col(kind) == "film") & F.coalesce(year_of(query) != year_of(title), F.lit(False))
    forms = with_forms(asked.where((F.col("_q") != "") & ~clash), title, kind, "_f").where(~short_conflict("_q", "_f"))
    ratios = forms.withColumn("_s", similarity.indel(sort_key("_q"), sort_key("_f")))
    best = ratios.groupBy(*key).agg(F.max("_s").alias("_best"))
    every = asked.groupBy(*key).agg(F.max("_q").alias("_q"))
    return every.join(best, key, "left").select(*key, F.when(F.col("_q") != "", F.coalesce("_best", F.lit(0.0))).alias("score"))


def passes(score: Column | str, cutoff: float = CUTOFF) -> Column:
    """Whether a score reaches the cutoff; null doesn't."""
    score = F.col(score) if isinstance(score, str) else score
    return F.coalesce(score >= cutoff, F.lit(False))


def candidate_instruments(labels: DataFrame, key: list[str], title: str = "title", candidates: str = "candidates", kind: str = "kind") -> DataFrame:
    """(*key, exact, token_set, token_sort, surface): whether any candidate of a title matches it, by instrument.

    Null and empty candidates don't count. exact compares folded titles, of which empty ones equal nothing.
    """
    rows = labels.select(*key, F.col(title).alias("_title"), F.col(kind).alias("_kind"), F.explode_outer(usable(candidates)).alias("_cand"))
    each = rows.withColumns({"_t": folded("_title"), "_c": F.when(F.col("_cand").isNotNull(), folded("_cand"))})
    marked = each.withColumns({"_e": (F.col("_t") == F.col("_c")) & (F.col("_t") != ""), "_set": passes(similarity.token_set("_t", "_c")), "_sort": passes(similarity.token_sort("_t", "_c", CUTOFF))})
    pairs = each.where("_cand is not null").select("_title", "_cand", "_kind").distinct()
    scores = pair_scores(pairs, ["_title", "_cand", "_kind"], "_title", "_cand", "_kind").withColumnRenamed("score", "_surface")
    joined = marked.join(scores, ["_title", "_cand", "_kind"], "left")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return joined.groupBy(*key).agg(some(F.col("_e")).alias("exact"), some(F.col("_set")).alias("token_set"), some(F.col("_sort")).alias("token_sort"), some(passes("_surface")).alias("surface"))


def decided(labels: DataFrame, pick: str = "same_item") -> DataFrame:
    """Rows with a whole-number pick, as int; others, such as ?, are undecided."""
    return labels.withColumn(pick, F.col(pick).try_cast("double").try_cast("int")).where(F.col(pick).isNotNull())


def with_overrides(labels: DataFrame, fixes: DataFrame, key: list[str], column: str = "human_in") -> DataFrame:
    """A column replaced by that of ``fixes`` where the key is in it; the last of several fixes by their order column ``at``."""
    last = fixes.groupBy(*key).agg(F.max_by(column, "at").alias("_fixed"))
    return labels.join(last, key, "left").withColumn(column, F.coalesce("_fixed", column)).drop("_fixed")


def long_predictions(labels: DataFrame, instruments: dict[str, str | Column], human: str, *carried: str) -> DataFrame:
    """One row per label and instrument: (*carried, instrument, predicted, human)."""
    cells = [F.struct(F.lit(name).alias("instrument"), (F.col(c) if isinstance(c, str) else c).alias("predicted")) for name, c in instruments.items()]
    return labels.select(*carried, F.col(human).alias("human"), F.explode(F.array(*cells)).alias("x")).select(*carried, "x.instrument", "x.predicted", "human")


def confusion(predictions: DataFrame, by: str = "catalog") -> DataFrame:
    """Counts and rates per instrument, over all (by is null) and per catalog, in one pass.

    Precision and recall without cases, F1 without them or where both are 0, are null. Rows whose prediction or label
    is null aren't counted.
    """
    rows = predictions.where("predicted is not null and human is not null")
    p, h = F.col("predicted"), F.col("human")
    counts = rows.groupingSets([["instrument"], ["instrument", by]], "instrument", by).agg(F.count_if(p & h).alias("tp"), F.count_if(p & ~h).alias("fp"), F.count_if(~p & h).alias("fn"), F.count_if(~p & ~h).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    rates = counts.withColumns({"n": n, "precision": precision, "recall": recall, "accuracy": (F.col("tp") + F.col("tn")) / n, "in_rate": (F.col("tp") + F.col("fp")) / n, "human_rate": (F.col("tp") + F.col("fn")) / n})
    return rates.withColumns({"f1": F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "bias": F.col("in_rate") - F.col("human_rate")})


def kappa(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Agreement of two raters beyond chance: (*by, n, n_disagree, agreement, kappa); null where chance alone agrees fully."""
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rate = lambda c: F.avg(F.col(c).cast("double"))
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(a) != F.col(b)).alias("n_disagree"), rate(a).alias("_a"), rate(b).alias("_b"))
    po, pe = 1 - F.col("n_disagree") / F.col("n"), F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))
    return sums.select(*by, "n", "n_disagree", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def strata(sample: DataFrame, frame: DataFrame, verdict: str, by: str = "catalog") -> DataFrame:
    """Weight of a labeled row in each stratum: (by, verdict, n_sample, n_frame, share, weight), cells without rows included.

    share is that of the frame's rows of a catalog which have the verdict, over the number of catalogs; the frame's
    undecided rows count in the denominator. Weights are scaled to sum to 1 over all sample rows.
    """
    levels = frame.select(by).distinct().where(F.col(by).isNotNull())
    cells = levels.withColumn(verdict, F.explode(F.array(F.lit(True), F.lit(False))))
    in_frame = frame.groupBy(by).agg(F.count("*").alias("_all"), F.count_if(F.col(verdict)).alias("_in"), F.count_if(~F.col(verdict)).alias("_out"))
    in_sample = sample.groupBy(by, verdict).agg(F.count("*").alias("n_sample"))
    n_levels = levels.agg(F.count("*").alias("_levels"))
    joined = cells.join(in_frame, by).join(in_sample, [by, verdict], "left").join(F.broadcast(n_levels))
    n_frame = F.when(F.col(verdict), F.col("_in")).otherwise(F.col("_out"))
    sized = joined.withColumns({"n_sample": F.coalesce("n_sample", F.lit(0)).cast("long"), "n_frame": n_frame})
    share = sized.withColumn("share", F.col("n_frame") / F.col("_all") / F.col("_levels"))
    used = share.agg(F.sum(F.when(F.col("n_sample") > 0, F.col("share"))).alias("_used"))
    weight = F.when(F.col("n_sample") > 0, F.col("share") / F.col("n_sample") / F.col("_used"))
    return share.join(F.broadcast(used)).select(by, verdict, "n_sample", "n_frame", "share", weight.alias("weight"))


def reweighted(predictions: DataFrame, weights: DataFrame, verdict: str, by: str = "catalog") -> DataFrame:
    """Weighted shares of predicted and human members per instrument, over all and per catalog: (instrument, by, rate, human_rate, raw_rate)."""
    joined = predictions.join(weights.select(by, verdict, "weight"), [by, verdict]).where("weight is not null and predicted is not null and human is not null")
    part = lambda c: F.sum(F.col("weight") * F.col(c).cast("double")) / F.sum("weight")
    return joined.groupingSets([["instrument"], ["instrument", by]], "instrument", by).agg(part("predicted").alias("rate"), part("human").alias("human_rate"), F.avg(F.col("predicted").cast("double")).alias("raw_rate"))


def sign_test(pairs: DataFrame, a: str, b: str, human: str, *by: str) -> DataFrame:
    """Exact two-sided test on the labels that only one of two instruments gets right: (*by, a_only, b_only, p_value), p null without any."""
    right = lambda c: F.col(c) == F.col(human)
    counts = pairs.groupBy(*by).agg(F.count_if(right(a) & ~right(b)).alias("a_only"), F.count_if(right(b) & ~right(a)).alias("b_only"))
    n = F.col("a_only") + F.col("b_only")
    p = F.least(F.lit(1.0), 2 * binomial_tail(F.least("a_only", "b_only"), n))
    return counts.withColumn("p_value", F.when(n > 0, p))


def worst_bias(metrics: DataFrame, by: str = "catalog") -> DataFrame:
    """Largest absolute bias over catalogs per instrument: (instrument, max_abs_bias)."""
    return metrics.where(F.col(by).isNotNull()).groupBy("instrument").agg(F.max(F.abs("bias")).alias("max_abs_bias"))


def spans(metrics: DataFrame, catalog: str, leave_out: list[str], by: str = "catalog") -> DataFrame:
    """How far F1, and the bias on one catalog, lie apart over instruments: (f1_span, bias_span)."""
    real = metrics.where(~F.col("instrument").isin(leave_out)) if leave_out else metrics
    f1, bias = F.when(F.col(by).isNull(), F.col("f1")), F.when(F.col(by) == catalog, F.col("bias"))
    return real.agg((F.max(f1) - F.min(f1)).alias("f1_span"), (F.max(bias) - F.min(bias)).alias("bias_span"))


def corrected_rates(cells: DataFrame, metrics: DataFrame, instrument: str, by: str = "catalog") -> DataFrame:
    """Rates of cells corrected by the instrument's sensitivity and specificity: (cells, sens, spec, corrected, in_range).

    cells hold ``by`` and ``ood``, the apparent share of non-members. Null where the two sum to 1 or less; not clipped.
    """
    own = metrics.where((F.col("instrument") == instrument) & F.col(by).isNotNull()).select(by, F.try_divide("tp", F.col("tp") + F.col("fn")).alias("sens"), F.try_divide("tn", F.col("tn") + F.col("fp")).alias("spec"))
    room = F.col("sens") + F.col("spec") - 1
    corrected = F.when(room > 0, 1 - ((1 - F.col("ood")) + F.col("spec") - 1) / room)
    return cells.join(own, by, "left").withColumn("corrected", corrected).withColumn("in_range", F.coalesce(F.col("corrected").between(0, 1), F.lit(False)))


def error_by(predictions: DataFrame, *by: str) -> DataFrame:
    """Share of errors and mean signed error per group: (*by, n, error_rate, signed_error)."""
    p, h = F.col("predicted").cast("double"), F.col("human").cast("double")
    return predictions.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(p - h)).alias("error_rate"), F.avg(p - h).alias("signed_error"))


def relabel_agreement(blind: DataFrame, hinted: DataFrame, key: list[str], order: str, slots: list[str], pick: str = "same_item") -> DataFrame:
    """Two labelings of the same titles: one row of counts and rates.

    Of each side the first row of a key by ``order`` counts. A label is a member if its pick is above 0, null being 0.
    A slot is identical if it holds the same candidate, null being equal to null, in all matched rows. The flag
    says whether all picks of disagreeing rows lie behind the identical slots, taken as a prefix.
    """
    from cresset.operators.catalog import first_rows

    a, b = first_rows(blind, key, [order]), first_rows(hinted, key, [order])
    number = lambda c: F.coalesce(c.try_cast("double").try_cast("int"), F.lit(0))
    left = a.select(*key, number(F.col(pick)).alias("_pa"), *(F.col(s).alias(f"_a_{s}") for s in slots))
    right = b.select(*key, number(F.col(pick)).alias("_pb"), "shown", *(F.col(s).alias(f"_b_{s}") for s in slots))
    both = left.join(right, key).withColumns({"_ha": F.col("_pa") > 0, "_hb": F.col("_pb") > 0})
    differ = F.col("_ha") != F.col("_hb")
    share = lambda c: F.avg(c.cast("double"))
    same = F.array(*(F.bool_and(F.col(f"_a_{s}").eqNullSafe(F.col(f"_b_{s}"))) for s in slots))
    picks = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(differ, F.array("_pa", "_pb"))))))
    sums = both.agg(F.count("*").alias("n_matched"), F.count_if(differ).alias("n_disagree"), F.size(F.filter(same, lambda x: x)).alias("slots_identical"), F.filter(picks, lambda x: x > 0).alias("_picks"), share(~differ).alias("agreement"), share(F.col("_hb") == F.col("shown")).alias("hinted_agrees"), share(F.col("_ha") == F.col("shown")).alias("blind_agrees"))
    behind = (F.size("_picks") > 0) & F.coalesce(F.array_min("_picks") > F.col("slots_identical"), F.lit(False))
    return sums.select("n_matched", "n_disagree", "slots_identical", F.array_join("_picks", ",").alias("disagreement_slots"), behind.alias("all_behind"), "agreement", "hinted_agrees", "blind_agrees", (F.col("hinted_agrees") - F.col("blind_agrees")).alias("anchoring"))


def joined_verdicts(labels: DataFrame, verdicts: DataFrame, key: list[str], order: str, column: str = "in_catalog") -> DataFrame:
    """Labels with the verdict on their key, the last one by ``order``; raises KeyError if a label has none."""
    last = verdicts.groupBy(*key).agg(F.max_by(column, order).alias(column))
    lacking = labels.join(last.select(*key), key, "left_anti").limit(1).count()
    if lacking:
        raise KeyError("labels without a verdict")
    return labels.join(last, key)


def carried_over(labels: DataFrame, before: DataFrame, key: list[str], columns: list[str], order: str) -> DataFrame:
    """Columns of an earlier result joined to labels, "" where it has none; of several rows of a key all come from the last by ``order``."""
    last = before.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    old = last.select(*key, *(F.col("_row")[c].alias(c) for c in columns))
    return labels.join(old, key, "left").withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


def reproduced(labels: DataFrame, before: DataFrame, key: list[str], columns: list[str], order: str) -> DataFrame:
    """How many labels have the value of an earlier result: (column, n, n_same); a value that is lacking counts as false."""
    old = carried_over(labels.select(*key, *(F.col(c).alias(f"_new_{c}") for c in columns)), before, key, columns, order)
    same = lambda c: F.count_if((F.lower(F.col(c)) == "true") == F.coalesce(F.col(f"_new_{c}"), F.lit(False)))
    sums = old.agg(F.count("*").alias("n"), *(same(c).alias(c) for c in columns))
    return sums.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_same")) for c in columns))).alias("x")).select("x.column", "n", "x.n_same")


def without(predictions: DataFrame, overlaps: Column) -> DataFrame:
    """Errors and F1 per instrument of all rows, and F1 of those that don't overlap: (instrument, n, fp, fn, f1, n_overlapping, f1_without)."""
    marked = predictions.withColumn("_own", overlaps)
    every = confusion(marked.withColumn("_all", F.lit(None).cast("string")), "_all").where(F.col("_all").isNull()).dropDuplicates(["instrument"])
    rest = confusion(marked.where(~F.col("_own")).withColumn("_all", F.lit(None).cast("string")), "_all").dropDuplicates(["instrument"]).select("instrument", F.col("n").alias("_n"), F.col("f1").alias("f1_without"))
    joined = every.join(rest, "instrument", "left")
    return joined.select("instrument", "n", "fp", "fn", "f1", (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n_overlapping"), "f1_without")


def corrected_summary(corrected: DataFrame, by: str = "catalog") -> DataFrame:
    """Corrected rates over cells: (by, n_cells, low, high, n_out_of_range)."""
    return corrected.groupBy(by).agg(F.count("*").alias("n_cells"), F.min("corrected").alias("low"), F.max("corrected").alias("high"), F.count_if(~F.col("in_range")).alias("n_out_of_range"))
