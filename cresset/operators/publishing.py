"""Summaries of cells, and results as a long table of named values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cresset.functions.numbers import shown

BAND = 0.02


def cell_summary(cells: DataFrame) -> DataFrame:
    """One row over cells with member_rate, conf, gap, ece, brier and n.

    Gaps above, below and within the closed band of 0.02 are counted, and the cells whose ece is the absolute gap.
    """
    gap = F.col("gap")
    return cells.agg(F.count("*").alias("n_cells"), F.count_if(gap > BAND).alias("n_under"), F.count_if(gap < -BAND).alias("n_over"), F.count_if(gap.between(-BAND, BAND)).alias("n_flat"), F.avg("ece").alias("mean_ece"), F.avg("brier").alias("mean_brier"), F.sum("n").alias("total"), F.min("conf").alias("conf_low"), F.max("conf").alias("conf_high"), F.try_divide(F.max("member_rate"), F.min("member_rate")).alias("member_ratio"), (F.max("member_rate") - F.min("member_rate")).alias("member_swing"), F.count_if(F.abs(F.col("ece") - F.abs(gap)) < 5e-4).alias("n_ece_is_gap"))


def variance_of_means(cells: DataFrame, by: list[str], value: str) -> DataFrame:
    """Population variance of the group means of a value, per grouping column: (grouping, n_groups, variance)."""
    def one(c: str) -> DataFrame:
        means = cells.groupBy(c).agg(F.avg(value).alias("m"))
        return means.agg(F.count("*").alias("n_groups"), F.var_pop("m").alias("variance")).select(F.lit(c).alias("grouping"), "n_groups", "variance")

    return reduce(DataFrame.union, map(one, by))


def reductions(cells: DataFrame, base: str, columns: list[str]) -> DataFrame:
    """What columns take off a base, over all cells: (n, largest, median, n_worse); nulls are left out."""
    each = cells.select(F.explode(F.array(*(F.col(base) - F.col(c) for c in columns))).alias("r")).where("r is not null")
    return each.agg(F.count("*").alias("n"), F.max("r").alias("largest"), F.percentile("r", 0.5).alias("median"), F.count_if(F.col("r") < 0).alias("n_worse"))


def long_metrics(metrics: DataFrame, key: list[str], values: list[str], prefix: str = "") -> DataFrame:
    """(name, value): one row per key and value, named by prefix, value and the key's parts; null key parts are "all"."""
    cells = F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values))
    rows = metrics.select(*key, F.explode(cells).alias("x"))
    return rows.select(F.concat_ws(".", F.lit(prefix) if prefix else F.lit(None), "x.metric", *(F.coalesce(F.col(k).cast("string"), F.lit("all")) for k in key)).alias("name"), "x.value")


def provenance(named: DataFrame, source: str, digits: int = 3, scale: float = 1.0, signed: bool = False) -> DataFrame:
    """(name, text, source) sorted by name, to be written as lines; undefined values are left out."""
    text = shown(F.col("value") * scale, digits, signed)
    return named.where("value is not null").select("name", text.alias("text"), F.lit(source).alias("source")).orderBy("name")


def macro_lines(values: DataFrame) -> DataFrame:
    """Lines that define each name as its text, sorted."""
    letters = F.regexp_replace("name", "[^A-Za-z]", "")
    return values.select(F.concat(F.lit("\\newcommand{\\"), letters, F.lit("}{"), "text", F.lit("}  % "), "source").alias("value")).orderBy("value")


def cost(item_prompts: DataFrame, verdicts: DataFrame, system_chars: int, batch: int = 10, answer_tokens: int = 8, price_in: float = 3.0, price_out: float = 15.0) -> DataFrame:
    """Calls, tokens and price of judging: (n_verdicts, n_calls, mean_chars, tokens_in, tokens_out, price).

    item_prompts holds the prompt of one item in each row, whose mean length stands for all verdicts; each call also
    sends the system text. A token is four characters, an answer so many tokens; prices are per million tokens.
    """
    means = item_prompts.agg(F.avg(F.length("prompt")).alias("mean_chars"))
    sums = verdicts.agg(F.count("*").alias("n_verdicts")).join(F.broadcast(means)).withColumn("n_calls", F.ceil(F.col("n_verdicts") / batch))  # one row each
    tokens = sums.withColumns({"tokens_in": F.col("n_verdicts") * F.col("mean_chars") / 4 + F.col("n_calls") * (system_chars / 4), "tokens_out": F.col("n_verdicts") * answer_tokens})
    return tokens.withColumn("price", (F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6)
