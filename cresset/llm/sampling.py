"""Samples whose categories have wanted shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cresset.sources.workspace import written

#: Rows that one task ranks; the rows of a category are split into ranges of about so many.
PER_TASK = 100_000


def category_key(c: Column) -> Column:
    """A category in lower case without blanks around it; null stays null."""
    return F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))


def _wanted(targets: DataFrame, match: list[str]) -> DataFrame:
    """Rows wanted of each category by share, and at least; a repeated target is one."""
    return targets.select(*match, "target_set", "category", category_key(F.col("category")).alias("key"), F.round(F.coalesce(F.col("target_share") * F.col("sample_size"), F.lit(0.0))).cast("long").alias("by_share"), F.coalesce("min_rows", F.lit(0)).cast("long").alias("at_least")).distinct().withColumn("needed", F.greatest("by_share", "at_least"))


def _number(*parts: Column | str, digits: int) -> Column:
    """A whole number of so many hexadecimal digits that looks random, from the text of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, digits), 16, 10).cast("long")


def passed(rank: Column, n: Column, of: Column, start: Column) -> Column:
    """How many of n draws among ``of`` rows are made up to a rank: the whole numbers that rank * n / of passes, counted from the start.

    start counts millionths (2^-20). Where a product of two counts might not fit a long, it is a decimal, which holds
    the square of any row count.
    """
    part = lambda a, b: F.call_function("div", a, b)
    wide = lambda c: c.cast("decimal(19,0)")
    short = part(rank * n + part(start * of, F.lit(1 << 20)), of)
    long = part(wide(rank) * wide(n) + wide(part(wide(start) * wide(of), wide(F.lit(1 << 20)))), wide(of))
    return F.when(n >= of, rank).when(of <= 0, 0).when(of < 1 << 31, short).otherwise(long)


def _available(frame: DataFrame, id_col: str, key_col: str, seed: int, per_task: int, match: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a key in ranges of their random number, and the counts of the ranges."""
    by = [*match, "key"]
    rows = frame.select(*match, F.col(id_col).alias("id"), category_key(F.col(key_col)).alias("key")).where("key is not null")
    ranges = max(1, -(-rows.count() // per_task))
    random = _number(F.lit(str(seed)), *(F.col(c).cast("string") for c in (*by, "id")), digits=10)
    ordered = rows.withColumn("random", random).withColumn("range", F.floor(F.col("random") * ranges / (1 << 40)).cast("int"))
    return ordered, written(ordered.groupBy(*by, "range").agg(F.count("*").alias("n")), "sample-counts")


def _drawn(ordered: DataFrame, counts: DataFrame, targets: DataFrame, seed: int, match: list[str]) -> DataFrame:
    """(*match, target_set, category, id, repaired) of the rows drawn."""
    by = [*match, "key"]
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*by).orderBy("range")) - F.col("n")).withColumn("available", F.sum("n").over(Window.partitionBy(*by))).drop("n")
    ranked = ordered.withColumn("in_range", F.row_number().over(Window.partitionBy(*by, "range").orderBy("random", "id"))).join(before, [*by, "range"]).withColumn("rank", F.col("before") + F.col("in_range"))
    joined = ranked.join(_wanted(targets, match).where("needed > 0"), by)
    start = _number(F.lit(str(seed)), "target_set", digits=5)
    first = F.least("by_share", "available")
    upto, until = (passed(rank, first, F.col("available"), start) for rank in (F.col("rank"), F.col("rank") - 1))
    rest = joined.withColumns({"is_first": upto > until, "left": F.col("rank") - upto, "of": F.col("available") - first, "more": F.least("needed", "available") - first})
    again = [passed(left, F.col("more"), F.col("of"), start) for left in (F.col("left"), F.col("left") - 1)]
    is_more = ~F.col("is_first") & (again[0] > again[1])
    drawn = rest.withColumn("repaired", is_more).where(F.col("is_first") | is_more)
    return drawn.select(*match, "target_set", "category", "id", "repaired")


def draw_sample(frame: DataFrame, targets: DataFrame, id_col: str = "row_id", key_col: str = "key", seed: int = 17, per_task: int = PER_TASK, match: tuple[str, ...] = ()) -> DataFrame:
    """Systematic unequal-probability sample for each target set: (target_set, category, id_col, repaired).

    frame: ``key_col`` holds the category of each row; targets: target_set, category, target_share, min_rows,
    sample_size. Columns named in ``match`` are in both, and targets hold for frame rows equal in them. Categories are
    compared without letter case and blanks around them. Null shares, sizes and minimums count as 0.

    Every row of a category has the inclusion probability by_share / available. The rows are put in random order
    within their sorted categories, the probabilities summed up along them, and a row is drawn where the sum passes
    one random start plus a whole number. Shares are whole rows, so the sum over each category is whole too and the
    crossing is found in integers from a row's rank. Where the minimum is more, the same is done once more among the
    rows not drawn (repaired = true). A category that doesn't suffice is taken whole.

    Ranks need no category in one task: rows fall into ranges of their random number, counts of the ranges are
    summed up, and only then are the rows of each range ranked. Rows of equal id or content are drawn each on its
    own; ties of the random number are resolved by the id. Rows with null category are in no sample; an empty frame
    gives an empty sample; other columns aren't read.
    """
    ordered, counts = _available(frame, id_col, key_col, seed, per_task, list(match))
    drawn = _drawn(ordered, counts, targets, seed, list(match))
    return drawn.select("target_set", "category", F.col("id").alias(id_col), "repaired")


def sample_report(frame: DataFrame, targets: DataFrame, id_col: str = "row_id", key_col: str = "key", seed: int = 17, per_task: int = PER_TASK, match: tuple[str, ...] = ()) -> DataFrame:
    """Per category of the targets: (target_set, category, available, needed, drawn, shortfall), of the sample that is drawn.

    needed is share times size to the nearest whole number, or min_rows if that is more; drawn counts the rows of
    ``draw_sample`` with the same arguments, of which shortfall lacks some. A category without rows has 0 available.
    """
    named = [*match, "target_set", "category"]
    ordered, counts = _available(frame, id_col, key_col, seed, per_task, list(match))
    drawn = _drawn(ordered, counts, targets, seed, list(match)).groupBy(*named).agg(F.count("*").alias("drawn"))
    available = counts.groupBy(*match, "key").agg(F.sum("n").alias("available"))
    joined = _wanted(targets, list(match)).join(available, [*match, "key"], "left").join(drawn, named, "left")
    of = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("target_set", "category", of("available"), "needed", of("drawn"), (F.col("needed") - F.coalesce("drawn", F.lit(0))).alias("shortfall"))
