"""Ranks over a whole table without one task for all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cresset.sources.workspace import written

_ROWS = 1 << 33  # monotonically_increasing_id() counts a partition's rows in its lower 33 bits


def ranked(df: DataFrame, within: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds each row's rank, from 1 and without ties, among rows equal in ``within``, and their number ``group_size``.

    Rows are range-partitioned by group and order, so that a large group lies in several partitions; a row's rank is
    its place among the rows of its group in its partition, plus those of the partitions before. Only groups that lie
    in several partitions need the latter, and as the rows are sorted there are at most two such pieces for each
    partition. ``order`` should resolve ties. Rows of null in ``within`` are a group. An empty table stays empty.
    """
    keys = [F.col(c).asc_nulls_first() for c in within]
    sorted_rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = written(sorted_rows.withColumn("_r_place", F.monotonically_increasing_id()), "ranked")
    whole = placed.withColumn("_r_part", F.floor(F.col("_r_place") / _ROWS).cast("int"))
    piece = Window.partitionBy("_r_part", *within)
    near = whole.withColumns({"_r_first": F.min("_r_place").over(piece), "_r_n": F.count("*").over(piece)})
    pieces = whole.groupBy("_r_part", *within).agg(F.count("*").alias("_r_own"))
    parts = F.array_sort(F.collect_list(F.struct("_r_part", "_r_own")))
    several = pieces.groupBy(*within).agg(parts.alias("_r_parts")).where(F.size("_r_parts") > 1)  # a list has at most one entry for each partition
    before = lambda x: F.aggregate(F.filter("_r_parts", lambda y: y["_r_part"] < x["_r_part"]), F.lit(0).cast("long"), lambda s, y: s + y["_r_own"])
    total = F.aggregate("_r_parts", F.lit(0).cast("long"), lambda s, y: s + y["_r_own"])
    names = {c: f"_g{k}" for k, c in enumerate(within)}
    spread = several.select(*(F.col(c).alias(g) for c, g in names.items()), total.alias("_r_all"), F.explode(F.transform("_r_parts", lambda x: F.struct(x["_r_part"].alias("part"), before(x).alias("before")))).alias("_r_x"))
    spread = spread.select(*names.values(), "_r_all", F.col("_r_x.part").alias("_r_p"), F.col("_r_x.before").alias("_r_before"))
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(names[c])), within, F.col("_r_part") == F.col("_r_p"))
    joined = near.join(F.broadcast(spread), same, "left")  # at most two rows for each partition
    rank = F.col("_r_place") - F.col("_r_first") + 1 + F.coalesce("_r_before", F.lit(0))
    return joined.withColumns({name: rank, "group_size": F.coalesce("_r_all", "_r_n")}).select(*df.columns, name, "group_size")


def quartile(rank: Column, n: Column) -> Column:
    """Q1 to Q4 of a rank among n: the cuts lie at the quarters of rank - 1 over n - 1; a single row is Q1."""
    above = [F.when(4 * (rank - 1) > j * (n - 1), 1).otherwise(0) for j in (1, 2, 3)]
    return F.concat(F.lit("Q"), (1 + above[0] + above[1] + above[2]).cast("string"))
