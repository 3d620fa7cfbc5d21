"""Titles restored from ids where they were withheld."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_slots(rows: DataFrame, key: list[str], titles: list[str], ids: list[str]) -> DataFrame:
    """Wide candidate columns as rows: (*key, slot, title, id), slots from 1."""
    slots = F.array(*(F.struct(F.col(t).alias("title"), F.col(i).alias("id")) for t, i in zip(titles, ids, strict=True)))
    return rows.select(*key, F.posexplode(slots).alias("at", "s")).select(*key, (F.col("at") + 1).alias("slot"), "s.title", "s.id")


def wide_slots(rows: DataFrame, key: list[str], value: str, names: list[str]) -> DataFrame:
    """Rows of slots as wide columns again: (*key, *names)."""
    return rows.groupBy(*key).agg(*(F.max(F.when(F.col("slot") == k, F.col(value))).alias(n) for k, n in enumerate(names, 1)))


def withheld(title: Column | str, item: Column | str, source: Column | str | None = None, restricted: Sequence[str] | None = None) -> Column:
    """Whether a title is to be filled: it is null or empty, there is an id, and its source is one of the restricted ones, if any are named."""
    title, item, source = (F.col(c) if isinstance(c, str) else c for c in (title, item, source))
    lacks = (F.coalesce(title, F.lit("")) == "") & (F.coalesce(item, F.lit("")) != "")
    return lacks if restricted is None else lacks & F.coalesce(source.isin(list(restricted)), F.lit(False))


def restore(rows: DataFrame, catalog: DataFrame, scope: str, title: str, item: str, column: str = "title", also: dict[str, str] | None = None, restricted: Sequence[str] | None = None) -> DataFrame:
    """Fills withheld titles from the catalog, "" for unknown ids; other rows stay. Adds was_withheld.

    catalog: (scope, item_id, column), of repeated ids the last title by ``row_id``; titles of null are unknown. also
    names further columns of rows, filled together with the title, with those of the catalog they come from, which
    are those of the same row. With ``restricted`` only titles of these scopes are filled.
    """
    more = also or {}
    held = F.struct(F.col(column).alias("_title"), *(F.col(c).alias(f"_{n}") for n, c in more.items()))
    known = catalog.where(F.col(column).isNotNull()).groupBy(F.col(scope).alias("_scope"), F.col("item_id").alias("_item")).agg(F.max_by(held, "row_id").alias("_known"))
    joined = rows.join(known, (F.col(scope) == F.col("_scope")) & (F.col(item) == F.col("_item")), "left").withColumn("was_withheld", withheld(title, item, scope, restricted))
    filled = {title: "_title"} | {n: f"_{n}" for n in more}
    return joined.withColumns({n: F.when(F.col("was_withheld"), F.coalesce(F.col("_known")[c], F.lit(""))).otherwise(F.col(n)) for n, c in filled.items()}).drop("_scope", "_item", "_known")
