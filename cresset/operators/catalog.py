"""Item catalogs and the users whose last item is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cresset.functions.text import normalized
from cresset.operators.ranking import quartile, ranked


def first_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the least by ``order``, found with partial maxima; null keys are a key."""
    rest = [c for c in df.columns if c not in key]
    held = F.struct(*(F.col(c) for c in dict.fromkeys([*order, *rest])))
    least = df.groupBy(*key).agg(F.min(held).alias("_row"))
    return least.select(*key, *(F.col("_row")[c].alias(c) for c in rest)).select(*df.columns)


def build_catalog(items: DataFrame, interactions: DataFrame, scope: str = "catalog", item: str = "item_id", order: str = "row_id") -> DataFrame:
    """Catalog of distinct items: (scope, item, title, normalized_title, interaction_count, popularity_quartile).

    Interactions are counted per item before they are joined; items without any have 0. The quartile goes by the rank
    of the count from the largest on, ties by item; rows of an item after its first by ``order`` are dropped. Items
    of null id are dropped, null titles have the normal form "".
    """
    ids = items.select(scope, F.col(item).cast("string").alias(item), "title", order).where(F.col(item).isNotNull())
    distinct = first_rows(ids, [scope, item], [order])
    counts = interactions.select(scope, F.col(item).cast("string").alias(item)).groupBy(scope, item).agg(F.count("*").alias("interaction_count"))
    counted = distinct.join(counts, [scope, item], "left").withColumn("interaction_count", F.coalesce("interaction_count", F.lit(0)).cast("long"))
    placed = ranked(counted, [scope], [F.col("interaction_count").desc(), F.col(item).asc()])
    return placed.select(scope, item, "title", normalized("title").alias("normalized_title"), "interaction_count", quartile(F.col("rank"), F.col("group_size")).alias("popularity_quartile"))


def eligible_users(interactions: DataFrame, least: int, user: str = "user_id") -> DataFrame:
    """(user, n) of users with at least so many rows; null users aren't users."""
    return interactions.where(F.col(user).isNotNull()).groupBy(user).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def split_users(users: DataFrame, n_audit: int, n_calibration: int, key: Column, user: str = "user_id") -> DataFrame:
    """Disjoint samples of users by a hashed key, ties by user: (user, part) with part audit or calibration.

    Fewer users than asked raise ValueError.
    """
    wanted = n_audit + n_calibration
    chosen = users.select(user, key.alias("_key")).orderBy("_key", user).limit(wanted).collect()  # bounded by the samples asked for
    if len(chosen) < wanted:
        raise ValueError(f"{len(chosen)} users are eligible; {wanted} are asked for")
    rows = [(r[user], "audit" if k < n_audit else "calibration") for k, r in enumerate(sorted(chosen, key=lambda r: (r._key, r[user])))]
    return users.sparkSession.createDataFrame(rows, f"{user} {users.schema[user].dataType.simpleString()}, part string")


def ordered_histories(interactions: DataFrame, users: DataFrame, time: str = "timestamp", item: str = "item_id", user: str = "user_id") -> DataFrame:
    """Rows of the users in order of time, null first, and item: (user, part, place, item, is_target).

    The last row of each user is the target. Users with fewer than two rows are left out. One user's rows may lie in
    several tasks; ``as_arrays`` makes one row per user where histories are known to be short.
    """
    own = interactions.select(user, F.col(item).cast("string").alias(item), time).join(users, user)
    placed = ranked(own, [user], [F.col(time).asc_nulls_first(), F.col(item).asc_nulls_first()], "place")
    return placed.where("group_size >= 2").select(user, "part", "place", item, (F.col("place") == F.col("group_size")).alias("is_target"))


def with_target_quartile(histories: DataFrame, catalog: DataFrame, item: str = "item_id", user: str = "user_id") -> DataFrame:
    """The target of each user with its quartile, Q4 for unknown items: (user, part, target_item_id, target_quartile, n_history)."""
    targets = histories.where("is_target").select(user, "part", F.col(item).alias("target_item_id"), (F.col("place") - 1).alias("n_history"))
    known = catalog.select(F.col(item).alias("target_item_id"), F.col("popularity_quartile").alias("q"))
    return targets.join(known, "target_item_id", "left").select(user, "part", "target_item_id", F.coalesce("q", F.lit("Q4")).alias("target_quartile"), "n_history")


def as_arrays(histories: DataFrame, item: str = "item_id", user: str = "user_id") -> DataFrame:
    """(user, history, target_item_id): each user's items in order, all but the last, as one array."""
    rows = histories.groupBy(user).agg(F.array_sort(F.collect_list(F.struct("place", item))).alias("r"))
    items = F.transform("r", lambda x: x[item])
    return rows.select(user, F.slice(items, 1, F.size("r") - 1).alias("history"), F.element_at(items, -1).alias("target_item_id"))
