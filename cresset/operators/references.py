"""References to records that do not exist at their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cresset.sources.workspace import written

#: References of one key that one task merges; a key with more is split. At most _HOT_KEYS keys can be so hot.
PER_TASK, _HOT_KEYS = 50_000, 1000


def trimmed_key(c: Column) -> Column:
    """The key in lower case without blanks around it; null where nothing is left."""
    bare = F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))
    return F.when(bare != "", bare)


def orphan_references(refs: DataFrame, parents: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """References whose parent record isn't there at their time: (table_name, row_id, scope, key, at, reason).

    refs: table_name, row_id, scope, key, at. parents: scope, key, since, until; a parent is there from since (null:
    always) until just before until (null: not removed). Both tables are put together by scope and key, sorted by
    time and merged in one pass that counts the parents open so far. reason is missing (no such parent at any time),
    deleted (an earlier parent has ended) or late (the first parent comes later).

    Keys are compared without letter case and blanks around them; null, empty and blank keys refer to nothing, a null
    scope matches no parent and is missing without being merged. At a null time only a parent without since and until counts. Repeated references are
    reported each, repeated parents count once; a parent that ends before it begins is never there. Other columns
    aren't read; without parents every reference is missing; without references the result is empty.
    A key with more than ``per_task`` references, or a thousandth of all, is split by row, and its parents, which are
    summed up by time before, are copied to each part. A key with as many instants of parents is split by time at
    quantiles; each part begins with the sums of the parts before it.
    """
    named = refs.select("table_name", "row_id", "scope", trimmed_key(F.col("key")).alias("key"), F.col("at").alias("t")).where("key is not null")
    asked = named.where("scope is not null")
    nowhere = named.where("scope is null").select("table_name", "row_id", "scope", "key", F.col("t").alias("at"), F.lit("missing").alias("reason"))
    lives = parents.select("scope", trimmed_key(F.col("key")).alias("key"), "since", "until").where("key is not null and scope is not null").distinct()
    there = F.coalesce(F.col("until") > F.col("since"), F.lit(True))
    always = (F.col("since").isNull() & F.col("until").isNull()).cast("long")
    opens = lives.select("scope", "key", F.when(there, F.col("since")).otherwise(F.col("until")).alias("t"), there.cast("long").alias("opened"), always.alias("always"))
    closes = lives.where(there & F.col("until").isNotNull()).select("scope", "key", F.col("until").alias("t"), F.lit(-1).cast("long").alias("opened"), F.lit(0).cast("long").alias("always"))
    steps = opens.union(closes).groupBy("scope", "key", "t").agg(F.sum("opened").alias("opened"), F.sum("always").alias("always")).withColumn("kind", F.lit(0))
    steps = written(steps, "reference-steps")
    limit = max(per_task, (asked.count() // _HOT_KEYS) + 1)
    hot = _hot(asked, limit)
    if hot:
        parts = F.broadcast(asked.sparkSession.createDataFrame(hot, "scope string, key string, parts int"))
        asked = asked.join(parts, ["scope", "key"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("table_name", "row_id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    asked = asked if hot else asked.withColumn("part", F.lit(0))
    steps, cuts = _cut_by_time(steps, max(per_task, steps.count() // _HOT_KEYS + 1))
    if cuts is not None:
        asked = asked.join(F.broadcast(cuts), ["scope", "key"], "left").withColumn("slot", _slot(F.col("cuts"), F.col("t"))).drop("cuts", "base")
        base = F.broadcast(cuts.select("scope", "key", F.explode("base").alias("b")).select("scope", "key", F.col("b.slot").alias("slot"), "b.opened_before", "b.always_before", "b.steps_before", "b.steps_ever"))
    else:
        asked, steps = asked.withColumn("slot", F.lit(0)), steps.withColumn("slot", F.lit(0))
    if hot:
        steps = steps.join(parts, ["scope", "key"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    else:
        steps = steps.withColumn("part", F.lit(0))

    stream = asked.withColumn("kind", F.lit(1)).unionByName(steps, allowMissingColumns=True)
    group = Window.partitionBy("scope", "key", "slot", "part")
    so_far = group.orderBy(F.col("t").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    is_step = F.when(F.col("kind") == 0, 1)
    merged = stream.withColumns({"opened_sum": F.coalesce(F.sum("opened").over(so_far), F.lit(0)), "always_sum": F.coalesce(F.sum("always").over(so_far), F.lit(0)), "before": F.count(is_step).over(so_far), "ever": F.count(is_step).over(group)}).where("kind = 1")
    if cuts is not None:
        added = {"opened_sum": "opened_before", "always_sum": "always_before", "before": "steps_before"}
        merged = merged.join(base, ["scope", "key", "slot"], "left").withColumns({c: F.col(c) + F.coalesce(b, F.lit(0)) for c, b in added.items()} | {"ever": F.coalesce("steps_ever", "ever")})
    open_ = F.when(F.col("t").isNull(), F.col("always_sum")).otherwise(F.col("opened_sum"))
    reason = F.when(F.col("ever") == 0, "missing").when(F.col("before") > 0, "deleted").otherwise("late")
    return merged.where(open_ <= 0).select("table_name", "row_id", "scope", "key", F.col("t").alias("at"), reason.alias("reason")).union(nowhere)


def _hot(rows: DataFrame, limit: int) -> list[tuple[str, str, int]]:
    """Keys with more rows than the limit and the number of their parts; at most _HOT_KEYS."""
    counts = rows.where("scope is not null").groupBy("scope", "key").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return [(r.scope, r.key, -(-r.n // limit)) for r in counts.collect()]


def _slot(cuts: Column, t: Column) -> Column:
    """The part of a time: how many cuts lie at or before it; 0 for a null time and an uncut key."""
    return F.coalesce(F.size(F.filter(cuts, lambda c: c <= t)), F.lit(0)).cast("int")


def _cut_by_time(steps: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Steps with their part, and for the keys that have several the cuts and what comes before each part.

    The cuts are quantiles of a key's instants; all cuts together are as many as the limit goes into all steps, and
    one for each key.
    """
    hot = _hot(steps, limit)
    if not hot:
        return steps, None
    spark = steps.sparkSession
    sizes = F.broadcast(spark.createDataFrame(hot, "scope string, key string, parts int"))
    own = steps.join(sizes, ["scope", "key"])
    quantiles = own.groupBy("scope", "key", "parts").agg(F.percentile_approx("t", [k / _HOT_KEYS for k in range(1, _HOT_KEYS)], 10_000).alias("q"))
    at = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda k: F.element_at("q", F.least(F.greatest((k * _HOT_KEYS / F.col("parts")).cast("int"), F.lit(1)), F.lit(_HOT_KEYS - 1))))
    cuts = spark.createDataFrame(quantiles.select("scope", "key", F.array_distinct(at).alias("cuts")).collect(), quantiles.select("scope", "key", at.alias("cuts")).schema)
    placed = steps.join(F.broadcast(cuts), ["scope", "key"], "left").withColumn("slot", _slot(F.col("cuts"), F.col("t")))
    sums = placed.where("cuts is not null").groupBy("scope", "key", "slot").agg(F.sum("opened").alias("o"), F.sum("always").alias("a"), F.count("*").alias("n"))
    found = {}
    for r in sums.orderBy("scope", "key", "slot").collect():  # as many rows as there are parts
        found.setdefault((r.scope, r.key), []).append(r)
    rows = []
    for r in cuts.collect():
        total, opened, always, n, base = sum(x.n for x in found.get((r.scope, r.key), [])), 0, 0, 0, []
        by_slot = {x.slot: x for x in found.get((r.scope, r.key), [])}
        for k in range(len(r.cuts) + 1):
            base.append((k, opened, always, n, total))
            if k in by_slot:
                opened, always, n = opened + by_slot[k].o, always + by_slot[k].a, n + by_slot[k].n
        rows.append((r.scope, r.key, r.cuts, base))
    schema = T.StructType([*cuts.schema.fields, T.StructField("base", T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("opened_before", "always_before", "steps_before", "steps_ever"))])))])
    return placed.drop("cuts"), spark.createDataFrame(rows, schema)


def orphans_by_period(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Orphans per table, period of their time and reason: (table_name, period, reason, n). A null time has a null period."""
    return orphans.groupBy("table_name", F.date_trunc(period, "at").alias("period"), "reason").agg(F.count("*").alias("n"))
