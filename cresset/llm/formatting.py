"""Records that differ in their formatting only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cresset.sources.workspace import written

#: Copies of one key that one task handles, and the most keys that can have more.
PER_TASK, _HOT_KEYS = 20_000, 2000


def words_key(text: Column) -> Column:
    """The words of a text, runs of letters and digits in lower case, sorted; null where it has none."""
    words = F.array_sort(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def copies(records: DataFrame, same: list[str], text_col: str, id_col: str = "row_id", per_task: int = PER_TASK) -> DataFrame:
    """Each record with its group: (id_col, keep_id, n_copies), keep_id being the smallest id of the group.

    Records are of one group if the columns ``same`` are equal, null being equal to null, and the texts hold the same
    words the same number of times. Texts without words, null and empty ones included, belong to no group and don't
    come out. A record without copies is a group of its own; rows of equal id are one record.

    Records and their keys are written once. The size of each key is counted exactly with partial counts. Keys of more
    than ``per_task`` records, or one two-thousandth of all, are hot: there are at most so many, they are known to all
    tasks, and their records are spread by salt and brought together in two levels. The rest take one shuffle.
    """
    key = F.to_json(F.struct(*(F.col(c).alias(f"s{k}") for k, c in enumerate(same)), words_key(F.col(text_col)).alias("words")), {"ignoreNullFields": "false"})
    keyed = written(records.select(F.col(id_col).alias("id"), key.alias("key"), words_key(F.col(text_col)).isNotNull().alias("has_words")).where("has_words").drop("has_words"), "formatting-keys")
    limit = max(per_task, keyed.count() // _HOT_KEYS + 1)
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()  # at most _HOT_KEYS rows, as their records are at most all records
    if not crowded:
        return _grouped(keyed).select(F.col("id").alias(id_col), "keep_id", "n_copies")
    parts = F.broadcast(records.sparkSession.createDataFrame([(r.key, -(-r.n // limit)) for r in crowded], "key string, parts int"))
    rest = _grouped(keyed.join(parts, "key", "left_anti"))
    salted = keyed.join(parts, "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    level = salted.groupBy("key", "salt").agg(F.min("id").alias("keep_id"), F.count_distinct("id").alias("n")).groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n_copies"))
    spread = salted.select("id", "key").distinct().join(F.broadcast(level), "key")
    return rest.unionByName(spread).select(F.col("id").alias(id_col), "keep_id", "n_copies")


def _grouped(keyed: DataFrame) -> DataFrame:
    """Each id once with the least id and the size of its key: one shuffle by key, whose rows are sorted by id once."""
    by_id, whole = Window.partitionBy("key").orderBy("id"), Window.partitionBy("key")
    fresh = keyed.withColumn("fresh", (F.row_number().over(by_id) == 1) | ~F.col("id").eqNullSafe(F.lag("id").over(by_id)))
    return fresh.withColumns({"keep_id": F.min("id").over(whole), "n_copies": F.count_if("fresh").over(whole)}).where("fresh").drop("fresh")
