"""Titles judged as they arrive: what is there is worked off, what was answered isn't asked again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cresset.operators.judging import pending
from cresset.sources import files


def judge_new(spark: SparkSession, titles: str, schema: T.StructType, log: str, checkpoint: str, key: list[str], judge: Callable[[DataFrame], DataFrame], log_schema: T.StructType, max_files: int = 100) -> StreamingQuery:
    """Judges the parquet rows that came since the last call, in batches of bounded size, and appends to a log of JSON lines.

    judge takes rows of the key columns and returns rows of the log's schema, with ``batch`` set by this function. A
    batch that is run again after a failure replaces nothing: its rows carry its number, and are left out if the log
    has them already. Titles that were asked but not answered come up again when they occur again.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(titles)

    def one(batch: DataFrame, number: int) -> None:
        done = _log(spark, log, log_schema)
        if done.where(F.col("batch") == number).limit(1).count():
            return
        asked = pending(batch, done, key)
        files.append_json_lines(judge(asked.select(*key)).withColumn("batch", F.lit(number).cast("long")).select(*log_schema.fieldNames()), log)

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return files.read_json_lines(spark, path, schema)
