"""Readers and writers of the file formats."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _at(path: str, spark: SparkSession | None = None):  # noqa: ANN202
    """File system and path, of whatever system the path is on."""
    context = (spark or SparkSession.active()).sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def _read_text(path: str) -> str:
    system, target = _at(path)
    stream = system.open(target)
    try:
        return SparkSession.active().sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(path: str, text: str) -> None:
    system, target = _at(path)
    stream = system.create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, keep_empty: bool = True) -> DataFrame:
    """CSV with a header; quoted fields may hold line ends. With ``keep_empty`` an empty field is "", and NA or None are text."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    if not keep_empty:
        return reader.csv(path)
    df = reader.option("nullValue", "\x00").option("emptyValue", "").csv(path)  # an empty field without quotes is null to the reader
    return df.select(*(F.coalesce(f.name, F.lit("")).alias(f.name) if f.dataType == T.StringType() else f.name for f in schema.fields))


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType, bad_lines: str = "skip", partitions: int | None = None) -> DataFrame:
    """JSON lines, plain or compressed, of the schema's fields only; absent ones are null.

    bad_lines: skip leaves out what is no JSON, fail raises, keep gives the text in _corrupt_record. A compressed file is read by
    one task; ``partitions`` spreads its rows.
    """
    if bad_lines == "fail":
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
        lines = spark.read.text(path).where(F.trim("value") != "")
        df = lines.select(F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
        if bad_lines == "skip":
            df = df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return df.repartition(partitions) if partitions else df


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def read_json_document(path: str) -> dict:
    """A nested document of bounded size, such as a report."""
    return json.loads(_read_text(path))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: (path, text)."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def find_files(spark: SparkSession, folder: str, names: list[str]) -> dict[str, str]:
    """Where files lie anywhere below a folder; FileNotFoundError names those that don't."""
    system, root = _at(folder, spark)
    found: dict[str, list[str]] = {n: [] for n in names}
    listed = system.listFiles(root, True)
    while listed.hasNext():
        path = listed.next().getPath()
        if path.getName() in found:
            found[path.getName()].append(path.toString())
    lacking = [n for n, p in found.items() if not p]
    if lacking:
        raise FileNotFoundError(f"not below {folder}: {', '.join(lacking)}")
    return {n: min(p) for n, p in found.items()}


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "error", by: list[str] | None = None) -> None:
    """JSON lines with nulls written, so that a withheld value differs from an absent one."""
    writer = df.write.mode(mode).option("ignoreNullFields", False)
    (writer.partitionBy(*by) if by else writer).json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Adds rows to a log; those of a failed write don't appear."""
    write_json_lines(df, path, "append")


def write_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """A column of text as lines, in the order of the frame."""
    df.select(df.columns[0]).write.mode(mode).text(path)


def write_report(named: DataFrame, path: str) -> dict:
    """A long table (name, value) of bounded size as a nested document; parts of names lie between points."""
    out: dict = {}
    for r in named.select("name", "value").collect():  # a report: as many rows as it has figures
        *parents, last = r["name"].split(".")
        at = out
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = r["value"]
    _write_text(path, json.dumps(out, indent=1, sort_keys=True))
    return out


def write_manifest(folder: str, **values: object) -> dict:
    """A manifest of a run with the time it was made, unless that is given."""
    out = {"created_at": datetime.datetime.now(datetime.UTC).isoformat()} | values
    _write_text(f"{folder}/manifest.json", json.dumps(out, indent=1, sort_keys=True))
    return out


def all_there(paths: list[str], force: bool = False) -> bool:
    """Whether all outputs exist, so that a step can be left out."""
    return not force and all(system.exists(target) for system, target in map(_at, paths))


def built_once(spark: SparkSession, folder: str, name: str, inputs: DataFrame, build: Callable[[], DataFrame]) -> DataFrame:
    """A table built from inputs, read again as long as these are the same.

    It is kept under a fingerprint of the inputs: their number, and the sum of their rows' hashes, without order.
    """
    marks = inputs.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*inputs.columns).cast("decimal(38,0)")).alias("h")).first()
    path = f"{folder}/{name}-{marks.n}-{marks.h or 0}"
    if not all_there([f"{path}/_SUCCESS"]):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def epoch_seconds(column: str, pattern: str = "yyyy-MM-dd HH:mm:ss"):  # noqa: ANN201
    """Seconds since 1970 of a text without zone, in the session's zone; null if it is none."""
    return F.unix_timestamp(F.try_to_timestamp(column, F.lit(pattern)))
