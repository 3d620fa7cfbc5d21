"""Queries of this subpackage: name to a function of the session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cresset.llm import disguised, encoding, formatting, garbled, leakage, mapping, sampling, spans
from cresset.sources.tables import table
from cresset.sources.workspace import written


def _keyed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all tables that targets are stated for: (table_name, field_name, row_id, key)."""
    frame = table(spark, folder, "sampling_frame_1200", "row_id", "catalog")
    labels = table(spark, folder, "human_labels_201", "row_id", "llm_says", "model")
    parts = [(frame, "sampling_frame_1200", "catalog"), (labels, "human_labels_201", "llm_says"), (labels, "human_labels_201", "model")]
    return reduce(DataFrame.union, [t.select(F.lit(n).alias("table_name"), F.lit(c).alias("field_name"), "row_id", F.col(c).alias("key")) for t, n, c in parts])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_report(spark, folder).where("shortfall > 0").select("target_set", "category")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows available, needed and drawn of every category."""
    return sampling.sample_report(_keyed_rows(spark, folder), table(spark, folder, "sample_targets"), match=("table_name", "field_name"))


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of all target sets."""
    return sampling.draw_sample(_keyed_rows(spark, folder), table(spark, folder, "sample_targets"), match=("table_name", "field_name"))


def _mapped(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    unanswered = table(spark, folder, "verdicts", "row_id", "catalog", "title", "judged").where("not judged").select("row_id", F.col("catalog").alias("scope"), F.col("title").alias("text"))
    catalog = table(spark, folder, "catalog", "catalog", "item_id", "title", "normalized_title")
    entries = catalog.select(F.col("catalog").alias("scope"), F.col("item_id").alias("entry_id"), F.explode(F.array("title", "normalized_title")).alias("text"))
    return unanswered, mapping.map_values(unanswered, entries)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    unanswered, mapped = _mapped(spark, folder)
    named = mapped.where("entry_id is not null").select(F.col("scope").alias("s"), F.col("text").alias("t"), "entry_id")
    joined = unanswered.join(named, (F.col("scope") == F.col("s")) & (F.col("text") == F.col("t")), "left")
    return joined.select("row_id", F.coalesce("entry_id", F.lit("")).alias("item_id"))


def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Typed titles that mean no entry."""
    return _mapped(spark, folder)[1].where("entry_id is null").select(F.col("scope").alias("catalog"), F.col("text").alias("title"))


def _encoded_values(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "catalog", "row_id", "catalog", "title")
    firsts = table(spark, folder, "human_labels_201", "row_id", "catalog", "cand_1")
    return titles.select(F.lit("catalog").alias("table_name"), "row_id", F.col("catalog").alias("source"), F.col("title").alias("text")).union(firsts.select(F.lit("human_labels_201"), "row_id", "catalog", "cand_1"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_restored(spark, folder).select("table_name", "row_id")


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled values with what could be restored of them."""
    values = _encoded_values(spark, folder)
    return garbled.repair(values, garbled.learn(values), ["table_name", "row_id"])


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "catalog", "row_id", "catalog", "title", "normalized_title")
    verdicts = table(spark, folder, "verdicts", "row_id", "catalog", "title")
    parts = [(titles, "catalog", "title"), (titles, "catalog", "normalized_title"), (verdicts, "verdicts", "title")]
    return reduce(DataFrame.union, [t.select(F.lit(n).alias("table_name"), F.lit(c).alias("field_name"), "row_id", F.col("catalog").alias("source"), F.col(c).alias("text")) for t, n, c in parts])


_VALUE = ["table_name", "field_name", "row_id"]


def _garbled_titles(values: DataFrame) -> DataFrame:
    titles = values.where("field_name = 'title'")
    return garbled.repair(titles, garbled.learn(titles), _VALUE).select(*_VALUE)


def _disguised(values: DataFrame) -> DataFrame:
    """Values that hold other characters, in one form, without garbled ones."""
    return disguised.unify(values, _VALUE).join(_garbled_titles(values), _VALUE, "left_anti")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _disguised(_titles(spark, folder)).select("table_name", "field_name", "row_id")


def p5_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Disguised values in their one form."""
    return _disguised(_titles(spark, folder))


def p6_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Every verdict that has a group, with the record kept of it and the number of copies."""
    values = _titles(spark, folder)
    found = disguised.disguised_values(values.where("table_name = 'verdicts'"), _VALUE).select(*_VALUE)  # their one form isn't needed here
    other = written(found.join(_garbled_titles(values), _VALUE, "left_anti").select("row_id"), "disguised-verdicts")
    verdicts = table(spark, folder, "verdicts", "row_id", "catalog", "model", "in_catalog", "title").join(other, "row_id", "left_anti")
    return formatting.copies(verdicts, ["catalog", "model", "in_catalog"], "title")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_copies(spark, folder).where("row_id <> keep_id").select("keep_id", F.col("row_id").alias("copy_id"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, folder, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per leaked item, the number of documents that hold it."""
    return _leaks(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = spans.shared_pairs(table(spark, folder, "documents", "doc_id", "text"))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_shared(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_amounts(table(spark, folder, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_report, p1_sample, p3_found, p3_unmatched, p4_found, p4_restored, p5_found, p5_unified, p6_found, p6_copies, p7_ids, p8_found, p8_items, p9_found, p9_shared)}
