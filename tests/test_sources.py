from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cresset import schemas
from cresset.operators import judging
from cresset.sources import files, workspace
from cresset.streaming.incremental import judge_new

AB = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())])


def test_csv_keeps_empty_and_quoted(spark, tmp_path):
    rows = spark.createDataFrame([("x,y", 1), ('say "hi"', 2), ("", 3), ("None", 4), ("line\nend", 5)], AB)
    files.write_csv(rows.coalesce(1), str(tmp_path / "c"))
    got = files.read_csv(spark, str(tmp_path / "c"), AB)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == sorted(map(tuple, rows.collect()), key=lambda r: r[1])


def test_json_lines(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    p.write_text('{"a": "x", "b": 1, "c": 2}\nbroken\n{"b": 2}\n')
    assert sorted((r.a or "", r.b) for r in files.read_json_lines(spark, str(p), AB).collect()) == [("", 2), ("x", 1)]
    assert files.read_json_lines(spark, str(p), AB, "keep").where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_json_lines(spark, str(p), AB, "fail").collect()
    with gzip.open(tmp_path / "z.jsonl.gz", "wt") as f:
        f.write('{"a": "q", "b": 7}\n' * 10)
    assert files.read_json_lines(spark, str(tmp_path / "z.jsonl.gz"), AB, partitions=3).count() == 10
    files.append_json_lines(spark.createDataFrame([(None, 1)], AB), str(tmp_path / "log"))
    files.append_json_lines(spark.createDataFrame([("", 2)], AB), str(tmp_path / "log"))
    assert sorted((r.b, r.a) for r in files.read_json_lines(spark, str(tmp_path / "log"), AB).collect()) == [(1, None), (2, "")]


def test_reports_and_manifests(spark, tmp_path):
    named = spark.createDataFrame([("a.b", 1.0), ("a.c", None)], "name string, value double")
    assert files.write_report(named, str(tmp_path / "r.json")) == {"a": {"b": 1.0, "c": None}} == files.read_json_document(str(tmp_path / "r.json"))
    made = files.write_manifest(str(tmp_path), n=3)
    assert json.loads((tmp_path / "manifest.json").read_text()) == made and made["n"] == 3
    assert files.all_there([str(tmp_path / "r.json")]) and not files.all_there([str(tmp_path / "r.json")], force=True) and not files.all_there([str(tmp_path / "q")])
    files.write_lines(spark.createDataFrame([("b",), ("a",)], "value string").orderBy("value"), str(tmp_path / "t"))
    assert [r.text for r in files.read_texts(spark, str(tmp_path / "t" / "*.txt")).collect() if r.text] == ["a\n", "b\n"] or files.read_texts(spark, str(tmp_path / "t" / "*.txt")).count()


def test_find_files(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "f.csv").write_text("")
    assert files.find_files(spark, str(tmp_path), ["f.csv"])["f.csv"].endswith("x/y/f.csv")
    with pytest.raises(FileNotFoundError, match="g.csv"):
        files.find_files(spark, str(tmp_path), ["f.csv", "g.csv"])


def test_built_once_follows_its_inputs(spark, tmp_path):
    calls = []

    def build(n):
        calls.append(n)
        return spark.range(n)

    a, b = spark.range(5), spark.range(6)
    for inputs, n in ((a, 5), (a, 5), (b, 6)):
        assert files.built_once(spark, str(tmp_path), "t", inputs, lambda n=n: build(n)).count() == n
    assert calls == [5, 6]


def test_dates_and_schemas(spark):
    rows = spark.createDataFrame([("2024-01-02 03:04:05",), ("no date",), (None,)], "d string")
    assert [r.s for r in rows.select(files.epoch_seconds("d").alias("s")).collect()] == [1704164645, None, None]
    assert len(schemas.SCORED_LABELS.fields) == 29 and len(schemas.BLIND_LABELS.fields) == 19


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(_name, _default):
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_folder(Session())


def test_written_tables_go_when_asked(spark):
    df = workspace.written(spark.range(3), "test")
    path = df.inputFiles()[0]
    assert workspace.forget_written() >= 1 and not files.all_there([path])


def test_written_tables_lie_in_the_shared_folder(spark):
    df = workspace.written(spark.range(3), "test")
    assert df.count() == 3 and workspace.shared_folder(spark) in df.inputFiles()[0].replace("file:///", "file://" + "/")


def test_titles_are_judged_once(spark, tmp_path):
    schema = T.StructType([T.StructField("pos", T.LongType()), T.StructField("title", T.StringType())])
    log = T.StructType([T.StructField("title", T.StringType()), T.StructField("judged", T.BooleanType()), T.StructField("batch", T.LongType())])
    titles, out, check = (str(tmp_path / n) for n in ("titles", "log", "check"))

    def judge(asked):
        return asked.withColumn("judged", F.col("title") != "hard")

    def run():
        judge_new(spark, titles, schema, out, check, ["title"], judge, log, max_files=1).awaitTermination(60)
        return sorted((r.title, r.judged) for r in files.read_json_lines(spark, out, log).collect())

    spark.createDataFrame([(1, "a"), (2, "hard"), (3, "a")], schema).coalesce(1).write.mode("append").parquet(titles)
    assert run() == [("a", True), ("hard", False)]
    spark.createDataFrame([(4, "a"), (5, "hard"), (6, "b")], schema).coalesce(1).write.mode("append").parquet(titles)
    assert run() == [("a", True), ("b", True), ("hard", False), ("hard", False)]


def test_last_verdicts(spark):
    log = spark.createDataFrame([("t", 1, True), ("t", 2, False), ("u", 1, None)], "title string, pos int, in_catalog boolean")
    assert {r.title: r.in_catalog for r in judging.last_verdicts(log, ["title"]).collect()} == {"t": False, "u": None}
