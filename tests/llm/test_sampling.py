from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from cresset.llm import sampling as S

TARGETS = "target_set string, category string, target_share double, min_rows long, sample_size long, key string"


def _frame(spark, counts):
    rows, i = [], 0
    for c, n in counts.items():
        for k in range(n):
            i += 1
            rows.append((i, [c, c.upper(), f" {c}\t"][k % 3] if c else None, "clash"))
    return spark.createDataFrame(rows, "row_id long, key string, category string")


def test_shares_floors_and_shortfalls(spark):
    frame = _frame(spark, {"a": 5000, "b": 700, "c": 12, None: 9})
    targets = spark.createDataFrame([("s", "A", 0.5, 1, 1000, ""), ("s", "b", 0.5, 1, 1000, ""), ("s", "c", 0.0, 10, 1000, ""), ("t", "c", 0.25, 3, 100, ""), ("t", "a", 0.75, None, 100, ""), ("u", "zz", 0.1, 5, 100, ""), ("u", "c", 0.0, 0, 100, ""), ("v", "b", 0.1, 300, 100, "")], TARGETS)
    report = {(r.target_set, r.category): (r.available, r.needed, r.drawn, r.shortfall) for r in S.sample_report(frame, targets).collect()}
    assert report == {("s", "A"): (5000, 500, 500, 0), ("s", "b"): (700, 500, 500, 0), ("s", "c"): (12, 10, 10, 0), ("t", "c"): (12, 25, 12, 13), ("t", "a"): (5000, 75, 75, 0), ("u", "zz"): (0, 10, 0, 10), ("u", "c"): (12, 0, 0, 0), ("v", "b"): (700, 300, 300, 0)}
    for per_task in (100_000, 97):
        drawn = S.draw_sample(frame, targets, per_task=per_task).collect()
        assert Counter((r.target_set, r.category) for r in drawn) == {k: v[2] for k, v in report.items() if v[2]}
        assert len({(r.target_set, r.row_id) for r in drawn}) == len(drawn)
        assert {r.target_set for r in drawn if r.repaired} == {"s", "v"}
    again = S.draw_sample(frame.repartition(5), targets, per_task=97)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in drawn}
    other = {tuple(r)[:3] for r in S.draw_sample(frame, targets, seed=3).collect()}
    assert other != {tuple(r)[:3] for r in drawn}


def test_every_row_is_drawn_equally_often(spark):
    frame = _frame(spark, {"a": 40})
    targets = spark.createDataFrame([(f"s{k}", "a", 0.5, 15, 20, "") for k in range(400)], TARGETS)
    many = Counter(r.row_id for seed in range(6) for r in S.draw_sample(frame, targets.limit(1), seed=seed).collect())
    assert sum(many.values()) == 6 * 15 and max(many.values()) <= 6
    assert set(Counter(r.target_set for r in S.draw_sample(frame, targets).collect()).values()) == {15}


def test_repeated_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a")], "row_id long, key string")
    targets = spark.createDataFrame([("s", "a", 1.0, 1, 3, "")], TARGETS)
    assert S.draw_sample(frame, targets).count() == 3
    assert S.draw_sample(frame.limit(0), targets).count() == 0 and S.draw_sample(frame, targets.limit(0)).count() == 0
    assert S.sample_report(frame.limit(0), targets).first().shortfall == 3


def test_targets_hold_for_their_own_field(spark):
    frame = spark.createDataFrame([("f", 1, "a"), ("f", 2, "a"), ("g", 3, "a")], "field_name string, row_id long, key string")
    targets = spark.createDataFrame([("f", "s", "a", 1.0, 1, 2), ("g", "t", "a", 1.0, 1, 2)], "field_name string, target_set string, category string, target_share double, min_rows long, sample_size long")
    assert {r.target_set: r.shortfall for r in S.sample_report(frame, targets, match=("field_name",)).collect()} == {"s": 0, "t": 1}
    assert Counter(r.target_set for r in S.draw_sample(frame, targets, match=("field_name",)).collect()) == {"s": 2, "t": 1}


def test_counts_of_any_size(spark):
    rows = spark.createDataFrame([(4 * 10**9, 3 * 10**9, 4 * 10**9 + 1, 5), (10**13, 10**12, 10**13 + 7, (1 << 20) - 1), (0, 5, 10, 7), (7, 5, 5, 7), (3, 0, 0, 7)], "rank long, n long, of long, start long")
    got = [r.p for r in rows.select(S.passed(F.col("rank"), F.col("n"), F.col("of"), F.col("start")).alias("p")).collect()]
    want = [(r.rank * r.n + (r.start * r.of >> 20)) // r.of if r.n < r.of else r.rank for r in rows.collect()[:4]]
    assert got[:4] == want and got[4] == 3


def test_the_report_counts_the_sample(spark):
    frame = spark.createDataFrame([(k, "ab"[k % 7 == 0]) for k in range(500)], "row_id long, key string")
    targets = spark.createDataFrame([("s", "a", 0.5, 1, 100, ""), ("s", "b", 0.5, 80, 100, ""), ("s", "b", 0.5, 80, 100, "again")], TARGETS)
    sample = Counter(r.category for r in S.draw_sample(frame, targets).collect())
    report = {r.category: (r.drawn, r.shortfall) for r in S.sample_report(frame, targets).collect()}
    assert report == {"a": (50, 0), "b": (72, 8)} and sample == {"a": 50, "b": 72}
