from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from cresset.llm import formatting as P

SCHEMA = "row_id long, model string, flag boolean, title string, key string, n int"


def _brute(rows):
    groups = defaultdict(set)
    for i, m, f, t, *_ in rows:
        words = tuple(sorted(re.findall(r"[^\W_]+", (t or "").lower())))
        if words:
            groups[m, f, words].add(i)
    return sorted((i, min(g), len(g)) for g in groups.values() for i in g)


@pytest.mark.parametrize("per_task", [P.PER_TASK, 5])
def test_groups_by_brute_force(spark, per_task, monkeypatch):
    if per_task == 5:
        monkeypatch.setattr(P, "_HOT_KEYS", 100)
    random.seed(7)
    rows = []
    for i in range(900):
        words = ["Old", "Mill", "Tide"] if i % 3 == 0 else random.choices(["old", "mill", "tide", "ä1", "x", "x"], k=random.randint(0, 3))
        random.shuffle(words)
        title = random.choice([" ", ", ", "_", "\t"]).join(random.choice([str.lower, str.upper, str])(w) for w in words)
        rows.append((i, random.choice(["m", None]), random.choice([True, False, None]), random.choice([title, title + "!"]), "clash", 1))
    rows += [(1000, "m", True, None, "", 0), (1001, "m", True, "...", "", 0), rows[0], rows[0], (1002, "m", True, "long " * 5000, "", 0), (1003, "m", True, "LONG " * 5000, "", 0)]
    got = P.copies(spark.createDataFrame(rows, SCHEMA), ["model", "flag"], "title", per_task=per_task)
    assert got.columns == ["row_id", "keep_id", "n_copies"]
    assert sorted(map(tuple, got.collect())) == _brute(rows)


def test_the_rest_takes_one_shuffle(spark):
    df = spark.createDataFrame([(k, "m", True, f"Old Mill {k % 7}", "", 0) for k in range(50)], SCHEMA)
    plan = P.copies(df, ["model", "flag"], "title")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) == 1 and len(re.findall(r"\bSort ", plan)) == 1, plan


def test_empty(spark):
    assert P.copies(spark.createDataFrame([], SCHEMA), ["model"], "title").count() == 0
