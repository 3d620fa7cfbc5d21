from __future__ import annotations

import datetime as dt
import itertools
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cresset.functions.numbers import binomial_tail, erfc, shown
from cresset.functions.similarity import indel_ratio, token_set_ratio
from cresset.operators import audit, catalog, gates, judging, publishing, ranking, references, resampling, restoring, retrieval, scoring


@pytest.mark.parametrize(("n", "sizes"), [(1, [1, 0, 0, 0]), (2, None), (4, [1, 1, 1, 1]), (6, [2, 1, 1, 2]), (7, [2, 2, 1, 2]), (10, [3, 2, 2, 3]), (11, [3, 3, 2, 3])])
def test_quartile_sizes(spark, n, sizes):
    got = Counter(r.q for r in spark.range(1, n + 1).select(ranking.quartile(F.col("id"), F.lit(n)).alias("q")).collect())
    if n > 1:
        want = Counter(pd.qcut(pd.Series(range(1, n + 1)), 4, labels=["Q1", "Q2", "Q3", "Q4"]).astype(str))
        assert got == want
    if sizes:
        assert [got[f"Q{k}"] for k in (1, 2, 3, 4)] == sizes


def test_ranks_do_not_depend_on_partitions(spark):
    random.seed(1)
    rows = [(random.choice(["a", "b", None]), random.randint(0, 5), i) for i in range(300)]
    want = {}
    for g in ("a", "b", None):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))
        want |= {x[2]: (k + 1, len(own)) for k, x in enumerate(own)}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "g string, v int, i int").repartition(parts)
        got = {r.i: (r["rank"], r.group_size) for r in ranking.ranked(df, ["g"], [F.col("v").desc(), F.col("i").asc()]).collect()}
        assert got == want
    assert ranking.ranked(spark.createDataFrame([], "g string, v int"), ["g"], [F.col("v")]).count() == 0


REF = "table_name string, row_id long, scope string, key string, at timestamp, extra string"
PARENT = "scope string, key string, since timestamp, until timestamp, extra string"


def _t(d):
    return None if d is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=d)


def _reason(ref, parents):
    _, _, scope, key, at = ref[:5]
    k = (key or "").strip().lower()
    if not k:
        return "none"
    own = [(s, u) for sc, pk, s, u, _ in parents if scope is not None and sc == scope and pk is not None and pk.strip().lower() == k]
    if at is None:
        ok = any(s is None and u is None for s, u in own)
    else:
        ok = any((s is None or s <= at) and (u is None or u > at) for s, u in own)
    if ok:
        return "none"
    return "missing" if not own else "?" if at is None else "deleted" if any((s is None or s <= at) or (u is not None and u <= at) for s, u in own) else "late"


@pytest.mark.parametrize("per_task", [50_000, 3])
def test_orphans_by_brute_force(spark, per_task):
    random.seed(5)
    parents = [(random.choice("xyz"), random.choice(["a", " A ", "b", "c", None, ""]), _t(random.choice([None, 1, 3, 5, 9])), _t(random.choice([None, 2, 4, 8])), "e") for _ in range(25)]
    parents += [("x", "hot", _t(k / 4), _t(k / 4 + 0.1 + (k % 3) / 10), "e") for k in range(60)]
    refs = [("t", i, random.choice(["x", "y", "z", None]), random.choice(["a", "A\t", "b", "c", "d", "", "  ", None, "a", "hot", "hot"]), _t(random.choice([None, *(k / 8 for k in range(-4, 130))])), "e") for i in range(600)]
    refs += refs[:3] + [("t", 1000 + k, None, "a", _t(2), "e") for k in range(40)]  # without scope: missing, whatever their number
    found = references.orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PARENT), per_task)
    got = sorted((r.row_id, r.reason) for r in found.collect())
    want = sorted((r[1], w) for r in refs if (w := _reason(r, parents)) != "none")
    assert [i for i, _ in got] == [i for i, _ in want]
    for (_, g), (_, w) in zip(got, want):
        assert w == "?" or g == w


def test_orphans_of_empty_tables(spark):
    refs, parents = spark.createDataFrame([("t", 1, "x", "a", _t(1), "")], REF), spark.createDataFrame([("x", "a", None, None, "")], PARENT)
    none_r, none_p = refs.limit(0), parents.limit(0)
    assert [r.reason for r in references.orphan_references(refs, none_p).collect()] == ["missing"]
    assert references.orphan_references(none_r, parents).count() == 0
    by = references.orphans_by_period(references.orphan_references(refs, none_p)).collect()
    assert [(r.table_name, r.reason, r.n, r.period.month) for r in by] == [("t", "missing", 1, 1)]


def test_catalog_with_zero_counts_and_repeats(spark):
    items = spark.createDataFrame([(1, "c", "a", "A"), (2, "c", "a", "later"), (3, "c", "b", None), (4, "c", None, "x"), (5, "c", "d", "D (1999)")], "row_id int, catalog string, item_id string, title string")
    uses = spark.createDataFrame([("c", "d"), ("c", "d"), ("c", "z")], "catalog string, item_id string")
    got = {r.item_id: (r.title, r.normalized_title, r.interaction_count, r.popularity_quartile) for r in catalog.build_catalog(items, uses).collect()}
    assert got == {"d": ("D (1999)", "d", 2, "Q1"), "a": ("A", "a", 0, "Q2"), "b": (None, "", 0, "Q4")}


def test_users(spark):
    rows = spark.createDataFrame([(f"u{i % 5}", f"i{i}", i) for i in range(20)] + [("solo", "x", 1)], "user_id string, item_id string, timestamp long")
    users = catalog.eligible_users(rows, 4)
    assert users.count() == 5
    split = catalog.split_users(users, 2, 2, F.xxhash64("user_id"))
    parts = Counter(r.part for r in split.collect())
    assert parts == {"audit": 2, "calibration": 2} and split.select("user_id").distinct().count() == 4
    with pytest.raises(ValueError):
        catalog.split_users(users, 4, 2, F.xxhash64("user_id"))
    solo = spark.createDataFrame([("solo", "audit"), ("u1", "audit")], "user_id string, part string")
    h = catalog.ordered_histories(rows, solo)
    assert [(r.place, r.item_id, r.is_target) for r in h.orderBy("place").collect()] == [(1, "i1", False), (2, "i6", False), (3, "i11", False), (4, "i16", True)]
    assert [tuple(r) for r in catalog.as_arrays(h).collect()] == [("u1", ["i1", "i6", "i11"], "i16")]
    known = spark.createDataFrame([("zz", "Q1")], "item_id string, popularity_quartile string")
    assert [r.target_quartile for r in catalog.with_target_quartile(h, known).collect()] == ["Q4"]


def _entries(spark, n=120):
    random.seed(2)
    words = [f"w{k}" for k in range(60)] + ["of", "the"]
    rows = [("s", f"i{k:03}", " ".join(random.choices(words, k=4))) for k in range(n)]
    return rows, retrieval.index(spark.createDataFrame(rows, "catalog string, item_id string, title string"))


@pytest.mark.parametrize("per_task", [retrieval.PER_TASK, 1])
def test_rare_tokens_by_brute_force(spark, per_task):
    rows, entries = _entries(spark)
    queries = spark.createDataFrame([(f"q{k}", "s", rows[k][2]) for k in range(10)] + [("none", "s", "zzz"), ("empty", "s", "")], "query string, catalog string, folded string")
    got = {}
    for r in retrieval.by_rare_tokens(queries, entries, retrieval.Depth(k=5), per_task=per_task).collect():
        got.setdefault(r["query"], []).append((r.place, r.item_id))
    df = Counter(t for _, _, x in rows for t in set(x.split()))
    for k in range(10):
        scores = {i: sum(math.log(len(rows) / (1 + df[t])) for t in set(rows[k][2].split()) & set(x.split()) if df[t] <= 0.02 * len(rows)) for _, i, x in rows}
        hit = {i for _, i, x in rows if any(df[t] <= 0.02 * len(rows) for t in set(rows[k][2].split()) & set(x.split()))}
        want = sorted(hit, key=lambda i: (-round(scores[i], 6), i))[:5]
        assert [i for _, i in sorted(got.get(f"q{k}", []))] == want
    assert "none" not in got and "empty" not in got


@pytest.mark.parametrize("scorer", ["ratio", "token_set"])
def test_all_pairs_by_brute_force(spark, scorer):
    rows, entries = _entries(spark)
    entries = entries.union(entries.limit(5)).repartition(5)  # repeated entries are one
    queries = spark.createDataFrame([(f"q{k}", "s", rows[k][2] + " extra") for k in range(8)] + [("other", "t", "w1")], "query string, catalog string, sorted string")
    got = {}
    for r in retrieval.compare_all(queries, entries, 4, 0.0, scorer).collect():
        got.setdefault(r["query"], []).append((r.place, r.item_id, round(r.score, 9)))
    compare = {"ratio": indel_ratio, "token_set": token_set_ratio}[scorer]
    sort = lambda x: " ".join(sorted(x.split()))
    for k in range(8):
        want = sorted(((-compare(rows[k][2] + " extra", sort(x)), i) for _, i, x in rows))[:4]
        assert [(i, s) for _, i, s in sorted(got[f"q{k}"])] == [(i, round(-s, 9)) for s, i in want]
    assert "other" not in got


def test_equal_texts_are_compared_once(monkeypatch):
    seen = []
    real = retrieval.BitStrings
    monkeypatch.setattr(retrieval, "BitStrings", lambda texts: seen.extend(texts) or real(texts))
    best = {}
    retrieval._search(["mill old"], {"mill old": ["e3", "e1", "e2"], "lantern": ["e1", "e4"]}, best, 3, 0.0, "ratio")
    assert seen == ["mill old", "lantern"] and best == {"mill old": [(100.0, "e1"), (100.0, "e2"), (100.0, "e3")]}


def test_best_entries_among_many_of_one_text(spark):
    texts = ["mill old the", "mill old", "harbor lantern", "mill"]
    rows = [("s", f"e{k:03d}", texts[k % 3]) for k in range(90)] + [("s", "e005", "mill"), ("s", "e001", "mill old the")]
    queries = spark.createDataFrame([("q0", "s", "mill old the"), ("q1", "s", "mill old the"), ("q2", "s", "mill"), ("q3", "t", "mill")], "query string, catalog string, sorted string")
    entries = spark.createDataFrame(rows, "catalog string, item_id string, sorted string")
    asked = {r["query"]: r["sorted"] for r in queries.collect() if r["catalog"] == "s"}
    for least in (0.0, 60.0):
        got = {}
        for r in retrieval.compare_all(queries, entries, 5, least).collect():
            got.setdefault(r["query"], []).append((r.place, r.item_id, r.score))
        best = {q: {i: max(indel_ratio(x, t) for _, j, t in rows if j == i) for _, i, _ in rows} for q, x in asked.items()}
        want = {q: sorted((i for i, v in b.items() if v >= least), key=lambda i: (-b[i], i))[:5] for q, b in best.items()}
        assert {q: [i for _, i, _ in sorted(rows)] for q, rows in got.items()} == want


def test_retrieve_is_at_most_the_depth(spark):
    rows, _ = _entries(spark, 100)
    items = spark.createDataFrame([*rows, ("s", "null", None)], "catalog string, item_id string, title string")
    titles = spark.createDataFrame([("s", rows[0][2]), ("s", rows[0][2]), ("s", ""), ("s", None), ("s", "unlike it all")], "catalog string, title string")
    got = retrieval.retrieve(titles, items).collect()
    per = Counter(r.title for r in got)
    assert set(per) == {rows[0][2], "unlike it all"} and set(per.values()) == {8}
    assert len({(r.title, r.item_id) for r in got}) == len(got)
    assert [r.item_id for r in got if r.title == rows[0][2] and r.place == 1] == [rows[0][1]]
    assert "null" not in {r.item_id for r in got}


def test_retrieve_compares_only_what_rare_tokens_leave_open(spark, monkeypatch):
    rows = [("s", f"i{k:03}", f"common{k % 2} word{k // 10}") for k in range(1000)]
    items = spark.createDataFrame(rows, "catalog string, item_id string, title string")
    titles = spark.createDataFrame([("s", "word7"), ("s", "common0 zzz")], "catalog string, title string")
    compared = []
    real = retrieval.compare_all
    monkeypatch.setattr(retrieval, "compare_all", lambda queries, *rest: compared.extend(r["title"] for r in queries.collect()) or real(queries, *rest))
    got = {}
    for r in retrieval.retrieve(titles, items).collect():
        got.setdefault(r.title, []).append((r.place, r.item_id))
    assert compared == ["common0 zzz"]
    assert [i for _, i in sorted(got["word7"])] == [f"i{k:03}" for k in range(70, 78)] and len(got["common0 zzz"]) == 8


def test_best_by_tokens_in_small_parts(monkeypatch):
    random.seed(4)
    n, words = 50, 12
    sets = [sorted(random.sample(range(words), random.randint(0, 5))) for _ in range(n)]
    asked = [random.sample(range(words + 2), random.randint(0, 6)) for _ in range(9)]
    idf = [[(t % 4 + 1) * 0.7 - 1.0 for t in q] for q in asked]
    owners, codes = (np.array([x for i, s in enumerate(sets) for x in ([i, c][side] for c in s)]) for side in (0, 1))
    begin = np.append(0, np.cumsum([len(q) for q in asked]))
    queries = np.array([0, 2, 3, 5, 8])
    for at_once in (1, 30, 1 << 22):
        monkeypatch.setattr(retrieval, "POSTINGS_AT_ONCE", at_once)
        found = retrieval.best_by_tokens(owners, codes, n, queries, begin, np.array(sum(asked, [])), np.array(sum(idf, [])), 4)
        got = [(int(q), int(i), float(v)) for part in found for q, i, v in zip(*part)]
        want = []
        for q in queries.tolist():
            sums = {i: round(sum(w for t, w in zip(asked[q], idf[q]) if t in s), 6) for i, s in enumerate(sets) if set(asked[q]) & set(s)}
            want += [(q, i, sums[i]) for i in sorted(sums, key=lambda i: (-sums[i], i))[:4]]
        assert got == want


def test_replies(spark):
    reply = "item 1: 2\n2: 9\n3: 1 sure\nitem 3 : 0\n1_0: 1\nno colon\n7: 1\n4 : x\n: \n2:: 3"
    rows = spark.createDataFrame([(1, reply, [3, 3, 1, 1]), (2, None, [1]), (3, "", [1])], "b int, reply string, n_cands array<int>")
    assert sorted((r.b, r.item, r.pick) for r in judging.parse_replies(rows, ["b"]).collect()) == [(1, 1, 2), (1, 3, 0)]


def test_verdict_states_and_failing_judge(spark):
    cand = "array<struct<item_id:string,title:string>>"
    items = spark.createDataFrame([(1, k, f"t{k}", [("a", "t1"), ("b", "t2")]) for k in (1, 2, 3)], f"batch long, item int, title string, candidates {cand}")
    picks = spark.createDataFrame([(1, 1, 2), (1, 2, 0)], "batch long, item int, pick int")
    got = {r.item: (r.judged, r.in_catalog, r.match_title, r.match_id) for r in judging.verdicts(items, picks, ["batch"]).collect()}
    assert got == {1: (True, True, "t2", "b"), 2: (True, False, "", ""), 3: (False, None, None, None)}

    def broken(_):
        raise OSError

    asked = judging.prompts(items.withColumn("candidates", F.transform("candidates", lambda c: c["title"])), [])
    assert [r.reply for r in judging.judge(asked, broken).collect()] == [None]
    assert [r.reply for r in judging.judge(asked, judging.equal_title_judge).collect()] == ["1: 1\n2: 2\n3: 0"]


def test_pending_asks_unanswered_again(spark):
    rows = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, "a", False), (4, "b", False), (5, None, False)], "pos int, title string, judged boolean")
    assert [(r.title, r["first"]) for r in judging.pending(rows, rows, ["title"]).collect()] == [("a", 1)]


def test_confusion_of_undefined_rates(spark):
    rows = spark.createDataFrame([("m", "c", False, True), ("m", "c", False, False), ("m", "c", None, True)], "instrument string, catalog string, predicted boolean, human boolean")
    got = {r.catalog: r for r in scoring.confusion(rows).collect()}
    assert got[None].n == 2 and got["c"].precision is None and got["c"].f1 is None and got["c"].recall == 0.0


def test_kappa_and_sign_test(spark):
    rows = spark.createDataFrame([(True, True, True)] * 3 + [(True, False, True)] * 7 + [(False, True, True)] * 3, "a boolean, b boolean, h boolean")
    r = scoring.sign_test(rows, "a", "b", "h").first()
    want = min(1, 2 * sum(math.comb(10, i) for i in range(4)) / 2**10)
    assert (r.a_only, r.b_only) == (7, 3) and r.p_value == pytest.approx(want)
    same = spark.createDataFrame([(True, True, True)], "a boolean, b boolean, h boolean")
    assert scoring.sign_test(same, "a", "b", "h").first().p_value is None
    assert scoring.kappa(same, "a", "b").first().kappa is None
    for k, n in ((0, 5), (3, 10), (200, 1000)):
        got = spark.range(1).select(binomial_tail(F.lit(k), F.lit(n)).alias("t")).first().t
        assert got == pytest.approx(sum(math.comb(n, i) for i in range(k + 1)) / 2**n, rel=1e-9)


def test_strata_hold_empty_cells(spark):
    frame = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", True)], "catalog string, says boolean")
    sample = spark.createDataFrame([("a", True), ("a", True), ("b", True)], "catalog string, says boolean")
    got = {(r.catalog, r.says): (r.n_sample, r.n_frame, r.weight) for r in scoring.strata(sample, frame, "says").collect()}
    assert got[("a", False)] == (0, 1, None) and got[("b", False)][:2] == (0, 0)
    assert sum(n * w for n, _, w in got.values() if w) == pytest.approx(1)


def test_resampling(spark):
    rows = spark.createDataFrame([(True, True)] * 60 + [(True, False)] * 20 + [(False, True)] * 10 + [(False, False)] * 30, "predicted boolean, human boolean")
    r = resampling.interval(resampling.bootstrap(rows, n=4000)).first()
    rng = np.random.default_rng(0)
    f1 = []
    cells = np.repeat([0, 1, 2, 3], [60, 20, 10, 30])
    for _ in range(4000):
        c = np.bincount(rng.choice(cells, 120), minlength=4)
        f1.append(2 * c[0] / (2 * c[0] + c[1] + c[2]))
    assert r.low == pytest.approx(np.percentile(f1, 2.5), abs=0.01) and r.high == pytest.approx(np.percentile(f1, 97.5), abs=0.01)
    assert resampling.interval(resampling.bootstrap(rows.limit(0), n=10)).first().n_draws == 0
    bias = resampling.interval(resampling.bootstrap(rows, resampling.bias_of, n=2000)).first()
    assert bias.low < 10 / 120 < bias.high
    same = resampling.bootstrap(rows, n=2500).orderBy("draw").collect()
    assert same == resampling.bootstrap(rows.repartition(3), n=2500).orderBy("draw").collect()

    values = spark.createDataFrame([(1.0, True)] * 8 + [(0.0, True)] * 2 + [(1.0, False)] * 2 + [(0.0, False)] * 8, "v double, g boolean")
    p = resampling.permutation_p(values, "v", "g", n=5000).first()
    every = [sum(c) for c in itertools.combinations([1] * 10 + [0] * 10, 10)]
    exact = sum(abs(x / 10 - (10 - x) / 10) >= 0.6 - 1e-12 for x in every) / len(every)
    assert p.observed == pytest.approx(0.6) and p.p_value == pytest.approx(exact, abs=0.01)
    assert resampling.permutation_p(values.where("g"), "v", "g").first().p_value is None


def test_posterior(spark):
    frame = spark.createDataFrame([("a", True)] * 60 + [("a", False)] * 40, "catalog string, says boolean")
    sample = spark.createDataFrame([("a", True, True)] * 45 + [("a", True, False)] * 5 + [("a", False, False)] * 50, "catalog string, says boolean, human boolean")
    r = resampling.posterior_rates(sample, frame, "says", "human", n=20_000).first()
    assert r.member_rate == pytest.approx(0.54) and r.ood_low < 0.46 < r.ood_high and r.ood_high - r.ood_low < 0.25


def test_audit(spark):
    log = spark.createDataFrame([("c", k, f"t{k % 4}", k >= 10 and k % 2 == 0, k != 3) for k in range(25)], "cell string, pos int, title string, in_catalog boolean, judged boolean")
    assert [r.block for r in audit.blocks(log, ["cell"]).collect()] == [0]
    arms = {r.pos: r.arm for r in audit.arms(log, ["cell"]).collect()}
    assert {arms[k] for k in range(10)} == {"A"} and arms[11] == "B" and arms[12] == "C"
    changes = audit.conflicts(log, ["cell"]).first().n_changes
    want = sum(1 for t in range(4) for a, b in itertools.pairwise([k >= 10 and k % 2 == 0 for k in range(25) if k % 4 == t]) if a != b)
    assert changes == want
    assert audit.coverage(log, log, ["cell"]).first().asDict() == {"cell": "c", "n_titles": 4, "n_judged": 4, "n_missing": 0}
    totals = audit.audit_totals(log, spark.range(100)).first()
    assert (totals.n, totals.n_unanswered, totals.partial_batches, totals.total_batches, totals.affected_estimate) == (25, 1, 1, 3, 4)
    assert audit.sample_per_group(log, "cell", 7, F.xxhash64("pos"), "pos").count() == 7
    z = spark.range(1).select(*(c.alias(k) for k, c in audit.two_proportions(F.lit(0.12), F.lit(500), F.lit(0.1), F.lit(500)).items())).first()
    pooled = math.sqrt(0.11 * 0.89 * 2 / 500)
    assert z.z == pytest.approx(0.02 / pooled) and z.p_value == pytest.approx(math.erfc(0.02 / pooled / math.sqrt(2)))


def test_gates(spark):
    log = spark.createDataFrame([("c", "m", 1, "t", True, True, "known"), ("c", "m", 2, "t", False, True, ""), ("c", "m", 3, "u", False, False, None), ("c", "m", 4, "v", True, True, "gone")], "catalog string, model string, pos int, title string, in_catalog boolean, judged boolean, match_title string")
    known = spark.createDataFrame([("c", "known")], "catalog string, title string")
    checks = gates.integrity(log, log, known, ["catalog", "model"])
    assert sorted((r.check, r.n_bad) for r in checks.collect()) == [("conflict", 1), ("coverage", 1), ("dangling", 1)]
    with pytest.raises(ValueError, match="conflict"):
        gates.require(checks)
    gates.require(checks.limit(0))
    texts = spark.createDataFrame([("a", "x\nclaimed 12%"), ("b", "SUPERSEDED\nclaimed 12%")], "path string, text string")
    assert [(r.path, r.line) for r in gates.claims(texts, [r"claimed \d+%"]).collect()] == [("a", 2)]
    lines = spark.createDataFrame([("a",), ("b",)], "value string")
    assert [(r.value, r.side) for r in gates.stale(lines, lines.where("value = 'a'")).collect()] == [("b", "now")]


def test_restoring(spark):
    rows = spark.createDataFrame([(1, "c", None, "a"), (2, "c", "", "b"), (3, "c", "kept", "a"), (4, "c", "", ""), (5, "c", None, None)], "i int, scope string, t string, id string")
    known = spark.createDataFrame([(1, "c", "a", "old"), (2, "c", "a", "A"), (3, "c", "a", None)], "row_id int, catalog string, item_id string, title string").withColumnRenamed("catalog", "scope")
    got = {r.i: (r.t, r.was_withheld) for r in restoring.restore(rows, known, "scope", "t", "id").collect()}
    assert got == {1: ("A", True), 2: ("", True), 3: ("kept", False), 4: ("", False), 5: (None, False)}
    wide = spark.createDataFrame([(1, "x", "y", "1", "2")], "k int, a string, b string, ai string, bi string")
    long = restoring.long_slots(wide, ["k"], ["a", "b"], ["ai", "bi"])
    assert sorted(tuple(r) for r in long.collect()) == [(1, 1, "x", "1"), (1, 2, "y", "2")]
    assert [tuple(r) for r in restoring.wide_slots(long, ["k"], "title", ["a", "b"]).collect()] == [(1, "x", "y")]


def test_publishing(spark):
    named = spark.createDataFrame([("f1.a", 0.5), ("f1.b", None)], "name string, value double")
    assert [tuple(r) for r in publishing.provenance(named, "src", 2).collect()] == [("f1.a", "0.50", "src")]
    assert [r.value for r in publishing.macro_lines(publishing.provenance(named, "src", 2)).collect()] == ["\\newcommand{\\fa}{0.50}  % src"]
    one = spark.range(1)
    assert one.select(shown(F.lit(1234.5), 1, True, True).alias("x")).first().x == "+1,234.5"
    assert one.select(erfc(F.lit(0.5)).alias("x")).first().x == pytest.approx(math.erfc(0.5))
    cells = spark.createDataFrame([(0.5, 0.48, 0.02, 0.02, 0.1, 10, 0.4), (0.6, 0.5, 0.1, 0.1, 0.2, 5, None)], "member_rate double, conf double, gap double, ece double, brier double, n long, other double")
    r = publishing.cell_summary(cells).first()
    assert (r.n_under, r.n_over, r.n_flat, r.total, r.n_ece_is_gap) == (1, 0, 1, 15, 2)
    assert publishing.reductions(cells, "conf", ["other"]).first().n == 1


def test_unanswered_items_are_asked_again(spark):
    cand = "array<struct<item_id:string,title:string,quartile:string>>"
    items = spark.createDataFrame([("c", k, f"t{k}", "AB"[k % 2], [("a", "t1", "Q1"), ("b", "t2", None)]) for k in range(1, 25)], f"cell string, pos long, title string, arm string, candidates {cand}")

    def forgetful(prompt):
        """Answers the first of a batch's items only."""
        return judging.equal_title_judge(prompt).split("\n")[0]

    with pytest.raises(ValueError, match="unanswered after all rounds: A 12, B 9"):
        judging.judge_all(items, ["cell"], forgetful, ["pos"], rounds=1, arm="arm")
    with pytest.raises(ValueError, match="unanswered"):
        judging.judge_all(items, ["cell"], lambda p: 1 / 0, ["pos"], rounds=2, pause=0.0)
    got = {r.pos: (r.in_catalog, r.match_id, r.match_quartile) for r in judging.judge_all(items.where("pos < 4"), ["cell"], forgetful, ["pos"]).collect()}
    assert got == {1: (True, "a", "Q1"), 2: (True, "b", ""), 3: (False, "", "")}


def test_failed_calls_wait_longer_each_time(spark, tmp_path):
    log = str(tmp_path / "calls")

    def failing(_):
        import time

        with open(log, "a") as f:
            f.write(f"{time.time()}\n")
        raise OSError

    asked = spark.createDataFrame([("p",)], "prompt string")
    assert judging.judge(asked, failing, attempts=3, pause=0.1).first().reply is None
    times = [float(x) for x in open(log).read().split()]
    assert len(times) == 3 and times[1] - times[0] >= 0.1 and times[2] - times[1] >= 0.2


def test_restoring_of_restricted_sources_with_their_quartile(spark):
    rows = spark.createDataFrame([(1, "m", None, "a", None), (2, "z", None, "a", None), (3, "m", "kept", "a", "Q9"), (4, "m", "", "gone", ""), (5, None, None, "a", None)], "i int, catalog string, t string, id string, q string")
    known = spark.createDataFrame([(1, "m", "a", "old", "Q1"), (2, "m", "a", "A", "Q2"), (3, "m", "a", None, "Q3"), (1, "z", "a", "Z", "Q4")], "row_id int, catalog string, item_id string, title string, popularity_quartile string")
    got = {r.i: (r.t, r.q, r.was_withheld) for r in restoring.restore(rows, known, "catalog", "t", "id", also={"q": "popularity_quartile"}, restricted=["m"]).collect()}
    assert got == {1: ("A", "Q2", True), 2: (None, None, False), 3: ("kept", "Q9", False), 4: ("", "", True), 5: (None, None, False)}


def test_intervals_of_all_instruments(spark):
    rows = spark.createDataFrame([("m", True, True)] * 60 + [("m", True, False)] * 20 + [("m", False, True)] * 10 + [("m", False, False)] * 30 + [("all", True, True)] * 5 + [("none", None, True)], "instrument string, predicted boolean, human boolean")
    got = {(r.instrument, r.statistic): r for r in resampling.bootstrap_all(rows, n=3000).collect()}
    pairs = rows.where("instrument = 'm'")
    assert got["m", "kappa"].value == pytest.approx(scoring.kappa(pairs, "predicted", "human").first().kappa)
    assert got["m", "bias"].value == pytest.approx(10 / 120)
    one = resampling.interval(resampling.bootstrap(pairs, n=3000)).first()
    assert got["m", "f1"].low == pytest.approx(one.low, abs=0.01) and got["m", "f1"].high == pytest.approx(one.high, abs=0.01)
    assert got["m", "kappa"].low < got["m", "kappa"].value < got["m", "kappa"].high
    assert got["all", "kappa"].value is None and got["all", "kappa"].n_draws == 0 and got["none", "f1"].value is None


def test_a_permutation_in_buckets_is_the_same_test(spark):
    random.seed(4)
    values = spark.createDataFrame([(random.random() + 0.25 * (k % 2), k % 2 == 1) for k in range(300)], "v double, g boolean")
    whole, split = (resampling.permutation_p(values, "v", "g", n=3000, per_bucket=b).first() for b in (1000, 7))
    assert whole.observed == pytest.approx(split.observed) and whole.p_value == pytest.approx(split.p_value, abs=0.01)
    none = resampling.permutation_p(values.withColumn("g", F.col("v") * 1e9 % 2 < 1), "v", "g", n=3000, per_bucket=20).first()
    assert none.p_value > 0.01


def test_an_earlier_result_comes_from_one_row(spark):
    now = spark.createDataFrame([("k", True, False), ("new", True, True)], "key string, a boolean, b boolean")
    before = spark.createDataFrame([("k", 2, True, None), ("k", 1, False, True)], "key string, at int, a boolean, b boolean")
    old = {r.key: (r.a, r.b) for r in scoring.carried_over(now.select("key"), before, ["key"], ["a", "b"], "at").collect()}
    assert old == {"k": ("true", ""), "new": ("", "")}
    assert {r.column: (r.n, r.n_same) for r in scoring.reproduced(now, before, ["key"], ["a", "b"], "at").collect()} == {"a": (2, 1), "b": (2, 1)}


def test_f1_without_overlaps_and_summaries(spark):
    rows = spark.createDataFrame([("m", True, True, "x"), ("m", True, False, "old x"), ("m", False, True, "x"), ("k", True, True, "old")], "instrument string, predicted boolean, human boolean, title string")
    got = {r.instrument: (r.n, r.fp, r.fn, round(r.f1, 6), r.n_overlapping, r.f1_without and round(r.f1_without, 6)) for r in scoring.without(rows, F.col("title").contains("old")).collect()}
    assert got == {"m": (3, 1, 1, 0.5, 1, 0.666667), "k": (1, 0, 0, 1.0, 1, None)}
    cells = spark.createDataFrame([("c", 0.2, True), ("c", None, False), ("c", 1.4, False)], "catalog string, corrected double, in_range boolean")
    assert tuple(scoring.corrected_summary(cells).first()) == ("c", 3, 0.2, 1.4, 2)
    prompts = spark.createDataFrame([("x" * 40,), ("x" * 60,)], "prompt string")
    r = publishing.cost(prompts, spark.range(25), 80).first()
    assert (r.n_verdicts, r.n_calls, r.mean_chars, r.tokens_in, r.tokens_out) == (25, 3, 50.0, 25 * 12.5 + 3 * 20, 200) and r.price == pytest.approx((372.5 * 3 + 200 * 15) / 1e6)
