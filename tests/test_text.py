from __future__ import annotations

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cresset.functions import similarity as S
from cresset.functions import text as X
from cresset.operators import scoring


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(row[j + 1], row[j])
            last = keep
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé 日", max_size=40), st.text("abcé 日", max_size=40))
def test_common_length_is_that_of_the_table(a, b):
    assert S.common_length(a, b) == _lcs(a, b)
    ratio = S.indel_ratio(a, b)
    assert ratio == S.indel_ratio(b, a) and 0 <= ratio <= 100 and (ratio == 100) == (a == b)
    for least in (50.0, 90.0):
        assert S.indel_ratio(a, b, least) == (ratio if ratio >= least else 0.0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcé 日", max_size=90), max_size=12), st.text("abcé 日x", max_size=200))
def test_many_at_once_are_one_by_one(texts, query):
    many = S.ManyStrings(texts)
    assert many.common(query).tolist() == [S.common_length(query, t) for t in texts]
    assert many.ratios(query).tolist() == [S.indel_ratio(query, t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abcé 日", max_size=150), st.text("abcé 日x", max_size=150)), max_size=12))
def test_pairs_at_once_are_one_by_one(pairs):
    assert S.common_lengths([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [S.common_length(a, b) for a, b in pairs]


@settings(max_examples=60, deadline=None)
@given(st.text("ab é", max_size=20), st.lists(st.text("ab é", max_size=20), max_size=8))
def test_token_sets_at_once_are_one_by_one(query, texts):
    assert S.token_set_ratios(query, texts).tolist() == [S.token_set_ratio(query, t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text("abcé 日", max_size=20), st.lists(st.text("abcé 日", max_size=20), max_size=10), st.sampled_from([1.0, 40.0, 66.0, 90.0, 100.0]))
def test_bounds_lose_nothing(query, texts, least):
    for near, one in ((S.NearStrings, S.indel_ratio), (S.NearTokenSets, S.token_set_ratio)):
        at, ratios = near(texts).at_least(query, least)
        if query or one is S.token_set_ratio:
            want = {k: one(query, t) for k, t in enumerate(texts) if (query or t) and one(query, t) >= least}
            assert dict(zip(at.tolist(), ratios.tolist())) == want


def test_ratios_by_hand():
    assert S.indel_ratio("abcd", "abxd") == 75.0
    assert S.indel_ratio(None, "a") is None and S.indel_ratio("", "") == 100.0
    assert S.token_sort_ratio("b a", "a b") == 100.0
    assert S.token_set_ratio("tide", "old tide mill") == 100.0  # one side holds the other
    assert S.token_set_ratio("", "a") == 0.0 and S.token_set_ratio("a", "b") == 0.0
    both, a, b = "mill", "mill old", "mill red"
    want = max(200 * _lcs(a, b) / (len(a) + len(b)), 200 * len(both) / (len(both) + len(a)))
    assert S.token_set_ratio("old mill", "red mill") == pytest.approx(want)


TITLES = ["", None, "Café Lumen", "Glass Tide (1987)", "Glass  Tide (1987) ", "½ Moon", "ﬁne day", "a‿b", "İzmir", "١٢ nights", "हिन्दी", "x" * 5000, "Tide (987)", "A_B-C", "ＡＢＣ", "Ünder (2020) x"]


def test_normal_and_folded_forms_are_those_of_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES)], "i int, t string")
    got = {r.i: (r.n, r.f) for r in rows.select("i", X.normalized("t").alias("n"), X.folded("t").alias("f")).collect()}
    for i, t in enumerate(TITLES):
        if t != "İzmir":  # its lower case has another number of signs in the JVM
            assert got[i][0] == X.normalize_text(t), t
        assert got[i][1] == X.fold_text(t), t


def test_combining_class_decides_what_is_dropped():
    assert X.fold_text("é") == "e"
    assert X.fold_text("ः") == ""  # a mark of class 0 stays until punctuation goes
    assert unicodedata.combining("ः") == 0


# (query, title, kind, whether they match), one for each rule
PAIRS = [
    ("Wooden Rail Set with Bridge and 40 Parts", "Rail set", "product", False),
    ("Garden Hose, Coiled, for Balcony", "7", "product", False),
    ("Clay Figures for School 5-9, 6 Pack", "Clay Figures for", "product", False),
    ("Storm and Harbor Too", "Storm and Harbor (1991)", "film", False),
    ("The Old Waffle House", "Waffle House", "place", False),
    ("Ann's East Side Bagel", "East Side Bagel", "place", False),
    ("Marble Run 4 Deluxe Edition", "Marble Run 4 (2012)", "film", False),
    ("Oak Shape Sorter for Children, 90 Pieces", "Oak Shape Sorter for Children", "product", False),
    ("Red Fern Bakery", "Fern Bakery", "place", False),
    ("The Harbour", "The Barbour", "place", False),
    ("The Silent Coast (1979)", "The Silent Coast (1938)", "film", False),
    ("Café de la Lune", "Cafe de la Lune", "place", True),
    ("Brasserie Étoile", "Brasserie Etoile", "place", True),
    ("Léonie (2003)", "Leonie (Merveilleux été de Léonie Blanc, Le) (2003)", "film", True),
    ("N1ght", "Night (a.k.a. N1ght) (1994)", "film", True),
    ("Boats in White", "Boats in White (a.k.a. BIW) (1999)", "film", True),
    ("The Quarry", "Quarry, The (1995)", "film", True),
    ("Harvest Week (1997)", "Harvest Week (a.k.a. HW7) (1997)", "film", True),
    ("Juniper Grill", "The Juniper Grill", "place", True),
    ("Step-In Tavern", "Step-In Tavern - Lower Town", "place", True),
    ("Nora's Cafe", "Nora's Café", "place", True),
]


def test_pairs_by_rule(spark):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "i int, query string, title string, kind string, want boolean")
    got = {r.i: r.ok for r in scoring.pair_scores(rows, ["i"]).select("i", scoring.passes("score").alias("ok")).collect()}
    assert [got[i] for i in range(len(PAIRS))] == [p[3] for p in PAIRS]


def test_unusable_differs_from_no_match(spark):
    rows = spark.createDataFrame([(1, "", "anything", "place"), (2, None, "x", "film"), (3, "Wholly Unrelated Thing", "Some Other Words", "place"), (4, "one two three four five", "six seven eight nine ten", "place"), (5, "a b", None, "place")], "i int, query string, title string, kind string")
    got = {r.i: r.score for r in scoring.pair_scores(rows, ["i"]).collect()}
    assert got[1] is None and got[2] is None and got[3] == 0.0 and 0 < got[4] < 90 and got[5] == 0.0


def test_short_guard_and_year(spark):
    rows = spark.createDataFrame([("fern bakery", "red fern bakery"), ("a b c d e", "a b c d f"), ("", "a"), ("b a", "a b")], "q string, f string")
    assert [r.c for r in rows.select(X.short_conflict("q", "f").alias("c")).collect()] == [True, False, True, False]
    years = spark.createDataFrame([("x (1999)",), ("x (0999) ",), ("x 1999",), (None,)], "t string")
    assert [r.y for r in years.select(X.year_of("t").alias("y")).collect()] == ["1999", "0999", None, None]


def test_forms(spark):
    cases = [("Quarry, The (a.k.a. Pit, A) (1995)", "film", ["quarry the a k a pit a", "quarry the", "the quarry", "pit a", "a pit"]), ("The Mill - Upper Gate", "place", ["the mill upper gate", "mill upper gate", "the mill", "mill"]), ("Kit (red) [big]", "product", ["kit red big", "kit big", "kit red"]), (None, "film", []), ("", "film", []), ("Été (x) (12) (Ü, La) (1990)", "film", ["ete x 12 u la", "ete", "u la"]), ("7 (Seven) (1995)", "film", ["7 seven", "7", "seven"])]
    rows = spark.createDataFrame([(i, t, k) for i, (t, k, _) in enumerate(cases)], "i int, title string, kind string")
    got = {}
    for r in X.with_forms(rows, "title", "kind").distinct().collect():
        got.setdefault(r.i, []).append(r.form)
    assert [sorted(got.get(i, [])) for i in range(len(cases))] == [sorted(set(w)) for _, _, w in cases]


def test_columns_are_the_functions(spark):
    random.seed(3)
    words = ["tide", "mill", "old", "café", "x", ""]
    pairs = [(" ".join(random.choices(words, k=random.randint(0, 5))), " ".join(random.choices(words, k=random.randint(0, 5)))) for _ in range(80)] + [(None, "a"), ("a", None)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for r in rows.select("a", "b", S.indel("a", "b").alias("i"), S.token_sort("a", "b").alias("o"), S.token_set("a", "b").alias("s")).collect():
        assert (r.i, r.o, r.s) == (S.indel_ratio(r.a, r.b), S.token_sort_ratio(r.a, r.b), S.token_set_ratio(r.a, r.b))
    for r in rows.select("a", "b", S.indel("a", "b", 80.0).alias("i"), S.token_sort("a", "b", 80.0).alias("o")).where("a is not null and b is not null").collect():
        assert (r.i, r.o) == (S.indel_ratio(r.a, r.b, 80.0), S.token_sort_ratio(r.a, r.b, 80.0))
    assert rows.limit(0).select(S.indel("a", "b")).count() == 0


def test_contains_any(spark):
    rows = spark.createDataFrame([("Old (19 Mill",), (None,), ("",)], "t string")
    assert [r.c for r in rows.select(X.contains_any("t", ["(19", "q"]).alias("c")).collect()] == [True, False, False]
    assert [r.c for r in rows.select(X.contains_any(F.col("t"), []).alias("c")).collect()] == [False] * 3


def test_strings_as_bits_by_brute_force():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcé ", k=n)) for n in (0, 1, 5, 40, 63, 64, 65, 127, 128, 129, 200) for _ in range(6)]
    many = S.BitStrings(texts)
    for query in sorted([*rng.sample(texts, 25), "", "zz", "a" * 90, "a" * 64]):
        assert many.common(query).tolist() == [S.common_length(query, t) for t in texts]


def test_strings_of_the_same_signs_in_another_order_are_ruled_out(monkeypatch):
    rng = random.Random(6)
    words = "quiet meadow lantern harbor kettle winter".split()
    texts = [" ".join("".join(rng.sample(w, len(w))) for w in words) for _ in range(300)] + [" ".join(words)]
    compared = []
    real = S.common_lengths
    monkeypatch.setattr(S, "common_lengths", lambda a, b: compared.append(len(a)) or real(a, b))
    for near in (S.NearStrings(texts), S.NearTokenSets(texts)):
        compared.clear()
        at, ratios = near.at_least(" ".join(words), 90.0)
        assert at.tolist() == [300] and ratios.tolist() == [100.0] and sum(compared) <= 1


def test_few_pairs_are_looked_at_closely(monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(200)]
    texts = [" ".join(["pack", "of", *rng.sample(words, 4)]) for _ in range(2000)]
    monkeypatch.setattr(S, "common_lengths", lambda *_: pytest.fail("many pairs were compared"))
    monkeypatch.setattr(S.Overlaps, "at_least", lambda *_: pytest.fail("lists were gone through"))
    for near in (S.NearStrings(texts), S.NearTokenSets(texts)):
        at, ratios = near.at_least(texts[5] + "x", 90.0)
        assert 5 in at.tolist() and ratios.min() >= 90.0
