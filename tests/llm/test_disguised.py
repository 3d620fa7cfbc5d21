from __future__ import annotations

import random

from cresset.llm import disguised as D

SCHEMA = "row_id long, text string, findings string"
CASES = {  # text: (kinds, form)
    "Ｏｌｄ Mill １２": (["width"], "Old Mill 12"),
    "ﬁne Mill": (["ligature"], "fine Mill"),
    "café Mill": (["mark"], "café Mill"),
    "Mi​ll­": (["invisible"], "Mill"),
    "Old Mill　Tide": (["space"], "Old Mill Tide"),
    "Old Мill Тide": (["look-alike"], "Old Mill Tide"),
    "ＭΙll x": (["width", "space", "look-alike"], "MIll x"),
    "Гоpод Мир": (["look-alike"], "Город Мир"),
}
PROPER = ["Mill café “x” – y", "Тихая гавань", "Παλιά γέφυρα (1999)", "静かな港、東", "Old\tMill\nTide", "", "Mill Тихая Tide", "½ ® ª", "naïve œuvre æon"]


def _unified(spark, texts):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], SCHEMA)
    return {texts[r.row_id]: r for r in D.unify(df, ["row_id"]).collect()}


def test_kinds_and_forms(spark):
    vocabulary = ["old mill tide fine 12 café x", "Город Мир", "MILL"]
    got = _unified(spark, [*CASES, *PROPER, *vocabulary])
    assert set(got) == set(CASES)
    for text, (kinds, form) in CASES.items():
        assert got[text].findings == kinds and got[text].unified == form and got[text].unrepaired == 0, text


def test_look_alikes_are_repaired_only_to_known_words(spark):
    got = _unified(spark, ["Zorkаp Tide", "Tіdе", "tide"])
    assert got["Zorkаp Tide"].unified == "Zorkаp Tide" and got["Zorkаp Tide"].unrepaired == 1 and got["Zorkаp Tide"].findings == ["look-alike"]
    assert got["Tіdе"].unified == "Tide" and got["Tіdе"].unrepaired == 0


def test_only_the_word_itself_is_replaced(spark):
    """A word of which another known word is a part stays as it is."""
    got = _unified(spark, ["xаt xаty", "xat", "zxаt_xаt"])
    assert got["xаt xаty"].unified == "xat xаty" and got["xаt xаty"].unrepaired == 1
    assert got["zxаt_xаt"].unified == "zxаt_xat" and got["zxаt_xаt"].unrepaired == 1


def test_nulls_repeats_long_and_empty(spark):
    rows = [(1, None, ""), (2, "a​b", ""), (2, "a​b", ""), (3, "y" * 50_000 + " z", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.row_id, len(r.unified)) for r in D.unify(df, ["row_id"]).collect())
    assert got == [(2, 2), (2, 2), (3, 50_002)]
    assert D.unify(df.limit(0), ["row_id"]).count() == 0


def test_pattern_misses_no_finding(spark):
    random.seed(1)
    signs = "abcАВеоνΡ́​ ﬁＡ１日é -Ж"
    texts = list({"".join(random.choices(signs, k=6)) for _ in range(600)})
    want = {t for t in texts if D.findings_of(t)[0]}
    assert set(_unified(spark, texts)) == want


def test_one_script():
    assert D.one_script("Mіll") == "Mill" and D.one_script("Жill") == "Жill" and D.one_script("мир") == "мир"
    assert D.one_script("Рrа") == "Pra"  # look-alikes in the majority
    assert D.one_script("haгbor") == "harbor" and D.one_script("γacht") == "yacht" and D.one_script("mⲟcha") == "mocha" and D.one_script("ѡave") == "wave"
