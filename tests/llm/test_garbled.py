from __future__ import annotations

import random

import pytest

from cresset.llm import garbled as G

random.seed(12)
WORDS = ["café", "brûlée", "señor", "über", "naïve", "coração", "mañana", "fjörd", "plain", "harbor", "mill", "old", "tide", "glass", "Łódź", "garçon", "élan", "straße"]
OTHER = ["Тихая гавань", "Город из стекла", "Παλιά γέφυρα", "静かな港", "Пётр и Дёма", "Лунный берег"]
SCHEMA = "row_id long, source string, text string, garbled string"


def _title():
    t = " ".join(random.choices(WORDS, k=5)).title()
    return t + (f" ({random.choice(OTHER)})" if random.random() < 0.3 else "") + random.choice(["", " – Deluxe", "?", "’s", " ½ ®"])


def _swap(text, read, wrote="utf-8"):
    try:
        return text.encode(wrote).decode(read)
    except UnicodeError:
        return None


@pytest.fixture(scope="module")
def rows():
    out, truth = [], {}
    for k in range(4000):
        text = _title()
        kind = k % 40
        bad = None
        if kind == 1:
            bad = _swap(text, "latin-1")
        elif kind == 2:
            bad = _swap(text, "mac_roman")
        elif kind == 3:
            bad = _swap(text, "cp437")
        elif kind == 4:
            once = _swap(text, "latin-1")
            bad = _swap(once, "latin-1")
        elif kind == 5:
            w = text.split()
            w[0] = _swap(w[0], "latin-1") or w[0]
            bad = " ".join(w)
        elif kind == 6:
            bad = "".join("�" if "\x80" < c < "ƀ" else c for c in text)
        elif kind == 7 and text.isascii() is False:
            bad = "".join("?" if c in "éûñïãçöüß" else c for c in text)
            if "?" not in bad.replace("? ", "").rstrip("?"):
                bad = None
        elif kind == 8:
            bad = "Glass Tide (" + "Город из стекла".encode("cp1251").decode("latin-1") + ")"
        if bad and bad != text:
            truth[k] = text if kind != 8 else "Glass Tide (Город из стекла)"
            text = bad
        out.append((k, random.choice(["a", "b"]), text, "clash"))
    return out, truth


def test_found_and_restored(spark, rows):
    data, truth = rows
    df = spark.createDataFrame([*data, (9000, "a", None, ""), (9001, "a", "", ""), (9002, None, "plain", ""), (9003, "a", "Who Is It?", ""), (9004, "a", "x" * 20000, "")], SCHEMA)
    model = G.learn(df)
    got = {r.row_id: r for r in G.repair(df, model, ["row_id"]).collect()}
    missed, extra = set(truth) - set(got), set(got) - set(truth)
    assert len(missed) <= 0.02 * len(truth) and len(extra) <= 0.002 * len(data)
    restorable = [k for k in truth if k % 40 in (1, 2, 3, 4, 5, 8) and k in got]
    right = sum(got[k].restored == truth[k] for k in restorable)
    assert right >= 0.95 * len(restorable)
    assert all(got[k].state == "lost" for k in truth if k % 40 == 6 and k in got)
    assert not {9000, 9001, 9002, 9003, 9004} & set(got)


def test_proper_text_of_any_script_stays(spark):
    texts = OTHER * 30 + [" ".join(random.choices(WORDS, k=4)) for _ in range(600)] + ["ÀÉÎ", "Ñandú", "Ærø", "São Tomé"] * 5
    df = spark.createDataFrame([(k, "a", t, "") for k, t in enumerate(texts)], SCHEMA)
    assert G.repair(df, G.learn(df), ["row_id"]).count() == 0


RUSSIAN = "город стекло гавань берег ветер дождь вечер старый маяк синяя дверь чужой тихий лунный море песок камень дорога остров корабль зеркало память рассвет молоко береза сторона поворот прогулка королева трава сердце голос небо звезда ворота причал радуга порог горизонт".split()
POLISH = "żółw łódź źródło książka wąwóz świeży dąb gęś ćma pięść łąka żaba święto ściana późno cześć miłość zając ważny źle".split()


def _phrases(words, n, seed):
    random.seed(seed)
    return [" ".join(random.choices(words, k=5)) for _ in range(n)]


def _repaired(spark, proper, broken):
    """Restored text of each broken one; the proper ones must stay."""
    rows = [(k, "good", t, "") for k, t in enumerate(proper)] + [(10_000 + k, "bad", t, "") for k, t in enumerate(broken)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.row_id: r.restored for r in G.repair(df, G.learn(df), ["row_id"]).collect()}
    assert not [k for k in got if k < 10_000]
    return [got.get(10_000 + k) for k in range(len(broken))]


@pytest.mark.parametrize(("words", "wrote", "read"), [(RUSSIAN, "koi8_r", "cp1251"), (RUSSIAN, "cp1251", "koi8_r"), (RUSSIAN, "cp866", "cp1251"), (POLISH, "cp1250", "latin-1"), (RUSSIAN, "koi8_r", "latin-1")])
def test_pages_read_as_others(spark, words, wrote, read):
    truth = _phrases(words, 60, 5)
    got = _repaired(spark, _phrases(words, 900, 4) + _phrases(WORDS, 300, 3), [t.encode(wrote).decode(read) for t in truth])
    right = sum(a == b for t, g in zip(truth, got) for a, b in zip(t.split(), (g or "").split()))
    assert right >= 0.9 * 5 * len(truth)


def test_letters_that_no_page_has_are_learned(spark):
    """The source was written in a page with two pairs of letters in each other's place, which only its own texts can tell."""
    odd = str.maketrans("рлво", "лров")
    truth = _phrases(RUSSIAN, 150, 5)
    got = _repaired(spark, _phrases(RUSSIAN, 1500, 4), [t.translate(odd).encode("koi8_r").decode("latin-1") for t in truth])
    right = sum(a == b for t, g in zip(truth, got) for a, b in zip(t.split(), (g or "").split()))
    assert right >= 0.9 * 5 * len(truth)


def test_signs_of_two_bytes():
    assert "静かな港" in G.readings("静かな港".encode("euc_jp").decode("latin-1")).values()
    assert "静かな港" not in G.readings("静かな港").values()


def test_sources_are_learned_apart(spark):
    """More sources than any fixed number of slots, each with its own page."""
    pages = ["latin-1", "mac_roman", "cp437"]
    rows = []
    for k in range(600):
        text = _phrases(WORDS, 4, k)
        rows += [(4 * k + j, f"s{k}", _swap(t, pages[k % 3]) or t if j == 0 else t, "") for j, t in enumerate(text)]
    df = spark.createDataFrame(rows, SCHEMA)
    learned = G.learn(df)
    held = {r.source: G.profile(r.learned) for r in learned.profiles.collect()}
    assert len(held) == 600
    for k in range(600):
        mine = {c for c, w in held[f"s{k}"].weights.items() if w > 0.5 and c.endswith(">utf-8")}
        assert all(c.startswith(("latin-1", "cp1252", "cp1254", "iso8859_15", "cp1257")) for c in mine) if k % 3 == 0 else f"{pages[k % 3]}>utf-8" in mine or not mine


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert G.repair(df, G.learn(df), ["row_id"]).count() == 0


def test_readings():
    assert G.readings("plain") == {}
    assert G.readings("cafÃ©")["latin-1>utf-8"] == "café"
    assert G.readings("cafÃƒÂ©")["cp1252>utf-8 twice"] == "café"
    assert G.readings("Ãîðîä")["latin-1>cp1251"] == "Город"
    assert "latin-1>utf-8" not in G.readings("Пётр")
