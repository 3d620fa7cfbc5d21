from __future__ import annotations

import random
import re

from cresset.llm import leakage as L

WORDS = [f"w{k}" for k in range(40)] + ["the", "of", "die", "für", "Öl"]


def _brute(docs, items, span):
    out = set()
    words = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    for i, t in items:
        w = words(t)
        grams = {tuple(w[k : k + span]) for k in range(len(w) - span + 1)}
        for d, x in docs:
            v = words(x)
            if any(tuple(v[k : k + span]) in grams for k in range(len(v) - span + 1)):
                out.add((d, i))
    return out


def _made(n_docs=60, n_items=90):
    random.seed(11)
    items = [(i, " ".join(random.choices(WORDS, k=random.randint(3, 40)))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        words = random.choices(WORDS, k=random.randint(0, 300))
        if d % 3 == 0:
            w = random.choice(items)[1].split()
            k = random.randint(1, len(w))
            at = random.randint(0, len(words))
            words[at:at] = [x.upper() for x in w[:k]]
        docs.append((d, random.choice([" ", "\n", " - ", ", "]).join(words)))
    return docs, items


def test_leaks_by_brute_force(spark, monkeypatch):
    docs, items = _made()
    items += [(500, None), (501, ""), (502, "w1 w2"), (1, items[1][1])]
    docs += [(900, None), (901, ""), (902, "..."), (0, docs[0][1]), (903, items[5][1] + " x " + items[6][1])]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, item_id string").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    want = _brute(docs, items, 13)
    assert len(want) >= 10
    scores = []
    for size, kept in ((L.INDEX_BYTES, L._KEPT), (900, L._KEPT), (200, 5000)):  # in one part, in several, in many for small portions of texts
        monkeypatch.setattr(L, "_KEPT", kept)
        got = L.leaked_items(d, i, index_bytes=size)
        assert got.columns == ["doc_id", "item_id", "score"]
        rows = got.collect()
        assert sorted((r.doc_id, r.item_id) for r in rows) == sorted(want)
        scores.append(sorted(map(tuple, rows)))
    assert scores[0] == scores[1] == scores[2]


def test_every_run_reaches_its_threshold():
    _, items = _made()
    index = L.ItemIndex(items, 13, block=8)
    for i, (_, text) in enumerate(items):
        words = L.words_of(text)
        for k in range(len(words) - 12):
            terms = list(dict.fromkeys(index.terms[w] for w in words[k : k + 13]))
            found = dict(index.above(terms))
            assert i in found
            exhaustive = {j for j in range(len(items)) if sum(w for t in terms for x, w in zip(*index.postings[t]) if x == j) >= index.need[j]}
            assert set(found) == exhaustive


def test_empty_tables(spark):
    docs, items = _made(3, 3)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert L.leaked_items(d.limit(0), i).count() == 0 and L.leaked_items(d, i.limit(0)).count() == 0


def test_a_long_text(spark):
    _, items = _made(1, 5)
    long = next(t for _, t in items if len(t.split()) >= 13)
    text = "w1 the of " * 200_000 + long + " w1" * 100_000
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert {r.item_id for r in L.leaked_items(d, i).collect()} == {j for _, j in _brute([(1, text)], items, 13)}
