from __future__ import annotations

import random

import numpy as np
import pytest

from cresset.llm import spans as S

SCHEMA = "doc_id long, text string, path string, n int"


def _brute(docs, span=400):
    seen: dict = {}
    for d, t in docs:
        for k in range(len(t or "") - span + 1):
            seen.setdefault(t[k : k + span], set()).add((d, k))
    pairs, shared = set(), {}
    for group in seen.values():
        ids = {d for d, _ in group}
        pairs |= {(a, b) for a in ids for b in ids if a < b}
        if len(ids) > 1:
            for d, k in group:
                shared.setdefault(d, set()).update(range(k, k + span))
    return pairs, {d: len(s) for d, s in shared.items()}


def _noise(n, signs="abcdefgh é日\n"):
    return "".join(random.choices(signs, k=n))


@pytest.fixture(scope="module")
def docs():
    random.seed(9)
    common = _noise(5000)
    out = []
    for d in range(60):
        parts = [_noise(random.randint(0, 900))]
        for _ in range(random.randint(0, 3)):
            n = random.choice([300, 398, 399, 400, 401, 450, 1200])
            at = random.randint(0, len(common) - n)
            parts += [common[at : at + n], _noise(random.randint(0, 500))]
        out.append((d, "".join(parts)))
    boiler = _noise(399)  # just too short, in a third of the texts
    for d in range(100, 140):
        out.append((d, _noise(200) + boiler + _noise(200)))
    for d in range(140, 150):
        out.append((d, _noise(200) + "Q" + boiler + _noise(200)))
    out += [(200, None), (201, ""), (202, "x" * 399), (203, "x" * 900), (204, "ab" * 450), (205, "x" * 400), (206, out[0][1]), (None, out[0][1])]
    return out


@pytest.mark.parametrize("in_pairs", [S.IN_PAIRS, 1])
def test_pairs_by_brute_force(spark, docs, in_pairs):
    want, _ = _brute([x for x in docs if x[0] is not None])
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], SCHEMA).repartition(4)
    got = [tuple(r) for r in S.shared_pairs(df, in_pairs=in_pairs).collect()]
    assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("in_pairs", [S.IN_PAIRS, 1])
def test_amounts_by_brute_force(spark, docs, in_pairs):
    _, want = _brute([x for x in docs if x[0] is not None])
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], SCHEMA)
    got = {r.doc_id: r for r in S.shared_amounts(df, in_pairs=in_pairs).collect()}
    assert set(got) == {d for d, _ in docs if d is not None}
    assert {d: r.shared_chars for d, r in got.items() if r.shared_chars} == want
    assert got[200].n_chars == 0 and got[200].shared_share == 0 and got[206].shared_share > 0


def test_pieces_of_long_texts(spark, monkeypatch):
    random.seed(2)
    a = _noise(30_000)
    b = _noise(7000) + a[11_000:11_500] + _noise(9000)
    want = S._anchor_rows([a, b], 400)
    monkeypatch.setattr(S, "_PIECE", 3000)
    got = S._anchor_rows([a, b], 400)
    for x, y in zip(want, got):
        assert x.tolist() == y.tolist()


def test_minimizers_do_not_depend_on_neighbours():
    random.seed(3)
    texts = [_noise(1500), _noise(399), _noise(2500)]
    joined = S._anchor_rows(texts, 400)
    for k, t in enumerate(texts):
        alone = S._anchor_rows([t], 400)
        own = joined[0] == k
        assert joined[1][own].tolist() == alone[1].tolist() and joined[2][own].tolist() == alone[2].tolist()


def test_empty_and_equal_ids(spark):
    df = spark.createDataFrame([(1, "x y z " * 200, "", 0)] * 3, SCHEMA)
    assert S.shared_pairs(df).count() == 0 and S.shared_pairs(df.limit(0)).count() == 0
    assert S.shared_amounts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.shared_pairs(df, span=100)


def test_minimizers_depend_on_their_text_only():
    """By brute force, with ties and several texts in one batch."""
    random.seed(2)
    for _ in range(60):
        sizes = [random.randint(0, 60) for _ in range(random.randint(1, 5))]
        grams = np.array([random.randint(1, 6) for _ in range(sum(sizes) + 8)], dtype=np.uint64)
        ends = np.cumsum([*sizes[:-1], sizes[-1] + 8])
        window = 7
        want, last = set(), np.zeros(len(grams) - window + 1, dtype=np.int64)
        for w in range(len(last)):
            end = int(ends[np.searchsorted(ends, w, side="right")])
            last[w] = end - window
            if w <= last[w]:
                values = grams[w : w + window].tolist()
                want.add(w + values.index(min(values)))
        assert set(S.minimizers(grams, window, last).tolist()) == want
