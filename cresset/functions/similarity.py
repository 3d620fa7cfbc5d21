"""Similarity of strings by insertions and deletions, scaled to 0..100."""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, a word of bits per row of the table."""
    if not a or not b:
        return 0
    at: dict = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & at.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class ManyStrings:
    """Strings to which many others are compared, a position of all of them at a time."""

    def __init__(self, texts: Sequence[str]) -> None:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        self.lengths = sizes[self.order]
        points = [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for i in self.order]
        self.alphabet, codes = np.unique(np.concatenate([*points, np.zeros(0, dtype=np.uint32)]), return_inverse=True)
        self.codes = np.zeros((int(self.lengths[0]) if len(texts) else 0, len(texts)), dtype=np.int32)
        at = 0
        for k, n in enumerate(self.lengths):
            self.codes[:n, k] = codes[at : at + n]
            at += n
        #: strings that still have a sign at each position; longer ones come first
        self.active = np.searchsorted(-self.lengths, -np.arange(len(self.codes)), side="left")

    def common(self, query: str) -> np.ndarray:
        """Length of the longest common subsequence with each string, in their given order."""
        words = max(1, -(-len(query) // 64))
        hits = np.zeros((words, len(self.alphabet)), dtype=np.uint64)
        place = {c: k for k, c in enumerate(self.alphabet.tolist())}
        for k, c in enumerate(query):
            if (code := place.get(ord(c))) is not None:
                hits[k // 64, code] |= np.uint64(1) << np.uint64(k % 64)
        rows = np.full((words, len(self.lengths)), np.iinfo(np.uint64).max, dtype=np.uint64)
        for j, n in enumerate(self.active):
            codes = self.codes[j, :n]
            carry: np.ndarray | None = None
            for w in range(words):
                row = rows[w, :n]
                hit = row & hits[w][codes]
                total = row + hit
                over = total < row
                if carry is not None:
                    total += carry
                    over |= carry & (total == 0)
                carry = over
                rows[w, :n] = total | (row - hit)
        found = np.zeros(len(self.lengths), dtype=np.int64)
        for w in range(words):
            bits = min(64, len(query) - 64 * w)
            mask = np.uint64((1 << bits) - 1) if bits > 0 else np.uint64(0)
            found += np.bitwise_count(~rows[w] & mask)
        out = np.empty_like(found)
        out[self.order] = found
        return out

    def ratios(self, query: str) -> np.ndarray:
        """``indel_ratio`` with each string, in their given order."""
        sizes = np.empty_like(self.lengths)
        sizes[self.order] = self.lengths
        total = sizes + len(query)
        return np.where(total > 0, 200.0 * self.common(query) / np.maximum(total, 1), 100.0)


class BitStrings:
    """Strings held as bits by sign, to which many others are compared a sign at a time; for many queries in order, which share their beginnings."""

    #: Numbers that are held at most, and signs of a query of which the state is kept.
    HELD, KEPT = 1 << 23, 24

    def __init__(self, texts: Sequence[str]) -> None:
        self.n = len(texts)
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.parts: list[tuple] = []
        words = np.maximum(1, -(-self.lengths // 64))
        for w in np.unique(words).tolist():
            self._add(w, np.flatnonzero(words == w), texts)

    def _add(self, words: int, at: np.ndarray, texts: Sequence[str]) -> None:
        sizes = self.lengths[at]
        points = np.frombuffer("".join(texts[k] for k in at).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        alphabet, codes = np.unique(points, return_inverse=True)
        if len(alphabet) * words * len(at) > self.HELD and len(at) > 1:
            self._add(words, at[: len(at) // 2], texts)
            self._add(words, at[len(at) // 2 :], texts)
            return
        owner = np.repeat(np.arange(len(at)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hits = np.zeros((len(alphabet), words, len(at)), dtype=np.uint64)
        order = np.argsort(place, kind="stable")
        ends = np.searchsorted(place[order], np.arange(int(sizes.max(initial=0)) + 1))
        for j, (a, b) in enumerate(zip(ends, ends[1:])):
            k = order[a:b]
            hits[codes[k], j // 64, owner[k]] |= np.uint64(1) << np.uint64(j % 64)
        by_sign = {chr(c): hits[k] for k, c in enumerate(alphabet.tolist())}
        kept = np.full((self.KEPT + 1, words, len(at)), np.iinfo(np.uint64).max, dtype=np.uint64)
        self.parts.append((at, words, by_sign, kept, [""], [np.empty((words, len(at)), dtype=np.uint64) for _ in range(3)]))

    def common(self, query: str) -> np.ndarray:
        """Length of the longest common subsequence with each string."""
        out = np.zeros(self.n, dtype=np.int64)
        for at, words, by_sign, kept, last, (hit, total, row) in self.parts:
            same = 0
            for a, b in zip(last[0][: self.KEPT], query):
                if a != b:
                    break
                same += 1
            now = kept[same]
            for j in range(same, len(query)):
                to = kept[j + 1] if j < self.KEPT else row
                held = by_sign.get(query[j])
                if held is None:
                    if to is not now:
                        to[...] = now
                else:
                    np.bitwise_and(now, held, out=hit)
                    np.add(now, hit, out=total)
                    if words > 1:
                        over = total[0] < now[0]
                        for w in range(1, words):
                            more = total[w] < now[w]
                            total[w] += over
                            over = more | (over & (total[w] == 0))
                    np.bitwise_xor(now, hit, out=hit)
                    np.bitwise_or(total, hit, out=to)
                now = to
            last[0] = query
            out[at] = 64 * words - np.bitwise_count(now).sum(axis=0, dtype=np.int64)
        return out

    def ratios(self, query: str) -> np.ndarray:
        """``indel_ratio`` with each string."""
        total = self.lengths + len(query)
        return np.where(total > 0, 200.0 * self.common(query) / np.maximum(total, 1), 100.0)


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The whole numbers from each low to before its high, one range behind the other."""
    sizes = high - low
    return np.arange(int(sizes.sum())) + np.repeat(low - np.cumsum(sizes) + sizes, sizes)


def common_lengths(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """``common_length`` of many pairs, a position of all of them at a time.

    The shorter string of a pair is held as bits; which of them a sign of the longer one stands for is looked up in a
    sorted list of all (pair, sign). Pairs are worked off by the number of words that their bits take.
    """
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(left, right)]
    out = np.zeros(len(pairs), dtype=np.int64)
    by_words: dict[int, list[int]] = {}
    for k, (a, _) in enumerate(pairs):
        if a:
            by_words.setdefault(-(-len(a) // 64), []).append(k)
    for words, members in by_words.items():
        members.sort(key=lambda k: -len(pairs[k][1]))  # those that still have signs come first
        out[members] = _common_in(words, [pairs[k] for k in members])
    return out


def _common_in(words: int, pairs: list[tuple[str, str]]) -> np.ndarray:
    n = len(pairs)
    point = lambda texts: np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    short, long = (np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    owner = np.repeat(np.arange(n), short)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(short) - short, short)
    keys = owner << 21 | point([a for a, _ in pairs])
    order = np.argsort(keys, kind="stable")
    known, first = np.unique(keys[order], return_index=True)
    bits = np.left_shift(np.uint64(1), (at[order] % 64).astype(np.uint64))
    hits = np.zeros((words, len(known) + 1), dtype=np.uint64)  # the last is for signs of the other side only
    for w in range(words):
        hits[w, :-1] = np.bitwise_or.reduceat(np.where(at[order] // 64 == w, bits, np.uint64(0)), first)
    signs = np.repeat(np.arange(n), long) << 21 | point([b for _, b in pairs])
    place = np.searchsorted(known, signs)
    place = np.where(known[np.minimum(place, len(known) - 1)] == signs, place, len(known))
    begin = np.cumsum(long) - long
    active = np.searchsorted(-long, -np.arange(int(long[0])), side="left")
    rows = np.full((words, n), np.iinfo(np.uint64).max, dtype=np.uint64)
    for j, m in enumerate(active):
        here = place[begin[:m] + j]
        carry: np.ndarray | None = None
        for w in range(words):
            row = rows[w, :m]
            hit = row & hits[w][here]
            total = row + hit
            over = total < row
            if carry is not None:
                total += carry
                over |= carry & (total == 0)
            carry = over
            rows[w, :m] = total | (row - hit)
    found = np.zeros(n, dtype=np.int64)
    for w in range(words):
        size = np.clip(short - 64 * w, 0, 64)
        mask = np.where(size == 64, np.iinfo(np.uint64).max, (np.uint64(1) << (size % 64).astype(np.uint64)) - np.uint64(1))
        found += np.bitwise_count(~rows[w] & mask)
    return found


def indel_ratio(a: str | None, b: str | None, least: float = 0.0) -> float | None:
    """100 times twice the common length over both lengths; two empty strings are equal; null where either is null.

    A ratio below ``least`` is given as 0, and where the lengths alone rule it out nothing is compared.
    """
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    if not total or a == b:
        return 100.0
    if 200.0 * min(len(a), len(b)) < least * total:
        return 0.0
    value = 200.0 * common_length(a, b) / total
    return value if value >= least else 0.0


def sorted_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort_ratio(a: str | None, b: str | None, least: float = 0.0) -> float | None:
    """Ratio of the strings with their tokens sorted; repeated tokens stay."""
    return None if a is None or b is None else indel_ratio(sorted_tokens(a), sorted_tokens(b), least)


def token_set_ratio(a: str | None, b: str | None) -> float | None:
    """Ratio that disregards what only one side has if the other holds it all.

    100 if there are common tokens and one side has no others. Else the largest of: the ratio of the two remainders
    behind the common tokens, and of the common tokens with either of the two. Without tokens on a side it is 0.
    """
    if a is None or b is None:
        return None
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = sorted(left & right)
    only_a, only_b = sorted(left - right), sorted(right - left)
    if both and not (only_a and only_b):
        return 100.0
    shared = " ".join(both)
    with_a, with_b = (" ".join([*both, *x]) for x in (only_a, only_b))
    rest_a, rest_b = " ".join(only_a), " ".join(only_b)
    head = len(shared) + bool(shared)
    whole = len(with_a) + len(with_b)
    best = 200.0 * (head + common_length(rest_a, rest_b)) / whole
    if shared:
        best = max(best, *(200.0 * len(shared) / (len(shared) + len(w)) for w in (with_a, with_b)))
    return best


def token_set_ratios(query: str, texts: Sequence[str]) -> np.ndarray:
    """``token_set_ratio`` of one string with many."""
    own = set(query.split())
    out = np.zeros(len(texts))
    if not own:
        return out
    open_: list[tuple[int, int, str, str]] = []
    for k, text in enumerate(texts):
        other = set(text.split())
        shared = own & other
        if shared and (len(shared) == len(own) or len(shared) == len(other)):
            out[k] = 100.0
        elif other:
            open_.append((k, len(" ".join(shared)), " ".join(sorted(own - shared)), " ".join(sorted(other - shared))))
    if open_:
        at, both, left, right = zip(*open_)
        both = np.array(both)
        head = both + (both > 0)
        sizes = [head + np.array([len(t) for t in rest]) for rest in (left, right)]
        best = 200.0 * (head + common_lengths(left, right)) / (sizes[0] + sizes[1])
        for size in sizes:
            best = np.maximum(best, np.where(both > 0, 200.0 * both / (both + size), 0.0))
        out[list(at)] = best
    return out


#: Classes of signs whose numbers bound the common length of two strings.
_CLASSES = 64


def sign_counts(texts: Sequence[str]) -> np.ndarray:
    """How many signs of each class a string has; the smaller counts of two strings sum to no less than their common length."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cells = np.repeat(np.arange(len(texts)), sizes) * _CLASSES + points % _CLASSES
    return np.bincount(cells, minlength=len(texts) * _CLASSES).reshape(-1, _CLASSES).astype(np.int32)


class Overlaps:
    """Sets of numbered features, to find those that share enough weight with another: lists of the sets by feature.

    ``owners`` are the places of the sets, ``codes`` their features; no pair of both is repeated.
    """

    def __init__(self, owners: np.ndarray, codes: np.ndarray, n: int) -> None:
        order = np.lexsort((owners, codes))
        self.n, self.owners = n, owners[order].astype(np.int32)
        self.codes, first = np.unique(codes[order], return_index=True)
        self.begin = np.append(first, len(codes))

    def at_least(self, codes: np.ndarray, weights: np.ndarray, least: np.ndarray, spare: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of the sets that share features of a weight of at least their entry of ``least``, and these weights.

        The most frequent features, up to a weight of ``spare``, are looked up only for the sets that the others don't rule out.
        """
        place = np.searchsorted(self.codes, codes)
        known = np.flatnonzero(self.codes[np.minimum(place, len(self.codes) - 1)] == codes) if len(self.codes) else np.zeros(0, dtype=np.int64)
        begin, end, weights = self.begin[place[known]], self.begin[place[known] + 1], weights[known]
        order = np.argsort(begin - end, kind="stable")
        later = int(np.searchsorted(np.cumsum(weights[order]), spare, side="right"))
        rest = float(weights[order[:later]].sum())
        now = order[later:]
        if len(now):
            sums = np.bincount(np.concatenate([self.owners[a:b] for a, b in zip(begin[now].tolist(), end[now].tolist())]), np.repeat(weights[now], end[now] - begin[now]), self.n)
        else:
            sums = np.zeros(self.n)
        at = np.flatnonzero(sums >= least - rest)
        sums, least = sums[at], least[at]
        if len(at):
            for k in order[:later].tolist():
                held = self.owners[begin[k] : end[k]]
                sums += np.where(held[np.minimum(np.searchsorted(held, at), len(held) - 1)] == at, weights[k], 0.0)
        reached = sums >= least
        return at[reached], sums[reached]


def trigrams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the texts and their distinct trigrams, as numbers: of each word with a blank on both sides. Words are parted by single blanks."""
    sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    middle = np.flatnonzero(points != 32)
    codes = points[middle - 1] << 42 | points[middle] << 21 | points[middle + 1]
    owners = np.repeat(np.arange(len(texts)), sizes)[middle]
    order = np.lexsort((codes, owners))
    owners, codes = owners[order], codes[order]
    first = np.ones(len(codes), dtype=bool)
    first[1:] = (owners[1:] != owners[:-1]) | (codes[1:] != codes[:-1])
    return owners[first], codes[first]


class SignBits:
    """How often texts hold each class of signs, a bit for each class and number reached: the bits in which two texts differ are no more than their insertions and deletions.

    The bits are those that tell most of the given texts apart, up to so many words; the most telling ones come first.
    """

    WORDS = 2

    def __init__(self, texts: Sequence[str]) -> None:
        counts = np.concatenate([sign_counts(texts[at : at + 16_384]).astype(np.uint16) for at in range(0, len(texts), 16_384)] or [np.zeros((0, _CLASSES), dtype=np.uint16)])
        reached = [(c, j, float(np.count_nonzero(counts[:, c] >= j))) for c in range(_CLASSES) for j in range(1, min(int(counts[:, c].max(initial=0)), _CLASSES) + 1)]
        reached = sorted(reached, key=lambda x: abs(x[2] - len(texts) / 2))[: 64 * self.WORDS]
        self.classes, self.numbers = (np.array([x[k] for x in reached], dtype=np.int64) for k in (0, 1))
        self.words = np.zeros((self.WORDS, len(texts)), dtype=np.uint64)
        for k, (c, j, _) in enumerate(reached):
            self.words[k // 64] |= (counts[:, c] >= j).astype(np.uint64) << np.uint64(k % 64)

    def of(self, text: str) -> np.ndarray:
        counts = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % _CLASSES, minlength=_CLASSES)
        out = np.zeros(64 * self.WORDS, dtype=bool)
        out[: len(self.classes)] = counts[self.classes] >= self.numbers
        return np.packbits(out, bitorder="little").view("<u8")


@lru_cache(maxsize=1 << 16)
def _token_bits(token: str) -> int:
    """Bits that stand for a token in 192: no more than it has signs with the blank behind it."""
    state, out = zlib.crc32(token.encode("utf-8", "surrogatepass")), 0
    for _ in range(min(len(token) + 1, 24)):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        out |= 1 << (state >> 12) % 192
    return out


def _set_bits(sets: Sequence[Sequence[str]]) -> np.ndarray:
    """Three words of bits for each set of tokens."""
    return np.frombuffer(b"".join(_any_of(s).to_bytes(24, "little") for s in sets), dtype="<u8").reshape(-1, 3).T.copy()


def _any_of(own: Sequence[str]) -> int:
    out = 0
    for t in own:
        out |= _token_bits(t)
    return out


#: Texts of which bits are compared at once, so that these stay in a processor's cache, and pairs of a text that count as few.
_AT_ONCE, _FEW = 65_536, 24


def _shared_least(least: float, total: np.ndarray) -> np.ndarray:
    """Trigrams, those with a blank in the middle among them, that strings of these lengths together share at a ratio of ``least``.

    Behind a blank on both sides of each, the common signs are at least so many runs less as there are other signs
    between them, and a run holds all its trigrams but two.
    """
    return total * (least / 40.0 - 2.0) - 1e-6


class NearStrings:
    """Strings among which those of at least some ratio to another are found: only those are compared whose lengths and numbers of signs allow it.

    The signs are compared as bits of all strings of a fitting length, in order of length. Where these leave more than a
    few, trigrams rule out those that have the signs in another order.
    """

    def __init__(self, texts: Sequence[str]) -> None:
        self.order = np.argsort([len(t) for t in texts], kind="stable")
        self.texts = [texts[k] for k in self.order.tolist()]
        self.lengths = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.bits = SignBits(self.texts)
        self.left, self.count, self.fits = np.empty(_AT_ONCE, dtype=np.uint64), np.empty(_AT_ONCE, dtype=np.uint8), np.empty(_AT_ONCE, dtype=bool)

    def likely(self, query: str, least: float) -> np.ndarray:
        """Places, in order of length, that lengths and signs don't rule out."""
        size = len(query)
        low = int(np.searchsorted(self.lengths, math.ceil(least * size / (200.0 - least) - 1e-6), side="left"))
        high = int(np.searchsorted(self.lengths, math.floor(size * (200.0 - least) / least + 1e-6), side="right"))
        own = self.bits.of(query)
        apart = 1.0 - least / 100.0
        out = []
        for a in range(low, high, _AT_ONCE):
            b = min(a + _AT_ONCE, high)
            left, count, fits = self.left[: b - a], self.count[: b - a], self.fits[: b - a]
            np.bitwise_xor(self.bits.words[0, a:b], own[0], out=left)
            np.bitwise_count(left, out=count)
            np.less_equal(count, np.uint8(min(255, int(apart * (size + int(self.lengths[b - 1])) + 1e-6))), out=fits)
            at = np.flatnonzero(fits)
            if len(at):
                differ = count[at].astype(np.int64)
                for w in range(1, self.bits.WORDS):
                    differ += np.bitwise_count(self.bits.words[w, a + at] ^ own[w])
                at += a
                out.append(at[differ <= apart * (size + self.lengths[at]) + 1e-6])
        likely = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
        if len(likely) > _FEW:
            codes = trigrams([query])[1]
            owners, others = trigrams([self.texts[k] for k in likely.tolist()])
            shared = np.bincount(owners[np.isin(others, codes)], minlength=len(likely))
            likely = likely[shared >= _shared_least(least, self.lengths[likely] + size) - (size - len(codes))]
        return likely

    def at_least(self, query: str, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and ratios of the strings that reach a ratio above 0."""
        likely = self.likely(query, least)
        others = [self.texts[k] for k in likely.tolist()]
        if len(others) <= _FEW:
            ratios = np.array([indel_ratio(query, t) for t in others], dtype=np.float64)
        else:
            ratios = 200.0 * common_lengths([query] * len(others), others) / np.maximum(self.lengths[likely] + len(query), 1)
        return _reached(self.order[likely], ratios, least)


class NearTokenSets:
    """The same for token-set ratios: what is shared is bounded by bits of the tokens, the rest by the signs of the distinct tokens."""

    def __init__(self, texts: Sequence[str]) -> None:
        sets = [sorted(set(t.split())) for t in texts]
        whole = [" ".join(s) for s in sets]
        self.near = NearStrings(whole)
        self.order, self.sizes = self.near.order, self.near.lengths
        self.texts = [texts[k] for k in self.order.tolist()]
        self.words = _set_bits([sets[k] for k in self.order.tolist()])
        #: signs, with a blank behind each token, for which a set's bits don't stand
        self.spare = self.sizes + 1 - np.bitwise_count(self.words).sum(axis=0, dtype=np.int64)
        self.floors: tuple = (None, None)
        self.more = np.empty(_AT_ONCE, dtype=np.uint8)

    def _alike(self, own: list[str], size: int, least: float) -> np.ndarray:
        """Places that may be alike by what is shared alone: all tokens of a side, or enough of their letters with a blank behind each."""
        part = min(1.0, least / (200.0 - least))
        if self.floors[0] != least:
            self.floors = (least, np.clip(np.ceil(part * self.sizes + 1 - 1e-6) - self.spare, 0, 255).astype(np.uint8))
        bits = _set_bits([own])[:, 0]
        spare = size + 1 - int(np.bitwise_count(bits).sum())
        last = int(np.bitwise_count(bits[2]))
        floor = max(0, int(np.ceil(part * size + 1 - 1e-6)) - spare - last)
        smaller = int(np.searchsorted(self.sizes, size, side="left"))
        first = int(np.searchsorted(self.sizes, 1, side="left"))  # no tokens, nothing shared
        out = []
        for low, high in ((first, smaller), (max(first, smaller), len(self.sizes))):
            for a in range(low, high, _AT_ONCE):
                b = min(a + _AT_ONCE, high)
                left, count, more, fits = self.near.left[: b - a], self.near.count[: b - a], self.more[: b - a], self.near.fits[: b - a]
                np.bitwise_and(self.words[0, a:b], bits[0], out=left)
                np.bitwise_count(left, out=count)
                np.bitwise_and(self.words[1, a:b], bits[1], out=left)
                np.bitwise_count(left, out=more)
                np.add(count, more, out=count)
                if low == first and high == smaller:
                    np.add(count, np.uint8(last), out=count)
                    np.greater_equal(count, self.floors[1][a:b], out=fits)
                else:
                    np.greater_equal(count, np.uint8(min(255, floor)), out=fits)
                at = np.flatnonzero(fits) + a
                if len(at):
                    both = np.bitwise_count(self.words[:, at] & bits[:, None]).sum(axis=0, dtype=np.int64)
                    out.append(at[both + np.minimum(self.spare[at], spare) >= part * np.minimum(self.sizes[at], size) + 1 - 1e-6])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def at_least(self, query: str, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and ratios of the strings that reach a ratio above 0."""
        own = sorted(set(query.split()))
        if not own:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        text = " ".join(own)
        close = self.near.likely(text, least)
        likely = np.union1d(self._alike(own, len(text), least), close[self.sizes[close] > 0])
        others = [self.texts[k] for k in likely.tolist()]
        ratios = np.array([token_set_ratio(query, t) for t in others], dtype=np.float64) if len(others) <= _FEW else token_set_ratios(query, others)
        return _reached(self.order[likely], ratios, least)


def _reached(at: np.ndarray, ratios: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places, in order, and ratios of those that reach the least one."""
    order = np.flatnonzero(ratios >= least)
    order = order[np.argsort(at[order])]
    return at[order], ratios[order]


@F.pandas_udf(T.IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Common length of each pair, null where either is."""
    out = pd.Series(pd.NA, index=a.index, dtype="Int32")
    held = a.notna() & b.notna()
    if held.any():
        out[held] = common_lengths(a[held].tolist(), b[held].tolist())
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def indel(a: Column | str, b: Column | str, least: float = 0.0) -> Column:
    """``indel_ratio`` as a column. Pairs whose lengths rule out the least ratio, and equal ones, aren't compared."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    total = F.length(a) + F.length(b)
    apart = 200.0 * F.least(F.length(a), F.length(b)) < least * total
    value = 200.0 * _common(F.when((a != b) & ~apart, a), b) / total
    return F.when(a == b, 100.0).when(apart, 0.0).when(a.isNotNull() & b.isNotNull(), F.when(value >= least, value).otherwise(0.0))


def token_sort(a: Column | str, b: Column | str, least: float = 0.0) -> Column:
    """``token_sort_ratio`` as a column."""
    a, b = (F.array_join(F.array_sort(_words(F.col(c) if isinstance(c, str) else c)), " ") for c in (a, b))
    return indel(a, b, least)


def token_set(a: Column | str, b: Column | str) -> Column:
    """``token_set_ratio`` as a column; only what both sides have on their own is compared in Python."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    left, right = F.array_distinct(_words(a)), F.array_distinct(_words(b))
    text = lambda words: F.array_join(F.array_sort(words), " ")
    shared, rest_a, rest_b = text(F.array_intersect(left, right)), text(F.array_except(left, right)), text(F.array_except(right, left))
    head = F.length(shared) + F.when(shared != "", 1).otherwise(0)
    size_a, size_b = (F.when(rest != "", head + F.length(rest)).otherwise(F.length(shared)) for rest in (rest_a, rest_b))
    holds = (shared != "") & ((rest_a == "") | (rest_b == ""))
    compared = 200.0 * (head + _common(F.when(~holds, rest_a), rest_b)) / (size_a + size_b)
    with_shared = F.when(shared != "", F.greatest(*(200.0 * F.length(shared) / (F.length(shared) + size) for size in (size_a, size_b)))).otherwise(0.0)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).when(holds, 100.0).when(a.isNotNull() & b.isNotNull(), F.greatest(compared, with_shared))
