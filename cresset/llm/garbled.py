"""Text that was decoded with a wrong character encoding.

A swap of code pages is taken as a substitution cipher: each sign or group of signs that the wrong page made stands
for one letter. Ciphers start as the pairs of a page that was read and an encoding that was written, once or twice
over. Per source, expectation-maximization learns how often each cipher occurs, which one a token was written in, and
for what letter each sign of it stands: the likelihood of a reading comes from bigrams of the language, which are
counted over all texts and, from one round to the next, without what is probably garbled. A sign's letter is the one
that its neighbours in the source's garbled tokens make most likely, times the share of the letter's occurrences that
are this sign, the page's letter counting as a few occurrences; so a cipher may depart from its page. Garbled tokens are then translated by the letters of their cipher; where several
ciphers agree on the letters their probabilities add up. Signs that replace lost letters are a cipher that many
letters share: they are found in the same way and stay unrestored.
"""

from __future__ import annotations

import codecs
import json
import math
import pickle
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cresset.llm._lookalikes import in_latin, plain_form
from cresset.sources.workspace import written

# Code pages in which UTF-8 is read by mistake, and pages of other scripts read as Western ones.
READ_PAGES = ("latin-1", "cp1252", "mac_roman", "cp437", "cp1251", "cp1250", "cp850", "cp1253", "cp1254", "cp1257", "iso8859_2", "iso8859_15", "koi8_r", "cp866")
SINGLE_PAGES = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "koi8_r", "cp866")
WRITTEN_PAGES = ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5", "cp1253", "iso8859_7", "cp1250", "iso8859_2", "cp1252", "cp850", "mac_roman")
LATIN_PAGES = ("cp1250", "iso8859_2", "cp1252", "cp850", "mac_roman")
# Encodings of two bytes a sign, and the pages they are read as.
WIDE_PAGES, WIDE_READ = ("shift_jis", "euc_jp", "gb18030", "euc_kr"), ("latin-1", "cp1252")

LITERAL, LOST = "literal", "lost"
ROUNDS = 3
#: Occurrences that the letter of its page counts as when the letter of a sign is learned.
PAGE_LETTER = 3.0
_TOKEN = re.compile(r"[^\x00-\x20!-/:->@\[-`{-~]+")
_UNIT = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}")
_GAP = re.compile(r"\?(?=[^\W\d_])|\?\?|[^\W\d_]\?$")
_LAST_GAP = re.compile(r"[^?\ufffd]*[^\W\d_]\?$")
_FLOOR, _KEPT, _SCRIPT = 1e-9, 0.9, 0.05
#: Share of tokens that hold look-alike letters, as assumed.
_DISGUISED = 1e-2


@lru_cache(maxsize=64)
def _page(name: str) -> dict[str, int]:
    """Sign to byte for the upper half of a code page; undefined bytes are control signs."""
    out = {}
    for b in range(128, 256):
        try:
            c = codecs.decode(bytes([b]), name)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


def _once(text: str, page: str, again: bool = False) -> tuple[str, list[tuple[str, str]]]:
    """The text with all groups that are UTF-8 in the page's bytes replaced, and the groups with their letters.

    Control signs are no letters, but where the result is read ``again`` they may be part of groups.
    """
    to_byte = _page(page)
    raw = bytes(ord(c) if c < "\x80" else to_byte.get(c, 0xFF) for c in text)
    out, units, at = [], [], 0
    for m in _UNIT.finditer(raw):
        letter = m[0].decode("utf-8", "replace")
        if len(letter) == 1 and unicodedata.category(letter)[0] not in "C" or letter == "\u00ad" or again and letter <= "\x9f":
            out += [text[at : m.start()], letter]
            units.append((text[m.start() : m.end()], letter))
            at = m.end()
    return "".join(out) + text[at:], units


@lru_cache(maxsize=256)
def _swap(page: str, wrote: str) -> dict[int, str]:
    """Sign to the letter that its byte is in the other page, where they differ."""
    out = {}
    for c, b in _page(page).items():
        try:
            d = codecs.decode(bytes([b]), wrote)
        except UnicodeDecodeError:
            continue
        if d != c:
            out[ord(c)] = d
    return out


@lru_cache(maxsize=1 << 10)
def letters_of(wrote: str, upper: bool) -> tuple[str, ...]:
    """Letters of one case that a page holds besides the Latin ones."""
    return tuple(c for c in _page(wrote) if c.isalpha() and c.isupper() == upper)


def _wide(token: str, page: str) -> dict[str, str]:
    """Readings of a token whose bytes are signs of two bytes each, of East Asian scripts only."""
    to_byte = _page(page)
    raw = bytes(ord(c) if c < "\x80" else to_byte.get(c, 0xFF) for c in token)
    out = {}
    for wrote in WIDE_PAGES:
        try:
            read = raw.decode(wrote)
        except UnicodeDecodeError:
            continue
        high = [c for c in read if c >= "\x80"]
        if 2 <= len(high) <= len(raw) // 2 and all(_symbol(c)[0] in "一あ가" for c in high):
            out[f"{page}>{wrote}"] = read
    return out


def _substituted(token: str, page: str, wrote: str, changes: dict[int, str]) -> str | None:
    """The token with its signs replaced, unless that leaves something that is no letter."""
    read = token.translate(_swap(page, wrote) | changes if changes else _swap(page, wrote))
    return read if read != token and all(c.isalpha() for c in read if c >= "\x80") else None


@lru_cache(maxsize=1 << 16)
def readings(token: str) -> dict[str, str]:
    """What the token may stand for under each cipher that changes it."""
    out: dict[str, str] = {}
    if token.isascii():
        return out
    for page in READ_PAGES:
        once, units = _once(token, page)
        if units:
            out[f"{page}>utf-8"] = once
        if page in READ_PAGES[:4]:
            inner, units = _once(token, page, again=True)
            if units:
                twice, more = max((_once(inner, second) for second in dict.fromkeys((page, "latin-1", "cp1252"))), key=lambda x: sum(len(u) for u, _ in x[1]))
                if more:
                    out[f"{page}>utf-8 twice"] = twice
    for page, written_as in single_ciphers(token):
        for wrote in written_as:
            if read := _substituted(token, page, wrote, {}):
                out[f"{page}>{wrote}"] = read
    high = [c for c in token if c >= "\x80"]
    if len(high) >= 3:
        for page in WIDE_READ:
            if all(c in _page(page) for c in high):
                out |= _wide(token, page)
    return out


def single_ciphers(token: str) -> list[tuple[str, tuple[str, ...]]]:
    """Pages that a token can have been read as byte by byte, each with the pages it can have been written in.

    A word wholly of other signs may be in any script. One with Latin letters beside them must hold a sign that is no
    letter, as one accent instead of another can't be told from proper text, and is read in Latin letters.
    """
    high = [c for c in token if c >= "\x80"]
    if any(c.isascii() and c.isalpha() for c in token):
        written_as = LATIN_PAGES if any(not c.isalpha() for c in high) else ()
    else:
        written_as = WRITTEN_PAGES if len(high) >= 2 else ()
    return [(page, tuple(w for w in written_as if w != page)) for page in SINGLE_PAGES if all(c in _page(page) for c in high)] if written_as else []


def is_learned(cipher: str) -> bool:
    """Whether the letters of a cipher are learned, sign by sign."""
    return cipher.partition(">")[2] in WRITTEN_PAGES


def is_lost(token: str) -> bool:
    """Whether signs in the token may replace letters that can't be restored."""
    return "\ufffd" in token or bool(_GAP.search(token))


@lru_cache(maxsize=1 << 16)
def _symbol(c: str) -> tuple[str, float]:
    """The sign counted for a character, and the logarithm of the character's share of it; proper text holds no control signs.

    Letters of the Latin, Greek, Cyrillic and Armenian scripts and signs up to the box drawings count each, so that
    there are at most a few thousand signs; of other scripts all letters count as one, and so do all other signs.
    """
    o = ord(c)
    if 0x80 <= o < 0xA0:
        return c, -12.0
    if 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0x20000 <= o < 0x33480:
        return "一", -8.0
    if 0x3040 <= o < 0x3100:
        return "あ", -4.5
    if 0xAC00 <= o < 0xD7B0:
        return "가", -7.0
    if o < 0x0590 or 0x1E00 <= o < 0x25A0:
        return c.lower()[:1], 0.0
    return (unicodedata.name(c, "?").split(" ")[0], -4.0) if c.isalpha() else ("☐", -7.0)


@lru_cache(maxsize=1 << 16)
def _kind(sign: str) -> str:
    """The kind of a sign: border, digit, ASCII letter, or the script of another letter; all else is a sign."""
    if sign in "^$" or not sign:
        return "^"
    if not sign.isalpha():
        return "digit" if sign.isdigit() else "sign"
    return "plain" if sign.isascii() else unicodedata.name(sign, "?").split(" ")[0]


def bigrams(text: str) -> list[tuple[str, str]]:
    """Neighbouring signs of a reading, with its borders."""
    signs = ["^", *(_symbol(c)[0] for c in text), "$"]
    return list(zip(signs, signs[1:]))


@dataclass(frozen=True)
class Profile:
    """What is learned of a source: how often each cipher occurs, and the letters that depart from its page."""

    total: float
    weights: dict[str, float]
    letters: dict[str, dict[int, str]]

    def share(self, cipher: str) -> float:
        return (self.weights.get(cipher, 0.0) + 0.1) / (self.total + 10) if self.weights else 1e-5

    def readings(self, token: str) -> dict[str, str]:
        """Readings by the learned letters."""
        out = readings(token)
        if not self.letters or token.isascii():
            return out
        out = dict(out)
        for page, written_as in single_ciphers(token):
            for wrote in written_as:
                changes = self.letters.get(f"{page}>{wrote}")
                if changes and not changes.keys().isdisjoint(map(ord, token)):
                    read = _substituted(token, page, wrote, changes)
                    out.pop(f"{page}>{wrote}", None)
                    if read:
                        out[f"{page}>{wrote}"] = read
        return out


@lru_cache(maxsize=1 << 12)
def profile(learned: str | None) -> Profile:
    """A source's profile from its text; nothing is known of a source without one."""
    held = json.loads(learned) if learned else {}
    letters = {c: {ord(x["sign"]): x["letter"] for x in held["letters"] if x["cipher"] == c} for c in {x["cipher"] for x in held["letters"]}} if held.get("letters") else {}
    return Profile(held.get("total", 0.0), held.get("weights") or {}, letters)


class Model:
    """Bigrams of the language."""

    def __init__(self, pairs: dict[tuple[str, str], float]) -> None:
        self.pairs = pairs
        self.first: dict[str, float] = defaultdict(float)
        self.second: dict[str, float] = defaultdict(float)
        for (a, b), n in pairs.items():
            self.first[a] += n
            self.second[b] += n
        self.total = sum(self.first.values()) or 1.0
        self.steps: dict[tuple[str, str], float] = defaultdict(float)
        self.steps_from: dict[str, float] = defaultdict(float)
        for (a, b), n in pairs.items():
            self.steps[_kind(a), _kind(b)] += n
            self.steps_from[_kind(a)] += n
        self.sizes = Counter(_kind(c) for c in self.second)
        self.known: dict[tuple[str | None, str, frozenset[str]], dict[str, float]] = {}
        self._hidden = [c for c in self.second if c > "\x7f"]

    def probability(self, a: str, b: str, less_pair: float = 0.0, less_first: float = 0.0, less_second: float = 0.0) -> float:
        n, of = self.pairs.get((a, b), 0.0) - less_pair, self.first.get(a, 0.0) - less_first
        single = max(self.second.get(b, 0.0) - less_second, 0.0) / self.total + _FLOOR
        x, y = _kind(a), _kind(b)
        step = max(self.steps.get((x, y), 0.0) - less_pair, 0.0) / (self.steps_from.get(x, 0.0) + 1.0) / max(self.sizes.get(y, 0), 30)
        rest = (1 - _KEPT - _SCRIPT) * single + _SCRIPT * step
        return _KEPT * max(n, 0.0) / of + rest if of > 1e-6 else rest

    def score(self, text: str, own: float = 0.0) -> float:
        """Log likelihood of a reading; ``own`` times the text's own bigrams are left out of the counts."""
        pairs = bigrams(text)
        value = sum(_symbol(c)[1] for c in text)
        if own:
            both, first, second = Counter(pairs), Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
            return value + sum(math.log(self.probability(a, b, own * both[a, b], own * first[a], own * second[b])) for a, b in pairs)
        return value + sum(math.log(self.probability(a, b)) for a, b in pairs)

    def score_lost(self, token: str, own: float) -> float:
        """Log likelihood of a token in which signs stand for unknown letters."""
        if "\ufffd" in token:
            return 0.0
        value, before = 0.0, "^"
        signs = [_symbol(c)[0] for c in token] + ["$"]
        for b in signs:
            if b == "?":
                value += math.log(0.5)
                before = ""
                continue
            if before:
                value += math.log(self.probability(before, b, own, own, own))
            else:
                reach = sum(self.probability(x, b) * self.second[x] for x in self._hidden)
                value += math.log(reach / self.total * 10 + _FLOOR)
            before = b
        return value

    def posterior(self, learned: str | None, token: str, n: float, beside: frozenset[str] = frozenset()) -> dict[str, float]:
        """Probability of each cipher, and of the literal reading, for a token that occurs n times in a source.

        Ciphers found ``beside`` it, in the same text, are as likely as not.
        """
        if (learned, token, beside) in self.known:
            return self.known[learned, token, beside]
        source = profile(learned)
        options = source.readings(token)
        lost = is_lost(token)
        if not options and not lost:
            return {LITERAL: 1.0}
        plain = plain_form(token)
        literal = self.score(plain, n)
        if in_latin(plain) != plain:
            literal = max(literal, self.score(in_latin(plain)) + math.log(_DISGUISED))
        logs = {LITERAL: literal}
        scores = {read: self.score(read, n) for read in set(options.values())}
        for key, read in options.items():
            logs[key] = scores[read] + math.log(0.5 if key in beside else source.share(key))
        if lost:
            logs[LOST] = self.score_lost(token, n) + math.log(source.share(LOST))
        most = max(logs.values())
        sums = {k: math.exp(v - most) for k, v in logs.items()}
        total = sum(sums.values())
        out = {k: v / total for k, v in sums.items()}
        if len(self.known) < 1 << 18:
            self.known[learned, token, beside] = out
        return out

    def evidence(self, cipher: str, token: str, read: str) -> list[tuple[str, str, bool, float]]:
        """(sign, letter, whether it is the page's, weight) for each sign of a token, by its neighbours in the reading."""
        page, _, wrote = cipher.partition(">")
        out = []
        signs = ["^", *(_symbol(c)[0] for c in read), "$"]
        for k, sign in enumerate(token):
            if sign < "\x80":
                continue
            own = _swap(page, wrote).get(ord(sign), sign)
            likely = {d: self.probability(signs[k], _symbol(d)[0]) * self.probability(_symbol(d)[0], signs[k + 2]) for d in dict.fromkeys((own, *letters_of(wrote, own.isupper())))}
            total = sum(likely.values())
            out += [(sign, d, d == own, w / total) for d, w in likely.items() if w > 0.02 * total or d == own]
        return out

    def ciphers(self, learned: str | None, text: str) -> frozenset[str]:
        """Ciphers that the garbled tokens of a text are most probably written in."""
        out = set()
        for token in _TOKEN.findall(text):
            if not token.isascii():
                weights = self.posterior(learned, token, 1.0)
                key = max(weights, key=weights.get)
                if key not in (LITERAL, LOST):
                    out.add(key)
        return frozenset(out)

    def best(self, learned: str | None, token: str, n: float = 1.0, beside: frozenset[str] = frozenset()) -> tuple[str, str]:
        """State of a token, and what it stands for: the reading of the largest probability summed over ciphers."""
        weights = self.posterior(learned, token, n, beside)
        options = profile(learned).readings(token)
        by_text: dict[str, float] = defaultdict(float)
        for key, w in weights.items():
            if key not in (LITERAL, LOST):
                by_text[options[key]] += w
        text, weight = max(by_text.items(), key=lambda x: x[1], default=("", 0.0))
        garbled = 1 - weights.get(LITERAL, 0.0)
        if garbled <= 0.5:
            return LITERAL, token
        return ("restored", text) if weight >= weights.get(LOST, 0.0) else (LOST, token)


@dataclass(frozen=True)
class Learned:
    """The language's bigrams, and (source, learned) of the sources of which something is known."""

    model: Model
    profiles: DataFrame | None


def _first_weight(token: str) -> float:
    """Trust in the literal reading before anything is learned."""
    high = sum(c >= "\x80" for c in token)
    if is_lost(token) or any(k.partition(">")[2].startswith("utf-8") for k in readings(token)):
        return 0.0
    return 0.0 if high >= 3 and high > 0.6 * len(token) and all(ord(c) < 0x180 or not c.isalpha() for c in token) else 1.0


def _tokens(values: DataFrame) -> DataFrame:
    """(source, token, n) of all texts."""
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("token", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for token in _TOKEN.findall(text):
                    counts[source, token] += 1
            if len(counts) > 1 << 18:
                yield _counted(counts)
                counts.clear()
        if counts:
            yield _counted(counts)

    def _counted(counts: Counter[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in counts]), pa.array([t for _, t in counts]), pa.array(list(counts.values()), type=pa.int64())], names=["source", "token", "n"])

    return values.select("source", "text").mapInArrow(run, schema).groupBy("source", "token").agg(F.sum("n").alias("n"))


_PAIR, _SHARE, _LETTER, _PAGE_LETTER = range(4)


def _with_profiles(rows: DataFrame, learned: Learned) -> DataFrame:
    """Adds what is learned of each row's source; few sources are sent to all tasks by Spark, many are joined."""
    return rows.withColumn("learned", F.lit(None).cast("string")) if learned.profiles is None else rows.join(learned.profiles, "source", "left")


def _round(tokens: DataFrame, before: Learned | None) -> Learned:
    """One round: weights of the readings by what is learned so far, and from these what is learned next."""
    held = tokens.sparkSession.sparkContext.broadcast(pickle.dumps(before and before.model))
    names = ("source", "a", "b", "c")
    schema = T.StructType([T.StructField("kind", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in names), T.StructField("w", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = pickle.loads(held.value)
        sums: dict[tuple[int, str, str, str, str], float] = defaultdict(float)
        for batch in batches:
            for source, token, n, learned in zip(*(c.to_pylist() for c in batch.columns)):
                weights = {LITERAL: _first_weight(token)} if now is None else now.posterior(learned, token, n)
                options = {} if len(weights) == 1 else profile(learned).readings(token)
                for key, w in weights.items():
                    if w > 1e-4:
                        sums[_SHARE, source, key, "", ""] += w * n
                        if key != LOST and not is_learned(key):  # letters that are still to be learned tell nothing of the language
                            for a, b in bigrams(plain_form(token) if key == LITERAL else options[key]):
                                sums[_PAIR, "", a, b, ""] += w * n
                        if w > 0.1 and is_learned(key):
                            for sign, letter, of_page, likely in now.evidence(key, token, options[key]):
                                sums[_PAGE_LETTER if of_page else _LETTER, source, key, sign, letter] += w * n * likely
            if len(sums) > 1 << 19:
                yield _summed(sums)
                sums.clear()
        if sums:
            yield _summed(sums)

    def _summed(sums: dict[tuple[int, str, str, str, str], float]) -> pa.RecordBatch:
        columns = [pa.array([k[0] for k in sums], type=pa.int32()), *(pa.array([k[i] for k in sums], type=pa.string()) for i in range(1, 5))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(sums.values()), type=pa.float64())], names=schema.names)

    asked = _with_profiles(tokens, before or Learned(Model({}), None)).select("source", "token", "n", "learned")
    sums = written(asked.mapInArrow(run, schema).groupBy("kind", *names).agg(F.sum("w").alias("w")), "garbled-sums")
    pairs = {(r.a, r.b): r.w for r in sums.where(F.col("kind") == _PAIR).collect()}  # at most the square of the signs that _symbol tells apart
    if before is None:
        return Learned(Model(pairs), None)
    shares = sums.where(F.col("kind") == _SHARE).groupBy("source").agg(F.sum("w").alias("total"), F.map_from_entries(F.collect_list(F.when(F.col("a") != LITERAL, F.struct("a", "w")))).alias("weights"))
    counted = F.col("w") + F.when(F.col("kind") == _PAGE_LETTER, PAGE_LETTER).otherwise(0.0)
    by_letter = sums.where(F.col("kind").isin(_LETTER, _PAGE_LETTER)).select("source", "a", "b", "c", (F.col("kind") == _PAGE_LETTER).alias("of_page"), counted.alias("w"))
    emitted = F.col("w") / F.sum("w").over(Window.partitionBy("source", "a", "c"))  # of a letter's occurrences, those that are this sign; a group has as many rows as the page has signs
    chosen = by_letter.withColumn("fit", F.col("w") * emitted).groupBy("source", "a", "b").agg(F.max_by(F.struct("c", "of_page"), "fit").alias("best")).where("not best.of_page")
    letters = chosen.groupBy("source").agg(F.collect_list(F.struct(F.col("a").alias("cipher"), F.col("b").alias("sign"), F.col("best.c").alias("letter"))).alias("letters"))
    profiles = shares.join(letters, "source", "left").select("source", F.to_json(F.struct("total", "weights", "letters")).alias("learned"))
    return Learned(Model(pairs), written(profiles, "garbled-profiles"))


def _named(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(""))


def learn(values: DataFrame, source_col: str = "source", text_col: str = "text", rounds: int = ROUNDS) -> Learned:
    """Bigrams, ciphers and their letters from all texts; null texts are left out, repeated ones count again, a null source is named ""."""
    named = values.where(F.col(text_col).isNotNull()).select(_named(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    tokens = written(_tokens(named), "garbled-tokens")
    learned = None
    for _ in range(rounds + 1):
        learned = _round(tokens, learned)
    return learned


def repair(values: DataFrame, learned: Learned, keep: list[str], source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The garbled ones among the values: (*keep, garbled, restored, state).

    state is restored, partly (some of it is lost) or lost; restored holds the text with what could be restored. Rows
    whose text is null, empty or proper in any script don't come out; repeated rows come out each; long texts are
    handled whole. keep: columns to pass on; columns named like the new ones aren't allowed among them.
    """
    held = values.sparkSession.sparkContext.broadcast(pickle.dumps(learned.model))
    schema = T.StructType([*(values.schema[c] for c in keep), T.StructField("garbled", T.StringType()), T.StructField("restored", T.StringType()), T.StructField("state", T.StringType()), T.StructField("doubtful", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = pickle.loads(held.value)
        for batch in batches:
            rows, garbled, restored, states, doubts = [], [], [], [], []
            for k, (source, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                found, doubt = set(), []
                beside = now.ciphers(source, text)

                def read(m: re.Match[str], source: str | None = source, found: set[str] = found, doubt: list[str] = doubt, beside: frozenset[str] = beside) -> str:
                    if m[0].isascii() and "?" not in m[0]:
                        return m[0]
                    state, out = now.best(source, m[0], beside=beside)
                    if state == LOST and _LAST_GAP.fullmatch(m[0]):
                        doubt.append(m[0][:-1].lower())
                    else:
                        found.add(state)
                    return out

                out = _TOKEN.sub(read, text)
                if found - {LITERAL} or doubt:
                    doubts.append([] if found - {LITERAL} else doubt)
                    found |= {LOST} if doubt else set()
                    rows.append(k)
                    garbled.append(text)
                    restored.append(out)
                    states.append("lost" if "restored" not in found else "partly" if LOST in found else "restored")
            if rows:
                kept = batch.select(list(range(2, batch.num_columns))).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(garbled), pa.array(restored), pa.array(states), pa.array(doubts, type=pa.list_(pa.string()))], names=schema.names)

    suspicious = values.where(F.col(text_col).rlike(r"[^\x00-\x7f]|\?")).withColumn("_source", _named(F.col(source_col))).select(F.col("_source").alias("source"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    asked_of = _with_profiles(suspicious, learned).select("learned", "_text", *(F.col(f"_keep_{c}").alias(c) for c in keep))
    found = written(asked_of.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "garbled-found")
    # A question mark may just end a word. It stands for a letter where the corpus holds the word with another letter
    # there, one that isn't ASCII, but not the word without it.
    asked = found.select(F.explode("doubtful").alias("word")).distinct()
    split = r"[\x00-\x20!-/:-@\[-`{-~]+"
    words = values.where(~F.col(text_col).contains("?")).select(F.explode(F.split(F.lower(F.col(text_col)), split)).alias("word"))
    longer = words.where(F.col("word").rlike(r"[^\x00-\x7f]$")).select(F.expr("left(word, length(word) - 1)").alias("word"))
    plain, completed = (w.join(asked, "word", "left_semi").distinct() for w in (words, longer))
    lost = completed.join(plain, "word", "left_anti").withColumn("_lost", F.lit(1))
    cleared = found.select("_row", F.explode("doubtful").alias("word")).distinct().join(lost, "word", "left").groupBy("_row").agg(F.count("_lost").alias("n_lost")).where("n_lost = 0").select("_row")
    return found.join(cleared, "_row", "left_anti").drop("_row", "doubtful")
