"""Encoding of a corpus with a byte-level BPE vocabulary, without learning anything.

Each batch of texts is cut into words by character class, its distinct words are walked in sorted order, which
is the depth-first order of their trie, and the last token of every prefix is carried down the path: the
encoding of a prefix shared by many words is found once. The rows need no shuffle, as a word's ids depend on
the vocabulary only.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cresset.llm import _chars as C

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text taken at once, and longest piece of a text where a safe cut exists.
_BATCH, _PIECE = 1 << 20, 1 << 22
#: Words, and pairs of tokens, that a Python worker remembers; beyond it starts anew.
_REMEMBERED = 1 << 19

# The endings that a word leaves to a token of their own.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class TrieEncoder:
    """Ids of words by propagating the last token of each prefix down their trie.

    A token may follow the last token of a prefix if no merge across their border comes before the merges that
    make the two; exactly one of the tokens that end a prefix does so.
    """

    def __init__(self, vocabulary: bytes) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.token = {i: t for t, i in self.rank.items()}
        self.longest = [0] * 256  # of the tokens that end in a byte
        for t in self.rank:
            self.longest[t[-1]] = max(self.longest[t[-1]], len(t))
        self._parts: dict[bytes, tuple[bytes, bytes]] = {}
        self._right: dict[bytes, list[bytes]] = {}
        self._left: dict[bytes, list[bytes]] = {}
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[bytes, np.ndarray] = {}

    def _split(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens whose merge makes this one."""
        if token not in self._parts:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                ranks = [self.rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
                k = min(range(len(ranks)), key=ranks.__getitem__)
                if ranks[k] >= self.rank[token]:  # no merges lead to it
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self._parts[token] = (parts[0], parts[1]) if len(parts) == 2 else (b"", b"")
        return self._parts[token]

    def _chain(self, token: bytes, side: int, known: dict[bytes, list[bytes]]) -> list[bytes]:
        """The pieces at one side of a token, from a byte to the whole."""
        if token not in known:
            out, piece = [token], token
            while len(piece) > 1 and (piece := self._split(piece)[side]):
                out.append(piece)
            known[token] = out[::-1]
        return known[token]

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether the tokens a, b stay two tokens when their bytes are encoded together."""
        if (a, b) not in self._fits:
            if len(self._fits) > _REMEMBERED:
                self._fits.clear()
            self._fits[a, b] = self._stay(self._chain(a, 1, self._right), self._chain(b, 0, self._left))
        return self._fits[a, b]

    def _stay(self, xs: list[bytes], ys: list[bytes]) -> bool:
        i = j = 0
        never = 1 << 60
        while True:
            across = self.rank.get(xs[i] + ys[j], never)
            left = self.rank[xs[i + 1]] if i + 1 < len(xs) else never
            right = self.rank[ys[j + 1]] if j + 1 < len(ys) else never
            if across < left and across <= right:
                return False
            if left == right == never:
                return True
            if left <= right:
                i += 1
            else:
                j += 1

    def encode(self, words: list[bytes]) -> None:
        """Adds the ids of distinct words to ``self.words``."""
        rank, longest, fits = self.rank, self.longest, self.fits
        last: list[bytes] = [b""]
        before = b""
        for word in sorted(words):
            if word in rank:  # also reached by the walk, but its end is known
                self.words[word] = np.array([rank[word]], dtype=np.int32)
                continue
            shared, most = 0, min(len(word), len(before), len(last) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest[word[end - 1]]), end):
                    token = word[start:end]
                    if token in rank and (not start or fits(last[start], token)):
                        last.append(token)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            before, ids, end = word, [], len(word)
            while end:
                ids.append(rank[last[end]])
                end -= len(last[end])
            self.words[word] = np.array(ids[::-1], dtype=np.int32)


def word_starts(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices where the words of the texts begin: letters, numbers, other signs, each with one space before it, the
    rest of white space, and English endings behind an apostrophe."""
    n = len(points)
    kind = C.classes()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[np.cumsum(lengths)] = True  # behind each text
    first[0] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    space = kind == C.SPACE
    gives = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])  # the last of white space, before something else
    start[gives] = True
    start[gives[points[gives] == 0x20] + 1] = False
    for i in np.flatnonzero((points == 0x27) & start[:n]):
        stop = i + 1
        while stop < min(i + 3, n) and not first[stop] and points[stop] < 128:
            stop += 1
        tail = "".join(map(chr, points[i + 1 : stop]))
        end = next((e for e in _ENDINGS if tail.startswith(e)), None)
        if end:
            start[i + 1] = False
            if len(end) == 2:
                start[i + 2] = False
            if i + 1 + len(end) < n:
                start[i + 1 + len(end)] = True
    return np.flatnonzero(start[:n])


def _pieces(text: str) -> list[str]:
    """A very long text in pieces, cut before a space between other signs and a letter."""
    out, begin = [], 0
    while len(text) - begin > _PIECE:
        at = begin + _PIECE // 2
        while (at := text.find(" ", at)) > 0 and not (at + 1 < len(text) and text[at + 1].isalpha() and not text[at - 1].isspace()):
            at += 1
        if at <= 0:
            break
        out.append(text[begin:at])
        begin = at
    return [*out, text[begin:]]


def encode_texts(encoder: TrieEncoder, texts: list[str | None]) -> pa.Array:
    """List array of the ids of each text; null and empty texts have an empty list."""
    parts = [_pieces(t or "") for t in texts]
    per = np.array([len(p) for p in parts], dtype=np.int64)
    flat = [x for p in parts for x in p]
    points, lengths = C.code_points(flat)
    if not len(points):
        return pa.array([[]] * len(texts), type=pa.list_(pa.int32()))
    starts = word_starts(points, lengths)
    words = C.slices_of_words(points, starts, np.append(starts[1:], len(points))).dictionary_encode()
    distinct = words.dictionary.to_pylist()
    if len(encoder.words) > _REMEMBERED:
        encoder.words.clear()
    encoder.encode([w for w in distinct if w not in encoder.words])
    ids = [encoder.words[w] for w in distinct]
    size = np.array([len(x) for x in ids], dtype=np.int64)
    begin = np.cumsum(size) - size
    index = words.indices.to_numpy(zero_copy_only=False)
    many = size[index]
    ends = np.cumsum(many)
    values = np.concatenate(ids)[np.repeat(begin[index] - (ends - many), many) + np.arange(ends[-1])]
    behind = np.searchsorted(starts, np.cumsum(lengths))  # words up to the end of each piece
    total = np.concatenate([[0], ends])[np.concatenate([[0], behind])][np.concatenate([[0], np.cumsum(per)])]
    return pa.ListArray.from_arrays(pa.array(total, type=pa.int32()), pa.array(values, type=pa.int32()))


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """Token ids of every text, unchanged and without special tokens.

    docs: one row in, one row out with ``id_col`` (any type, may repeat) and ``out_col`` (array<int>). Null and empty
    texts give an empty list; repeated rows are encoded each; other columns, also one named like ``out_col``, are left
    out; an empty table gives an empty table. tokenizer: a vocabulary of ranks, read by the driver; its size is that
    of the vocabulary and doesn't depend on the data.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    field = docs.schema[id_col]
    schema = T.StructType([T.StructField(id_col, field.dataType), T.StructField(out_col, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            for a, b in C.groups(C.text_sizes(texts), _BATCH):
                ids = encode_texts(encoder, texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=[id_col, out_col])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


_ENCODERS: dict[int, TrieEncoder] = {}


def _encoder(vocabulary) -> TrieEncoder:  # noqa: ANN001
    """One encoder for each vocabulary and Python worker, kept between tasks."""
    data = vocabulary.value
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TrieEncoder(data)
    return _ENCODERS[key]
