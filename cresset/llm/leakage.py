"""Held-out test items inside a training corpus.

The items, not the corpus, are indexed: a BM25 inverted index with block maxima, made in parts of bounded size by
statistics of all items. The corpus is read once, and every passage of every text queries all parts by WAND. An item's threshold is the least score that any run of
``span`` of its words can reach, so that no leak scores below; what scores above is compared word by word.
"""

from __future__ import annotations

import atexit
import math
import pickle
import shutil
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cresset.llm import _chars as C
from cresset.sources.workspace import written

#: Bytes of item text that are indexed in one part; a worker holds one part at a time.
INDEX_BYTES = 8 << 20
#: Bytes of texts that are searched at once, and that a worker keeps while it goes through several parts.
_BATCH, _KEPT = 1 << 20, 32 << 20


def word_ranges(points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters and digits, none across two texts."""
    n = len(points)
    kind = C.classes()[points]
    inside = (kind == C.LETTER) | (kind == C.NUMBER)
    border = np.zeros(n + 1, dtype=bool)
    border[np.cumsum(lengths)] = True
    border[0] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:n]
    ends[:-1] &= ~inside[1:] | border[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words_of(text: str) -> list[str]:
    """The words of one text in lower case."""
    points, lengths = C.code_points([text])
    return [text[a:b].lower() for a, b in zip(*word_ranges(points, lengths))] if len(points) else []


@dataclass(frozen=True)
class Statistics:
    """Number and mean length of all items, and the number of those that each word is in."""

    items: int
    mean: float
    found: dict[str, int]

    @staticmethod
    def of(words: list[list[str]]) -> Statistics:
        found: dict[str, int] = defaultdict(int)
        for ws in words:
            for w in set(ws):
                found[w] += 1
        return Statistics(len(words), sum(map(len, words)) / max(1, len(words)) or 1.0, found)


class ItemIndex:
    """BM25 postings of items in blocks of neighbours, with the largest weight of each term in each block."""

    def __init__(self, items: list[tuple[object, str]], span: int, block: int = 0, k1: float = 1.2, b: float = 0.75, statistics: Statistics | None = None) -> None:
        block = block or max(32, -(-len(items) // 64))
        self.ids, self.span, self.block = [i for i, _ in items], span, block
        words = [words_of(t or "") for _, t in items]
        self.terms: dict[str, int] = {}
        rows = [[self.terms.setdefault(w, len(self.terms)) for w in ws] for ws in words]
        of_all = statistics or Statistics.of(words)
        mean = of_all.mean
        found = np.array([of_all.found[w] for w in self.terms], dtype=float)
        idf = np.log1p((of_all.items - found + 0.5) / (found + 0.5))
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.grams: list[set[tuple[int, ...]]] = []
        self.need = np.full(len(rows), np.inf)
        for item, row in enumerate(rows):
            weight = {t: idf[t] * n * (k1 + 1) / (n + k1 * (1 - b + b * len(row) / mean)) for t, n in _counted(row).items()}
            for t, w in weight.items():
                postings[t].append((item, float(w)))
            grams = {tuple(row[k : k + span]) for k in range(len(row) - span + 1)}
            self.grams.append(grams)
            if grams:
                self.need[item] = min(math.fsum(weight[t] for t in set(g)) for g in grams) * (1 - 1e-9)
        self.least = float(self.need.min()) if len(rows) else math.inf
        self.least_of = [float(self.need[k : k + block].min()) for k in range(0, len(rows), block)]
        self.postings = {t: ([i for i, _ in p], [w for _, w in p]) for t, p in postings.items()}
        self.top = np.zeros(len(self.terms) + 1)  # the last is for words of no item
        self.block_top: dict[int, dict[int, float]] = {}
        for t, p in postings.items():
            self.top[t] = max(w for _, w in p)
            self.block_top[t] = best = {}
            for i, w in p:
                best[i // block] = max(best.get(i // block, 0.0), w)
        # the same as arrays: the blocks of a term and its largest weights there lie between its two starts
        sizes = [len(self.block_top[t]) if t in self.block_top else 0 for t in range(len(self.terms) + 1)]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        held = [x for t in range(len(self.terms)) for x in self.block_top.get(t, {}).items()]
        self.part_of, self.part_top = np.array([k for k, _ in held], dtype=np.int64), np.array([w for _, w in held])

    def above(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items whose score for a query of distinct terms reaches their threshold, with the score."""
        cursors = [[0, *self.postings[t], float(self.top[t]), self.block_top[t]] for t in terms]
        out: list[tuple[int, float]] = []
        while cursors:
            cursors.sort(key=lambda c: c[1][c[0]])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= self.least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][1][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]] == item:
                pivot += 1
            part = item // self.block
            if sum(c[4].get(part, 0.0) for c in cursors[: pivot + 1]) < self.least_of[part]:
                to = (part + 1) * self.block
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][1][cursors[pivot + 1][0]])
                moved = cursors[: pivot + 1]
            elif cursors[0][1][cursors[0][0]] == item:
                moved, to = cursors[: pivot + 1], item + 1
                score = math.fsum(c[2][c[0]] for c in moved)
                if score >= self.need[item]:
                    out.append((item, score))
            else:
                moved, to = cursors[:pivot], item
            for c in moved:
                while c[0] < len(c[1]) and c[1][c[0]] < to:
                    c[0] += 1
            cursors = [c for c in cursors if c[0] < len(c[1])]
        return out


def _counted(row: list[int]) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for t in row:
        out[t] += 1
    return out


def _reaching(index: ItemIndex, terms: np.ndarray, first: np.ndarray, stop: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Those of the passages whose distinct terms can reach a threshold of some block of items."""
    if not len(among):
        return among
    at = first[among, None] + np.arange(int((stop - first)[among].max()))
    words = np.where(at < stop[among, None], terms[np.minimum(at, len(terms) - 1)], len(index.terms))
    words.sort(axis=1)
    words[:, 1:][words[:, 1:] == words[:, :-1]] = len(index.terms)
    counts = (index.starts[1:] - index.starts[:-1])[words].ravel()
    entry = np.repeat(index.starts[words.ravel()] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    blocks = len(index.least_of)
    passage = np.repeat(np.repeat(np.arange(len(among)), words.shape[1]), counts)
    sums = np.bincount(passage * blocks + index.part_of[entry], index.part_top[entry], len(among) * blocks).reshape(-1, blocks)
    return among[(sums >= np.array(index.least_of) * (1 - 1e-6)).any(axis=1)]


def leaks_in(index: ItemIndex, texts: list[str | None]) -> list[tuple[int, int, float]]:
    """(text, item, best score of a passage that holds a run of the item) for a batch of texts."""
    points, lengths = C.code_points([t or "" for t in texts])
    if not len(points) or not math.isfinite(index.least):
        return []
    begins, ends = word_ranges(points, lengths)
    if not len(begins):
        return []
    coded = C.slices_of_words(points, begins, ends).dictionary_encode()
    none = len(index.terms)
    known = np.array([index.terms.get(w.decode("utf-8", "surrogatepass").lower(), none) for w in coded.dictionary.to_pylist()], dtype=np.int64)
    terms = known[coded.indices.to_numpy(zero_copy_only=False)]
    until = np.searchsorted(begins, np.cumsum(lengths))
    since = np.concatenate([[0], until[:-1]])
    size = 2 * index.span
    step = size - index.span + 1  # every run of a text lies in one passage
    many = np.where(until - since >= index.span, -(-(until - since - index.span + 1) // step), 0)
    of = np.repeat(np.arange(len(texts)), many)
    first = since[of] + (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * step
    stop = np.minimum(first + size, until[of])
    most = np.concatenate([[0.0], np.cumsum(index.top[terms])])
    best: dict[tuple[int, int], float] = {}
    for k in _reaching(index, terms, first, stop, np.flatnonzero(most[stop] - most[first] >= index.least * (1 - 1e-6))):
        passage = terms[first[k] : stop[k]].tolist()
        for item, score in index.above([t for t in dict.fromkeys(passage) if t != none]):
            grams = index.grams[item]
            if any(tuple(passage[j : j + index.span]) in grams for j in range(len(passage) - index.span + 1)):
                key = (int(of[k]), item)
                best[key] = max(best.get(key, 0.0), score)
    return [(d, i, s) for (d, i), s in best.items()]


def leaked_items(docs: DataFrame, items: DataFrame, span: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Documents that hold ``span`` or more consecutive words of an item: (id_col, item_col, score).

    Words are runs of letters and digits in lower case. One row for each pair of ids, with the best BM25 score of a
    passage; repeated rows of either table add nothing. Null and empty texts hold nothing, items of fewer words than
    ``span`` leak nowhere, null ids are kept as ids; empty tables give an empty table; other columns aren't read.
    The score doesn't depend on ``index_bytes``: items of more text are indexed in several parts by the statistics of
    all of them, which every worker goes through for each portion of its texts, so that the corpus is read once.
    """
    out_id, out_item = docs.schema[id_col], items.schema[item_col]
    named = item_col if item_col != id_col else f"{item_col}_item"
    schema = T.StructType([T.StructField(id_col, out_id.dataType), T.StructField(named, out_item.dataType), T.StructField("score", T.DoubleType())])
    texts = items.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).where("t is not null")
    load, parts = _shipped(docs.sparkSession, texts, span, index_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_type = _arrow(out_item.dataType)
        order = list(range(parts))
        held: tuple[int, ItemIndex] | None = None
        for portion in _portions(batches, _KEPT if parts > 1 else 0):
            for part in order:
                held = held if held and held[0] == part else (part, load(part))
                for ids, column in portion:
                    found = leaks_in(held[1], column.to_pylist())
                    if found:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([d for d, _, _ in found])), pa.array([held[1].ids[i] for _, i, _ in found], type=item_type), pa.array([s for _, _, s in found], type=pa.float64())], names=[id_col, named, "score"])
            order.reverse()  # the part at hand comes first for the next portion

    return docs.select(id_col, text_col).mapInArrow(run, schema).groupBy(id_col, named).agg(F.max("score").alias("score"))


def _portions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[pa.Array, pa.Array]]]:
    """Ids and texts in pieces to be searched at once, as many of them together as have ``size`` bytes."""
    held: list[tuple[pa.Array, pa.Array]] = []
    total = 0
    for batch in batches:
        column = batch.column(1)
        for a, b in C.groups(C.text_sizes(column), _BATCH):
            piece = (batch.column(0).slice(a, b - a), column.slice(a, b - a))
            held.append(piece)
            total += piece[1].nbytes
            if total > size:
                yield held
                held, total = [], 0
    if held:
        yield held


def _shipped(spark: SparkSession, texts: DataFrame, span: int, index_bytes: int):  # noqa: ANN202
    """A function that loads a part of the index in a task, and the number of parts.

    One part is broadcast. Several are files that Spark brings to each executor, as they are too large together to be
    held in memory; the driver makes one after the other.
    """
    total = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, math.ceil(total / index_bytes))
    if parts == 1:
        held = spark.sparkContext.broadcast(pickle.dumps(ItemIndex([(r.i, r.t) for r in texts.collect()], span)))  # at most index_bytes of text
        return lambda part: pickle.loads(held.value), 1
    placed = texts.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts)).cast("int"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, len(ws), sorted(set(ws))) for p, ws in zip(batch.column(0).to_pylist(), map(words_of, batch.column(1).to_pylist()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=t) for c, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.string())))], names=["part", "n", "words"])

    counted = written(placed.select("part", "t").mapInArrow(words, "part int, n long, words array<string>"), "leak-words")
    sums = counted.agg(F.count("*").alias("items"), F.sum("n").alias("n")).first()
    each = counted.select("part", F.explode("words").alias("word"))
    found = written(each.groupBy("word").agg(F.count("*").alias("found")), "leak-found")
    folder, name = Path(tempfile.mkdtemp(prefix="cresset-")), uuid.uuid4().hex
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    for part in range(parts):
        own = found.join(each.where(F.col("part") == part).select("word").distinct(), "word", "left_semi").collect()  # as many words as a part's items have
        rows = [(r.i, r.t) for r in placed.where(F.col("part") == part).collect()]
        statistics = Statistics(sums.items, sums.n / sums.items or 1.0, {r.word: r.found for r in own})
        path = folder / f"{name}-{part}"
        path.write_bytes(pickle.dumps(ItemIndex(rows, span, statistics=statistics)))
        spark.sparkContext.addFile(str(path))
    return lambda part: pickle.loads(Path(SparkFiles.get(f"{name}-{part}")).read_bytes()), parts


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
