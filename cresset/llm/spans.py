"""Long spans that stand verbatim in several texts.

Of each text only the k-mers at minimizers are taken: the position of the least hash of every window of starts.
Window and k-mer together are as long as the wanted span, so that a shared span holds a shared k-mer. These are the
edges of a de Bruijn graph in which one k-mer follows another if it comes next in a text. Edges found in one text
only are dropped, and paths without branches compact to one edge. What lies at and beside the occurrences of the paths
that several texts hold is then cut out of the texts, in one pass. A path as long as the span settles the texts that
have the same SHA-256 of its text; shorter ones are extended by their texts to both sides. Where a short path has many
occurrences these are split by all windows of the wanted length around it, whose groups then share the span, instead
of being compared pair by pair.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cresset.llm import _chars as C
from cresset.sources.workspace import written

SPAN, WINDOW, GRAM = 400, 128, 24
#: Occurrences of a short path that are compared in pairs; more are split by windows of the span.
IN_PAIRS = 32
#: Pairs that one task makes of one group.
_PER_SALT = 2000
_BATCH, _PIECE = 1 << 18, 1 << 22
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE, dtype=np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hashes:
    """Hashes of any substring of some code points by their prefix sums, a polynomial modulo 2^64."""

    def __init__(self, points: np.ndarray) -> None:
        n = 1 << max(16, int(len(points)).bit_length())
        up, self.down = _powers(n)
        self.sums = np.zeros(len(points) + 1, dtype=np.uint64)
        mixed = (points.astype(np.uint64) + np.uint64(0x5851F42D)) * _MIX
        mixed ^= mixed >> np.uint64(31)
        mixed *= up[: len(points)]
        np.cumsum(mixed, out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.sums[starts + length] - self.sums[starts]) * self.down[starts])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


def _least(keys: np.ndarray, window: int) -> np.ndarray:
    """Least value of every ``window`` neighbours, from running minima of blocks in both directions."""
    n = len(keys)
    padded = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - window + 1], ahead[window - 1 : n])


def minimizers(grams: np.ndarray, window: int, last: np.ndarray) -> np.ndarray:
    """Positions that hold the least hash of some window, the first of equal ones. Windows that begin behind their ``last`` start don't count.

    A position is least in a window if it equals the largest of the least values of the windows it lies in. Where the
    one before has the same value, it is the first in none but the windows that begin between the two.
    """
    low = _least(grams, window)
    low[np.arange(len(low)) > last] = 0
    around = np.zeros(len(grams) + window, dtype=np.uint64)
    around[window - 1 : window - 1 + len(low)] = low
    at = np.flatnonzero(grams == ~_least(~around[:-1], window))
    same = np.flatnonzero((grams[at[1:]] == grams[at[:-1]]) & (at[1:] - at[:-1] < window)) + 1
    if len(same):
        held = np.append(around[window - 1 :], np.zeros(window + 1, dtype=np.uint64))
        bounds = np.stack([at[same - 1] + 1, at[same] + 1], axis=1).ravel()
        first = np.maximum.reduceat(held, bounds)[::2] == grams[at[same]]
        at = np.delete(at, same[~first])
    return at


def anchors(points: np.ndarray, lengths: np.ndarray, span: int = SPAN, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, position and k-mer hash of the minimizers of texts that lie one behind another in ``points``."""
    none = np.zeros(0, dtype=np.int64)
    if len(points) < span:
        return none, none, none.astype(np.uint64)
    hashes = Hashes(points)
    grams = hashes.all(gram)
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    at = minimizers(grams, window, ends[text[: len(grams) - window + 1]] - (window + gram - 1))
    kmer = span - window + 1
    at = at[at + kmer <= ends[text[at]]]
    return text[at], at - (ends - lengths)[text[at]], hashes.at(at, kmer)


def _anchor_rows(texts: list[str | None], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a batch; very long texts in overlapping pieces."""
    cuts = [(i, s) for i, t in enumerate(texts) if t and len(t) >= span for s in range(0, max(1, len(t) - span + 1), _PIECE)]
    parts = [texts[i][s : s + _PIECE + 2 * span] for i, s in cuts]
    points, lengths = C.code_points(parts)
    part, at, kmer = anchors(points, lengths, span)
    owner, shift = np.array([i for i, _ in cuts], dtype=np.int64), np.array([s for _, s in cuts], dtype=np.int64)
    text, at = owner[part], at + shift[part]
    if len(cuts) > len(set(owner.tolist())):
        _, keep = np.unique(np.stack([text, at]), axis=1, return_index=True)
        text, at, kmer = text[keep], at[keep], kmer[keep]
    return text, at, kmer


def _kmers(docs: DataFrame, span: int) -> DataFrame:
    """(kmer, id, pos, ord) of every text; ord counts the anchors of a text."""
    schema = T.StructType([T.StructField("kmer", T.LongType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("pos", T.IntegerType()), T.StructField("ord", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for a, b in C.groups(C.text_sizes(column), _BATCH):
                text, at, kmer = _anchor_rows(column.slice(a, b - a).to_pylist(), span)
                if len(text):
                    new = np.concatenate([[True], text[1:] != text[:-1]])
                    order = np.arange(len(text)) - np.maximum.accumulate(np.where(new, np.arange(len(text)), 0))
                    yield pa.RecordBatch.from_arrays([pa.array(kmer.view(np.int64)), batch.column(0).slice(a, b - a).take(pa.array(text)), pa.array(at.astype(np.int32)), pa.array(order.astype(np.int32))], names=schema.names)

    return docs.select("id", "text").mapInArrow(run, schema)


def _paths(docs: DataFrame, span: int) -> DataFrame:
    """Occurrences of compacted paths: (path, id, start, size); the text at start of that size is equal in all of them."""
    kmers = written(_kmers(docs, span), "span-kmers")
    repeated = kmers.groupBy("kmer").agg(F.count("*").alias("n")).where("n > 1").select("kmer")
    edges = written(kmers.join(repeated, "kmer", "left_semi"), "span-edges")
    along = Window.partitionBy("id").orderBy("pos")
    next_to = lambda name, step: F.when(F.abs(F.lag("ord", step).over(along) - F.col("ord")) == 1, F.lag(name, step).over(along))
    chained = edges.withColumns({"before": next_to("kmer", 1), "after": next_to("kmer", -1)})
    only = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    nodes = chained.groupBy("kmer").agg(only("before").alias("sole_before"), only("after").alias("sole_after"))
    joined = edges.join(nodes, "kmer")
    inner = (F.lag("ord", 1).over(along) == F.col("ord") - 1) & (F.col("sole_before") == F.lag("kmer", 1).over(along)) & (F.lag("sole_after", 1).over(along) == F.col("kmer"))
    marked = joined.withColumn("head", F.when(F.coalesce(inner, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("part", F.sum("head").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    kmer = span - WINDOW + 1
    return numbered.groupBy("id", "part").agg(F.min_by("kmer", "pos").alias("path"), F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + kmer).alias("size")).select("path", "id", "start", "size")


def _pairs(rows: DataFrame, key: str, *carried: str, once: bool = False) -> DataFrame:
    """Rows of equal key and different id, the smaller id first; large groups are made by several tasks.

    With ``once``, of groups that have the same ids only one is made. They are told by their size and by two sums over
    hashes of the ids, 128 bits.
    """
    marks = [F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("mark"), F.bit_xor(F.xxhash64(F.lit("ids"), "id")).alias("mark2")] if once else []
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"), (F.min("id") != F.max("id")).alias("several"), *marks).where("several")
    if once:
        sizes = sizes.groupBy("n", "mark", "mark2").agg(F.min(key).alias(key))
    held = rows.join(sizes.select(key, F.ceil(F.col("n") / _PER_SALT).cast("int").alias("salts")), key)
    left = held.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    right = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    names = ("id", *carried)
    a = left.select(key, "salt", *(F.col(c).alias(f"{c}_a") for c in names))
    b = right.select(key, "salt", *(F.col(c).alias(f"{c}_b") for c in names))
    return a.join(b, [key, "salt"]).where("id_a < id_b")


def _around(docs: DataFrame, wanted: DataFrame, span: int, reach: Column, head: Column, tail: Column) -> DataFrame:
    """Adds to occurrences of paths (id, start, size) a digest of their text, its beginning and end, and the text beside it.

    head and tail have ``span`` characters at most and are null where these aren't needed, left and right have as many
    as ``reach``. Only what is cut out of a text goes on from here.
    """
    cut = wanted.withColumn("reach", reach).join(docs, "id")
    begin = F.greatest(F.col("start") - F.col("reach"), F.lit(0))
    end, short = F.col("start") + F.col("size"), F.least(F.col("size"), F.lit(span))
    piece = lambda at, size: F.col("text").substr(at + 1, size)
    sides = {"left": piece(begin, F.col("start") - begin), "right": piece(end, F.col("reach"))}
    inside = {"digest": F.sha2(piece(F.col("start"), F.col("size")), 256)} | {n: F.when(needed, piece(at, short)) for n, (needed, at) in {"head": (head, F.col("start")), "tail": (tail, end - short)}.items()}
    return cut.select(*wanted.columns, *(c.alias(n) for n, c in (sides | inside).items()))


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


@F.pandas_udf(T.StructType([T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType())]))
def _extended(left_a, left_b, right_a, right_b):  # noqa: ANN001, ANN202
    import pandas as pd

    return pd.DataFrame({"left": [_common(a[::-1], b[::-1]) for a, b in zip(left_a, left_b)], "right": [_common(a, b) for a, b in zip(right_a, right_b)]}).astype("int32")


def _windows(rows: DataFrame, span: int) -> DataFrame:
    """(window, id, start): hashes of all substrings of length span of the column ``around``, which begins at ``start``."""
    schema = T.StructType([T.StructField("window", T.LongType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("start", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for k, text in enumerate(texts):
                if len(text) >= span:
                    seen = Hashes(C.code_points([text])[0]).all(span).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(seen), batch.column(0).slice(k, 1).take(pa.array(np.zeros(len(seen), dtype=np.int64))), pa.array(np.arange(starts[k], starts[k] + len(seen), dtype=np.int32))], names=schema.names)

    return rows.select("id", F.col("start").cast("int"), "around").mapInArrow(run, schema)


def _prepared(docs: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    if span < 2 * WINDOW:
        raise ValueError(f"spans are found from {2 * WINDOW} characters on")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= span))


def shared_pairs(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", in_pairs: int = IN_PAIRS) -> DataFrame:
    """Pairs of records that share a span of at least ``span`` characters: (id_a, id_b), each once, id_a < id_b.

    Characters are code points, compared exactly. Null, empty and shorter texts and null ids share nothing; rows of
    equal id aren't paired with each other; an empty table gives an empty one; other columns aren't read.
    """
    texts = _prepared(docs, id_col, text_col, span)
    paths = _several(_paths(texts, span), in_pairs)
    is_long = F.col("size") >= span
    held = written(_around(texts, paths, span, F.greatest(F.lit(span) - F.col("size"), F.lit(0)), ~is_long & F.col("is_crowded"), F.lit(False)), "span-contexts")
    same_text = held.where(is_long).select(F.concat("path", F.lit(" "), "digest").alias("path"), "id").distinct()
    settled = written(_pairs(same_text, "path", once=True).select("id_a", "id_b").distinct(), "span-pairs")
    few = held.where(~is_long & ~F.col("is_crowded"))
    doubtful = _pairs(few.select("path", "id", "start", "digest"), "path", "start", "digest").where("digest_a = digest_b").join(settled, ["id_a", "id_b"], "left_anti")
    near = doubtful.select("path", "id_a", "start_a", "id_b", "start_b")
    for x in "ab":
        sides = few.select("path", F.col("id").alias(f"id_{x}"), F.col("start").alias(f"start_{x}"), "size", F.col("left").alias(f"left_{x}"), F.col("right").alias(f"right_{x}"))
        near = near.join(sides if x == "a" else sides.drop("size"), ["path", f"id_{x}", f"start_{x}"])
    reached = near.withColumn("more", _extended("left_a", "left_b", "right_a", "right_b"))
    by_text = reached.where(F.col("more.left") + F.col("size") + F.col("more.right") >= span).select("id_a", "id_b").distinct()
    crowded = held.where(~is_long & F.col("is_crowded")).select("id", F.lit(0).alias("start"), F.concat("left", "head", "right").alias("around"))
    by_window = _pairs(_windows(crowded, span).select("window", "id").distinct(), "window", once=True).select("id_a", "id_b")
    return settled.union(by_text).union(by_window).distinct()


def _several(paths: DataFrame, in_pairs: int) -> DataFrame:
    """Occurrences of the paths that several records hold, and whether there are more of them than are compared in pairs."""
    paths = written(paths, "span-paths")
    counted = paths.groupBy("path").agg((F.count("*") > in_pairs).alias("is_crowded"), (F.min("id") != F.max("id")).alias("several")).where("several").drop("several")
    return paths.join(counted, "path")


def _shared_ranges(texts: DataFrame, paths: DataFrame, span: int, in_pairs: int) -> DataFrame:
    """(id, start, stop) of spans that another record holds; together they cover all of them."""
    reach = F.greatest(F.lit(span) - F.col("size"), F.lit(WINDOW + GRAM))
    around = written(_around(texts, _several(paths, in_pairs), span, reach, F.col("is_crowded"), F.col("is_crowded") & (F.col("size") >= span)), "span-contexts")
    few, crowded = around.where("not is_crowded"), around.where("is_crowded")
    pairs = _pairs(few, "path", "start", "size", "digest", "left", "right").where("digest_a = digest_b").withColumn("more", _extended("left_a", "left_b", "right_a", "right_b"))
    held = pairs.where(F.col("more.left") + F.col("size_a") + F.col("more.right") >= span)
    ends = lambda x: held.select(F.col(f"id_{x}").alias("id"), (F.col(f"start_{x}") - F.col("more.left")).alias("start"), (F.col(f"start_{x}") + F.col(f"size_{x}") + F.col("more.right")).alias("stop"))
    long = crowded.where(F.col("size") >= span)
    of_text = long.groupBy("path", "digest").agg((F.min("id") != F.max("id")).alias("several")).where("several").drop("several")
    inside = long.join(of_text, ["path", "digest"], "left_semi").select("id", "start", (F.col("start") + F.col("size")).alias("stop"))
    begin = F.col("start") - F.length("left")
    borders = [
        crowded.where(F.col("size") < span).select("id", begin.alias("start"), F.concat("left", "head", "right").alias("around")),
        long.select("id", begin.alias("start"), F.concat("left", "head").alias("around")),
        long.select("id", (F.col("start") + F.col("size") - span).alias("start"), F.concat("tail", "right").alias("around")),
    ]
    windows = _windows(borders[0].union(borders[1]).union(borders[2]), span)
    common = windows.groupBy("window").agg((F.min("id") != F.max("id")).alias("several")).where("several").select("window")
    by_window = windows.join(common, "window", "left_semi").select("id", "start", (F.col("start") + span).alias("stop"))
    return ends("a").union(ends("b")).union(inside).union(by_window)


def shared_amounts(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", in_pairs: int = IN_PAIRS) -> DataFrame:
    """How much of each record stands elsewhere: (id_col, n_chars, shared_chars, shared_share, n_spans).

    One row for each record that has an id, also of those that share nothing. shared_chars counts the characters
    that lie in spans of at least ``span`` characters that another record holds too, each character once; n_spans
    counts the stretches these make. Null texts count as empty; rows of equal id are one record, of its longest text.
    """
    records = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    texts = _prepared(docs, id_col, text_col, span)
    found = _shared_ranges(texts, _paths(texts, span), span, in_pairs)
    along = Window.partitionBy("id").orderBy("start")
    begins = found.withColumn("fresh", F.when(F.col("start") <= F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    stretches = begins.withColumn("part", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0))).groupBy("id", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    sums = stretches.groupBy("id").agg(F.sum(F.col("stop") - F.col("start")).alias("shared_chars"), F.count("*").alias("n_spans"))
    sizes = records.groupBy("id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0)).cast("long")
    return sizes.join(sums, "id", "left").select(F.col("id").alias(id_col), "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("shared_share"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"))
