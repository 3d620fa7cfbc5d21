"""Uncertainty by resampling, computed from counts so that the effort doesn't depend on the number of labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cresset.sources.workspace import written

#: Draws that one task makes at once; each block has a seed of its own, so that results don't depend on partitions.
BLOCK = 1000
#: Distinct values that one task of a permutation test draws from; more are split into buckets.
PER_BUCKET = 100_000


def _draws(spark, n: int, seed: int, make: Callable[[np.random.Generator, int], np.ndarray]) -> DataFrame:  # noqa: ANN001
    """n values of a statistic: (draw, value), undefined ones null."""
    blocks = -(-n // BLOCK)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block in frame["id"]:
                size = min(BLOCK, n - block * BLOCK)
                values = make(np.random.default_rng([seed, int(block)]), size)
                yield pd.DataFrame({"draw": np.arange(size) + block * BLOCK, "value": values})

    drawn = spark.range(0, blocks, 1, min(blocks, spark.sparkContext.defaultParallelism * 2)).mapInPandas(run, "draw long, value double")
    return drawn.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def interval(draws: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(low, high, n_draws) of the defined draws, interpolated between neighbours."""
    return draws.agg(F.percentile("value", low).alias("low"), F.percentile("value", high).alias("high"), F.count("value").alias("n_draws"))


def f1_of(tp: np.ndarray, fp: np.ndarray, fn: np.ndarray, tn: np.ndarray) -> np.ndarray:
    """F1 of confusion counts; undefined where precision or recall is, or both are 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p, r = tp / (tp + fp), tp / (tp + fn)
        return 2 * p * r / (p + r)


def bias_of(tp: np.ndarray, fp: np.ndarray, fn: np.ndarray, tn: np.ndarray) -> np.ndarray:
    return (fp - fn) / (tp + fp + fn + tn)


def bootstrap(predictions: DataFrame, statistic: Callable[..., np.ndarray] = f1_of, n: int = 20_000, seed: int = 20) -> DataFrame:
    """Draws of a statistic of predicted against human: (draw, value).

    A resample of rows with replacement has confusion counts that are multinomial with the shares of the counts, so
    the rows are counted once and only counts are drawn. Null rows don't count; without rows all draws are null.
    """
    p, h = F.col("predicted"), F.col("human")
    c = predictions.agg(F.count_if(p & h), F.count_if(p & ~h), F.count_if(~p & h), F.count_if(~p & ~h)).first()
    cells = np.array(c, dtype=float)
    total = int(cells.sum())

    def make(rng: np.random.Generator, size: int) -> np.ndarray:
        if not total:
            return np.full(size, np.nan)
        return statistic(*rng.multinomial(total, cells / total, size).T.astype(float))

    return _draws(predictions.sparkSession, n, seed, make)


def kappa_of(tp: np.ndarray, fp: np.ndarray, fn: np.ndarray, tn: np.ndarray) -> np.ndarray:
    """Agreement beyond chance; undefined where chance alone agrees fully."""
    with np.errstate(divide="ignore", invalid="ignore"):
        n = tp + fp + fn + tn
        a, b = (tp + fp) / n, (tp + fn) / n
        chance = a * b + (1 - a) * (1 - b)
        return np.where(chance < 1, ((tp + tn) / n - chance) / (1 - chance), np.nan)


STATISTICS = {"f1": f1_of, "kappa": kappa_of, "bias": bias_of}


def bootstrap_all(predictions: DataFrame, statistics: dict[str, Callable[..., np.ndarray]] = STATISTICS, n: int = 20_000, seed: int = 20, low: float = 2.5, high: float = 97.5) -> DataFrame:
    """Every statistic of every instrument with its interval: (instrument, statistic, value, low, high, n_draws).

    As ``bootstrap``, from one count of all rows; all statistics of an instrument are of the same draws.
    """
    p, h = F.col("predicted"), F.col("human")
    cells = {"tp": p & h, "fp": p & ~h, "fn": ~p & h, "tn": ~p & ~h}
    counts = predictions.groupBy("instrument").agg(*(F.count_if(c).alias(k) for k, c in cells.items()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                own = np.array([r.tp, r.fp, r.fn, r.tn], dtype=float)
                total = int(own.sum())
                blocks = [np.random.default_rng([seed, k]).multinomial(total, own / total, min(BLOCK, n - k * BLOCK)) for k in range(-(-n // BLOCK))] if total else []
                drawn = np.concatenate(blocks).T.astype(float) if blocks else np.zeros((4, 0))
                for name, statistic in statistics.items():
                    values = statistic(*drawn)
                    values = values[~np.isnan(values)]
                    ends = np.percentile(values, [low, high]).tolist() if len(values) else [None, None]
                    point = float(statistic(*own[:, None])[0]) if total else None
                    out.append((r.instrument, name, None if point is None or np.isnan(point) else point, *ends, len(values)))
            yield pd.DataFrame(out, columns=["instrument", "statistic", "value", "low", "high", "n_draws"])

    return counts.mapInPandas(run, "instrument string, statistic string, value double, low double, high double, n_draws long")


def permutation_p(values: DataFrame, value: str, group: str, n: int = 20_000, seed: int = 21, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Two-sided p of a difference of group means under random groups: (observed, p_value), smoothed by one.

    The values are counted by value, and a random group of the same size is a draw without replacement from these
    counts. Of very many distinct values the counts lie in buckets: how many of a group fall into each bucket is drawn
    first, by all tasks alike, and every bucket draws so many of its own; together that is the same draw. Rows of null
    value or group don't count; without rows in both groups p is null.
    """
    rows = values.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    counts = written(rows.groupBy(F.col(value).cast("double").alias("v")).agg(F.count_if(F.col(group)).alias("a"), F.count("*").alias("n")), "permutation-counts")
    sums = counts.agg(F.count("*").alias("distinct"), F.sum("a").alias("a"), F.sum("n").alias("n"), F.sum(F.col("v") * F.col("a")).alias("va"), F.sum(F.col("v") * F.col("n")).alias("vn")).first()
    spark = values.sparkSession
    if not sums.a or sums.a == sums.n:
        return spark.createDataFrame([(None, None)], "observed double, p_value double")
    n_a, total = int(sums.a), int(sums.n)
    difference = lambda x: x / n_a - (sums.vn - x) / (total - n_a)
    observed = float(difference(sums.va))
    buckets = -(-sums.distinct // per_bucket)
    placed = counts.withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(buckets)).cast("int"))
    sizes = {r.bucket: int(r.n) for r in placed.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # one row per bucket
    known = np.array([sizes.get(k, 0) for k in range(buckets)], dtype=np.int64)
    held = placed.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("own"))
    blocks = -(-n // BLOCK)
    tasks = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(min(blocks * buckets, spark.sparkContext.defaultParallelism * 2))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                block, size = int(r.block), min(BLOCK, n - int(r.block) * BLOCK)
                shares = np.random.default_rng([seed, block]).multivariate_hypergeometric(known, n_a, size, method="marginals")[:, int(r.bucket)]
                v, own = np.array([x["v"] for x in r.own]), np.array([x["n"] for x in r.own], dtype=np.int64)
                rng = np.random.default_rng([seed, block, int(r.bucket)])
                drawn = np.array([rng.multivariate_hypergeometric(own, k, method="marginals") @ v for k in shares])
                yield pd.DataFrame({"draw": np.arange(size) + block * BLOCK, "part": drawn})

    each = tasks.mapInPandas(run, "draw long, part double").groupBy("draw").agg(F.sum("part").alias("x"))
    hits = each.agg(F.count_if(F.abs(difference(F.col("x"))) >= abs(observed) - 1e-12).alias("h"))
    return hits.select(F.lit(observed).alias("observed"), ((F.col("h") + 1) / (n + 1)).alias("p_value"))


def posterior_rates(sample: DataFrame, frame: DataFrame, verdict: str, human: str, by: str = "catalog", n: int = 200_000, seed: int = 22) -> DataFrame:
    """Share of non-members per catalog with its interval: (by, member_rate, ood, ood_low, ood_high, n_in, n_out).

    The rate of each stratum and the frame's weight have beta posteriors with half a case added on both sides; one
    draw of the weight serves both strata. Rows of null verdict or label don't count, in the frame they count as out.
    """
    f = frame.groupBy(by).agg(F.count("*").alias("frame_n"), F.count_if(F.col(verdict)).alias("frame_in"))
    k = lambda v, h: F.count_if((F.col(verdict) == v) & (F.col(human) if h else F.lit(True)) & F.col(human).isNotNull())
    s = sample.groupBy(by).agg(k(True, False).alias("n_in"), k(True, True).alias("in_in"), k(False, False).alias("n_out"), k(False, True).alias("out_in"))
    schema = f"{by} {frame.schema[by].dataType.simpleString()}, member_rate double, ood double, ood_low double, ood_high double, n_in long, n_out long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for r in rows.itertuples(index=False):
                rng = np.random.default_rng([seed, int(r.n_in), int(r.n_out), int(r.frame_n)])
                w = rng.beta(r.frame_in + 0.5, r.frame_n - r.frame_in + 0.5, n)
                rate = w * rng.beta(r.in_in + 0.5, r.n_in - r.in_in + 0.5, n) + (1 - w) * rng.beta(r.out_in + 0.5, r.n_out - r.out_in + 0.5, n)
                low, high = np.percentile(1 - rate, [2.5, 97.5])
                share = r.frame_in / r.frame_n
                member = share * r.in_in / r.n_in + (1 - share) * r.out_in / r.n_out if r.n_in and r.n_out else None
                out.append((getattr(r, by), member, None if member is None else 1 - member, low, high, r.n_in, r.n_out))
            yield pd.DataFrame(out, columns=[by, "member_rate", "ood", "ood_low", "ood_high", "n_in", "n_out"])

    return f.join(s, by).mapInPandas(run, schema)
