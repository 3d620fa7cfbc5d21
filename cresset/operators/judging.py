"""Verdicts of a judge on titles with candidates."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cresset.sources.workspace import written

#: Titles asked at once, and what a judge is told before them.
BATCH = 10
SYSTEM = "Say for each numbered title which of its numbered candidates is the same work, 0 for none. Answer with a line for each: number of the title, colon, number of the candidate."


def pending(titles: DataFrame, done: DataFrame, key: list[str], order: str = "pos") -> DataFrame:
    """Distinct titles not yet answered, in the order of their first occurrence: (*key, first).

    done holds the key columns and ``judged``; unanswered rows of it don't count, so that they are asked again.
    Null titles aren't asked.
    """
    present = titles.where(F.col(key[-1]).isNotNull()).groupBy(*key).agg(F.min(order).alias("first"))
    return present.join(done.where("judged").select(*key).distinct(), key, "left_anti")


def batched(titles: DataFrame, within: list[str], order: list[str], size: int = BATCH) -> DataFrame:
    """Adds batch and item numbers, from 0 and from 1, in order within the given columns."""
    from cresset.operators.ranking import ranked

    placed = ranked(titles, within, [F.col(c).asc() for c in order], "_place").drop("group_size")
    return placed.withColumns({"batch": F.floor((F.col("_place") - 1) / size).cast("long"), "item": ((F.col("_place") - 1) % size + 1).cast("int")}).drop("_place")


def item_lines(item: Column | str, title: Column | str, candidates: Column | str) -> Column:
    """One numbered item with its numbered candidates, a line each."""
    item, title = (F.col(c) if isinstance(c, str) else c for c in (item, title))
    lines = F.transform(candidates, lambda c, k: F.concat(F.lit("  "), (k + 1).cast("string"), F.lit(") "), c))
    return F.concat_ws("\n", F.concat(item.cast("string"), F.lit(". "), title), F.when(F.size(lines) > 0, F.array_join(lines, "\n")))


def prompts(items: DataFrame, within: list[str]) -> DataFrame:
    """One text per batch: (*within, batch, n_items, prompt); items: item, title, candidates. A batch has a bounded number of items."""
    lines = F.array_sort(F.collect_list(F.struct("item", item_lines("item", "title", "candidates").alias("text"))))
    grouped = items.groupBy(*within, "batch").agg(lines.alias("l"))
    return grouped.select(*within, "batch", F.size("l").alias("n_items"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("prompt"))


def parse_replies(replies: DataFrame, key: list[str]) -> DataFrame:
    """Picks read from replies: (*key, item, pick). replies: *key, reply, n_cands (array of the candidates of each item).

    Each line is cut at its first colon; the last token before and the first one after are whole numbers. Items from
    1 to the number of items and picks from 0 to that of its candidates are kept, of several for an item the last.
    Anything else, null replies included, is passed over.
    """
    lines = replies.select(*key, "n_cands", F.posexplode(F.split("reply", "\n")).alias("at", "line")).where(F.instr("line", ":") > 0)
    cut = F.instr("line", ":")
    before = F.split(F.trim(F.expr("substring(line, 1, instr(line, ':') - 1)")), r"\s+")
    after = F.split(F.trim(F.expr("substring(line, instr(line, ':') + 1)")), r"\s+")
    whole = lambda c: F.when(c.rlike(r"^[+-]?\d{1,9}$"), c.try_cast("int"))
    read = lines.where(cut > 0).select(*key, "at", "n_cands", whole(F.element_at(before, -1)).alias("item"), whole(F.element_at(after, 1)).alias("pick"))
    valid = read.where((F.col("item") >= 1) & (F.col("item") <= F.size("n_cands")) & (F.col("pick") >= 0)).where(F.col("pick") <= F.get("n_cands", F.col("item") - 1))
    return valid.groupBy(*key, "item").agg(F.max_by("pick", "at").alias("pick"))


def verdicts(items: DataFrame, picks: DataFrame, key: list[str]) -> DataFrame:
    """State of each item: adds judged, in_catalog, match_title, match_id, match_quartile.

    items: *key, item, candidates, an array of structs with item_id, title and, if known, quartile. Not answered:
    judged false, in_catalog null. Pick 0: in_catalog false and all of the match "". Else the candidate, a match
    without quartile having "".
    """
    joined = items.join(picks, [*key, "item"], "left")
    chosen = F.when(F.col("pick") > 0, F.get("candidates", F.col("pick") - 1))
    fields = items.schema["candidates"].dataType.elementType.fieldNames()
    quartile = F.when(F.col("pick") > 0, F.coalesce(chosen["quartile"] if "quartile" in fields else F.lit(None), F.lit("")))
    match = {"match_title": chosen["title"], "match_id": chosen["item_id"], "match_quartile": quartile}
    return joined.withColumns({"judged": F.col("pick").isNotNull(), "in_catalog": F.col("pick") != 0} | {n: F.when(F.col("pick") == 0, "").otherwise(c) for n, c in match.items()}).drop("pick")


def judge(batches: DataFrame, ask: Callable[[str], str], attempts: int = 4, pause: float = 1.0) -> DataFrame:
    """Replies of a judge to prompts: the columns of batches, and reply.

    ask is called in the tasks. After a failed call the next one waits ``pause`` seconds, then twice as long each
    time; a batch whose calls all fail has a null reply, which leaves its items unanswered.
    """
    schema = T.StructType([*batches.schema.fields, T.StructField("reply", T.StringType())])

    def once(prompt: str) -> str | None:
        for k in range(attempts):
            try:
                return ask(prompt)
            except Exception:  # the next attempt may succeed
                if k < attempts - 1:
                    time.sleep(pause * 2**k)
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(reply=[once(p) for p in frame["prompt"]])

    return batches.mapInPandas(run, schema)


def equal_title_judge(prompt: str) -> str:
    """A judge without a model: picks the first candidate whose normal form is the item's, else none."""
    import re

    from cresset.functions.text import fold_text

    out, item, wanted = {}, None, ""
    for line in prompt.split("\n"):
        if m := re.match(r"(\d+)\. (.*)$", line):
            item, wanted = int(m[1]), fold_text(m[2])
            out[item] = 0
        elif (m := re.match(r"  (\d+)\) (.*)$", line)) and item and not out[item] and fold_text(m[2]) == wanted:
            out[item] = int(m[1])
    return "\n".join(f"{i}: {p}" for i, p in out.items())


def last_verdicts(log: DataFrame, key: list[str], order: str = "pos") -> DataFrame:
    """The last row of each key in a log that is only appended to."""
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return last.select(*key, *(F.col("r")[c].alias(c) for c in rest))


def judge_all(items: DataFrame, within: list[str], ask: Callable[[str], str], order: list[str], rounds: int = 5, arm: str | None = None, attempts: int = 4, pause: float = 1.0) -> DataFrame:
    """Verdicts on all items, those left unanswered being asked again in new batches, up to so many rounds in all.

    items: *within, *order, candidates, title and whatever else. If some are still without an answer ValueError tells
    their number, by ``arm`` if given: they are missing data, and no result should be made of the rest.
    """
    open_, done = items, []
    for _ in range(rounds):
        placed = batched(open_, within, order)
        asked = prompts(placed.withColumn("candidates", F.transform("candidates", lambda c: c["title"])), within)
        replies = judge(asked, ask, attempts, pause)
        sizes = F.transform(F.array_sort(F.collect_list(F.struct("item", F.size("candidates").alias("n")))), lambda x: x["n"])
        counts = placed.groupBy(*within, "batch").agg(sizes.alias("n_cands"))
        picks = parse_replies(replies.join(counts, [*within, "batch"]), [*within, "batch"])
        state = written(verdicts(placed, picks, [*within, "batch"]).drop("batch", "item"), "judged")
        done.append(state.where("judged"))
        open_ = state.where("not judged").select(*items.columns)
        if not open_.limit(1).count():
            return reduce(DataFrame.unionByName, done)
    left = open_.groupBy(F.col(arm).alias("arm") if arm else F.lit("all").alias("arm")).agg(F.count("*").alias("n")).orderBy("arm").limit(100).collect()
    raise ValueError("unanswered after all rounds: " + ", ".join(f"{r.arm} {r.n}" for r in left))
