"""Text that looks ordinary but holds other characters, and its one form.

Widths, ligatures, separate accents, invisible signs and spaces have one ordinary form each. Look-alike letters depend
on the script of their word: the script that most of its letters have is taken as the word's, and letters of another
script are replaced by their look-alikes only where the word mixes scripts and the result is a word of the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cresset.llm import _lookalikes as L
from cresset.sources.workspace import written

_MIXED = {"width": f"[{L.FULL_WIDTH}]", "ligature": f"[{L.LIGATURES}]", "mark": f"[{L.MARKS}]", "invisible": f"[{L.INVISIBLE}]", "space": f"[{L.SPACES}]"}
_WORD = re.compile(r"[^\W_]+")
_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic")
#: Neighbouring letters of a word in two of the scripts; matched in one pass, whatever the length of the word.
_TWO_SCRIPTS = "|".join(rf"\p{{Is{a}}}[\p{{M}}\p{{N}}]*+\p{{Is{b}}}" for a in _SCRIPTS for b in _SCRIPTS if a != b)
_OTHER_SCRIPT = "[" + "".join(rf"\p{{Is{s}}}" for s in _SCRIPTS[1:]) + "]"


def suspicious(text: Column) -> Column:
    """Whether a text can hold a finding, by patterns that need no Python; the cheaper ones first rule most texts out."""
    signs = text.rlike("[" + "".join(p[1:-1] for p in _MIXED.values()) + "]")
    return text.rlike(r"[^\x00-\x7f]") & (signs | (text.rlike(_OTHER_SCRIPT) & text.rlike(_TWO_SCRIPTS)))


@lru_cache(maxsize=1 << 14)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0].split("-")[0]


def one_script(word: str) -> str:
    """The word with all letters in the script that dominates it, or the word itself if it isn't a mixture of look-alikes.

    In a tie Latin dominates.
    """
    scripts = [_script(c) for c in word if c.isalpha()]
    kinds = set(scripts)
    if len(kinds) < 2 or not kinds <= {s.upper() for s in _SCRIPTS}:
        return word
    main = max(sorted(kinds), key=lambda k: (scripts.count(k), k == "LATIN"))
    for target in dict.fromkeys((main, "LATIN")):  # with look-alikes in the majority the word is Latin nevertheless
        out = word.translate(L.TO_CYRILLIC) if target == "CYRILLIC" else word.translate(L.TO_GREEK) if target == "GREEK" else L.in_latin(word)
        if len({_script(c) for c in out if c.isalpha()}) == 1:
            return out
    return word


def findings_of(text: str) -> tuple[list[str], str, list[tuple[str, str]]]:
    """Kinds of findings, the text in its plain form, and its mixed words with their form in one script."""
    found = [k for k, p in _MIXED.items() if re.search(p, text)]
    plain = L.plain_form(text)
    mixed = []
    for word in dict.fromkeys(_WORD.findall(plain)):
        if not word.isascii() and (repaired := one_script(word)) != word:
            mixed.append((word, repaired))
    return found + ["look-alike"] * bool(mixed), plain, mixed


def pieces_of(text: str) -> list[str]:
    """The words of a text and what stands between them; together they are the text."""
    return re.findall(r"[^\W_]+|[\W_]+", text)


def words_of(text: Column) -> Column:
    """Words of a text in lower case, for the vocabulary."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)


_MIXED_WORD = T.StructType([T.StructField("word", T.StringType()), T.StructField("repaired", T.StringType())])


def disguised_values(values: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The values that hold findings: (*keep, text, plain, findings, mixed, pieces), each once and in any order.

    plain is the text without all but its look-alike letters; mixed lists the words that mix scripts with their form
    in one script, and pieces what the plain text is made of if there are any.
    """
    names = ("text", "plain", "findings", "mixed", "pieces")
    types = (T.StringType(), T.StringType(), T.ArrayType(T.StringType()), T.ArrayType(_MIXED_WORD), T.ArrayType(T.StringType()))
    schema = T.StructType([*(values.schema[c] for c in keep), *map(T.StructField, names, types)])
    arrow = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("word", pa.string()), ("repaired", pa.string())])), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            columns: tuple[list, ...] = ([], [], [], [], [])
            for k, text in enumerate(batch.column(0).to_pylist()):
                found, plain, mixed = findings_of(text)
                if found:
                    rows.append(k)
                    for column, value in zip(columns, (text, plain, found, [{"word": a, "repaired": b} for a, b in mixed], pieces_of(plain) if mixed else None)):
                        column.append(value)
            kept = batch.select(list(range(1, batch.num_columns))).take(pa.array(rows, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, columns, arrow)], names=schema.names)

    return values.where(suspicious(F.col(text_col))).select(F.col(text_col).alias("_text"), *keep).mapInArrow(run, schema)


def unify(values: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The values that hold findings, in one form: (*keep, text, unified, findings, unrepaired).

    keep names the columns that identify a value. findings lists width, ligature, mark, invisible, space and
    look-alike; unrepaired counts mixed words whose form in one script no text of the corpus holds, which stay as
    they are, word by word. Null, empty and ordinary texts don't come out, repeated rows come out each. Precomposed
    accents, typographic signs and words wholly in another script are no finding. Texts are handled whole.
    """
    found = written(disguised_values(values, keep, text_col).withColumn("_value", F.monotonically_increasing_id()), "disguised-values")
    asked = found.select(F.explode("mixed.repaired").alias("repaired")).select(F.lower("repaired").alias("word")).distinct()
    vocabulary = values.select(F.explode(words_of(F.col(text_col))).alias("word"))
    known = vocabulary.join(asked, "word", "left_semi").distinct()
    repairs = found.select("_value", F.explode("mixed").alias("m")).join(known.select(F.col("word").alias("known")), F.lower("m.repaired") == F.col("known"), "left")
    per_value = repairs.groupBy("_value").agg(F.map_from_entries(F.collect_list(F.when(F.col("known").isNotNull(), F.struct("m.word", "m.repaired")))).alias("repairs"), F.count_if(F.col("known").isNull()).cast("long").alias("unrepaired"))
    joined = found.join(per_value, "_value", "left")
    repaired = F.array_join(F.transform("pieces", lambda piece: F.coalesce(F.element_at("repairs", piece), piece)), "")
    unified = F.when(F.col("pieces").isNotNull(), repaired).otherwise(F.col("plain"))
    return joined.select(*keep, "text", unified.alias("unified"), "findings", F.coalesce("unrepaired", F.lit(0)).cast("long").alias("unrepaired"))
