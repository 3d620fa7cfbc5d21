"""Numbers that Spark has no function for."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    """Complementary error function; null for null."""
    return x.map(math.erfc, na_action="ignore")


def binomial_tail(k: Column, n: Column) -> Column:
    """Chance of at most k heads in n tosses, by the recurrence of the terms' logarithms."""
    term = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k.cast("long")),
        F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct(
            F.when(i == 0, -n * math.log(2)).otherwise(s["log"] + F.log((n - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double"))).alias("log"),
            (s["sum"] + F.exp(F.when(i == 0, -n * math.log(2)).otherwise(s["log"] + F.log((n - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double"))))).alias("sum"),
        ),
    )
    return term["sum"]


def shown(value: Column, digits: int = 1, signed: bool = False, grouped: bool = False) -> Column:
    """A number as text with fixed digits, a sign if wanted, and thousands grouped if wanted."""
    flags = ("+" if signed else "") + ("," if grouped else "")
    return F.format_string(f"%{flags}.{digits}f", value.cast("double"))
