"""Shared pieces of the catalog: rounding on both sides and prediction views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark import fixtures as FX


# Means of short decimals often end exactly on half a rounding unit, where the order of summation
# would decide the digit. Both sides move values by this small part of the unit before rounding.
OFF_TIE = 0.0314159265


def _nudge(digits: int) -> float:
    return OFF_TIE * 10.0**-digits


def r6(c: str | Column, digits: int = 6) -> Column:
    """Round away from ties and turn negative zero into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(_nudge(digits)), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; other columns stay."""
    return df.select(*[r6(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def q6(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::double + {_nudge(digits)!r}::double, {digits}) + 0.0::double)"


def pred(spark: SparkSession, sf: str) -> DataFrame:
    return FX.predictions(FX.meta_trials(spark, sf))


def train_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("year") < FX.TEST_YEAR), df.filter(F.col("year") == FX.TEST_YEAR)


WITH_META = f"with {FX.SQL_META}\n"
WITH_PRED = f"with {FX.SQL_PRED}\n"
WITH_MARKERS = f"with {FX.SQL_MARKERS}\n"
SQL_TT = """,
tr as (select * from meta where year < 2001), te as (select * from meta where year = 2001)"""
WITH_TT = WITH_META.rstrip() + SQL_TT + "\n"
