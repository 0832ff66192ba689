"""Null policy: NaN becomes null at the source, and division by zero gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def no_nan(df: DataFrame) -> DataFrame:
    """NaN as null in all float and double columns."""
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast(k)) for c, k in df.dtypes if k in ("double", "float")})


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(a, b)
