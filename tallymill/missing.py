"""One meaning of *missing*: NaN, unparsable text and blanks become NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def null_if_nan(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def to_number(col: Column, dtype: str = "double") -> Column:
    """Numeric coercion whose failures and NaNs are NULL."""
    value = col.try_cast(dtype)
    return null_if_nan(value) if dtype in ("double", "float") else value


def blank_to_null(col: Column) -> Column:
    return F.when(F.trim(col) != "", col)


def coerce(df: DataFrame, columns, dtype: str = "double") -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: to_number(df[f"`{c}`"].cast("string"), dtype) for c in present})


def sample_std(col: Column, single: str = "null") -> Column:
    """Sample deviation; ``single`` says what one lone value gives: ``null`` or ``zero``."""
    std = F.stddev_samp(col)
    if single == "null":
        return std
    if single == "zero":
        return F.when(F.count(col) == 1, F.lit(0.0)).otherwise(std)
    raise ValueError(f"single must be 'null' or 'zero', not {single!r}")


def require_columns(df: DataFrame, names) -> None:
    absent = sorted(set(names) - set(df.columns))
    if absent:
        raise ValueError(f"missing required columns {absent}; have {df.columns}")
