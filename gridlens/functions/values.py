"""Scalar helpers for loads, temperatures and client names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_TEMPERATURE = 18.0


def degree_hours(temp: Column, base: float = BASE_TEMPERATURE) -> list[Column]:
    """Heating and cooling degree hours; an unknown temperature stays unknown."""
    return [
        F.when(temp.isNotNull(), F.greatest(F.lit(0.0), F.lit(base) - temp)).alias("HDH"),
        F.when(temp.isNotNull(), F.greatest(F.lit(0.0), temp - F.lit(base))).alias("CDH"),
    ]


def clamp_nonneg(value: Column) -> Column:
    """Floor at 0 kW. ``greatest`` would turn NULL into 0, so NULL is kept apart."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def normalise_client_id(col: Column) -> Column:
    """``13``, `` mt_13 `` and ``MT_013`` all become ``MT_013``; other text is only trimmed and
    put in capitals."""
    text = F.upper(F.trim(col))
    digits = F.regexp_extract(text, r"^(?:MT_)?([0-9]+)$", 1)
    plain = F.regexp_replace(digits, r"^0+(?=[0-9])", "")
    width = F.greatest(F.lit(3), F.length(plain))
    padded = F.concat(F.lit("MT_"), F.repeat(F.lit("0"), width - F.length(plain)), plain)
    return F.when(digits != "", padded).otherwise(text)


def flags_to_int(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in cols})


def downcast(df: DataFrame, cols: list[str]) -> DataFrame:
    """Store as 32-bit floats; for sinks only, sums are taken in 64 bits."""
    return df.withColumns({c: F.col(c).cast("float") for c in cols})
