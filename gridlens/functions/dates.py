"""Calendar columns: parts of a stamp, Easter, Portuguese holidays, time marks, Fourier terms."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public holidays of Portugal.
FIXED_HOLIDAYS = [(1, 1), (4, 25), (5, 1), (6, 10), (8, 15), (12, 8), (12, 25)]
EASTER_HOLIDAYS = [-47, -2, 0]  # Carnival, Good Friday, Easter Sunday (days from Easter)
# Holidays that were suspended for some years.
SUSPENDABLE_HOLIDAYS = [(10, 5), (11, 1), (12, 1)]
SUSPENDABLE_EASTER_HOLIDAYS = [60]  # Corpus Christi
SUSPENDED_YEARS = (2013, 2014, 2015)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weekday(ts: Column | str) -> Column:
    """1 = Monday … 7 = Sunday."""
    return F.weekday(_col(ts)) + 1


def hour_of_day(ts: Column | str) -> Column:
    """1 … 24."""
    return F.hour(_col(ts)) + 1


def is_weekend(ts: Column | str) -> Column:
    return F.weekday(_col(ts)) >= 5


def floor_hour(ts: Column | str) -> Column:
    return F.date_trunc("HOUR", _col(ts)).cast("timestamp_ntz")


def easter_date(year: Column | str) -> Column:
    """Gregorian Easter Sunday, counted from 28 March.

    Integer arithmetic of the ecclesiastical moon (Oudin's form), written so that each step is
    used at most twice and the generated code stays short.
    """
    y = _col(year).cast("int")
    century = F.floor(y / 100).cast("int")
    golden = y % 19
    shift = century - F.floor(century / 4) - F.floor((century * 8 + 13) / 25)
    age = (shift + golden * 19 + 15) % 30
    moon = age - ((age + (golden > 10).cast("int")) > 28).cast("int")
    past_sunday = (y + F.floor(y / 4) + moon + 2 - century + F.floor(century / 4)) % 7
    return F.date_add(F.make_date(y, F.lit(3), F.lit(28)), (moon - past_sunday).cast("int"))


def is_holiday(ts: Column | str, suspended: Sequence[int] = SUSPENDED_YEARS) -> Column:
    """Whether the day is a holiday; plain column arithmetic, so no join with a date table."""
    day = _col(ts).cast("date")
    from_easter = F.datediff(day, easter_date(F.year(day)))
    month_day = F.month(day) * 100 + F.dayofmonth(day)
    always = month_day.isin([m * 100 + d for m, d in FIXED_HOLIDAYS]) | from_easter.isin(
        EASTER_HOLIDAYS
    )
    sometimes = month_day.isin([m * 100 + d for m, d in SUSPENDABLE_HOLIDAYS]) | from_easter.isin(
        SUSPENDABLE_EASTER_HOLIDAYS
    )
    if not suspended:
        return always | sometimes
    return always | (sometimes & ~F.year(day).isin(list(suspended)))


def holiday_dates(years: DataFrame, suspended: Sequence[int] = SUSPENDED_YEARS) -> DataFrame:
    """Every holiday of the years in column ``year``: one row (year, Holiday) per date."""
    y = F.col("year").cast("int")
    easter = easter_date(y)
    always = [F.make_date(y, F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS]
    always += [F.date_add(easter, n) for n in EASTER_HOLIDAYS]
    sometimes = [F.make_date(y, F.lit(m), F.lit(d)) for m, d in SUSPENDABLE_HOLIDAYS]
    sometimes += [F.date_add(easter, n) for n in SUSPENDABLE_EASTER_HOLIDAYS]
    off = y.isin(list(suspended)) if suspended else F.lit(False)
    dates = F.when(off, F.array(*always)).otherwise(F.array(*always, *sometimes))
    return years.select(y.alias("year"), F.explode(F.array_distinct(dates)).alias("Holiday"))


def flag_holidays(
    df: DataFrame, time: str = "Date", suspended: Sequence[int] = SUSPENDED_YEARS
) -> DataFrame:
    return df.withColumn("Is_Holiday", is_holiday(time, suspended))


def calendar_features(df: DataFrame, time: str = "Date") -> DataFrame:
    return df.withColumns(
        {
            "Weekday": weekday(time),
            "Hour": hour_of_day(time),
            "Month": F.month(time),
            "Is_Weekend": is_weekend(time),
        }
    )


def time_marks(ts: Column | str) -> list[Column]:
    """Hour and weekday on a −0.5 … 0.5 scale."""
    return [
        (F.hour(_col(ts)) / F.lit(23.0) - 0.5).alias("mark_hour"),
        (F.weekday(_col(ts)) / F.lit(6.0) - 0.5).alias("mark_weekday"),
    ]


def fourier_terms(ts: Column | str, period_days: float, order: int, prefix: str) -> list[Column]:
    """Sine and cosine pairs of the stamp for one season."""
    days = F.unix_seconds(_col(ts).cast("timestamp")) / F.lit(86400.0)
    terms = []
    for k in range(1, order + 1):
        angle = days * F.lit(2.0 * pi * k / period_days)
        terms += [F.sin(angle).alias(f"{prefix}_sin_{k}"), F.cos(angle).alias(f"{prefix}_cos_{k}")]
    return terms


def with_holiday_columns(
    df: DataFrame, time: str = "Date", suspended: Sequence[int] = SUSPENDED_YEARS
) -> tuple[DataFrame, list[str]]:
    """One 0/1 column per holiday, so that a model can learn each day's own effect."""
    day = F.col(time).cast("date")
    # Own columns for the distance to Easter and the day of the year, used many times below.
    staged = df.withColumns(
        {
            "_easter": F.datediff(day, easter_date(F.year(day))),
            "_month_day": F.month(day) * 100 + F.dayofmonth(day),
            "_kept": ~F.year(day).isin(list(suspended)) if suspended else F.lit(True),
        }
    )
    month_day, from_easter, kept = F.col("_month_day"), F.col("_easter"), F.col("_kept")
    tests = {f"holiday_{m}_{d}": month_day == m * 100 + d for m, d in FIXED_HOLIDAYS}
    tests |= {f"holiday_easter_{i}": from_easter == n for i, n in enumerate(EASTER_HOLIDAYS)}
    tests |= {
        f"holiday_{m}_{d}": (month_day == m * 100 + d) & kept for m, d in SUSPENDABLE_HOLIDAYS
    }
    tests |= {
        f"holiday_easter_off_{i}": (from_easter == n) & kept
        for i, n in enumerate(SUSPENDABLE_EASTER_HOLIDAYS)
    }
    flagged = staged.withColumns({name: test.cast("int") for name, test in tests.items()})
    return flagged.drop("_easter", "_month_day", "_kept"), list(tests)
