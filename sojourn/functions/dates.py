"""Date columns. ``as_of`` is always passed in: no expression here reads the clock."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.text import strip

AsOf = dt.date | str

# Year first: one separator used twice, with an optional time of day behind it. Year last: any of the three separators, two to four
# digits of year, whatever follows. Any other text comes to nothing. One pattern, as each costs a pass over every text.
_DATE = r"^(?:(\d{4})([-/])(\d{1,2})\2(\d{1,2})(?:[ T].*)?$|(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})|)[\s\S]*"
#: Year, month and day as written, and the separator if the year is first.
_PARTS = "$1$7 $3$6 $4$5 $2"


def as_date(value: AsOf) -> Column:
    return F.lit(value).cast("date")


def _date_of(year: Column, month: Column, day: Column) -> Column:
    """Date of three whole numbers, NULL unless it exists. The usual failure, day and month swapped, is
    caught by comparison, since a failing constructor costs an exception per row."""
    none = F.lit(0)
    midnight = F.try_make_timestamp_ntz(years=year, months=month, days=day, hours=none, mins=none, secs=none)
    usual = (year > 0) & month.between(1, 12)
    # Every month has 28 days.
    return F.when(usual & day.between(1, 28), F.make_date(year, month, day)).when(usual & day.between(29, 31), midnight.cast("date"))


def _trimmed(c: Column) -> Column:
    """Text without outer white space; most is without, which one test tells for less than trimming costs."""
    return F.when(c.rlike(r"^[!-~](?:.*[!-~])?$"), c).otherwise(strip(c))


def _parts(text: Column) -> Column:
    return F.regexp_replace(text, _DATE, _PARTS)


def _numbers(parts: Column) -> list[Column]:
    """Year, month and day. No empty text is cast, as a cast that fails costs an exception."""
    texts = [F.substring_index(F.substring_index(parts, " ", k), " ", -1) for k in (1, 2, 3)]
    return [F.nullif(text, F.lit("")).try_cast("int") for text in texts]


def _year_last(first: Column, second: Column, digits: Column) -> Column:
    year = F.when(digits < 50, digits + 2000).when(digits < 100, digits + 1900).otherwise(digits)
    return F.coalesce(_date_of(year, second, first), _date_of(year, first, second))


def _date_from(parts: Column, year: Column, month: Column, day: Column) -> Column:
    return F.when(F.endswith(parts, F.lit(" ")), _year_last(day, month, year)).otherwise(_date_of(year, month, day))


def parse_date(c: Column) -> Column:
    """Date from text: year first, else day first, else month first. NULL when none of them fits.

    A two-digit year below 50 is in the 2000s, any other in the 1900s. For columns of large tables
    ``parse_dates`` is faster.
    """
    parts = _parts(_trimmed(c))
    return _date_from(parts, *_numbers(parts))


def parse_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace text columns by their dates. Text, parts and numbers are each worked out in a step of
    their own, so that later steps can use them many times."""
    steps = df.withColumns({c: _trimmed(F.col(c)) for c in columns}).withColumns({c: _parts(F.col(c)) for c in columns})
    steps = steps.withColumns({f"_{c}_{k}": number for c in columns for k, number in enumerate(_numbers(F.col(c)))})
    dates = {c: _date_from(*[F.col(f) for f in (c, f"_{c}_0", f"_{c}_1", f"_{c}_2")]) for c in columns}
    return steps.withColumns(dates).select(*df.columns)


def format_date(c: Column, pattern: str = "dd/MM/yyyy") -> Column:
    return F.date_format(c, pattern)


def reformat_date(c: Column, pattern: str = "dd/MM/yyyy") -> Column:
    """Text date in the report format; text that is no date stays as it is."""
    return F.coalesce(F.date_format(parse_date(c), pattern), c)


def lenient_date_text(c: Column, pattern: str = "dd/MM/yyyy") -> Column:
    """Text date in the report format; text that is no date becomes empty."""
    return F.coalesce(F.date_format(parse_date(c), pattern), F.lit(""))


def is_valid_date(c: Column) -> Column:
    return parse_date(c).isNotNull()


def days_between(first: Column, second: Column) -> Column:
    """Days from ``first`` to ``second``; zero when either is missing."""
    return F.coalesce(F.datediff(second, first), F.lit(0))


def year_age(birth: Column, as_of: AsOf) -> Column:
    """Difference of calendar years, so the birthday itself plays no role."""
    return F.year(as_date(as_of)) - F.year(birth)
