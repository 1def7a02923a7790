"""Predicates on profiles. Each builder returns a Column that is true where nothing is asked for."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.dates import AsOf, as_date
from sojourn.schema import END, START
from sojourn.session import materialize

CURRENT = "current"
ENDED = "ended"
#: Group codes that stand for several groups, by code.
Composites = Mapping[str, Sequence[str]]


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(operator.and_, conditions, F.lit(True))


def date_filter(
    as_of: AsOf,
    start: AsOf | None = None,
    end: AsOf | None = None,
    min_days: int | None = None,
    mode: str = "stay",
) -> Column:
    """Range of dates, or a minimum of days in the rolling year.

    ``mode="stay"`` wants the stay over by ``end`` or still open, and with ``min_days`` only stays that
    have not ended before ``as_of``. ``mode="start_only"`` compares only the start. In both, ``end``
    gives way to ``min_days`` unless that is zero; zero itself still filters.
    """
    if mode not in ("stay", "start_only"):
        raise ValueError("mode must be 'stay' or 'start_only'")
    wanted = []
    if start:
        wanted.append(F.col(START) >= as_date(start))
    if end and not min_days:
        if mode == "stay":
            wanted.append(F.col(END).isNull() | (F.col(END) <= as_date(end)))
        else:
            wanted.append(F.col(START) <= as_date(end))
    if min_days is not None:
        wanted.append(F.col("days_1y") >= min_days)
        if mode == "stay":
            wanted.append(F.col(END).isNull() | (F.col(END) >= as_date(as_of)))
    return all_of(wanted)


def days_filter(value: int | None, comparison: str = ">=") -> Column:
    """Compare the rolling-year days; any comparison other than ``>=`` means ``<=``."""
    if value is None:
        return F.lit(True)
    return F.col("days_1y") >= value if comparison == ">=" else F.col("days_1y") <= value


def state_filter(state: str | None, as_of: AsOf) -> Column:
    """Still here after ``as_of``, gone by ``as_of``, or a given status."""
    if not state:
        return F.lit(True)
    if state == CURRENT:
        return F.col(END).isNull() | (F.col(END) > as_date(as_of))
    if state == ENDED:
        return F.col(END).isNotNull() & (F.col(END) <= as_date(as_of))
    return F.col("status") == state


def _wanted_groups(groups: str | Sequence[str] | None, composites: Composites | None) -> list[str]:
    """Plain group codes, or an empty list for no filter."""
    if not groups:
        return []
    codes = [groups] if isinstance(groups, str) else list(groups)
    if "ALL" in codes:
        return []
    return [plain for code in codes for plain in (composites or {}).get(code, (code,))]


def group_filter(
    groups: str | Sequence[str] | None, spellings: Mapping[str, Sequence[str]], column: str = "category",
    composites: Composites | None = None,
) -> Column:
    """Category is one of the spellings of the groups. ``ALL`` or unknown groups do not filter.

    A code in ``composites`` stands for the groups listed there.
    """
    names = sorted({s for g in _wanted_groups(groups, composites) for s in spellings.get(g, ())})
    return F.upper(F.col(column)).isin(names) if names else F.lit(True)


def filter_group(
    df: DataFrame,
    groups: str | Sequence[str] | None,
    spellings: DataFrame,
    column: str = "category",
    composites: Composites | None = None,
) -> DataFrame:
    """``group_filter`` with the spellings in a table of (group_name, spelling). Runs a job while it is built."""
    codes = _wanted_groups(groups, composites)
    if not codes:
        return df
    names = spellings.filter(F.col("group_name").isin(codes)).select(F.col("spelling").alias("_spelling")).distinct()
    names = materialize(names, "group-spellings")
    if names.isEmpty():
        return df
    return df.join(names, F.upper(F.col(column)) == F.col("_spelling"), "left_semi")
