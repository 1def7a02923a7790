"""The report entry points: one filter description, and the reports that take it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.dates import AsOf
from sojourn.operators import reports as rp
from sojourn.operators.classify import Rules, Scoring, group_flag, rule_cascade, rule_score
from sojourn.operators.filters import CURRENT, all_of, date_filter, days_filter, group_filter, state_filter
from sojourn.operators.search import PAGE_ROWS, newest_first, page, page_info
from sojourn.schema import END, START, SUBJECT
from sojourn.session import materialize


@dataclass(frozen=True)
class ReportFilter:
    """What a report is asked for; everything but ``as_of`` is optional."""

    as_of: AsOf
    start: AsOf | None = None
    end: AsOf | None = None
    groups: str | Sequence[str] | None = None
    spellings: Mapping[str, Sequence[str]] = field(default_factory=dict)
    days: int | None = None
    comparison: str = ">="
    state: str | None = None
    min_days: int | None = None
    composites: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def by_stay(self) -> Column:
        """The conditions of statistics and lists."""
        return all_of([
            date_filter(self.as_of, self.start, self.end, self.min_days),
            group_filter(self.groups, self.spellings, composites=self.composites),
            days_filter(self.days, self.comparison),
            state_filter(self.state, self.as_of),
        ])

    def by_category(self) -> Column:
        """The same without day count and state, as the table per category has it."""
        return all_of([
            date_filter(self.as_of, self.start, self.end, self.min_days),
            group_filter(self.groups, self.spellings, composites=self.composites),
        ])

    def by_start(self) -> Column:
        """Dates compared with the start only. Asking for current stays lifts the date range."""
        start, end = (None, None) if self.state == CURRENT else (self.start, self.end)
        return all_of([
            date_filter(self.as_of, start, end, self.min_days, mode="start_only"),
            group_filter(self.groups, self.spellings, composites=self.composites),
            state_filter(self.state, self.as_of),
        ])


def statistics(profiles: DataFrame, asked: ReportFilter, statuses: Mapping[str, str]) -> DataFrame:
    return rp.summary_stats(profiles.filter(asked.by_stay()), statuses)


def statistics_by_category(profiles: DataFrame, asked: ReportFilter, limit: int | None = 20) -> DataFrame:
    return rp.stats_by(profiles.filter(asked.by_category()), "category", limit)


def person_list(
    profiles: DataFrame, asked: ReportFilter, limit: int | None = PAGE_ROWS, offset: int = 0
) -> tuple[DataFrame, DataFrame]:
    """One page of profiles, newest first, and its page information."""
    kept = profiles.filter(asked.by_stay())
    return page(kept, newest_first(), limit, offset), page_info(kept, limit, offset)


def narrative(profiles: DataFrame, asked: ReportFilter, statuses: Mapping[str, str]) -> DataFrame:
    """Short report. Totals and category table read one stored copy of the few columns they need."""
    needed = profiles.filter(asked.by_category()).select(START, END, "category", "status", "days_1y")
    stored = materialize(needed, "narrative-input")
    stats = statistics(stored, asked, statuses)
    top = statistics_by_category(stored, asked, 10)
    return rp.narrative(stats, top, statuses, asked.start, asked.end, asked.min_days)


def narrative_by_label(profiles: DataFrame, asked: ReportFilter, groups: Rules, order: Sequence[str]) -> DataFrame:
    return rp.narrative_by_label(rp.label_by_category(profiles.filter(asked.by_start()), groups), order)


def predictions(profiles: DataFrame, scoring: Scoring, only_level: str | None = None, limit: int | None = 100) -> DataFrame:
    return rule_score(profiles, scoring, SUBJECT, limit, only_level)


@dataclass(frozen=True)
class Decision:
    """How the matrix decides on a class: rules may use ``flag``, set where any row of the same start
    and place satisfies ``companion``. Classes are conditions on the column ``decision``."""

    companion: Column
    rules: Rules
    default: str
    classes: Mapping[str, Column]
    flag: str = "group_flag"


def decide(stored: DataFrame, decision: Decision) -> DataFrame:
    """Add flag and decision to a stored table of profiles."""
    flagged = group_flag(stored, [START, "place"], decision.companion, decision.flag)
    return rule_cascade(flagged, decision.rules, decision.default)


def matrix_report(
    profiles: DataFrame, asked: ReportFilter, decision: Decision, columns: Sequence[str], limit: int | None = 50
) -> DataFrame:
    """Category by class matrix. ``columns`` names the profile columns the decision needs.

    The filtered profiles are stored once, as flags, matrix and grand total all read them.
    """
    wanted = list(dict.fromkeys([SUBJECT, START, "place", "category", *columns]))
    stored = materialize(profiles.filter(asked.by_start()).select(*wanted), "matrix-input")
    total = stored.agg(F.count(F.lit(1)).alias("total"))
    return rp.matrix(decide(stored, decision), total, decision.classes, limit=limit)
