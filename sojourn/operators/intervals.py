"""Versions, islands and day counts of keyed date intervals.

A subject may own a third of all rows, so nothing here gathers raw rows by subject. ``dedup_latest``
first brings the data down to one row per (subject, start_date); its row-number filter is applied
inside each input task before the shuffle. From then on a subject has at most one row per calendar
day, which bounds every later per-subject window however many raw rows the subject had.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sojourn.functions.dates import AsOf, as_date
from sojourn.functions.text import view_key
from sojourn.schema import END, LABEL, START, SUBJECT, UPDATED

#: Which end an island with both open and closed rows gets: the last closed end, or the end the
#: islands were built with (an open row reaches to ``as_of``).
OPEN_ISLAND = ("last_closed", "max_effective")


def keyed(stays: DataFrame) -> DataFrame:
    """Rows with a usable subject, in the key form everything is grouped by."""
    return stays.withColumn(SUBJECT, view_key(F.col(SUBJECT))).filter(F.col(SUBJECT) != "")


def latest_first() -> list[Column]:
    """Newest version first; among equals a known end beats an open one, a later end an earlier."""
    return [F.desc(UPDATED), F.desc_nulls_last(END)]


def dedup_latest(
    stays: DataFrame,
    keys: Sequence[str] = (SUBJECT, START),
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """The latest version per key. All other columns break ties, so the choice is repeatable."""
    rows = keyed(stays)
    rest = [F.desc(c) for c in rows.columns if c not in (*keys, UPDATED, END)]
    ranked = W.partitionBy(*keys).orderBy(*(order or latest_first()), *rest)
    return rows.withColumn("_version", F.row_number().over(ranked)).filter("_version = 1").drop("_version")


def person_latest(versions: DataFrame, attributes: Sequence[str] = ("name", "birth_date", "category")) -> DataFrame:
    """Personal attributes per subject from its most recently updated interval."""
    newest = F.max_by(F.struct(*attributes, UPDATED), F.struct(UPDATED, START))
    return versions.groupBy(SUBJECT).agg(newest.alias("p")).select(SUBJECT, "p.*")


def island_tags(versions: DataFrame, as_of: AsOf, gap_days: int = 1) -> DataFrame:
    """Number the islands of each subject: runs of intervals with no gap above ``gap_days``.

    Expects one row per (subject, start_date), as ``dedup_latest`` and ``day_intervals`` give.
    """
    in_order = W.partitionBy(SUBJECT).orderBy(F.asc_nulls_last(START))
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    until = in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    starts_new = F.col("prev_max_end").isNull() | (
        F.col(START) > F.date_add("prev_max_end", gap_days)
    )
    return (
        versions.withColumn("end_eff", F.coalesce(END, as_date(as_of)))
        .withColumn("prev_max_end", F.max("end_eff").over(before))
        .withColumn("new_island", F.when(starts_new, 1).otherwise(0))
        .withColumn("island_id", F.sum("new_island").over(until))
    )


def _effective_end(as_of: AsOf, open_island: str) -> Column:
    if open_island not in OPEN_ISLAND:
        raise ValueError(f"open_island must be one of {OPEN_ISLAND}")
    if open_island == "max_effective":
        return F.max("end_eff")
    return F.coalesce(F.max(END), as_date(as_of))


def distinct_text(c: str, joiner: str = " | ") -> Column:
    """Distinct non-NULL values in order, joined; NULL when there is none."""
    values = F.sort_array(F.collect_set(c))
    return F.when(F.size(values) > 0, F.array_join(values, joiner))


def _range_columns(as_of: AsOf, open_island: str) -> list[Column]:
    return [
        F.min(START).alias("island_start"),
        _effective_end(as_of, open_island).alias("island_end_eff"),
        F.max(END).alias("island_end_real"),
    ]


def _island_columns(as_of: AsOf, open_island: str) -> list[Column]:
    return [*_range_columns(as_of, open_island), distinct_text("place").alias("island_places")]


def island_ranges(stays: DataFrame, as_of: AsOf, gap_days: int = 1, open_island: str = "last_closed") -> DataFrame:
    """One row per island with its range alone, for counts of days.

    Versions that differ in neither update time nor end have the same range, so the other columns need not decide between them
    and are dropped before rows are shuffled and sorted.
    """
    narrow = dedup_latest(stays.select(SUBJECT, START, END, UPDATED))
    return island_tags(narrow, as_of, gap_days).groupBy(SUBJECT, "island_id").agg(*_range_columns(as_of, open_island))


def islands(tagged: DataFrame, as_of: AsOf, open_island: str = "last_closed") -> DataFrame:
    """One row per island: its range, the places seen in it and its newest label."""
    label = F.max_by(LABEL, F.struct(UPDATED, START)).alias("island_label")
    return tagged.groupBy(SUBJECT, "island_id").agg(*_island_columns(as_of, open_island), label)


def latest_island(island_rows: DataFrame) -> DataFrame:
    """The island that ends last; the later start decides between equal ends."""
    rest = [c for c in island_rows.columns if c != SUBJECT]
    last = F.max_by(F.struct(*rest), F.struct("island_end_eff", "island_start"))
    return island_rows.groupBy(SUBJECT).agg(last.alias("i")).select(SUBJECT, "i.*")


def window_days(as_of: AsOf, days: int = 365) -> Column:
    """Days of an island inside the ``days`` before ``as_of``, both ends counted."""
    today = as_date(as_of)
    floor = F.date_sub(today, days)
    inside = F.datediff(F.least("island_end_eff", today), F.greatest("island_start", floor)) + 1
    return F.when(F.col("island_end_eff") < floor, 0).otherwise(inside)


def elapsed_days(as_of: AsOf) -> Column:
    """Days of an island up to ``as_of``, both ends counted."""
    return F.datediff(F.least("island_end_eff", as_date(as_of)), F.col("island_start")) + 1


def is_recent(as_of: AsOf, days: int = 365) -> Column:
    return F.col(START) >= F.date_sub(as_date(as_of), days)


def days_in_window(island_rows: DataFrame, as_of: AsOf, days: int = 365) -> DataFrame:
    return island_rows.groupBy(SUBJECT).agg(
        F.coalesce(F.sum(window_days(as_of, days)), F.lit(0)).alias("days_1y")
    )


def days_lifetime(island_rows: DataFrame, as_of: AsOf) -> DataFrame:
    return island_rows.groupBy(SUBJECT).agg(
        F.coalesce(F.sum(elapsed_days(as_of)), F.lit(0)).alias("days_lifetime")
    )


def arrivals(versions: DataFrame, as_of: AsOf, days: int = 365) -> DataFrame:
    """How many intervals of each subject start within the window (or after ``as_of``)."""
    return versions.groupBy(SUBJECT).agg(F.count_if(is_recent(as_of, days)).alias("arrivals_1y"))


def subject_summary(
    tagged: DataFrame, as_of: AsOf, days: int = 365, open_island: str = "last_closed"
) -> DataFrame:
    """Latest island, latest person and all counts per subject, in one pass over the tagged rows.

    Every figure is carried through the island aggregate in a form the subject aggregate can finish,
    so neither level needs another shuffle or a join back to the intervals.
    """
    # Structs compare field by field, and no subject has a start date twice: the greatest struct that
    # leads with the order columns is the row wanted, for half the buffers that ``max_by`` keeps.
    newest = F.max(F.struct(UPDATED, START, LABEL, "name", "birth_date", "category"))
    per_island = tagged.groupBy(SUBJECT, "island_id").agg(
        *_island_columns(as_of, open_island),
        F.count_if(is_recent(as_of, days)).alias("recent"),
        newest.alias("newest"),
    )
    last = F.max(
        F.struct(
            "island_end_eff", "island_start", "island_end_real", "island_places",
            F.col(f"newest.{LABEL}").alias("island_label"),
        )
    )
    return (
        per_island.groupBy(SUBJECT)
        .agg(
            F.max("newest").alias("p"),
            last.alias("i"),
            F.sum("recent").alias("arrivals_1y"),
            F.coalesce(F.sum(window_days(as_of, days)), F.lit(0)).alias("days_1y"),
            F.coalesce(F.sum(elapsed_days(as_of)), F.lit(0)).alias("days_lifetime"),
        )
        .select(
            SUBJECT,
            "p.name",
            "p.birth_date",
            "p.category",
            F.col("i.island_start").alias(START),
            F.col("i.island_end_real").alias(END),
            F.col("i.island_places").alias("place"),
            F.col("i.island_label").alias(LABEL),
            "arrivals_1y",
            "days_1y",
            "days_lifetime",
        )
    )


def day_intervals(points: DataFrame, subject: str, at: str) -> DataFrame:
    """Distinct active days of each subject as one-day intervals, from timestamped rows."""
    return (
        points.select(F.col(subject).cast("string").alias(SUBJECT), F.to_date(at).alias(START))
        .distinct()
        .withColumn(END, F.col(START))
    )
