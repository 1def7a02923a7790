"""The profile: one row per subject with its latest island, counts, status and details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sojourn.functions.dates import AsOf
from sojourn.operators.intervals import dedup_latest, island_tags, subject_summary
from sojourn.operators.lookups import Lookup, attach_lookups


def profile(
    stays: DataFrame,
    lookups: Sequence[Lookup],
    as_of: AsOf,
    days: int = 365,
    gap_days: int = 1,
    open_island: str = "last_closed",
) -> DataFrame:
    """Two shuffles of the intervals, both safe for a hot subject, and one join.

    1. by (subject, start_date), after old versions were dropped inside the input tasks;
    2. by subject, with at most one row per subject and day; the island windows, the island
       aggregate and the subject aggregate all use this partitioning;
    3. the combined lookups join on subject, on the partitioning already there.
    """
    tagged = island_tags(dedup_latest(stays), as_of, gap_days)
    return attach_lookups(subject_summary(tagged, as_of, days, open_island), lookups)
