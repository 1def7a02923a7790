"""Lookups of many keys in a stored profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.operators.lookups import Lookup, attach_lookups
from sojourn.operators.search import PAGE_ROWS, by_priority, distinct_keys, page, page_info
from sojourn.plans.stored_profile import StoredProfile
from sojourn.schema import SUBJECT
from sojourn.session import materialize


def find_keys(profile: StoredProfile, lookups: Sequence[Lookup], keys: DataFrame, key: str = "key", position: str = "pos") -> DataFrame:
    """Profiles of all listed keys, however many. Neither the intervals nor buckets without a listed key are read."""
    wanted = materialize(distinct_keys(keys, key, position).select(F.col("key").alias(SUBJECT)), "wanted-keys")
    found = profile.read_subjects(wanted)
    return attach_lookups(found, lookups) if lookups else found


def search_keys(
    profile: StoredProfile,
    lookups: Sequence[Lookup],
    keys: DataFrame,
    priority: Sequence[str],
    limit: int | None = PAGE_ROWS,
    offset: int = 0,
    key: str = "key",
    position: str = "pos",
) -> tuple[DataFrame, DataFrame]:
    """``search_batch`` of the stored profile: one page by priority, and its page information.

    Only what ranks a profile is stored for the page; the other columns are read for the rows on it.
    """
    ranked = find_keys(profile, lookups, keys, key, position).select(SUBJECT, "start_date", "status")
    found = materialize(ranked, "ranked")
    shown = materialize(page(found, by_priority(priority), limit, offset).select(SUBJECT), "page")
    rows = attach_lookups(profile.read_subjects(shown), lookups)
    return page(rows, by_priority(priority), None), page_info(found, limit, offset)
