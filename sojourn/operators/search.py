"""Lookup of subjects by text or by a list of keys, and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.dates import AsOf
from sojourn.functions.text import norm_key, strip_accents
from sojourn.operators.intervals import keyed
from sojourn.operators.lookups import Lookup
from sojourn.plans.profile import profile
from sojourn.schema import START, SUBJECT
from sojourn.session import materialize

MAX_HITS = 100
PAGE_ROWS = 200


def squeezed(c: Column) -> Column:
    return F.replace(F.upper(c), F.lit(" "), F.lit(""))


def matches(keyword: str, accent_insensitive: bool = False) -> Column:
    """Key or name contains the keyword, case and spaces aside. The keyword is literal text."""
    raw = F.lit(keyword.strip())
    folded = squeezed(strip_accents(raw))
    name = F.col("name")
    hit = (
        F.contains(F.replace(F.col(SUBJECT), F.lit(" "), F.lit("")), folded)
        | F.contains(squeezed(name), folded)
        | F.contains(F.upper(name), F.upper(raw))
    )
    if accent_insensitive:
        hit = hit | F.contains(squeezed(strip_accents(name)), folded)
    return F.coalesce(hit, F.lit(False))


def newest_first() -> list[Column]:
    return [F.desc(START), F.asc(SUBJECT)]


def search_fuzzy(
    stays: DataFrame,
    lookups: Sequence[Lookup],
    keyword: str,
    as_of: AsOf,
    limit: int | None = MAX_HITS,
    accent_insensitive: bool = False,
) -> DataFrame:
    """The newest ``limit`` profiles that match, all of them if None. Keywords under two characters match nothing.

    A profile shows its subject's key and one of its names, so only the rows of subjects with a matching
    raw row are profiled, and the profile's own name is tested last. The subjects are stored while the query
    is built; the join with them is a broadcast only if their stored size is below the session's threshold.
    """
    hit = matches(keyword, accent_insensitive)
    if len(keyword.strip()) < 2:
        hit = F.lit(False)
    rows = keyed(stays)
    candidates = materialize(rows.filter(hit).select(SUBJECT).distinct(), "search-candidates")
    found = profile(rows.join(candidates, SUBJECT, "left_semi"), lookups, as_of).filter(hit)
    return page(found, newest_first(), limit)


def distinct_keys(keys: DataFrame, key: str, position: str, limit: int | None = None) -> DataFrame:
    """Normalized keys, each once with its first position; with ``limit`` only those first seen."""
    normalized = keys.select(norm_key(F.col(key)).alias("key"), F.col(position).alias("pos"))
    first = normalized.filter(F.col("key") != "").groupBy("key").agg(F.min("pos").alias("pos"))
    return first.orderBy("pos", "key").limit(limit) if limit is not None else first


def priority_rank(statuses: Sequence[str]) -> Column:
    """Place of the status in the list, one past its end for any other."""
    rank = F.lit(len(statuses) + 1)
    for place, status in reversed(list(enumerate(statuses, 1))):
        rank = F.when(F.col("status") == status, place).otherwise(rank)
    return rank


def by_priority(statuses: Sequence[str]) -> list[Column]:
    return [priority_rank(statuses).asc(), *newest_first()]


def search_batch_all(
    stays: DataFrame,
    lookups: Sequence[Lookup],
    keys: DataFrame,
    as_of: AsOf,
    key: str = "key",
    position: str = "pos",
    priority: Sequence[str] | None = None,
) -> DataFrame:
    """Profiles of all listed keys, however many, by priority if one is given.

    The distinct keys are stored while the query is built. Rows of other subjects are dropped before the profile.
    """
    wanted = distinct_keys(keys, key, position).select(F.col("key").alias(SUBJECT))
    found = profile(keyed(stays).join(materialize(wanted, "wanted-keys"), SUBJECT, "left_semi"), lookups, as_of)
    return found.orderBy(*by_priority(priority)) if priority is not None else found


def page(df: DataFrame, order: Sequence[Column], limit: int | None = PAGE_ROWS, offset: int = 0) -> DataFrame:
    """One page, or all rows in order if ``limit`` is None. Top-k in every task, never a full sort.

    ``offset`` is for shallow pages: all rows up to the page's end meet in one task. See ``page_after``.
    """
    ordered = df.orderBy(*order)
    ordered = ordered.offset(offset) if offset else ordered
    return ordered if limit is None else ordered.limit(limit)


def page_after(df: DataFrame, start: AsOf | None, subject: str, limit: int = PAGE_ROWS) -> DataFrame:
    """The page that follows the row of that start and subject, newest first; its cost does not grow with depth."""
    if start is None:
        later = F.col(START).isNull() & (F.col(SUBJECT) > subject)
    else:
        at = F.lit(str(start)).cast("date")
        later = (F.col(START) < at) | F.col(START).isNull() | ((F.col(START) == at) & (F.col(SUBJECT) > subject))
    return page(df.filter(later), newest_first(), limit)


def page_info(df: DataFrame, limit: int | None = PAGE_ROWS, offset: int = 0) -> DataFrame:
    """Total, and whether rows follow this page. The total is right even for a page past the end.

    Without ``limit`` the page reaches to the end, and the limit told is the largest number there is.
    """
    total = F.count(F.lit(1))
    limit = (1 << 62) if limit is None else limit
    return df.agg(
        total.alias("total"),
        F.greatest(F.least(total - offset, F.lit(limit)), F.lit(0)).cast("long").alias("page_rows"),
        (total > offset + limit).alias("has_more"),
        F.lit(offset).cast("long").alias("offset"),
        F.lit(limit).cast("long").alias("limit"),
    )


def search_batch(
    stays: DataFrame,
    lookups: Sequence[Lookup],
    keys: DataFrame,
    as_of: AsOf,
    priority: Sequence[str],
    limit: int = PAGE_ROWS,
    offset: int = 0,
    key: str = "key",
    position: str = "pos",
) -> tuple[DataFrame, DataFrame]:
    """One page of the profiles of the listed keys, by priority, and its page information.

    The profiles are stored once for both results while the query is built.
    """
    found = materialize(search_batch_all(stays, lookups, keys, as_of, key, position), "search-batch")
    return page(found, by_priority(priority), limit, offset), page_info(found, limit, offset)


def keys_not_found(keys: DataFrame, found: DataFrame, key: str = "key", found_key: str = SUBJECT) -> DataFrame:
    """Distinct normalized keys that are not among the found ones."""
    asked = keys.select(norm_key(F.col(key)).alias("key")).filter(F.col("key") != "").distinct()
    have = found.select(norm_key(F.col(found_key)).alias("key")).distinct()
    return asked.join(have, "key", "left_anti")


