"""Lookup tables: loading with key conflicts, joining to profiles, the status they imply."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions.text import not_blank, view_key
from sojourn.schema import LABEL, SUBJECT


@dataclass(frozen=True)
class Lookup:
    """A table of subjects, and the status a hit in it stands for."""

    name: str
    rows: DataFrame
    status: str
    key: str
    columns: Sequence[str] = ()
    #: (text before first column, text before second column, ...) of the detail sentence.
    detail: Sequence[str] = ()

    def detail_text(self) -> Column:
        parts: list[Column] = []
        for lead, column in zip(self.detail, self.columns):
            parts += [F.lit(lead), F.coalesce(F.col(f"{self.name}_{column}"), F.lit(""))]
        return F.concat(*parts)


def merge_lookup(
    current: DataFrame, batch: DataFrame, key: str, position: str, keep: str = "first"
) -> DataFrame:
    """Load ``batch`` into ``current`` under a unique key.

    ``keep="first"`` leaves existing rows alone and takes the first new row of each key;
    ``keep="last"`` replaces them by the last new row. Rows without a key are dropped.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    columns = [c for c in current.columns if c != key]
    both = current.select(key, *columns, F.lit(0).alias("_load"), F.lit(0).cast("long").alias("_at")).unionByName(
        batch.select(key, *columns, F.lit(1).alias("_load"), F.col(position).cast("long").alias("_at"))
    )
    both = both.withColumn(key, view_key(F.col(key))).filter(F.col(key) != "")
    pick = F.min_by if keep == "first" else F.max_by
    row = pick(F.struct(*columns), F.struct("_load", "_at", *columns)).alias("row")
    return both.groupBy(key).agg(row).select(key, "row.*")


def combine_lookups(lookups: Sequence[Lookup]) -> DataFrame:
    """All lookups as one table with one row per key and one struct per lookup.

    One combined table needs one join where separate tables need one each, and grouping on the
    normalized key means a key spelled two ways cannot multiply profile rows.
    """
    tagged = None
    for one in lookups:
        row = F.struct(F.lit(True).alias("hit"), *[F.col(c).alias(f"{one.name}_{c}") for c in one.columns])
        keyed = one.rows.select(view_key(F.col(one.key)).alias(SUBJECT), row.alias(one.name))
        keyed = keyed.filter(F.col(SUBJECT) != "")
        tagged = keyed if tagged is None else tagged.unionByName(keyed, allowMissingColumns=True)
    return tagged.groupBy(SUBJECT).agg(*[F.min(one.name).alias(one.name) for one in lookups])


def status_of(lookups: Sequence[Lookup]) -> Column:
    """Status of the first lookup, in the given order, that has the subject."""
    return F.coalesce(*[F.when(F.col(one.name).isNotNull(), F.lit(one.status)) for one in lookups])


def final_status() -> Column:
    """A verified label wins over the status from the lookups."""
    return F.coalesce(F.trim(not_blank(F.col(LABEL))), F.col("lookup_status"))


def attach_lookups(subjects: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    """Add status, lookup columns and detail sentences to a table keyed by subject.

    Both sides are unique on the key, so no key is hot. The join is left to the planner, which
    broadcasts the lookups only when their measured size allows.
    """
    joined = subjects.join(combine_lookups(lookups), SUBJECT, "left")
    joined = joined.withColumn("lookup_status", status_of(lookups)).withColumn("status", final_status())
    unpacked = [
        F.col(f"{one.name}.{one.name}_{c}").alias(f"{one.name}_{c}") for one in lookups for c in one.columns
    ]
    flat = joined.select(*subjects.columns, "lookup_status", "status", *unpacked)
    return flat.withColumns({f"{one.name}_detail": one.detail_text() for one in lookups if one.detail})
