"""The profile as a stored table that follows its fact table load by load.

Next to one summary row per subject it stores the versions these come from, both by buckets of the subject. The
manifests of two versions of the fact table tell which months changed between them, and the load id of a row whether it changed.
So a refresh reads the changed months, the buckets of the subjects they name, and derives those subjects
anew; everything else stays as it is stored. Lookups are attached when the profile is read, so they may change at any time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sojourn.operators.intervals import OPEN_ISLAND, dedup_latest, island_tags, keyed, subject_summary
from sojourn.operators.lookups import Lookup, attach_lookups
from sojourn.schema import STAY_SCHEMA, START, SUBJECT
from sojourn.session import materialize
from sojourn.sources import tables, versions

BUCKETS = 64
VERSIONS, SUMMARIES = "versions_of", "summaries_of"
SUMMARY_SCHEMA = T.StructType([
    *[STAY_SCHEMA[c] for c in (SUBJECT, "name", "birth_date", "category", START, "end_date", "place", "verified_label")],
    *[T.StructField(c, T.LongType()) for c in ("arrivals_1y", "days_1y", "days_lifetime")],
])


@dataclass(frozen=True)
class StoredProfile:
    """A profile at ``path`` of the fact table at ``fact``.

    ``buckets`` grows with the subjects, not with the loads: a refresh rewrites the buckets it touches. It is fixed by the first build, as are
    ``days``, ``gap_days`` and ``open_island``. One refresh at a time; a second one raises ``VersionConflict``.
    """

    spark: SparkSession
    path: str
    fact: str
    buckets: int = BUCKETS
    days: int = 365
    gap_days: int = 1
    open_island: str = OPEN_ISLAND[0]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(SUBJECT), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, column: str) -> str:
        folder = versions.new_folder()
        placed = rows.withColumn(column, self._bucket()).hint("rebalance", F.col(column)).sortWithinPartitions(column, SUBJECT)
        versions.write_rows(placed, self.path, folder, column)
        return folder

    def _written(self, folder: str, schema: T.StructType) -> DataFrame:
        return versions.read_folder(self.spark, self.path, folder, schema)

    def _stored(self, at: versions.Version, column: str, schema: T.StructType, buckets: Sequence[int] | None = None) -> DataFrame:
        names = [versions.part_name(column, b) for b in (range(self.buckets) if buckets is None else buckets)]
        return versions.read_parts(self.spark, self.path, at, schema, names)

    def _summaries(self, rows: DataFrame, as_of: str) -> DataFrame:
        tagged = island_tags(rows, as_of, self.gap_days)
        return subject_summary(tagged, as_of, self.days, self.open_island).select(*SUMMARY_SCHEMA.names)

    def _settings(self) -> dict:
        return {"buckets": self.buckets, "days": self.days, "gap_days": self.gap_days, "open_island": self.open_island}

    def _publish(self, base: versions.Version, fact: int, as_of: str, parts: dict[str, list[str]]) -> versions.Version:
        info = {"fact": fact, "as_of": as_of, "settings": self._settings()}
        return versions.publish(self.spark, self.path, base, parts, versions.new_folder(), info)

    def _parts(self, *folders: str) -> dict[str, list[str]]:
        return {name: [folder] for folder in folders for name in versions.folder_parts(self.spark, self.path, folder)}

    def build(self, as_of: str) -> versions.Version:
        """The profile from the whole fact table; replaces what is stored."""
        base, fact = versions.current(self.spark, self.path), versions.current(self.spark, self.fact)
        rows = versions.read_parts(self.spark, self.fact, fact, STAY_SCHEMA)
        stored = self._write(dedup_latest(rows), VERSIONS)
        summaries = self._write(self._summaries(self._written(stored, STAY_SCHEMA), as_of), SUMMARIES)
        return self._publish(base, fact.number, as_of, {**{name: [] for name in base.parts}, **self._parts(stored, summaries)})

    def _base(self) -> versions.Version:
        base = versions.current(self.spark, self.path)
        if base.number and base.info["settings"] != self._settings():
            raise ValueError(f"{self.path} was built with {base.info['settings']}")
        return base

    def _changed_months(self, since: int, until: versions.Version) -> list[str]:
        """Partitions of the fact table whose folders differ."""
        before = versions.version(self.spark, self.fact, since).parts if since else {}
        return [name for name, folders in until.parts.items() if folders != before.get(name)]

    def changed_subjects(self, since: int, until: versions.Version) -> DataFrame:
        """Subjects of the rows that the fact table's loads after version ``since`` wrote, each once."""
        rows = versions.read_parts(self.spark, self.fact, until, tables.STORED, self._changed_months(since, until))
        loads = [versions.version(self.spark, self.fact, n).load for n in range(since + 1, until.number + 1)]
        return keyed(rows.filter(F.col(tables.LOAD).isin(loads))).select(SUBJECT).distinct()

    def refresh(self, as_of: str | None = None) -> versions.Version:
        """Takes in every load since the last refresh. Without one it changes nothing, so it can be repeated at any time.

        With another ``as_of`` than the stored one, all summaries are derived anew from the stored versions, the fact
        table is read no further than for the changes.
        """
        base, fact = self._base(), versions.current(self.spark, self.fact)
        if not base.number:
            if as_of is None:
                raise ValueError("the first refresh needs as_of")
            return self.build(as_of)
        since, parts = base.info["fact"], {}
        day = as_of or base.info["as_of"]
        if fact.number > since:
            parts = self._take_in(base, since, fact, day)
        if day != base.info["as_of"]:
            merged = versions.Version(parts={**base.parts, **parts})
            summaries = self._write(self._summaries(self._stored(merged, VERSIONS, STAY_SCHEMA), day), SUMMARIES)
            parts |= self._parts(summaries)
        return self._publish(base, fact.number, day, parts) if parts or fact.number > since else base

    def _take_in(self, base: versions.Version, since: int, until: versions.Version, as_of: str) -> dict[str, list[str]]:
        """New folders of the touched buckets: versions of the changed months replaced, touched subjects derived again.

        A key lies in one month, and a changed month is read as a whole, so its versions need no join with what is stored or touched.
        """
        subjects = materialize(self.changed_subjects(since, until), "touched-subjects")
        touched = [r[0] for r in subjects.select(self._bucket()).distinct().collect()]  # bounded by the buckets
        months = self._changed_months(since, until)
        rows = keyed(versions.read_parts(self.spark, self.fact, until, STAY_SCHEMA, months))
        fresh = dedup_latest(rows.filter(self._bucket().isin(touched)) if len(touched) < self.buckets else rows)
        month = F.coalesce(tables.month_of(F.col(START)), F.lit(versions.NULL_PART))
        kept = self._stored(base, VERSIONS, STAY_SCHEMA, touched).filter(~month.isin([name.split("=", 1)[1] for name in months]))
        stored = self._write(kept.unionByName(fresh), VERSIONS)
        derived = self._summaries(self._written(stored, STAY_SCHEMA).join(subjects, SUBJECT, "left_semi"), as_of)
        others = self._stored(base, SUMMARIES, SUMMARY_SCHEMA, touched).join(subjects, SUBJECT, "left_anti")
        return self._parts(stored, self._write(others.unionByName(derived), SUMMARIES))

    def read_subjects(self, subjects: DataFrame) -> DataFrame:
        """Stored summaries of a table of subjects, which is read twice; only their buckets are."""
        touched = [r[0] for r in subjects.select(self._bucket()).distinct().collect()]  # bounded by the buckets
        found = self._stored(versions.current(self.spark, self.path), SUMMARIES, SUMMARY_SCHEMA, touched)
        return found.join(subjects.select(SUBJECT), SUBJECT, "left_semi")

    def changed_summaries(self, since: int, until: versions.Version) -> DataFrame:
        """Subject and name of the summaries that are new or named otherwise after version ``since``.

        Buckets whose folders are the same in both versions are not read; of those whose old folders were deleted every row counts as changed.
        """
        before = versions.version(self.spark, self.path, since).parts if since else {}
        names = [name for name, folders in until.parts.items() if name.startswith(f"{SUMMARIES}=") and folders != before.get(name)]
        present = {f for name in names for f in before.get(name, []) if versions.folder_parts(self.spark, self.path, f)}
        old = versions.Version(parts={name: [f for f in before.get(name, []) if f in present] for name in names})
        key = [SUBJECT, "name"]
        known = versions.read_parts(self.spark, self.path, old, SUMMARY_SCHEMA).select(F.col(SUBJECT).alias("_subject"), F.col("name").alias("_name"))
        same = (F.col(SUBJECT) == F.col("_subject")) & F.col("name").eqNullSafe(F.col("_name"))
        return versions.read_parts(self.spark, self.path, until, SUMMARY_SCHEMA, names).select(*key).join(known, same, "left_anti")

    def read(self, lookups: Sequence[Lookup] = ()) -> DataFrame:
        """The profile as of the last refresh, with the lookups as they are now."""
        summaries = self._stored(versions.current(self.spark, self.path), SUMMARIES, SUMMARY_SCHEMA)
        return attach_lookups(summaries, lookups) if lookups else summaries
