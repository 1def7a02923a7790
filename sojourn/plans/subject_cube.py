"""Distinct subjects of any range of days from a stored cube of exact bits.

Every subject has a number, stored once. The cube holds, for each day, group and word of 64 numbers, the bits of the subjects
with an interval that starts on the day. The subjects of any set of days are the union of its words, so a range needs the cube's rows of its
days and neither the intervals nor a distinct count over them. Words without a subject are not stored: the cube has at most one row per subject
and day, and one row is two numbers, so neither its aggregates nor its sorts grow with how thinly the subjects are spread.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sojourn.operators.intervals import keyed
from sojourn.operators.numbering import ROW_NUMBER, numbered
from sojourn.schema import START, SUBJECT
from sojourn.session import materialize
from sojourn.sources import versions

DAY, GROUP, WORD, BITS, MONTH = "day", "grp", "word", "bits", "month_of_day"
SIZE = 64
CUBE_SCHEMA = T.StructType([
    T.StructField(DAY, T.DateType()), T.StructField(GROUP, T.StringType()), T.StructField(WORD, T.LongType()), T.StructField(BITS, T.LongType()),
])
Range = tuple[str, dt.date | str, dt.date | str]


def _month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


@dataclass(frozen=True)
class SubjectCube:
    """A cube at ``path``, by months of its days."""

    spark: SparkSession
    path: str

    def build(self, stays: DataFrame, group: str = "category") -> versions.Version:
        """From intervals in any number of versions; rows without a start or a subject are in no day. Replaces what is stored."""
        rows = materialize(keyed(stays).select(SUBJECT, F.col(START).alias(DAY), F.col(group).cast("string").alias(GROUP)).filter(F.col(DAY).isNotNull()).distinct(), "days")
        # Numbered by group, so that the words of a group are full once many days are united.
        subjects = rows.groupBy(SUBJECT).agg(F.min(GROUP).alias(GROUP))
        numbers = numbered(subjects, [GROUP, SUBJECT]).select(SUBJECT, (F.col(ROW_NUMBER) - 1).alias("no"))
        placed = rows.join(numbers, SUBJECT).select(DAY, GROUP, F.expr(f"no div {SIZE}").alias(WORD), F.expr(f"shiftleft(1L, cast(no % {SIZE} as int))").alias(BITS))
        cube = placed.groupBy(DAY, GROUP, WORD).agg(F.bit_or(BITS).alias(BITS)).withColumn(MONTH, _month(F.col(DAY)))
        base, folder = versions.current(self.spark, self.path), versions.new_folder()
        versions.write_rows(cube.hint("rebalance", F.col(MONTH)).sortWithinPartitions(MONTH, DAY), self.path, folder, MONTH)
        parts = {name: [folder] for name in versions.folder_parts(self.spark, self.path, folder)}
        return versions.publish(self.spark, self.path, base, {**{name: [] for name in base.parts}, **parts}, folder, {"bits": SIZE})

    def count(self, ranges: Sequence[Range], by_group: bool = True) -> DataFrame:
        """Distinct subjects of each named range of days, both ends included, by group or in all: ``name[, grp], subjects``.

        Ranges or groups without a subject are not listed. Only months that a range touches are read. A range is spelled out in days, which
        the calendar bounds. Days that lie in the same ranges are united first, so that a word is repeated per range only once they are one.
        """
        at = versions.current(self.spark, self.path)
        if at.number and at.info.get("bits") != SIZE:
            raise ValueError(f"{self.path} was built in another layout; build it again")
        given = self.spark.createDataFrame([(n, str(a), str(b)) for n, a, b in ranges], "name string, lo string, hi string")
        days = given.filter("lo <= hi").select("name", F.explode(F.sequence(F.col("lo").cast("date"), F.col("hi").cast("date"))).alias(DAY))
        alike = days.groupBy(DAY).agg(F.sort_array(F.collect_set("name")).alias("names"))
        spans = materialize(alike.select(DAY, "names", F.min(DAY).over(W.partitionBy("names")).alias("span")), "range-days")
        months = [r[0] for r in spans.select(_month(F.col(DAY))).distinct().collect()]
        cube = versions.read_parts(self.spark, self.path, at, CUBE_SCHEMA, [versions.part_name(MONTH, m) for m in months])
        once = cube.join(spans.select(DAY, "span"), DAY).groupBy("span", GROUP, WORD).agg(F.bit_or(BITS).alias(BITS))
        keys = ["name", GROUP] if by_group else ["name"]
        named = once.join(spans.filter(F.col(DAY) == F.col("span")).select("span", F.explode("names").alias("name")), "span")
        united = named.groupBy(*keys, WORD).agg(F.bit_or(BITS).alias(BITS))
        return united.groupBy(*keys).agg(F.sum(F.bit_count(BITS)).alias("subjects"))
