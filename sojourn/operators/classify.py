"""Classification from caller-supplied rules: groups, scores, reasons, cascades, group flags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.operators.filters import all_of
from sojourn.session import materialize

#: (condition, value) pairs; the first condition that is true gives the value.
Rules = Sequence[tuple[Column, Column | str | int]]


@dataclass(frozen=True)
class Scoring:
    """Bands whose points are added, levels as (least score, name), and (condition, text) reasons."""

    bands: Sequence[Rules]
    levels: Sequence[tuple[int, str]]
    lowest: str
    reasons: Sequence[Rules]
    default_reason: str


def first_match(rules: Rules, default: Column | str | int | None = None) -> Column:
    chosen = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        chosen = F.when(condition, value) if chosen is None else chosen.when(condition, value)
    fallback = default if isinstance(default, Column) else F.lit(default)
    return fallback if chosen is None else chosen.otherwise(fallback)


def at_least(column: str, steps: Sequence[tuple[int, int]]) -> Rules:
    """Points for reaching a value, highest step first."""
    return [(F.col(column) >= least, points) for least, points in sorted(steps, reverse=True)]


def category_group(df: DataFrame, spellings: DataFrame, column: str = "category", other: str = "OTHER") -> DataFrame:
    """Add ``group_name``: the first group, in declared order, that lists the category's spelling.

    ``spellings`` has (group_name, group_order, spelling). A spelling in several groups is reduced to
    one before the join, so no row is multiplied.
    """
    one_each = spellings.groupBy(F.upper(F.trim("spelling")).alias("_spelling")).agg(
        F.min_by("group_name", F.struct("group_order", "group_name")).alias("group_name")
    )
    one_each = materialize(one_each, "spellings")
    joined = df.join(one_each, F.upper(F.trim(F.col(column))) == F.col("_spelling"), "left")
    return joined.select(*df.columns, F.coalesce("group_name", F.lit(other)).alias("group_name"))


def score(scoring: Scoring) -> Column:
    """Sum of the points of every band."""
    total = F.lit(0)
    for band in scoring.bands:
        total = total + first_match(band, 0)
    return total


def level(scoring: Scoring, points: Column) -> Column:
    return first_match([(points >= least, name) for least, name in scoring.levels], scoring.lowest)


def reasons(scoring: Scoring) -> Column:
    """The texts of all reasons that apply, or the default text."""
    texts = F.concat_ws("; ", *[first_match(reason) for reason in scoring.reasons])
    return F.when(texts == "", scoring.default_reason).otherwise(texts)


def rule_score(df: DataFrame, scoring: Scoring, tie: str, limit: int | None = 100, only_level: str | None = None) -> DataFrame:
    """The highest-scoring rows with level and reasons; all of them if ``limit`` is None.

    ``only_level`` picks the rows before ``limit`` counts them.
    """
    scored = df.withColumn("score", score(scoring)).filter("score > 0").withColumn("level", level(scoring, F.col("score")))
    if only_level:
        scored = scored.filter(F.col("level") == only_level)
    top = scored.orderBy(F.desc("score"), F.asc(tie))
    return (top if limit is None else top.limit(limit)).withColumn("reason", reasons(scoring))


def rule_cascade(df: DataFrame, rules: Rules, default: str, column: str = "decision") -> DataFrame:
    """Add the value of the first rule that applies."""
    return df.withColumn(column, first_match(rules, default))


def group_flag(df: DataFrame, by: Sequence[str], predicate: Column, column: str = "group_flag") -> DataFrame:
    """Flag (1 or 0) every row whose group has a row that satisfies the predicate. NULLs are one group.

    A window over the group would bring a hot group into one task. Here the flagged groups are made
    distinct inside the input tasks, stored, and joined back: broadcast if their stored size is small,
    and otherwise with the rows of a hot group split over several tasks. ``df`` is read twice, so pass
    a stored table where it is expensive to compute.
    """
    flagged = df.filter(predicate).select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
    flagged = materialize(flagged.withColumn("_flag", F.lit(1)), "flagged-groups")
    same_group = all_of(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)
    joined = df.join(flagged, same_group, "left")
    return joined.select(*df.columns, F.coalesce("_flag", F.lit(0)).alias(column))
