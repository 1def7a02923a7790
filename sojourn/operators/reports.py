"""Grouped statistics, matrix, report rows and short texts over profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sojourn.functions.dates import AsOf, format_date
from sojourn.operators.classify import Rules, first_match
from sojourn.schema import END, START, UPDATED

def is_open() -> Column:
    return F.col(END).isNull()


def summary_stats(profiles: DataFrame, statuses: Mapping[str, str]) -> DataFrame:
    """One row of totals; zeros for no input. ``statuses`` maps output columns to status values."""
    per_status = [F.count_if(F.col("status") == s).alias(name) for name, s in statuses.items()]
    return profiles.agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct("category").alias("categories"),
        *per_status,
        F.count_if(is_open()).alias("open_count"),
        F.round(F.coalesce(F.avg("days_1y"), F.lit(0.0)), 1).alias("avg_days"),
    )


def stats_by(profiles: DataFrame, column: str = "category", limit: int | None = 20) -> DataFrame:
    """Largest groups with how many of their rows are open; all groups if ``limit`` is None."""
    grouped = profiles.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_open()).alias("open_count"))
    ordered = grouped.orderBy(F.desc("n"), F.asc_nulls_last(column))
    return ordered if limit is None else ordered.limit(limit)


def label_by_category(profiles: DataFrame, groups: Rules, column: str = "category") -> DataFrame:
    """Counts per (label group, category). Rows that fit no label group are left out."""
    labelled = profiles.withColumn("label_group", first_match(groups)).filter(F.col("label_group").isNotNull())
    return labelled.groupBy("label_group", column).agg(F.count(F.lit(1)).alias("n"))


def narrative_by_label(counts: DataFrame, order: Sequence[str], column: str = "category", unit: str = "people") -> DataFrame:
    """One line per label group, in the given order: categories by falling count, and the total.

    Works on ``label_by_category`` output, so a line gathers categories, never rows.
    """
    padded = F.when(F.col("n") < 10, F.concat(F.lit("0"), F.col("n").cast("string"))).otherwise(F.col("n").cast("string"))
    item = F.concat(F.coalesce(column, F.lit("None")), F.lit(": "), padded, F.lit(f" {unit}"))
    ranked = F.struct((-F.col("n")).alias("rank"), F.col(column).alias("tie"), item.alias("item"))
    lines = counts.groupBy("label_group").agg(
        F.sort_array(F.collect_list(ranked)).alias("items"), F.sum("n").alias("total")
    )
    text = F.concat(
        F.col("label_group"), F.lit(": "), F.array_join(F.col("items.item"), "; "),
        F.lit(". Total: "), F.col("total").cast("string"), F.lit(f" {unit}."),
    )
    place = F.array_position(F.lit(list(order)), F.col("label_group"))
    return lines.select(place.cast("int").alias("line_no"), text.alias("text")).filter("line_no > 0")


def narrative(
    stats: DataFrame,
    top: DataFrame,
    statuses: Mapping[str, str],
    start: AsOf | None = None,
    end: AsOf | None = None,
    min_days: int | None = None,
    top_n: int = 5,
    column: str = "category",
) -> DataFrame:
    """Lines (line_no, text) of a short report on ``summary_stats`` and ``stats_by`` output.

    Lines that do not apply are absent: the period without dates, a status without rows, the list of
    groups without groups. Both inputs are already aggregated, so this handles tens of rows.
    """
    def number(c: str | Column) -> Column:
        return F.format_number(c, 0)

    period = " ".join(
        p for p in (start and f"from {_day(start)}", end and f"to {_day(end)}") if p
    ) + (f" (total days >= {min_days})" if min_days else "")
    lines: list[tuple[int, Column]] = []
    if period:
        lines.append((10, F.lit(f"Period: {period}")))
    lines += [
        (20, F.concat(F.lit("Total: "), number("total"), F.lit(" people"))),
        (30, F.concat(F.lit("- From "), F.col("categories").cast("string"), F.lit(" categories"))),
        (40, F.concat(F.lit("- Still open: "), number("open_count"))),
        (50, F.concat(F.lit("- Average days: "), F.format_string("%.1f", "avg_days"))),
        (60, F.lit("By status:")),
    ]
    for i, (name, status) in enumerate(statuses.items()):
        lines.append((70 + i, F.when(F.col(name) > 0, F.concat(F.lit(f"- {status}: "), number(name)))))
    rows = F.array(*[F.struct(F.lit(no).alias("line_no"), text.alias("text")) for no, text in lines])
    head = stats.select(F.inline(rows)).filter(F.col("text").isNotNull())

    # ``top`` holds at most its own limit of rows, so one partition is enough to number them.
    ranked = W.orderBy(F.desc("n"), F.asc_nulls_last(column))
    numbered = top.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_n)
    entry = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.coalesce(column, F.lit("None")), F.lit(": "), number("n"),
        F.lit(" (still open: "), F.col("open_count").cast("string"), F.lit(")"),
    )
    title = F.when(F.col("rank") == 1, F.struct(F.lit(200).alias("line_no"), F.lit("Top categories:").alias("text")))
    body = F.struct((F.col("rank") + 200).alias("line_no"), entry.alias("text"))
    return head.unionByName(numbered.select(F.inline(F.array_compact(F.array(title, body)))))


def _day(value: AsOf) -> str:
    text = str(value)
    return f"{text[8:10]}/{text[5:7]}/{text[:4]}"


def matrix(
    decided: DataFrame,
    grand_total: DataFrame,
    classes: Mapping[str, Column],
    column: str = "category",
    limit: int | None = 50,
    unknown: str = "UNKNOWN",
) -> DataFrame:
    """Category by class counts with each category's share of all rows; the largest categories, or all if ``limit`` is None.

    ``grand_total`` is one row with ``total``, counted over every category. It is the only side this
    library broadcasts unchecked by size, being an aggregate without keys.
    """
    name = F.upper(F.trim(F.coalesce(column, F.lit(unknown))))
    counted = decided.groupBy(name.alias(column)).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(is_class).alias(c) for c, is_class in classes.items()]
    )
    share = F.round(F.col("n").cast("double") * 100 / F.nullif(F.col("total"), F.lit(0)), 2)
    joined = counted.crossJoin(F.broadcast(grand_total))
    ranked = joined.withColumn("percent", share).drop("total")
    ordered = ranked.orderBy(F.desc("n"), F.asc(column))
    return ordered if limit is None else ordered.limit(limit)


def matrix_totals(rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Sums over the given categories: all of them for a matrix without limit, else those shown."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *classes)]
    return rows.agg(*sums, F.count(F.lit(1)).alias("categories"))


def report_rows(profiles: DataFrame, headings: Mapping[str, str], date_columns: Sequence[str] = ("birth_date", START, END)) -> DataFrame:
    """Columns under their display names, dates as day/month/year text."""
    return profiles.select(
        *[(format_date(F.col(c)) if c in date_columns else F.col(c)).alias(h) for c, h in headings.items()]
    )


def report_metrics(stats: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """The one row of totals as (position, metric, value) rows."""
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("metric"), F.col(c).cast("double").alias("value"))
        for i, (c, label) in enumerate(labels.items(), 1)
    ]
    return stats.select(F.inline(F.array(*rows)))


def report_by_category(top: DataFrame, column: str = "category") -> DataFrame:
    """``stats_by`` output with a running index; its own limit bounds the one partition used."""
    ranked = W.orderBy(F.desc("n"), F.asc_nulls_last(column))
    return top.select(F.row_number().over(ranked).alias("position"), column, "n", "open_count")


def last_update(stays: DataFrame, empty: str = "no data") -> DataFrame:
    """Time of the newest version as text."""
    newest = F.date_format(F.max(UPDATED), "dd/MM/yyyy HH:mm")
    return stays.agg(F.coalesce(newest, F.lit(empty)).alias("last_update"))


def table_counts(tables: Mapping[str, DataFrame], allowed: Sequence[str]) -> DataFrame:
    """Row count per table; only tables on the allow-list may be asked for."""
    refused = sorted(set(tables) - set(allowed))
    if refused:
        raise ValueError(f"not allowed: {', '.join(refused)}")
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts
