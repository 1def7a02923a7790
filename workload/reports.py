"""Filters, statistics, paging and report parts over the profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from sojourn.functions.text import contains_any
from sojourn.operators import filters as fl
from sojourn.operators import reports as rp
from sojourn.operators.search import page_after, page_info
from sojourn.plans import reports as pr
from sojourn.session import materialize, scratch_dir
from sojourn.sources.files import read_csv, write_report
from workload.intervals import profiles
from workload.tables import AS_OF, AS_OF_SQL, STATUSES, spellings, sql, stays, table

FROM, TO = "1998-01-01", "2000-12-31"
#: A group code that stands for two groups.
COMPOSITES = {"ASIA_OCEANIA": ("ASIA", "OCEANIA")}
NATIONS = {
    "AFRICA": ["NATION_0", "NATION_5", "NATION_10", "NATION_15", "NATION_20"],
    "ASIA": ["NATION_2", "NATION_7", "NATION_12", "NATION_17", "NATION_22"],
    "OCEANIA": ["NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_4"],
}
HEADINGS = {
    "name": "Name", "birth_date": "Born", "category": "Category", "subject": "Subject", "start_date": "Start",
    "end_date": "End", "place": "Places", "arrivals_1y": "Arrivals", "days_1y": "Days in year",
    "days_lifetime": "Days in all", "status": "Status", "verified_label": "Verified",
}
METRICS = {
    "total": "Total", "categories": "Categories", "open_count": "Still open", "work": "WORK", "family": "FAMILY",
    "study": "STUDY", "attention": "ATTENTION", "avg_days": "Average days",
}
LABELS = ["Work", "Family and visits"]


def brief(df):
    return df.select("subject", "category", "start_date", "end_date", "days_1y", "status")


def where(conditions):
    """Query for profiles that satisfy all conditions, which are built once a session runs."""
    return lambda spark, sf: brief(profiles(spark, sf).filter(fl.all_of(conditions())))


def stats(spark, sf):
    return rp.summary_stats(profiles(spark, sf), STATUSES)


def stats_empty(spark, sf):
    """No profile lasts that long: still one row, of zeros."""
    return rp.summary_stats(profiles(spark, sf).filter(fl.days_filter(100_000)), STATUSES)


def top_categories(spark, sf):
    return rp.stats_by(profiles(spark, sf), "category", 10)


def label_groups():
    status = F.col("status")
    return [(contains_any(status, ["work"]), LABELS[0]), (contains_any(status, ["family", "review"]), LABELS[1])]


def label_counts(spark, sf):
    return rp.label_by_category(profiles(spark, sf), label_groups())


ASKED = pr.ReportFilter(AS_OF, start=FROM, end=TO)
CURRENT_ONLY = pr.ReportFilter(AS_OF, start=FROM, end=TO, groups="AFRICA", spellings=NATIONS, state=fl.CURRENT)


def narrative(spark, sf):
    return pr.narrative(profiles(spark, sf), ASKED, STATUSES)


def person_page(spark, sf):
    return brief(pr.person_list(profiles(spark, sf), pr.ReportFilter(AS_OF, start=FROM), 200, 400)[0])


def current_by_label(spark, sf):
    """Current stays of one group; the date range does not apply to them."""
    return pr.narrative_by_label(profiles(spark, sf), CURRENT_ONLY, label_groups(), LABELS)


def person_page_after(spark, sf):
    kept = profiles(spark, sf).filter(pr.ReportFilter(AS_OF, start=FROM).by_stay())
    return brief(page_after(kept, "2001-03-31", "CUSTOMER#000000050", 200))


def written_report(spark, sf):
    """The three report parts as written to files and read again: every row of each part."""
    path = scratch_dir(spark, "report")
    kept = materialize(profiles(spark, sf).filter(ASKED.by_stay()), "report-input")
    metrics = rp.report_metrics(rp.summary_stats(kept, STATUSES), METRICS)
    write_report(path, metrics, rp.report_by_category(rp.stats_by(kept, limit=None)), rp.report_rows(kept, HEADINGS))
    shown = {
        "metrics": (F.col("metric"), F.col("value").cast("double").cast("bigint").cast("string")),
        "by_category": (F.col("category"), F.concat_ws("/", "n", "open_count")),
        "details": (F.col("Subject"), F.concat_ws("/", "Start", "Status", "Places")),
    }
    parts = None
    for part, (key, value) in shown.items():
        rows = read_csv(spark, f"{path}/{part}").select(F.lit(part).alias("part"), key.alias("key"), value.alias("value"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def table_counts(spark, sf):
    names = ["customer", "orders", "lineitem", "part"]
    return rp.table_counts({n: table(spark, sf, n) for n in names}, names)


QUERIES = {
    "filter_dates": where(lambda: [fl.date_filter(AS_OF, FROM, TO)]),
    "filter_min_days": where(lambda: [fl.date_filter(AS_OF, end=TO, min_days=60)]),
    "filter_min_days_zero": where(lambda: [fl.date_filter(AS_OF, end=TO, min_days=0)]),
    "filter_dates_strict": where(lambda: [fl.date_filter(AS_OF, FROM, TO, mode="start_only")]),
    "filter_category_group": lambda s, d: brief(fl.filter_group(profiles(s, d), ["ASIA_OCEANIA", "EUROPE"], spellings(s, d), composites=COMPOSITES)),
    "filter_category_list": where(lambda: [fl.group_filter(["AFRICA", "OCEANIA"], NATIONS)]),
    "filter_state_current": where(lambda: [fl.state_filter(fl.CURRENT, AS_OF)]),
    "filter_state_ended": where(lambda: [fl.state_filter(fl.ENDED, AS_OF)]),
    "filter_state": where(lambda: [fl.state_filter("WORK", AS_OF)]),
    "filter_days_op": where(lambda: [fl.days_filter(40, "<=")]),
    "filters_combined": where(lambda: [
        fl.date_filter(AS_OF, FROM, min_days=20), fl.group_filter("AFRICA", NATIONS),
        fl.days_filter(200, "<="), fl.state_filter(fl.CURRENT, AS_OF),
    ]),
    "summary_stats": stats,
    "summary_stats_empty": stats_empty,
    "stats_by_category": lambda s, d: rp.stats_by(profiles(s, d)),
    "stats_by_label_category": label_counts,
    "person_page": person_page,
    "person_page_after": person_page_after,
    "page_info": lambda s, d: page_info(profiles(s, d).filter(fl.date_filter(AS_OF, FROM)), 200, 400),
    "page_past_end": lambda s, d: page_info(profiles(s, d), 200, 10_000_000),
    "report_rows": lambda s, d: rp.report_rows(profiles(s, d), HEADINGS),
    "report_metrics": lambda s, d: rp.report_metrics(stats(s, d), METRICS),
    "report_by_category": lambda s, d: rp.report_by_category(top_categories(s, d)),
    "narrative_lines": narrative,
    "narrative_current": current_by_label,
    "report_files": written_report,
    "narrative_by_label": lambda s, d: rp.narrative_by_label(label_counts(s, d), LABELS),
    "last_update": lambda s, d: rp.last_update(stays(s, d)),
    "table_counts": table_counts,
}

_BRIEF = "SELECT subject, category, start_date, end_date, days_1y, status FROM prof"


def _where(condition: str) -> str:
    return sql(f"{_BRIEF} WHERE {condition}", "prof")


_IN = "'NATION_0','NATION_5','NATION_10','NATION_15','NATION_20'"
_COUNTS = """count(*) AS total, count(DISTINCT category) AS categories,
  count(*) FILTER (WHERE status = 'ATTENTION') AS attention, count(*) FILTER (WHERE status = 'WORK') AS work,
  count(*) FILTER (WHERE status = 'FAMILY') AS family, count(*) FILTER (WHERE status = 'STUDY') AS study,
  count(*) FILTER (WHERE end_date IS NULL) AS open_count, round(coalesce(avg(days_1y), 0.0), 1) AS avg_days"""
_TOP = "SELECT category, count(*) AS n, count(*) FILTER (WHERE end_date IS NULL) AS open_count FROM {} GROUP BY category ORDER BY n DESC, category LIMIT {}"
_LABELLED = """SELECT CASE WHEN lower(status) LIKE '%work%' THEN 'Work'
    WHEN lower(status) LIKE '%family%' OR lower(status) LIKE '%review%' THEN 'Family and visits' END AS label_group,
    category, count(*) AS n FROM prof WHERE label_group IS NOT NULL GROUP BY ALL"""

_LINES = """SELECT CASE label_group WHEN 'Work' THEN 1 ELSE 2 END AS line_no,
  label_group || ': ' || string_agg(category || ': ' || CASE WHEN n < 10 THEN '0' ELSE '' END || n || ' people', '; '
    ORDER BY n DESC, category) || '. Total: ' || CAST(sum(n) AS BIGINT) || ' people.' AS text
  FROM labelled GROUP BY label_group"""

ORACLES = {
    "filter_dates": _where(f"start_date >= DATE '{FROM}' AND (end_date IS NULL OR end_date <= DATE '{TO}')"),
    "filter_min_days": _where(f"days_1y >= 60 AND (end_date IS NULL OR end_date >= {AS_OF_SQL})"),
    "filter_min_days_zero": _where(
        f"days_1y >= 0 AND (end_date IS NULL OR end_date >= {AS_OF_SQL}) AND (end_date IS NULL OR end_date <= DATE '{TO}')"
    ),
    "filter_dates_strict": _where(f"start_date BETWEEN DATE '{FROM}' AND DATE '{TO}'"),
    "filter_category_group": sql(
        f"{_BRIEF} WHERE category IN (SELECT spelling FROM spell WHERE group_name IN ('ASIA', 'OCEANIA', 'EUROPE'))",
        "prof", "spell",
    ),
    "filter_category_list": _where(f"category IN ({_IN},'NATION_1','NATION_2','NATION_3','NATION_4')"),
    "filter_state_current": _where(f"end_date IS NULL OR end_date > {AS_OF_SQL}"),
    "filter_state_ended": _where(f"end_date <= {AS_OF_SQL}"),
    "filter_state": _where("status = 'WORK'"),
    "filter_days_op": _where("days_1y <= 40"),
    "filters_combined": _where(
        f"""start_date >= DATE '{FROM}' AND days_1y >= 20 AND (end_date IS NULL OR end_date >= {AS_OF_SQL})
        AND category IN ({_IN}) AND days_1y <= 200 AND (end_date IS NULL OR end_date > {AS_OF_SQL})"""
    ),
    "summary_stats": sql(f"SELECT {_COUNTS} FROM prof", "prof"),
    "summary_stats_empty": sql(f"SELECT {_COUNTS} FROM prof WHERE days_1y >= 100000", "prof"),
    "stats_by_category": sql(_TOP.format("prof", 20), "prof"),
    "stats_by_label_category": sql(_LABELLED, "prof"),
    "person_page": sql(f"{_BRIEF} WHERE start_date >= DATE '{FROM}' ORDER BY start_date DESC NULLS LAST, subject LIMIT 200 OFFSET 400", "prof"),
    "person_page_after": sql(
        f"""{_BRIEF} WHERE start_date >= DATE '{FROM}' AND (start_date < DATE '2001-03-31'
          OR (start_date = DATE '2001-03-31' AND subject > 'CUSTOMER#000000050'))
        ORDER BY start_date DESC, subject LIMIT 200""", "prof",
    ),
    "page_info": sql(
        f"""SELECT count(*) AS total, CAST(greatest(least(count(*) - 400, 200), 0) AS BIGINT) AS page_rows,
        count(*) > 600 AS has_more, CAST(400 AS BIGINT) AS "offset", CAST(200 AS BIGINT) AS "limit"
        FROM prof WHERE start_date >= DATE '{FROM}'""", "prof",
    ),
    "page_past_end": sql(
        """SELECT count(*) AS total, CAST(greatest(least(count(*) - 10000000, 200), 0) AS BIGINT) AS page_rows,
        count(*) > 10000200 AS has_more, CAST(10000000 AS BIGINT) AS "offset", CAST(200 AS BIGINT) AS "limit" FROM prof""",
        "prof",
    ),
    "report_rows": sql(
        """SELECT name AS "Name", strftime(birth_date, '%d/%m/%Y') AS "Born", category AS "Category", subject AS "Subject",
        strftime(start_date, '%d/%m/%Y') AS "Start", strftime(end_date, '%d/%m/%Y') AS "End", place AS "Places",
        arrivals_1y AS "Arrivals", days_1y AS "Days in year", days_lifetime AS "Days in all", status AS "Status",
        verified_label AS "Verified" FROM prof""", "prof",
    ),
    "report_metrics": sql(
        """SELECT CAST(m.p AS INTEGER) AS position, m.n AS metric, m.v AS value FROM (SELECT unnest([
          {'p': 1, 'n': 'Total', 'v': total::DOUBLE}, {'p': 2, 'n': 'Categories', 'v': categories::DOUBLE},
          {'p': 3, 'n': 'Still open', 'v': open_count::DOUBLE}, {'p': 4, 'n': 'WORK', 'v': work::DOUBLE},
          {'p': 5, 'n': 'FAMILY', 'v': family::DOUBLE}, {'p': 6, 'n': 'STUDY', 'v': study::DOUBLE},
          {'p': 7, 'n': 'ATTENTION', 'v': attention::DOUBLE}, {'p': 8, 'n': 'Average days', 'v': avg_days}]) AS m
        FROM totals)""", "prof", totals=f"SELECT {_COUNTS} FROM prof",
    ),
    "report_by_category": sql(
        "SELECT CAST(row_number() OVER (ORDER BY n DESC, category) AS INTEGER) AS position, * FROM top",
        "prof", top=_TOP.format("prof", 10),
    ),
    "narrative_lines": sql(
        """SELECT 10 AS line_no, 'Period: from 01/01/1998 to 31/12/2000' AS text
        UNION ALL SELECT 20, format('Total: {:,} people', total) FROM totals
        UNION ALL SELECT 30, format('- From {} categories', categories) FROM totals
        UNION ALL SELECT 40, format('- Still open: {:,}', open_count) FROM totals
        UNION ALL SELECT 50, format('- Average days: {:.1f}', avg_days) FROM totals
        UNION ALL SELECT 60, 'By status:'
        UNION ALL SELECT 70, format('- ATTENTION: {:,}', attention) FROM totals WHERE attention > 0
        UNION ALL SELECT 71, format('- WORK: {:,}', work) FROM totals WHERE work > 0
        UNION ALL SELECT 72, format('- FAMILY: {:,}', family) FROM totals WHERE family > 0
        UNION ALL SELECT 73, format('- STUDY: {:,}', study) FROM totals WHERE study > 0
        UNION ALL SELECT 200, 'Top categories:' FROM top HAVING count(*) > 0
        UNION ALL SELECT CAST(200 + rn AS INTEGER), format('{}. {}: {:,} (still open: {})', rn, category, n, open_count)
          FROM (SELECT *, row_number() OVER (ORDER BY n DESC, category) AS rn FROM top) WHERE rn <= 5""",
        "prof",
        kept=f"FROM prof WHERE start_date >= DATE '{FROM}' AND (end_date IS NULL OR end_date <= DATE '{TO}')",
        totals=f"SELECT {_COUNTS} FROM kept", top=_TOP.format("kept", 10),
    ),
    "narrative_by_label": sql(_LINES, "prof", labelled=_LABELLED),
    "narrative_current": sql(_LINES, "prof", labelled=_LABELLED.replace(
        "WHERE", f"WHERE category IN ({_IN}) AND (end_date IS NULL OR end_date > {AS_OF_SQL}) AND"
    )),
    "report_files": sql(
        """SELECT 'metrics' AS part, m.n AS key, CAST(CAST(trunc(m.v) AS BIGINT) AS VARCHAR) AS value FROM (SELECT unnest([
          {'n': 'Total', 'v': total::DOUBLE}, {'n': 'Categories', 'v': categories::DOUBLE}, {'n': 'Still open', 'v': open_count::DOUBLE},
          {'n': 'WORK', 'v': work::DOUBLE}, {'n': 'FAMILY', 'v': family::DOUBLE}, {'n': 'STUDY', 'v': study::DOUBLE},
          {'n': 'ATTENTION', 'v': attention::DOUBLE}, {'n': 'Average days', 'v': avg_days}]) AS m FROM totals)
        UNION ALL SELECT 'by_category', category, n || '/' || open_count FROM top
        UNION ALL SELECT 'details', subject, concat_ws('/', strftime(start_date, '%d/%m/%Y'), status, place) FROM kept""", "prof",
        kept=f"FROM prof WHERE start_date >= DATE '{FROM}' AND (end_date IS NULL OR end_date <= DATE '{TO}')",
        totals=f"SELECT {_COUNTS} FROM kept", top=_TOP.format("kept", 100_000),
    ),
    "last_update": sql(
        "SELECT coalesce(strftime(max(updated_at), '%d/%m/%Y %H:%M'), 'no data') AS last_update FROM stays", "stays"
    ),
    "table_counts": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in ("customer", "orders", "lineitem", "part")
    ),
}
