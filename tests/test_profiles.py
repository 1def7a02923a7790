"""Lookups, profile, filters, search, reports and rules on small frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sojourn.operators import classify as cl
from sojourn.operators import filters as fl
from sojourn.operators import reports as rp
from sojourn.operators import search as se
from sojourn.operators.lookups import Lookup, merge_lookup
from sojourn.plans.profile import profile
from sojourn.plans.reports import ReportFilter
from tests.conftest import rows

AS_OF = "2020-12-31"
STATUSES = {"work": "WORK", "watch": "WATCH"}


@pytest.fixture(scope="module")
def lookups(spark):
    def table(*keys):
        return spark.createDataFrame([(k, f"d{i}") for i, k in enumerate(keys)], "doc string, detail string")

    return [
        Lookup("watch", table("both"), "WATCH", "doc", ["detail"], ["Why: "]),
        Lookup("work", table("both", " worker", "WORKER ", None, ""), "WORK", "doc", ["detail"]),
        Lookup("study", table("labelled", "spaces"), "STUDY", "doc"),
    ]


@pytest.fixture(scope="module")
def profiles(make_stays, lookups):
    stays = make_stays(
        {"subject": "both", "start": "2020-12-01", "end": None, "name": "Ánh Dương", "category": "NGA"},
        {"subject": "worker", "start": "2020-06-01", "end": "2020-06-30", "category": "LAO"},
        {"subject": "labelled", "start": "2020-01-01", "end": "2020-12-31", "label": " CHECKED ", "category": "lao"},
        {"subject": "spaces", "start": "2019-01-01", "end": "2019-02-01", "label": "  ", "category": None},
        {"subject": "none", "start": "2021-02-01", "end": "2021-02-03", "category": "ATLANTIS"},
    )
    return profile(stays, lookups, AS_OF)


def subjects(df):
    return [r[0] for r in rows(df, "subject")]


def test_status_priority_label_and_duplicate_lookup_keys(profiles):
    assert rows(profiles, "subject", "lookup_status", "status") == [
        ("BOTH", "WATCH", "WATCH"), ("LABELLED", "STUDY", "CHECKED"), ("NONE", None, None),
        ("SPACES", "STUDY", "STUDY"), ("WORKER", "WORK", "WORK"),
    ]
    assert rows(profiles.filter("subject in ('BOTH', 'NONE')"), "watch_detail") == [("Why: ",), ("Why: d0",)]


def test_merge_lookup(spark):
    current = spark.createDataFrame([("A", "old"), ("B", "old")], "k string, v string")
    batch = spark.createDataFrame([("a ", "n1", 1), ("c", "n2", 2), ("C", "n3", 3), ("", "n4", 4), (None, "n5", 5)], "k string, v string, at int")
    assert rows(merge_lookup(current, batch, "k", "at", "first")) == [("A", "old"), ("B", "old"), ("C", "n2")]
    assert rows(merge_lookup(current, batch, "k", "at", "last")) == [("A", "n1"), ("B", "old"), ("C", "n3")]


def test_date_filters(profiles):
    def kept(**asked):
        return subjects(profiles.filter(fl.date_filter(AS_OF, **asked)))

    assert kept() == ["BOTH", "LABELLED", "NONE", "SPACES", "WORKER"]
    assert kept(start="2020-06-01", end="2020-12-30") == ["BOTH", "WORKER"]
    assert kept(start="2020-06-01", end="2020-12-30", mode="start_only") == ["BOTH", "WORKER"]
    assert kept(end="2019-12-31") == ["BOTH", "SPACES"]  # open stays pass
    assert kept(end="2019-12-31", mode="start_only") == ["SPACES"]
    assert kept(min_days=31) == ["BOTH", "LABELLED"]  # ended on as_of still counts as open here
    assert kept(end="2019-12-31", min_days=31) == ["BOTH", "LABELLED"]  # min_days replaces the end
    assert kept(end="2019-12-31", min_days=0) == ["BOTH"]  # zero does not, but filters as well
    assert kept(min_days=30, mode="start_only") == ["BOTH", "LABELLED", "WORKER"]


def test_state_filter_boundaries(profiles):
    def kept(state):
        return subjects(profiles.filter(fl.state_filter(state, AS_OF)))

    assert kept(fl.CURRENT) == ["BOTH", "NONE"]  # ended on as_of is not current here
    assert kept(fl.ENDED) == ["LABELLED", "SPACES", "WORKER"]
    assert kept("WORK") == ["WORKER"]
    assert len(kept(None)) == 5
    stats = rp.summary_stats(profiles, STATUSES).first()
    assert stats.open_count == 1  # and the summary counts only missing ends


def test_current_state_lifts_the_date_range(profiles):
    asked = ReportFilter(AS_OF, start="2022-01-01", state=fl.CURRENT)
    assert subjects(profiles.filter(asked.by_start())) == ["BOTH", "NONE"]
    assert subjects(profiles.filter(asked.by_stay())) == []


COMPOSITES = {"ASIA_OCEANIA": ("ASIA", "OCEANIA")}
GROUPS = {"EUROPE": ["NGA"], "AFRICA": ["NGA"], "ASIA": ["LAO"], "OCEANIA": ["FIJI"]}


def spelling_table(spark):
    listed = [(g, i, s) for i, (g, names) in enumerate(GROUPS.items()) for s in names]
    return spark.createDataFrame(listed, "group_name string, group_order int, spelling string")


@pytest.mark.parametrize("asked, expected", [
    ("EUROPE", ["BOTH"]), ("AFRICA", ["BOTH"]), ("ASIA_OCEANIA", ["LABELLED", "WORKER"]),
    (["EUROPE", "AFRICA"], ["BOTH"]), ("ALL", 5), (["ASIA", "ALL"], 5), (None, 5), ("NOWHERE", 5),
])
def test_group_filters_agree(spark, profiles, asked, expected):
    by_list = subjects(profiles.filter(fl.group_filter(asked, GROUPS, composites=COMPOSITES)))
    by_table = subjects(fl.filter_group(profiles, asked, spelling_table(spark), composites=COMPOSITES))
    assert by_list == by_table
    assert by_list == expected or len(by_list) == expected


def test_spelling_in_two_groups_gives_one_row(spark, profiles):
    grouped = cl.category_group(profiles, spelling_table(spark))
    assert rows(grouped, "subject", "group_name") == [
        ("BOTH", "EUROPE"), ("LABELLED", "ASIA"), ("NONE", "OTHER"), ("SPACES", "OTHER"), ("WORKER", "ASIA"),
    ]


def test_empty_summary_is_one_row_of_zeros(profiles):
    assert rows(rp.summary_stats(profiles.filter("false"), STATUSES)) == [(0, 0, 0, 0, 0, 0.0)]


def test_paging(profiles):
    def info(limit, offset):
        return tuple(se.page_info(profiles, limit, offset).first())

    assert info(2, 0) == (5, 2, True, 0, 2)
    assert info(5, 0) == (5, 5, False, 0, 5)
    assert info(3, 3) == (5, 2, False, 3, 3)
    assert info(2, 9) == (5, 0, False, 9, 2)  # the total stays right past the end
    pages = [r.subject for o in (0, 2, 4) for r in se.page(profiles, se.newest_first(), 2, o).collect()]
    assert pages == ["NONE", "BOTH", "WORKER", "LABELLED", "SPACES"]


def test_fuzzy_search(make_stays, lookups):
    stays = make_stays(
        {"subject": "ab 123", "start": "2020-01-01", "name": "He Wuyang"},
        {"subject": "cd456", "start": "2020-02-01", "name": "Ánh Dương"},
        {"subject": "ef789", "start": "2020-03-01", "name": "100% Cotton"},
        {"subject": "gh000", "start": "2020-04-01", "end": "2020-04-02", "name": "He Wuyang", "updated": "2020-01-01"},
        {"subject": "gh000", "start": "2020-05-01", "end": "2020-05-02", "name": "Renamed", "updated": "2020-06-01"},
    )

    def found(keyword, **options):
        return [r.subject for r in se.search_fuzzy(stays, lookups, keyword, AS_OF, **options).collect()]

    assert found("hewu") == ["AB 123"]  # a name since replaced does not count
    assert found("b1 23") == ["AB 123"]
    assert found(" x") == [] and found("h") == []
    assert found("Ánh Dương") == ["CD456"]
    assert found("anh duong") == [] and found("anh duong", accent_insensitive=True) == ["CD456"]
    assert found("0%") == ["EF789"] and found("1_0") == []  # wildcards are plain text
    assert found("00", limit=1) == ["GH000"]


def test_fuzzy_search_without_limit(make_stays, lookups):
    stays = make_stays(*[{"subject": f"k{i:03d}", "start": "2020-01-01", "name": f"name {i}"} for i in range(130)])
    assert se.search_fuzzy(stays, lookups, "name 1", AS_OF).count() == 41
    assert se.search_fuzzy(stays, lookups, "name", AS_OF).count() == 100
    assert se.search_fuzzy(stays, lookups, "name", AS_OF, limit=None).count() == 130


def test_batch_search_has_no_cut(spark, make_stays, lookups):
    stays = make_stays(*[{"subject": f"k{i}", "start": "2020-01-01"} for i in range(0, 1500, 3)])
    keys = spark.range(1500).selectExpr("id as pos", "concat('K', id) as key")
    page, info = se.search_batch(stays, lookups, keys, AS_OF, [], limit=10)
    assert page.count() == 10 and info.first()["total"] == 500
    assert se.search_batch_all(stays, lookups, keys, AS_OF, priority=[]).count() == 500


def test_page_after_follows_page(make_stays):
    stays = make_stays(*[{"subject": f"k{i:02d}", "start": f"2020-01-{1 + i % 3:02d}"} for i in range(30)])
    first = [(r.start_date, r.subject) for r in se.page(stays, se.newest_first(), 12).collect()]
    after = [(r.start_date, r.subject) for r in se.page_after(stays, first[6][0], first[6][1], 5).collect()]
    assert after == first[7:12]


def test_batch_search(spark, make_stays, lookups):
    stays = make_stays(*[{"subject": s, "start": "2020-01-01"} for s in ("worker", "both", "other", "more")])
    keys = spark.createDataFrame([(1, "mo-re"), (2, "WORKER"), (3, "none"), (4, "more"), (5, ""), (6, "both")], "pos int, key string")
    assert rows(se.distinct_keys(keys, "key", "pos")) == [("BOTH", 6), ("MORE", 1), ("NONE", 3), ("WORKER", 2)]
    assert rows(se.distinct_keys(keys, "key", "pos", 2)) == [("MORE", 1), ("WORKER", 2)]
    page, info = se.search_batch(stays, lookups, keys, AS_OF, ["WATCH", "WORK"], limit=2)
    assert [r.subject for r in page.collect()] == ["BOTH", "WORKER"]
    assert tuple(info.first()) == (3, 2, True, 0, 2)
    assert rows(se.keys_not_found(keys, stays)) == [("NONE",)]


def test_group_flag_treats_nulls_as_one_group(spark):
    df = spark.createDataFrame(
        [(1, "a", None, True), (2, "a", None, False), (3, None, None, False), (4, None, None, True), (5, "b", None, False), (6, "a", "x", False)],
        "id int, p string, q string, minor boolean",
    )
    flagged = cl.group_flag(df, ["p", "q"], F.col("minor"))
    assert rows(flagged, "id", "group_flag") == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 0), (6, 0)]


def test_scores_levels_reasons(spark):
    scoring = cl.Scoring(
        bands=[cl.at_least("days", [(8, 1), (30, 2), (90, 3)]), cl.at_least("visits", [(3, 1), (5, 2)]), cl.at_least("extra", [(1, 1)])],
        levels=[(6, "HIGH"), (3, "MEDIUM")], lowest="LOW",
        reasons=[[(F.col("days") >= 30, "long")], [(F.col("visits") >= 3, "often")]], default_reason="several",
    )
    df = spark.createDataFrame(
        [(1, 7, 2, 0), (2, 8, 2, 0), (3, 29, 3, 0), (4, 30, 4, 0), (5, 89, 5, 0), (6, 90, 5, 1)], "id int, days int, visits int, extra int"
    )
    top = cl.rule_score(df, scoring, "id")
    assert rows(top, "id", "score", "level", "reason") == [
        (2, 1, "LOW", "several"), (3, 2, "LOW", "often"), (4, 3, "MEDIUM", "long; often"),
        (5, 4, "MEDIUM", "long; often"), (6, 6, "HIGH", "long; often"),
    ]
    assert rows(cl.rule_score(df, scoring, "id", limit=1, only_level="MEDIUM"), "id") != []  # level before limit


def test_matrix_shares_use_all_rows_and_totals_the_shown(spark):
    decided = spark.createDataFrame([(c,) for c in "a" * 5 + "b" * 3 + "c" * 2], "category string")
    total = decided.agg(F.count(F.lit(1)).alias("total"))
    shown = rp.matrix(decided, total, {"x": F.col("category") == "a"}, limit=2)
    assert rows(shown, "category", "n", "x", "percent") == [("A", 5, 5, 50.0), ("B", 3, 0, 30.0)]
    assert rows(rp.matrix_totals(shown, ["x"])) == [(8, 5, 2)]
    assert rows(rp.matrix_totals(shown.filter("false"), ["x"])) == [(0, 0, 0)]


def test_narratives(spark):
    counts = spark.createDataFrame([("Work", "B", 9), ("Work", "A", 120), ("Other", "C", 10)], "label_group string, category string, n long")
    assert rows(rp.narrative_by_label(counts, ["Other", "Work"])) == [
        (1, "Other: C: 10 people. Total: 10 people."), (2, "Work: A: 120 people; B: 09 people. Total: 129 people."),
    ]
    stats = spark.createDataFrame([(1234, 2, 0, 5, 7, 1.5)], "total long, categories long, work long, watch long, open_count long, avg_days double")
    top = spark.createDataFrame([("A", 1200, 3), ("B", 34, 4)], "category string, n long, open_count long")
    lines = [r.text for r in rp.narrative(stats, top, STATUSES, "2020-01-01", None, 30, top_n=1).orderBy("line_no").collect()]
    assert lines == [
        "Period: from 01/01/2020 (total days >= 30)", "Total: 1,234 people", "- From 2 categories", "- Still open: 7",
        "- Average days: 1.5", "By status:", "- WATCH: 5", "Top categories:", "1. A: 1,200 (still open: 3)",
    ]


def test_last_update_and_counts(spark, make_stays):
    stays = make_stays({"updated": "2020-05-06T07:08:09"}, {"updated": "2019-01-01"})
    assert rows(rp.last_update(stays)) == [("06/05/2020 07:08",)]
    assert rows(rp.last_update(stays.filter("false"))) == [("no data",)]
    assert rows(rp.table_counts({"stays": stays}, ["stays"])) == [("stays", 2)]
    with pytest.raises(ValueError):
        rp.table_counts({"stays": stays}, ["other"])
    assert rows(rp.report_rows(make_stays({"start": "2020-02-01"}), {"start_date": "Start", "end_date": "End"})) == [("01/02/2020", None)]
