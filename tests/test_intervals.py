"""Versions, islands and counts on hand-made rows, and properties on random ones."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sojourn.operators import intervals as iv
from tests.conftest import day, rows

AS_OF = "2020-12-31"


def island_rows(stays, as_of=AS_OF, **options):
    return iv.islands(iv.island_tags(iv.dedup_latest(stays), as_of), as_of, **options)


def test_overlap_contained_touching_gap_single(make_stays):
    stays = make_stays(
        {"start": "2020-01-01", "end": "2020-01-10"},
        {"start": "2020-01-03", "end": "2020-01-04"},  # contained
        {"start": "2020-01-08", "end": "2020-01-12"},  # overlaps
        {"start": "2020-01-13", "end": "2020-01-14"},  # touches: next day
        {"start": "2020-01-16", "end": "2020-01-17"},  # two days later: new island
        {"subject": "P2", "start": "2020-05-01", "end": "2020-05-02"},
    )
    assert rows(island_rows(stays), "subject", "island_id", "island_start", "island_end_real") == [
        ("P1", 1, day("2020-01-01"), day("2020-01-14")),
        ("P1", 2, day("2020-01-16"), day("2020-01-17")),
        ("P2", 1, day("2020-05-01"), day("2020-05-02")),
    ]


def test_null_start_comes_last_and_joins_the_final_island(make_stays):
    stays = make_stays(
        {"start": None, "end": "2020-09-01"},
        {"start": "2020-01-01", "end": "2020-01-02"},
        {"start": "2020-03-01", "end": "2020-03-02"},
        {"subject": "P2", "start": None, "end": None},
    )
    assert rows(island_rows(stays), "subject", "island_id", "island_start", "island_end_eff") == [
        ("P1", 1, day("2020-01-01"), day("2020-01-02")),
        ("P1", 2, day("2020-03-01"), day("2020-09-01")),
        ("P2", 1, None, day(AS_OF)),
    ]


def test_open_row_in_a_closed_island(make_stays):
    stays = make_stays({"start": "2020-01-01", "end": None}, {"start": "2020-01-02", "end": "2020-01-05"})
    assert rows(island_rows(stays), "island_end_eff", "island_end_real") == [(day("2020-01-05"), day("2020-01-05"))]
    late = island_rows(stays, open_island="max_effective")
    assert rows(late, "island_end_eff", "island_end_real") == [(day(AS_OF), day("2020-01-05"))]
    with pytest.raises(ValueError):
        island_rows(stays, open_island="other")


def test_latest_version_wins(make_stays):
    stays = make_stays(
        {"subject": " p1", "start": "2020-01-01", "end": "2020-01-09", "updated": "2020-01-01"},
        {"subject": "P1 ", "start": "2020-01-01", "end": "2020-01-05", "updated": "2020-02-01"},
        {"subject": "P2", "start": "2020-01-01", "end": None},
        {"subject": "P2", "start": "2020-01-01", "end": "2020-01-03"},
        {"subject": "P2", "start": "2020-01-01", "end": "2020-01-02"},
        {"subject": "P3", "start": "2020-01-01", "end": "2020-01-02", "place": "A"},
        {"subject": "P3", "start": "2020-01-01", "end": "2020-01-02", "place": "B"},
        {"subject": "  ", "start": "2020-01-01"},
        {"subject": None, "start": "2020-01-01"},
    )
    assert rows(iv.dedup_latest(stays), "subject", "end_date", "place") == [
        ("P1", day("2020-01-05"), "X"), ("P2", day("2020-01-03"), "X"), ("P3", day("2020-01-02"), "B"),
    ]


def test_places_and_newest_label(make_stays):
    stays = make_stays(
        {"start": "2020-01-01", "end": "2020-01-05", "place": "b", "label": "old", "updated": "2020-01-01"},
        {"start": "2020-01-02", "end": "2020-01-05", "place": "a", "label": None, "updated": "2020-03-01"},
        {"start": "2020-01-03", "end": "2020-01-05", "place": "b", "label": "mid", "updated": "2020-02-01"},
        {"subject": "P2", "start": "2020-01-03", "end": "2020-01-05", "place": None},
    )
    assert rows(island_rows(stays), "subject", "island_places", "island_label") == [("P1", "a | b", None), ("P2", None, None)]


def test_day_counts(make_stays):
    stays = make_stays(
        {"subject": "past", "start": "2018-01-01", "end": "2018-01-10"},
        {"subject": "straddle", "start": "2019-12-01", "end": "2020-01-10"},
        {"subject": "open", "start": "2020-12-30", "end": None},
        {"subject": "future", "start": "2021-01-10", "end": "2021-01-20"},
    )
    found = iv.days_in_window(island_rows(stays), AS_OF).join(iv.days_lifetime(island_rows(stays), AS_OF), "subject")
    # The window starts 2020-01-01; an island after as_of counts negative, as validation keeps those out.
    assert rows(found) == [("FUTURE", -9, -9), ("OPEN", 2, 2), ("PAST", 0, 10), ("STRADDLE", 10, 41)]
    arrived = iv.arrivals(iv.dedup_latest(stays), AS_OF)
    assert rows(arrived) == [("FUTURE", 1), ("OPEN", 1), ("PAST", 0), ("STRADDLE", 0)]


def test_latest_island_and_person(make_stays):
    stays = make_stays(
        {"start": "2020-01-01", "end": "2020-12-01", "name": "late update", "updated": "2020-12-01"},
        {"start": "2020-12-10", "end": "2020-12-11", "name": "late start", "updated": "2020-06-01"},
    )
    assert rows(iv.latest_island(island_rows(stays)), "subject", "island_start") == [("P1", day("2020-12-10"))]
    assert rows(iv.person_latest(iv.dedup_latest(stays)), "name") == [("late update",)]


@pytest.fixture(scope="module")
def random_stays(make_stays):
    dice = random.Random(7)
    made = []
    for _ in range(400):
        start = dt.date(2019, 1, 1) + dt.timedelta(days=dice.randrange(700))
        end = start + dt.timedelta(days=dice.randrange(12))
        made.append({
            "subject": f"S{dice.choice([0, 0, 0, *range(30)])}",  # one subject holds many rows
            "start": start.isoformat(), "end": None if dice.random() < 0.02 else end.isoformat(),
            "updated": f"2020-0{dice.randrange(1, 9)}-01", "place": dice.choice("abc"), "name": dice.choice("xyz"),
        })
    return make_stays(*made)


def test_islands_match_a_day_by_day_count(random_stays):
    versions = iv.dedup_latest(random_stays).collect()
    as_of = day(AS_OF)
    expected = set()
    for subject in {v.subject for v in versions}:
        covered = set()
        for v in versions:
            if v.subject == subject:
                last = v.end_date or as_of
                covered |= {v.start_date + dt.timedelta(days=i) for i in range((last - v.start_date).days + 1)}
        for d in covered:
            if d - dt.timedelta(days=1) not in covered:
                end = d
                while end + dt.timedelta(days=1) in covered:
                    end += dt.timedelta(days=1)
                expected.add((subject, d, end))
    found = island_rows(random_stays, open_island="max_effective")
    assert set(rows(found, "subject", "island_start", "island_end_eff")) == expected


def test_summary_agrees_with_its_parts_and_ignores_input_order(random_stays):
    versions = iv.dedup_latest(random_stays)
    found = island_rows(random_stays)
    whole = iv.subject_summary(iv.island_tags(versions, AS_OF), AS_OF)
    assert whole.count() == versions.select("subject").distinct().count()
    assert rows(whole, "subject", "days_1y") == rows(iv.days_in_window(found, AS_OF))
    assert rows(whole, "subject", "days_lifetime") == rows(iv.days_lifetime(found, AS_OF))
    assert rows(whole, "subject", "arrivals_1y") == rows(iv.arrivals(versions, AS_OF))
    assert rows(whole, "subject", "name") == rows(iv.person_latest(versions), "subject", "name")
    last = iv.latest_island(found)
    assert rows(whole, "subject", "start_date", "end_date", "place") == rows(
        last, "subject", "island_start", "island_end_real", "island_places"
    )
    assert whole.filter("days_1y > days_lifetime").isEmpty()
    shuffled = iv.dedup_latest(random_stays.repartition(7, F.rand(3)))
    assert rows(iv.subject_summary(iv.island_tags(shuffled, AS_OF), AS_OF)) == rows(whole)


def test_day_intervals(spark):
    points = spark.createDataFrame(
        [(1, "2020-01-01 10:00:00"), (1, "2020-01-01 12:00:00"), (1, "2020-01-02 01:00:00"), (1, "2020-01-04 01:00:00")],
        "who int, at string",
    ).withColumn("at", F.to_timestamp("at"))
    runs = iv.island_tags(iv.day_intervals(points, "who", "at"), AS_OF).groupBy("island_id").count()
    assert rows(runs) == [(1, 2), (2, 1)]


def test_island_ranges_need_no_other_columns(spark, make_stays):
    """Ranges by the narrow rows are those of the islands, and no other column is shuffled."""
    rng = random.Random(8)
    stays = make_stays(*[{
        "subject": f"s{rng.randrange(6)}", "start": rng.choice([None, f"2020-0{rng.randrange(1, 5)}-{rng.randrange(10, 28)}"]), "place": f"p{rng.randrange(3)}",
        "end": rng.choice([None, f"2020-0{rng.randrange(3, 7)}-11"]), "updated": f"2020-01-0{rng.randrange(1, 4)}",
    } for _ in range(300)])
    narrow = iv.island_ranges(stays, "2020-12-31")
    whole = iv.islands(iv.island_tags(iv.dedup_latest(stays), "2020-12-31"), "2020-12-31")
    assert rows(narrow) == rows(whole, *narrow.columns)
    days = iv.days_in_window(narrow, "2020-12-31")
    assert "place" not in days._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
