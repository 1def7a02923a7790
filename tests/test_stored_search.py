"""Key lookups in the stored profile, and the cube of subjects, against the plain operators."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sojourn.operators.lookups import Lookup
from sojourn.operators.search import search_batch
from sojourn.plans.key_search import find_keys, search_keys
from sojourn.plans.stored_profile import StoredProfile
from sojourn.plans.subject_cube import SubjectCube
from sojourn.sources import tables, versions
from tests.conftest import rows
from workload import stored

AS_OF = "2024-12-31"


def test_keys(spark, make_stays, tmp_path, monkeypatch):
    rng, fact = random.Random(1), str(tmp_path / "fact")
    tables.append_stays(make_stays(*[{"subject": f"p{rng.randrange(50)}", "start": f"2024-{rng.randrange(1, 13):02d}-05", "label": rng.choice([None, "B", "A"])} for _ in range(120)]), fact)
    profile = StoredProfile(spark, str(tmp_path / "profile"), fact, buckets=32)
    profile.refresh(AS_OF)
    lookups = [Lookup("one", spark.createDataFrame([("P1",), ("p2",)], "doc string"), "ONE", "doc")]
    keys = spark.createDataFrame([("p-1", 3), (" P2", 1), ("p1", 0), ("p7", 2), ("none", 5), ("", 6), (None, 7), *[(f"P{i}", 10 + i) for i in range(20, 40)]], "key string, pos int")
    for limit, offset in ((5, 0), (7, 4), (100, 0), (5, 500)):
        want = search_batch(tables.read_stays(spark, fact), lookups, keys, AS_OF, ["ONE", "A"], limit, offset)
        got = search_keys(profile, lookups, keys, ["ONE", "A"], limit, offset)
        assert [tuple(r) for r in got[0].collect()] == [tuple(r) for r in want[0].select(*got[0].columns).collect()] and rows(got[1]) == rows(want[1])
    read, real = set(), versions.read_parts

    def watched(spark_, root, at, schema, only=None):
        read.update((root, name) for name in (at.parts if only is None else only) if name in at.parts)
        return real(spark_, root, at, schema, only)

    monkeypatch.setattr(versions, "read_parts", watched)
    assert rows(find_keys(profile, [], keys.filter("key = 'p7'")), "subject") == [("P7",)]
    assert len(read) == 1 and next(iter(read))[0] == profile.path  # one bucket, no interval


def test_cube(spark, make_stays, tmp_path):
    rng = random.Random(2)
    stays = make_stays(*[{
        "subject": rng.choice(["", " a", "A", *[f"s{i}" for i in range(40)]]), "category": rng.choice(["x", "y", None]),
        "start": None if rng.random() < 0.1 else (dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(200))).isoformat(),
    } for _ in range(400)])
    cube = SubjectCube(spark, str(tmp_path / "cube"))
    cube.build(stays)
    first = dt.date(2023, 12, 20)
    ranges = [(f"r{i}", first + dt.timedelta(days=rng.randrange(200)), first + dt.timedelta(days=rng.randrange(260))) for i in range(20)] + [("far", "2030-01-01", "2030-02-01")]
    clean = stays.withColumn("subject", F.trim(F.upper("subject"))).filter("subject <> ''")
    by_group, in_all = [], []
    for name, low, high in ranges:
        inside = clean.filter(F.col("start_date").between(str(low), str(high))).select("subject", "category").distinct().collect()
        in_all += [(name, len({r.subject for r in inside}))] if inside else []
        by_group += [(name, g, len({r.subject for r in inside if r.category == g})) for g in {r.category for r in inside}]
    assert rows(cube.count(ranges)) == sorted(by_group, key=repr)
    assert rows(cube.count(ranges, by_group=False)) == sorted(in_all, key=repr)
    cube.build(stays.limit(0))
    assert cube.count(ranges).count() == 0


def test_thinly_spread_subjects_cost_a_row_of_numbers_each(spark, tmp_path):
    """Every subject on one day of its own: a stored row is small however far apart the numbers of a day are."""
    stays = spark.range(40_000).selectExpr(
        "concat('S', id) as subject", "date_add(date'2001-01-01', cast(id * 7919 % 50 as int)) as start_date", "concat('G', id % 5) as category",
    )
    cube = SubjectCube(spark, str(tmp_path / "cube"))
    cube.build(stays)
    stored = spark.read.parquet(f"{tmp_path}/cube/data/*")
    assert {f.dataType.typeName() for f in stored.schema.fields} <= {"date", "string", "long"} and stored.count() <= 40_000
    assert rows(cube.count([("two", "2001-01-01", "2001-01-02"), ("all", "2001-01-01", "2001-12-31"), ("none", "2000-01-01", "2000-01-02")], by_group=False)) == [("all", 40_000), ("two", 1_600)]


def test_search_indexed_joins_its_tables_once(spark, monkeypatch):
    """Both loads used to join all line items anew."""
    read = []

    def append(stays, path):
        read.append(stays.inputFiles())
        raise InterruptedError

    monkeypatch.setattr(tables, "append_stays", append)
    with pytest.raises(InterruptedError):
        stored.search_indexed(spark, "/root/testdata/sf0.001")
    assert read[0] and not any("lineitem" in file for file in read[0])
