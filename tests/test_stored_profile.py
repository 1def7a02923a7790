"""The stored profile against the profile from scratch, and what a refresh reads."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from sojourn.operators.intervals import dedup_latest, island_tags, subject_summary
from sojourn.plans import stored_profile
from sojourn.plans.stored_profile import SUMMARY_SCHEMA, StoredProfile
from sojourn.sources import tables, versions
from tests.conftest import rows

AS_OF = "2024-12-31"


def scratch(spark, fact, as_of=AS_OF):
    return rows(subject_summary(island_tags(dedup_latest(tables.read_stays(spark, fact)), as_of), as_of).select(*SUMMARY_SCHEMA.names))


def random_stays(make_stays, rng, n, subjects):
    def one():
        start = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(300))
        return {
            "subject": f"s{rng.randrange(subjects)}", "name": rng.choice("ab"), "place": rng.choice("xyz"), "label": rng.choice([None, "", "L"]),
            "start": None if rng.random() < 0.1 else start.isoformat(), "end": None if rng.random() < 0.2 else (start + dt.timedelta(days=rng.randrange(9))).isoformat(),
            "updated": f"2024-01-{rng.randrange(1, 28):02d}",
        }

    return make_stays(*[one() for _ in range(n)])


def test_follows_loads(spark, make_stays, tmp_path):
    rng, fact = random.Random(8), str(tmp_path / "fact")
    tables.append_stays(random_stays(make_stays, rng, 80, 20), fact)
    kept = StoredProfile(spark, str(tmp_path / "profile"), fact, buckets=8)
    kept.refresh(AS_OF)
    assert rows(kept.read()) == scratch(spark, fact)
    for load in range(3):
        batch = random_stays(make_stays, rng, 12, 26).drop("updated_at").selectExpr("*", "concat(name, place) as position")
        if load == 1:  # two loads, one of them without de-duplication, before the next refresh
            tables.append_stays(random_stays(make_stays, rng, 6, 30), fact)
        tables.upsert_table(spark, fact, batch, dt.datetime(2025, 1, load + 1), "position", null_safe=load == 2)
        made = kept.refresh()
        assert rows(kept.read()) == scratch(spark, fact)
        assert kept.refresh() == made  # nothing new, nothing done
    kept.refresh("2025-02-01")
    assert rows(kept.read()) == scratch(spark, fact, "2025-02-01")
    with pytest.raises(ValueError, match="was built with"):
        StoredProfile(spark, kept.path, fact, buckets=4).refresh()


def test_reads_touched_months_and_buckets_only(spark, make_stays, tmp_path, monkeypatch):
    fact = str(tmp_path / "fact")
    tables.append_stays(make_stays(*[{"subject": f"s{i}", "start": f"2024-{1 + i % 12:02d}-01"} for i in range(60)]), fact)
    kept = StoredProfile(spark, str(tmp_path / "profile"), fact, buckets=16)
    kept.refresh(AS_OF)
    before = versions.current(spark, kept.path)
    batch = make_stays({"subject": "S3", "start": "2024-04-01", "name": "new"}).drop("updated_at").selectExpr("*", "name as position")
    tables.upsert_table(spark, fact, batch, dt.datetime(2025, 1, 1), "position")
    read, real = set(), versions.read_parts

    def watched(spark_, root, at, schema, only=None):
        read.update((root, name) for name in (at.parts if only is None else only) if name in at.parts)
        return real(spark_, root, at, schema, only)

    monkeypatch.setattr(stored_profile.versions, "read_parts", watched)
    after = kept.refresh()
    assert {name for root, name in read if root == fact} == {"start_month=2024-04"}
    changed = {name for name in after.parts if after.parts[name] != before.parts[name]}
    assert len(changed) == 2 and {name for root, name in read if root == kept.path} == changed
    assert ("S3", "new") in rows(kept.read(), "subject", "name")


def test_empty(spark, make_stays, tmp_path):
    fact = str(tmp_path / "fact")
    kept = StoredProfile(spark, str(tmp_path / "profile"), fact)
    with pytest.raises(ValueError, match="needs as_of"):
        kept.refresh()
    kept.refresh(AS_OF)
    assert kept.read().count() == 0
    tables.append_stays(make_stays({"subject": " a ", "start": "2024-01-01", "end": "2024-01-02"}, {"subject": " ", "start": "2024-01-01"}), fact)
    kept.refresh()
    assert rows(kept.read(), "subject", "days_lifetime") == [("A", 2)]
