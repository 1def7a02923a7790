"""Versions of the stored table: commits in one step, failed and repeated loads, two writers."""

from __future__ import annotations

import datetime as dt

import pytest

from sojourn.operators import upsert as up
from sojourn.sources import tables, versions
from tests.conftest import rows

NOW = dt.datetime(2025, 6, 1, 12)


@pytest.fixture
def fact(spark, make_stays, tmp_path):
    """A stored table with three months, an undated row among them, and a batch for two of them."""
    path = str(tmp_path / "fact")
    tables.append_stays(make_stays(
        {"subject": "a", "start": "2025-01-03", "name": "old"}, {"subject": "b", "start": "2025-02-03", "name": "old"},
        {"subject": "c", "start": "2025-03-03", "name": "old"}, {"subject": "d", "start": None, "name": "old"},
    ), path, "first")
    batch = make_stays(
        {"subject": "A", "start": "2025-01-03", "name": "new"}, {"subject": "B", "start": "2025-02-03", "name": "new"},
        {"subject": "E", "start": "2025-02-04", "name": "new"}, {"subject": "D", "start": None, "name": "new"},
    ).drop("updated_at").selectExpr("*", "name as position")
    return path, batch


def names(spark, path):
    return rows(tables.read_stays(spark, path), "subject", "name")


OLD = [("A", "old"), ("B", "old"), ("C", "old"), ("D", "old")]
NEW = [("A", "new"), ("B", "new"), ("C", "old"), ("D", "new"), ("D", "old"), ("E", "new")]


def test_replay_changes_nothing(spark, fact):
    path, batch = fact
    one = tables.upsert_table(spark, path, batch, NOW, "position", load_id="L1")
    assert names(spark, path) == NEW and rows(up.action_counts(one)) == [(2, 2)]
    later = NOW + dt.timedelta(days=1)
    two = tables.upsert_table(spark, path, batch, later, "position", load_id="L1")
    assert names(spark, path) == NEW and rows(two) == rows(one) and versions.current(spark, path).number == 2
    # Another load between them: the answer for the first is still that of its time.
    tables.upsert_table(spark, path, batch.limit(1), later, "position", load_id="L2")
    assert rows(tables.upsert_table(spark, path, batch, later, "position", load_id="L1")) == rows(one)
    tables.append_stays(tables.read_stays(spark, path), path, "first")
    assert versions.current(spark, path).number == 3


@pytest.mark.parametrize("broken", ["write", "ledger", "publish"])
def test_failed_load_is_invisible_and_can_be_repeated(spark, fact, monkeypatch, broken):
    """It fails after the months' updated rows are written, or at the last steps."""
    path, batch = fact
    with monkeypatch.context() as patch:
        def fail(*_):
            raise RuntimeError("stop")

        if broken == "write":
            real, calls = tables._write, []

            def second_fails(*given):
                calls.append(1)
                return real(*given) if len(calls) == 1 else fail()

            patch.setattr(tables, "_write", second_fails)
        elif broken == "ledger":
            patch.setattr(versions, "store_json", fail)
        else:
            patch.setattr(versions, "_rename_new", fail)
        with pytest.raises(RuntimeError, match="stop"):
            tables.upsert_table(spark, path, batch, NOW, "position", load_id="L1")
    assert names(spark, path) == OLD and versions.find_load(spark, path, "L1") is None
    assert rows(up.action_counts(tables.upsert_table(spark, path, batch, NOW, "position", load_id="L1"))) == [(2, 2)]
    assert names(spark, path) == NEW


def test_readers_keep_their_version(spark, fact):
    path, batch = fact
    before = tables.read_stays(spark, path)
    tables.upsert_table(spark, path, batch, NOW, "position")
    assert rows(before, "subject", "name") == OLD


def test_two_writers(spark, fact):
    path, batch = fact
    base = versions.current(spark, path)
    tables.upsert_table(spark, path, batch, NOW, "position", load_id="L1")
    with pytest.raises(versions.VersionConflict):
        versions.publish(spark, path, base, {}, "L2")
    assert versions.find_load(spark, path, "L2") is None and versions.find_load(spark, path, "L1").number == 2
    assert names(spark, path) == NEW


def test_unused_folders(spark, fact):
    path, batch = fact
    for i in range(3):
        tables.upsert_table(spark, path, batch, NOW, "position", null_safe=True, load_id=f"L{i}")
    kept = versions.current(spark, path)
    assert len(versions.drop_folders(spark, path, keep=1)) == 2
    assert names(spark, path) == [(s, n) for s, n in NEW if (s, n) != ("D", "old")]
    assert versions.current(spark, path) == kept and versions.find_load(spark, path, "L0")
    assert versions.drop_folders(spark, path, keep=1) == []


def test_months(spark, fact, tmp_path):
    path, _ = fact
    assert rows(tables.read_stays(spark, path, ["2025-02", None, "1999-01"]), "subject") == [("B",), ("D",)]
    assert tables.read_stays(spark, str(tmp_path / "nothing")).count() == 0
