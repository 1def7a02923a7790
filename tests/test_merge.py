"""The stored upsert: table and batch meet in one shuffle, with the rows that joins give."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sojourn.operators import upsert as up
from sojourn.sources import tables, versions
from tests.conftest import rows

NOW = dt.datetime(2025, 6, 1, 12)


def some(make_stays, rng, n, **more):
    """Few keys, so that most repeat; some without a subject or a start, labels that are blank or missing."""
    return make_stays(*[{
        "subject": rng.choice(["A", "B", "C", None]), "start": rng.choice([None, "2025-01-03", "2025-01-04", "2025-02-03"]),
        "name": f"n{rng.randrange(99)}", "end": rng.choice([None, "2025-03-01"]), "label": rng.choice([None, "", "L1", "L2"]), **more,
    } for _ in range(n)])


def given(make_stays, rng, n=30):
    return some(make_stays, rng, n, place="batch").drop("updated_at").withColumn("position", F.struct("name", F.xxhash64("*").alias("h")))


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("cell_rows", [3, 500_000])
def test_same_rows_as_joins(spark, make_stays, tmp_path, monkeypatch, null_safe, cell_rows):
    monkeypatch.setattr(tables, "CELL_ROWS", cell_rows)
    rng, path = random.Random(7), str(tmp_path / "fact")
    tables.append_stays(some(make_stays, rng, 25), path)
    batch = given(make_stays, rng).localCheckpoint()
    wanted = up.upsert_tagged(tables.read_stays(spark, path), batch, NOW, "position", null_safe=null_safe)
    wanted = rows(wanted.withColumn("action", F.lit(1)).drop("action")), sorted(r.action for r in wanted.collect())
    tagged = tables.upsert_table(spark, path, batch, NOW, "position", null_safe)
    assert (rows(tables.read_stays(spark, path)), sorted(r.action for r in tagged.collect())) == wanted


def test_one_shuffle_and_no_join(spark, make_stays, tmp_path, monkeypatch):
    rng, path, plans, real = random.Random(8), str(tmp_path / "fact"), [], versions.write_rows
    tables.append_stays(some(make_stays, rng, 25), path)

    def watched(rows_, *more):
        plans.append(rows_._jdf.queryExecution().executedPlan().toString())
        return real(rows_, *more)

    monkeypatch.setattr(versions, "write_rows", watched)
    tables.upsert_table(spark, path, given(make_stays, rng), NOW, "position")
    assert len(plans) == 2  # rows with a start, and those without
    assert all(p.count("Exchange ") == 1 and "Join" not in p for p in plans)
