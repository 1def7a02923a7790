from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sojourn.schema import STAY_SCHEMA  # noqa: E402
from sojourn.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[4]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    yield session
    session.stop()


def day(text: str | None) -> dt.date | None:
    return dt.date.fromisoformat(text) if text else None


@pytest.fixture(scope="session")
def make_stays(spark):
    """Stays from (subject, start, end, updated) and optional keyword columns."""

    def make(*rows: dict):
        full = []
        for r in rows:
            full.append((
                r.get("subject", "P1"), r.get("name", "N"), day(r.get("birth")), r.get("category", "C"),
                day(r.get("start")), day(r.get("end")), r.get("place", "X"), r.get("label"),
                dt.datetime.fromisoformat(r.get("updated", "2020-01-01")), r.get("file"),
            ))
        return spark.createDataFrame(full, STAY_SCHEMA)

    return make


def rows(df, *columns):
    """Rows as tuples in a stable order."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
