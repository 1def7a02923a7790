"""Work that must not multiply: once per row, few loads, tables of repeated names."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sojourn.operators import quality as qu
from sojourn.operators import upsert as up
from sojourn.plans import chunked
from sojourn.plans.stored_profile import VERSIONS, StoredProfile
from sojourn.sources import files, tables, versions
from sojourn.streaming import ingest
from workload import check, loads
from workload.tables import stays
from tests.conftest import rows


def test_checks_are_worked_out_once(spark):
    """A filter on the issues used to bring a copy of every check for each mention of them."""
    data = spark.range(4).select(F.col("id").alias("at"), F.when(F.col("id") % 2 == 0, "ab").otherwise("abcde").alias("subject"))
    checked = qu.validate(data.withColumn("subject", F.upper("subject")), [qu.key_check(F.col("at"), "subject")])
    for found in (qu.quality_sample(checked, "at"), qu.split_valid(qu.worked_out(checked))[0]):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("fewer than 5 characters") == 1
    assert rows(qu.quality_sample(checked, "at"), "row", "errors") == [(0, 1), (2, 1)]
    assert rows(qu.split_valid(qu.worked_out(checked))[0], "at") == [(1,), (3,)]


def test_drop_outcomes_of_repeated_names(spark, tmp_path):
    """Customers of one name are different customers; they used to be loaded as one subject."""
    given = "/root/testdata/sf0.001"
    for name in check.TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(Path(given) / f"{name}.parquet")
    customer = spark.read.parquet(f"{given}/customer.parquet")
    copies = customer.unionByName(customer.withColumn("c_custkey", F.col("c_custkey") + 1_000_000))
    (tmp_path / "customer.parquet").unlink()
    copies.toPandas().to_parquet(tmp_path / "customer.parquet")
    con = check.connect(str(tmp_path))
    assert check.compare(loads.drop_outcomes(spark, str(tmp_path)), con, loads.ORACLES["drop_outcomes"]).startswith("ok")


@pytest.fixture
def typed(spark):
    """Twenty rows: one key in three chunks of two, an undated row, a short key."""
    lines = [(f"aa{100 + i}", f"n{i}", f"{1 + i:02d}/01/2025", "x", i) for i in range(20)]
    lines[0], lines[7], lines[13] = ("aa-100", "a", "01/01/2025", "x", 0), ("AA100", "b", "01/01/2025", "x", 7), ("aa 100", "c", "01/01/2025", "x", 13)
    lines[8], lines[19] = ("b", "short", "09/01/2025", "x", 8), ("zz999", "undated", None, "y", 19)
    return spark.createDataFrame(lines, "Passport string, `Họ tên` string, `Ngày đến` string, `Quốc tịch` string, position int").repartition(3)


def chunks_of(spark, typed, base, rows_each=2, **options):
    found = chunked.import_chunks(
        spark, str(base / "fact"), typed, str(base / "ledger"), "L", dt.datetime(2025, 6, 1), "2025-06-01", ["X"], chunk_rows=rows_each, **options
    )
    return rows(found.drop("message"))


def test_chunks_share_loads(spark, typed, make_stays, tmp_path, monkeypatch):
    """Many chunks used to be as many loads, each of which rewrote the months it named. The ledger stays the same."""
    loads, real = [], tables.upsert_table
    monkeypatch.setattr(tables, "upsert_table", lambda *given, load_id: loads.append(load_id) or real(*given, load_id=load_id))
    found = {}
    for most in (20, 4):
        monkeypatch.setattr(chunked, "LOADS", most)
        base = tmp_path / str(most)
        tables.append_stays(make_stays({"subject": "AA100", "start": "2025-01-01", "name": "stored"}), str(base / "fact"))
        loads.clear()
        found[most] = chunks_of(spark, typed, base), rows(tables.read_stays(spark, str(base / "fact")), "subject", "start_date", "name")
        assert len(loads) == min(most, 10)
        assert chunks_of(spark, typed, base) == found[most][0] and len(loads) == min(most, 10)
    assert found[20] == found[4] and len(found[4][0]) == 10 and all(r[1] == "done" for r in found[4][0])
    assert sum(r[3] for r in found[4][0]) == 16 and sum(r[4] for r in found[4][0]) == 1


@pytest.mark.parametrize("stop", [True, False])
def test_load_that_fails_is_tried_by_chunk(spark, typed, make_stays, tmp_path, monkeypatch, stop):
    monkeypatch.setattr(chunked, "LOADS", 2)
    real = tables.upsert_table

    def breaks(*given, load_id):
        if load_id in ("L/0-4", "L/3"):
            raise RuntimeError("no space left")
        return real(*given, load_id=load_id)

    with monkeypatch.context() as patch:
        patch.setattr(tables, "upsert_table", breaks)
        if stop:
            with pytest.raises(RuntimeError, match="no space"):
                chunks_of(spark, typed, tmp_path, stop_at_error=True)
        else:
            states = [r[1] for r in chunks_of(spark, typed, tmp_path)]
            assert states == ["done", "done", "done", "failed", *["done"] * 6]
    assert all(r[1] == "done" for r in chunks_of(spark, typed.limit(0), tmp_path))
    assert tables.read_stays(spark, str(tmp_path / "fact")).count() == 17


def test_shared_load_that_was_not_noted(spark, typed, tmp_path, monkeypatch):
    """The table has it, the ledger does not: the undated row is not loaded twice, and its counts are noted then."""
    monkeypatch.setattr(chunked, "LOADS", 2)
    real = versions.store_json

    def lost(spark_, path, content):
        if path.endswith("states/5-9.json"):
            raise RuntimeError("lost")
        real(spark_, path, content)

    with monkeypatch.context() as patch:
        patch.setattr(versions, "store_json", lost)
        with pytest.raises(RuntimeError, match="lost"):
            chunks_of(spark, typed, tmp_path)
    found = chunks_of(spark, typed, tmp_path)
    assert all(r[1] == "done" for r in found) and sum(r[3] for r in found) == 17
    assert tables.read_stays(spark, str(tmp_path / "fact")).count() == 17


def test_last_row_of_a_key_is_carried_once(spark):
    """It used to be shuffled twice over, as the value and as the order."""
    batch = spark.createDataFrame([("a", 1, "x", None, 2), ("a", 1, None, "y", 3), ("b", None, "z", None, 1)], "k string, d int, v string, w string, at int")
    last = up.last_per_key(batch, ["k", "d"], "at")
    plan = last._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("v, v#") == 1 and last.columns == ["k", "d", "v", "w"]
    assert rows(last) == [("a", 1, None, "y"), ("b", None, "z", None)]


def test_small_link_tables_take_few_tasks(spark, monkeypatch):
    """Every step of a round used to write as many files as there are shuffle partitions."""
    components = pytest.importorskip("sojourn.llm.components")
    stored, real = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: stored.append(real(df, label)) or stored[-1])
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = spark.range(1, 200).selectExpr("id as a", "id - 1 - (id % 3 = 0)::int as b")
        found = rows(components.components(links))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert found == sorted(((k, 0) for k in range(1, 200)), key=repr)
    assert len(stored) > 3 and all(len(df.inputFiles()) <= components.LEAST_TASKS for df in stored[1:])


def test_dropped_files_are_scanned_once_for_their_encoding(spark, tmp_path, monkeypatch):
    scans = []
    whole = files.detect_encodings

    def counted(session, paths, *candidates):
        scans.append(paths)
        return whole(session, paths, *candidates)

    monkeypatch.setattr(files, "detect_encodings", counted)
    monkeypatch.setattr(ingest, "detect_encodings", counted)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.csv").write_text("Passport,Ngày đến\nAB12345,03/02/2001\n", encoding="utf-8")
    (tmp_path / "in" / "c[1].csv").write_text("Passport,Ngày đến\nAB12346,04/02/2001\n", encoding="utf-16")
    (tmp_path / "in" / "d.csv").write_text("Code\nAB12347\n", encoding="utf-8")
    at = {name: str(tmp_path / name) for name in ("in", "done", "state", "table", "outcomes")}
    query = ingest.ingest_folder(
        spark, at["in"], at["done"], at["state"], at["table"], ["Passport", "Ngày đến"], lambda: dt.datetime(2001, 7, 1), ["C"], outcomes=at["outcomes"],
    )
    query.awaitTermination()
    assert len(scans) == 1
    found = {r.file.rsplit("/", 1)[1]: (r.outcome, r.rows) for r in ingest.read_outcomes(spark, at["outcomes"]).collect()}
    assert found == {"a b.csv": ("loaded", 1), "c[1].csv": ("loaded", 1), "d.csv": ("failed", 0)}
    assert tables.read_stays(spark, at["table"]).count() == 2


def test_refresh_joins_no_intervals(spark, make_stays, tmp_path, monkeypatch):
    """Rows of changed months used to be joined with the keys of the load, and the stored versions as well."""
    fact, plans, real = str(tmp_path / "fact"), [], StoredProfile._write
    tables.append_stays(make_stays(*[{"subject": f"s{i}", "start": s, "name": "old"} for i in range(9) for s in ("2024-01-01", "2024-03-01", None)]), fact)
    kept = StoredProfile(spark, str(tmp_path / "profile"), fact, buckets=4)
    kept.refresh("2024-12-31")
    batch = make_stays(*[{"subject": f"S{i}", "start": "2024-03-01", "name": "new"} for i in range(5)]).drop("updated_at").selectExpr("*", "name as position")
    tables.upsert_table(spark, fact, batch, dt.datetime(2025, 1, 1), "position")

    def watched(self, found, column):
        if column == VERSIONS:
            plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        return real(self, found, column)

    monkeypatch.setattr(StoredProfile, "_write", watched)
    kept.refresh()
    assert len(plans) == 1 and "Join" not in plans[0]
    assert rows(kept.read(), "subject", "name") == [(f"S{i}", "new" if i < 5 else "old") for i in range(9)]


def test_loads_shuffle_what_differs_between_rows(spark, make_stays, tmp_path, monkeypatch):
    """The load id, the action and missing columns used to go through the shuffle with every row, and raw columns of line items through the joins."""
    plans, real = [], versions.write_rows

    def watched(found, *given):
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        real(found, *given)

    monkeypatch.setattr(versions, "write_rows", watched)
    tables.append_stays(make_stays({"subject": "a", "start": "2024-01-01"}).drop("source_file", "place"), str(tmp_path / "fact"), load_id="L")
    above, below = plans[0].split("RebalancePartitions", 1)
    assert all(name in above and name not in below.split("LogicalRDD")[0] for name in ("load_id", "action", "source_file", "place"))
    assert rows(tables.read_stays(spark, str(tmp_path / "fact")), "subject", "place", "name") == [("A", None, "N")]
    joined = stays(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "end_date" in joined and "l_quantity" not in joined and "l_shipdate" not in joined
