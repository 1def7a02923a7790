"""What the plans look like: shuffles, pushed filters, hot keys. And what the code must not contain."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sojourn.operators import classify as cl
from sojourn.operators import intervals as iv
from sojourn.operators import search as se
from sojourn.operators import upsert as up
from sojourn.plans.profile import profile
from sojourn.session import scratch_dir, stored_copies
from tests.conftest import rows
from workload.tables import AS_OF, NOW, lookups, stays, table

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_shuffles_intervals_twice_and_prunes_before_the_first(spark):
    text = plan(profile(stays(spark, SF).hint("rebalance"), lookups(spark, SF), AS_OF))
    steps = re.findall(r"(Exchange hashpartitioning\([^)]*\)|WindowGroupLimit|Window \[|SortMergeJoin|BroadcastHashJoin \[subject)", text)
    joined = next(i for i, s in enumerate(steps) if s in ("SortMergeJoin", "BroadcastHashJoin [subject"))
    # Read from the result down to the scan of the intervals.
    below = [s if s.startswith(("Window", "Sort", "Broad")) else re.sub(r"#\d+", "", s) for s in steps[joined + 1:]]
    assert below[:7] == [
        "Window [", "Window [", "Exchange hashpartitioning(subject, 4)", "Window [", "WindowGroupLimit",
        "Exchange hashpartitioning(subject, start_date, 4)", "WindowGroupLimit",
    ]


def test_scans_read_only_what_is_used(spark):
    text = plan(profile(stays(spark, SF), lookups(spark, SF), AS_OF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert all("l_extendedprice" not in s and "o_totalprice" not in s and "p_retailprice" not in s for s in schemas)
    counted = plan(se.page_info(table(spark, SF, "orders").filter("o_orderkey > 5")))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,5)]" in counted


def test_pages_and_totals_avoid_full_sorts_and_single_partition_windows(spark):
    profiles = profile(stays(spark, SF), lookups(spark, SF), AS_OF)
    paged = plan(se.page(profiles, se.newest_first(), 20, 40))
    assert "TakeOrderedAndProject(limit=60" in paged and "rangepartitioning" not in paged
    assert "Window [count" not in plan(se.page_info(profiles))


def test_batch_search_drops_other_subjects_before_the_shuffle(spark):
    keys = spark.createDataFrame([("customer#000000001", 1)], "key string, pos int")
    text = plan(se.search_batch_all(stays(spark, SF), lookups(spark, SF), keys, AS_OF))
    assert text.index("Exchange hashpartitioning(subject") < text.index("LeftSemi")  # the join is further down


@pytest.fixture
def hot_session(spark):
    """No broadcasts, and partitions count as skewed at a few kilobytes."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def executed(df):
    """Run, and return the final adaptive plan with the rows."""
    found = rows(df)
    df.collect()
    return found, plan(df)


def hot_rows(spark, n=30_000):
    """A third of the rows share one group."""
    group = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id").cast("string")))
    return spark.range(n).repartition(6).select("id", group.alias("place"), F.lit(None).cast("date").alias("start_date"), (F.col("id") % 7 == 0).alias("minor"))


def test_hot_group_is_split_for_the_group_flag(hot_session):
    df = hot_rows(hot_session)
    found, text = executed(cl.group_flag(df, ["start_date", "place"], F.col("minor")).select("id", "group_flag"))
    assert "skew=true" in text
    assert dict(found) == {i: int(i % 3 == 0 or i % 7 == 0) for i in range(30_000)}


def test_hot_key_is_split_for_upsert_labels_and_groups(hot_session, make_stays, monkeypatch):
    # Leaves the merged rows unstored, so that their join shows in the plan of the result.
    store = up.materialize
    monkeypatch.setattr(up, "materialize", lambda df, label: df if label == "changed" else store(df, label))
    base = hot_rows(hot_session)
    day = F.lit("2020-01-01").cast("date")
    current = base.select(
        F.upper("place").alias("subject"), F.col("id").cast("string").alias("name"), day.alias("birth_date"), F.lit("c").alias("category"),
        day.alias("start_date"), day.alias("end_date"), F.lit("p").alias("place"), F.lit(None).cast("string").alias("verified_label"),
        F.lit(NOW).cast("timestamp_ntz").alias("updated_at"), F.lit("f").alias("source_file"),
    )
    batch = current.filter("name < '2'").drop("updated_at").withColumn("at", F.col("name").cast("int"))
    # The maximum keeps the names in the shuffle; a column of one repeated key compresses to nothing.
    n = F.count(F.lit(1))
    found, text = executed(up.upsert_tagged(current, batch, NOW, "at").groupBy("action").agg(n, F.max("name")))
    hit = sum(1 for i in range(30_000) if i % 3 == 0 or str(i) < "2")
    assert [f[:2] for f in found] == [("kept", 30_000 - hit), ("updated", hit)]
    assert "skew=true" in text

    labels = batch.select("subject", F.lit("seen").alias("verified_label"), "at")
    found, text = executed(up.apply_labels(current, labels, NOW, "at").groupBy("verified_label").agg(n, F.max("name")))
    assert [f[:2] for f in found] == [("seen", hit), (None, 30_000 - hit)] and "skew=true" in text

    spellings = current.select(F.col("subject").alias("spelling"), F.lit("all").alias("group_name"), F.lit(1).alias("group_order"))
    grouped = cl.category_group(current.select("name", F.col("subject").alias("category")), spellings)
    found, text = executed(grouped.groupBy("group_name").agg(n, F.max("name")))
    assert [f[:2] for f in found] == [("all", 30_000)] and "skew=true" in text


def test_hot_subject_and_version_reach_the_shuffle_reduced(spark):
    """Of 30,000 versions of one stay each input task passes on one."""
    one = spark.range(30_000).repartition(6).select(
        F.when(F.col("id") >= 0, "hot").alias("subject"),  # no constant, which the planner would take out of the key
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 0).cast("int")).alias("start_date"), F.lit(None).cast("date").alias("end_date"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("updated_at"), F.col("id").alias("version"),
    )
    df = iv.dedup_latest(one)
    assert rows(df, "subject", "version") == [("HOT", 29_999)]
    df.collect()
    node, written = df._jdf.queryExecution().executedPlan().executedPlan(), []

    def visit(at):
        if at.nodeName() == "Exchange" and "subject" in at.simpleString(1000):
            written.append(at.metrics().apply("shuffleRecordsWritten").value())
        inner = [at.plan()] if at.nodeName().endswith("QueryStage") else [at.children().apply(i) for i in range(at.children().size())]
        for child in inner:
            visit(child)

    visit(node)
    assert written == [6]


class _Cluster:
    """A session without a shared folder whose master is a cluster."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return {"spark.sql.warehouse.dir": "file:/home/someone/spark-warehouse"}.get(key, default)

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"


def test_scratch_is_shared(spark, tmp_path):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(_Cluster, "x")
    assert scratch_dir(_Cluster, "x", "hdfs://shared").startswith("hdfs://shared/x-")
    with stored_copies(spark):
        path = scratch_dir(spark, "x", str(tmp_path))
        spark.range(3).write.parquet(path)
    assert not list(tmp_path.iterdir())


def test_library_reads_no_clock_and_runs_no_row_functions():
    banned = re.compile(r"current_date|current_timestamp|F\.now\(|date\.today|datetime\.now|localCheckpoint|F\.udf|pandas_udf|\.toPandas\(|F\.broadcast")
    allowed = {("operators/reports.py", "F.broadcast")}  # one row
    for path in (ROOT / "sojourn").rglob("*.py"):
        if path.relative_to(ROOT / "sojourn").parts[0] == "llm":
            continue  # has rules of its own
        for hit in banned.findall(path.read_text()):
            assert (str(path.relative_to(ROOT / "sojourn")), hit) in allowed, (path, hit)
