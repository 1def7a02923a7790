"""Versions, islands, counts, lookups and the profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from sojourn.operators import intervals as iv
from sojourn.operators.lookups import attach_lookups, merge_lookup
from sojourn.plans.profile import profile
from workload.tables import AS_OF, HOT_STAYS, lookups, sql, stays, table


def versions(spark, sf):
    return iv.dedup_latest(stays(spark, sf))


def tagged(spark, sf):
    return iv.island_tags(versions(spark, sf), AS_OF)


def islands(spark, sf):
    return iv.islands(tagged(spark, sf), AS_OF)


def profiles(spark, sf):
    return profile(stays(spark, sf), lookups(spark, sf), AS_OF)


def profile_hot_subject(spark, sf):
    """One subject holds a third of all rows."""
    return profile(stays(spark, sf, hot=True), lookups(spark, sf), AS_OF)


def event_islands(spark, sf):
    """Runs of active days per user; a day without events ends a run."""
    days = iv.day_intervals(table(spark, sf, "events"), "user_id", "ts")
    runs = iv.island_tags(days, AS_OF).groupBy("subject", "island_id")
    return runs.agg(
        F.min("start_date").alias("first_day"), F.max("end_date").alias("last_day"), F.count(F.lit(1)).alias("days")
    )


def islands_max_effective(spark, sf):
    return iv.islands(tagged(spark, sf), AS_OF, "max_effective").select("subject", "island_id", "island_end_eff")


def lookup_status(spark, sf):
    return profiles(spark, sf).select("subject", "verified_label", "lookup_status", "status")


def lookup_details(spark, sf):
    found = attach_lookups(iv.latest_island(islands(spark, sf)).withColumnRenamed("island_label", "verified_label"), lookups(spark, sf))
    return found.select("subject", "watch_kind", "watch_detail", "work_detail", "family_detail")


def lookup_loads(spark, sf):
    """A stored lookup of customers, and a batch of orders that spells the same keys in lower case."""
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    debtors = customer.filter("c_acctbal < 0").select(F.col("c_name").alias("doc_no"), F.col("c_mktsegment").alias("kind"), F.lit("stored").alias("origin"))
    loaded = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lower("c_name"), F.lit(" ")).alias("doc_no"), F.col("o_orderpriority").alias("kind"),
        F.col("o_orderkey").cast("string").alias("origin"), F.col("o_orderkey").alias("at"),
    )
    return debtors, loaded


def lookup_keep_first(spark, sf):
    return merge_lookup(*lookup_loads(spark, sf), "doc_no", "at", keep="first")


def lookup_keep_last(spark, sf):
    return merge_lookup(*lookup_loads(spark, sf), "doc_no", "at", keep="last")


QUERIES = {
    "dedup_latest": versions,
    "person_latest": lambda s, d: iv.person_latest(versions(s, d)),
    "island_tags": tagged,
    "islands": islands,
    "islands_max_effective": islands_max_effective,
    "latest_island": lambda s, d: iv.latest_island(islands(s, d)),
    "arrivals_1y": lambda s, d: iv.arrivals(versions(s, d), AS_OF),
    "days_1y": lambda s, d: iv.days_in_window(iv.island_ranges(stays(s, d), AS_OF), AS_OF),
    "days_lifetime": lambda s, d: iv.days_lifetime(iv.island_ranges(stays(s, d), AS_OF), AS_OF),
    "profile": profiles,
    "profile_hot_subject": profile_hot_subject,
    "event_islands": event_islands,
    "lookup_status": lookup_status,
    "lookup_details": lookup_details,
    "lookup_keep_first": lookup_keep_first,
    "lookup_keep_last": lookup_keep_last,
}

_STORED = "SELECT upper(c_name) AS doc_no, c_mktsegment AS kind, 'stored' AS origin, 0 AS load_no, 0 AS pos FROM customer WHERE c_acctbal < 0"
_LOADED = """SELECT upper(c_name), o_orderpriority, CAST(o_orderkey AS VARCHAR), 1, o_orderkey
  FROM orders JOIN customer ON o_custkey = c_custkey"""


def _merged(direction: str) -> str:
    return f"""SELECT doc_no, kind, origin FROM ({_STORED} UNION ALL {_LOADED})
      QUALIFY row_number() OVER (PARTITION BY doc_no ORDER BY load_no {direction}, pos {direction}) = 1"""


ORACLES = {
    "dedup_latest": sql("SELECT * FROM versions", "versions"),
    "person_latest": sql("SELECT * FROM person", "person"),
    "island_tags": sql("SELECT * FROM tags", "tags"),
    "islands": sql("SELECT * FROM isl", "isl"),
    "islands_max_effective": sql(
        "SELECT subject, island_id, max(end_eff) AS island_end_eff FROM tags GROUP BY subject, island_id", "tags"
    ),
    "latest_island": sql("SELECT * FROM last_isl", "last_isl"),
    "arrivals_1y": sql("SELECT * FROM arr", "arr"),
    "days_1y": sql("SELECT * FROM days1y", "days1y"),
    "days_lifetime": sql("SELECT * FROM life", "life"),
    "profile": sql("SELECT * FROM prof", "prof"),
    "profile_hot_subject": sql("SELECT * FROM prof", "prof", stays=HOT_STAYS),
    "event_islands": """
      WITH d AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS subject, CAST(ts AS DATE) AS day FROM events),
      n AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY subject ORDER BY day) AS INTEGER) AS run FROM d),
      r AS (SELECT subject, run, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM n GROUP BY subject, run)
      SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY first_day) AS island_id, first_day, last_day, days FROM r""",
    "lookup_status": sql("SELECT subject, verified_label, lookup_status, status FROM prof", "prof"),
    "lookup_details": sql(
        "SELECT subject, watch_kind, watch_detail, work_detail, family_detail FROM prof", "prof"
    ),
    "lookup_keep_first": _merged("ASC"),
    "lookup_keep_last": _merged("DESC"),
}
