"""The given tables seen as intervals, lookups, group spellings and import batches.

``stays`` makes every line item an interval of its customer; all queries read whole tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.functions.text import norm_key
from sojourn.operators.lookups import Lookup

AS_OF = "2001-06-30"
NOW = dt.datetime(2001, 7, 1, 8, 30)
NOW_SQL = "TIMESTAMP '2001-07-01 08:30:00'"
AS_OF_SQL = f"DATE '{AS_OF}'"
STATUSES = {"attention": "ATTENTION", "work": "WORK", "family": "FAMILY", "study": "STUDY"}
PRIORITY = list(STATUSES.values())


#: Given schemas: stating them spares a job per table that would only read them from the files.
_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = customers(spark, sf_dir).withColumn("stored_key", norm_key(F.replace("c_name", F.lit("#"), F.lit("-"))))  # once per customer
    return table(spark, sf_dir, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"))


def lines(spark: SparkSession, sf_dir: str, **derived: Column) -> DataFrame:
    """Line items with everything they refer to; joins carry columns ``derived`` from line items in place of those they come from."""
    # Parts first: where neither side is small, line items are shuffled twice, and the second time without their customers' columns.
    part = table(spark, sf_dir, "part")
    joined = table(spark, sf_dir, "lineitem").select("*", *[c.alias(name) for name, c in derived.items()]).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.join(orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))


def birth_date():
    return F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") * 37 % 22000).cast("int"))


def verified_label():
    return F.when(F.col("o_orderpriority") == "1-URGENT", "REVIEW").when(
        F.col("o_orderpriority") == "4-NOT SPECIFIED", "  "
    )


def stays(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    """Keys with case and space noise, some NULL starts, recent ones open, several versions per key.

    With ``hot`` every third order belongs to one and the same subject.
    """
    ship = F.col("l_shipdate").cast("date")
    still_open = (
        (F.col("l_returnflag") == "N")
        & (F.col("l_linestatus") == "O")
        & (F.col("l_shipdate") >= F.lit("2001-03-01").cast("timestamp_ntz"))
    )
    noisy = F.when(F.col("odd"), F.concat(F.lit(" "), F.lower("c_name"))).otherwise(F.col("c_name"))
    if hot:
        noisy = F.when(F.col("l_orderkey") % 3 == 0, "Hot Subject").otherwise(noisy)
    found = lines(
        spark, sf_dir, odd=F.col("l_linenumber") % 2 == 1, start_date=F.when(F.col("l_partkey") % 997 != 0, ship),
        end_date=F.when(~still_open, F.date_add(ship, F.col("l_quantity").cast("int"))),
    )
    return found.select(
        noisy.alias("subject"),
        F.concat("c_name", F.lit(" "), F.substr("o_orderpriority", F.lit(3))).alias("name"),
        birth_date().alias("birth_date"),
        F.col("n_name").alias("category"),
        "start_date",
        "end_date",
        F.col("p_name").alias("place"),
        verified_label().alias("verified_label"),
        F.col("o_orderdate").alias("updated_at"),
    )


def lookups(spark: SparkSession, sf_dir: str) -> list[Lookup]:
    """Four lookups in order of priority; a customer can be in two of them."""
    key = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lower("c_name"), F.lit(" "))).otherwise(F.col("c_name"))
    rows = customers(spark, sf_dir).select(
        key.alias("doc_no"), "c_acctbal", F.col("c_mktsegment").alias("kind"),
        F.col("c_custkey").cast("string").alias("ref_no"), F.col("n_name").alias("site"),
    )

    def segment(name: str) -> DataFrame:
        return rows.filter(F.col("kind") == name)

    return [
        Lookup("watch", rows.filter("c_acctbal < 0"), "ATTENTION", "doc_no", ["kind", "ref_no"], ["Kind: ", " - Ref: "]),
        Lookup("work", segment("BUILDING"), "WORK", "doc_no", ["kind", "site"], ["", " at "]),
        Lookup("family", segment("HOUSEHOLD"), "FAMILY", "doc_no", ["ref_no", "site"], ["Partner: ", " - "]),
        Lookup("study", segment("FURNITURE"), "STUDY", "doc_no"),
    ]


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as groups of nation spellings; nations 0 to 4 are also listed in a second group."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    first = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("group_name"), F.col("r_regionkey").alias("group_order"), F.col("n_name").alias("spelling")
    )
    second = nation.join(region, F.col("n_nationkey") == F.col("r_regionkey")).select(
        F.lit("OCEANIA").alias("group_name"), F.lit(9).alias("group_order"), F.col("n_name").alias("spelling")
    )
    return first.unionByName(second)


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored fact table: every order an interval, keys in stored form."""
    day = F.col("o_orderdate").cast("date")
    return orders(spark, sf_dir).select(
        F.col("stored_key").alias("subject"),
        F.col("c_name").alias("name"),
        birth_date().alias("birth_date"),
        F.col("n_name").alias("category"),
        day.alias("start_date"),
        F.date_add(day, 5).alias("end_date"),
        F.col("o_orderstatus").alias("place"),
        verified_label().alias("verified_label"),
        F.col("o_orderdate").alias("updated_at"),
        F.lit("orders").alias("source_file"),
    )


LINE_POSITION = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load in the fact schema: every line item, some keys twice, some starts NULL, some labels blank."""
    ship, label = F.col("l_shipdate").cast("date"), F.when(F.col("l_returnflag") == "R", "RETURNED").when(F.col("l_returnflag") == "A", "")
    found = lines(
        spark, sf_dir, start_date=F.when(F.col("l_partkey") % 997 != 0, ship), end_date=F.date_add(ship, F.col("l_quantity").cast("int")), label=label,
    )
    return found.select(
        F.col("stored_key").alias("subject"),
        F.concat("c_name", F.lit(" L"), F.col("l_linenumber").cast("string")).alias("name"),
        birth_date().alias("birth_date"),
        F.col("n_name").alias("category"),
        "start_date",
        "end_date",
        F.col("p_name").alias("place"),
        F.col("label").alias("verified_label"),
        F.lit("lineitem").alias("source_file"),
        F.struct(*LINE_POSITION).alias("position"),
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same load as it would be typed: text cells under foreign headers, some of them wrong."""
    ship = F.col("l_shipdate").cast("date")
    case = F.col("c_custkey") % 20
    key = (
        F.when(case == 3, F.lit(None))
        .when(case == 4, F.lit("a-1"))
        .when(case == 5, F.col("c_name"))
        .otherwise(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))))
    )
    left = F.date_add(ship, F.col("l_quantity").cast("int") - 3)
    return lines(spark, sf_dir).select(
        key.alias("Số hộ chiếu"),
        F.concat(F.lit("  "), F.col("c_name")).alias("Họ và tên"),
        F.date_format(birth_date(), "d/M/yyyy").alias("Ngày sinh"),
        F.when(F.col("n_nationkey") != 7, F.lower("n_name")).otherwise("elsewhere").alias("quoc_tich"),
        F.date_format(ship, "dd-MM-yyyy").alias("Ngày đến"),
        F.date_format(left, "yyyy/MM/dd").alias("NgayDi"),
        F.concat("p_name", F.lit("\n"), F.col("p_brand")).alias("Địa chỉ"),
        F.lit("lineitem").alias("source_file"),
        F.struct(*LINE_POSITION).alias("position"),
    )


# --- the same relations as DuckDB common table expressions -------------------------------------

_CTES = {
    "stays": """
      SELECT CASE WHEN l_linenumber % 2 = 1 THEN ' ' || lower(c_name) ELSE c_name END AS subject,
        c_name || ' ' || substr(o_orderpriority, 3) AS name,
        DATE '1950-01-01' + CAST(c_custkey * 37 % 22000 AS INTEGER) AS birth_date,
        n_name AS category,
        CASE WHEN l_partkey % 997 <> 0 THEN CAST(l_shipdate AS DATE) END AS start_date,
        CASE WHEN NOT (l_returnflag = 'N' AND l_linestatus = 'O' AND l_shipdate >= TIMESTAMP '2001-03-01')
             THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS end_date,
        p_name AS place,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'REVIEW' WHEN '4-NOT SPECIFIED' THEN '  ' END AS verified_label,
        o_orderdate AS updated_at
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey""",
    "versions": """
      SELECT * REPLACE (trim(upper(subject)) AS subject) FROM stays
      WHERE trim(upper(subject)) <> ''
      QUALIFY row_number() OVER (PARTITION BY trim(upper(subject)), start_date
        ORDER BY updated_at DESC NULLS LAST, end_date IS NULL, end_date DESC NULLS LAST, name DESC NULLS LAST,
          birth_date DESC NULLS LAST, category DESC NULLS LAST, place DESC NULLS LAST, verified_label DESC NULLS LAST) = 1""",
    "reaches": f"""
      SELECT *, coalesce(end_date, {AS_OF_SQL}) AS end_eff,
        max(coalesce(end_date, {AS_OF_SQL})) OVER (PARTITION BY subject ORDER BY start_date NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max_end
      FROM versions""",
    "flags": """
      SELECT *, CASE WHEN prev_max_end IS NULL OR start_date > prev_max_end + 1 THEN 1 ELSE 0 END AS new_island
      FROM reaches""",
    "tags": """
      SELECT *, CAST(sum(new_island) OVER (PARTITION BY subject ORDER BY start_date NULLS LAST
          ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island_id
      FROM flags""",
    "isl": f"""
      SELECT subject, island_id, min(start_date) AS island_start,
        coalesce(max(end_date), {AS_OF_SQL}) AS island_end_eff, max(end_date) AS island_end_real,
        string_agg(DISTINCT place, ' | ' ORDER BY place) AS island_places,
        first(verified_label ORDER BY updated_at DESC NULLS LAST, start_date DESC NULLS LAST) AS island_label
      FROM tags GROUP BY subject, island_id""",
    "last_isl": """
      SELECT * FROM isl QUALIFY row_number() OVER (PARTITION BY subject
        ORDER BY island_end_eff DESC NULLS LAST, island_start DESC NULLS LAST) = 1""",
    "person": """
      SELECT subject, name, birth_date, category, updated_at FROM versions
      QUALIFY row_number() OVER (PARTITION BY subject
        ORDER BY updated_at DESC NULLS LAST, start_date DESC NULLS LAST) = 1""",
    "days1y": f"""
      SELECT subject, CAST(coalesce(sum(CASE WHEN island_end_eff < {AS_OF_SQL} - 365 THEN 0 ELSE
          date_diff('day', greatest(island_start, {AS_OF_SQL} - 365), least(island_end_eff, {AS_OF_SQL})) + 1 END), 0)
          AS BIGINT) AS days_1y
      FROM isl GROUP BY subject""",
    "life": f"""
      SELECT subject, CAST(coalesce(sum(date_diff('day', island_start, least(island_end_eff, {AS_OF_SQL})) + 1), 0)
          AS BIGINT) AS days_lifetime
      FROM isl GROUP BY subject""",
    "arr": f"""
      SELECT subject, count(*) FILTER (WHERE start_date >= {AS_OF_SQL} - 365) AS arrivals_1y
      FROM versions GROUP BY subject""",
    "cust": """
      SELECT trim(upper(c_name)) AS key, c_acctbal, c_mktsegment AS kind, CAST(c_custkey AS VARCHAR) AS ref_no,
        n_name AS site FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "hits": """
      SELECT subject, w.key IS NOT NULL AS in_watch, b.key IS NOT NULL AS in_work,
        f.key IS NOT NULL AS in_family, s.key IS NOT NULL AS in_study,
        w.kind AS watch_kind, w.ref_no AS watch_ref_no, b.kind AS work_kind, b.site AS work_site,
        f.ref_no AS family_ref_no, f.site AS family_site
      FROM last_isl LEFT JOIN (FROM cust WHERE c_acctbal < 0) w ON subject = w.key
        LEFT JOIN (FROM cust WHERE kind = 'BUILDING') b ON subject = b.key
        LEFT JOIN (FROM cust WHERE kind = 'HOUSEHOLD') f ON subject = f.key
        LEFT JOIN (FROM cust WHERE kind = 'FURNITURE') s ON subject = s.key""",
    "status": """
      SELECT *, CASE WHEN in_watch THEN 'ATTENTION' WHEN in_work THEN 'WORK' WHEN in_family THEN 'FAMILY'
        WHEN in_study THEN 'STUDY' END AS lookup_status FROM hits""",
    "prof": """
      SELECT subject, name, birth_date, category, island_start AS start_date, island_end_real AS end_date,
        island_places AS place, island_label AS verified_label, arrivals_1y, days_1y, days_lifetime, lookup_status,
        coalesce(nullif(trim(island_label), ''), lookup_status) AS status,
        watch_kind, watch_ref_no, work_kind, work_site, family_ref_no, family_site,
        concat('Kind: ', watch_kind, ' - Ref: ', watch_ref_no) AS watch_detail,
        concat(work_kind, ' at ', work_site) AS work_detail,
        concat('Partner: ', family_ref_no, ' - ', family_site) AS family_detail
      FROM last_isl JOIN (SELECT * EXCLUDE (updated_at) FROM person) USING (subject)
        JOIN days1y USING (subject) JOIN life USING (subject)
        JOIN arr USING (subject) JOIN status USING (subject)""",
    "spell": """
      SELECT r_name AS group_name, r_regionkey AS group_order, n_name AS spelling
      FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT 'OCEANIA', 9, n_name FROM nation JOIN region ON n_nationkey = r_regionkey""",
    "fact": """
      SELECT upper(replace(c_name, '#', '')) AS subject, c_name AS name,
        DATE '1950-01-01' + CAST(c_custkey * 37 % 22000 AS INTEGER) AS birth_date, n_name AS category,
        CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + 5 AS end_date, o_orderstatus AS place,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'REVIEW' WHEN '4-NOT SPECIFIED' THEN '  ' END AS verified_label,
        o_orderdate AS updated_at, 'orders' AS source_file
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "batch": """
      SELECT upper(replace(c_name, '#', '')) AS subject, c_name || ' L' || CAST(l_linenumber AS VARCHAR) AS name,
        DATE '1950-01-01' + CAST(c_custkey * 37 % 22000 AS INTEGER) AS birth_date, n_name AS category,
        CASE WHEN l_partkey % 997 <> 0 THEN CAST(l_shipdate AS DATE) END AS start_date,
        CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS end_date, p_name AS place,
        CASE l_returnflag WHEN 'R' THEN 'RETURNED' WHEN 'A' THEN '' END AS verified_label, 'lineitem' AS source_file,
        l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey""",
    "latest_batch": """
      SELECT * EXCLUDE (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) FROM batch
      QUALIFY row_number() OVER (PARTITION BY subject, start_date ORDER BY l_orderkey DESC, l_linenumber DESC,
        l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""",
}
#: Every third order under one subject, as ``stays(hot=True)`` has it.
HOT_STAYS = _CTES["stays"].replace("SELECT CASE", "SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'Hot Subject'", 1)
_NEEDS = {
    "versions": ["stays"], "reaches": ["versions"], "flags": ["reaches"], "tags": ["flags"], "isl": ["tags"],
    "last_isl": ["isl"], "person": ["versions"], "days1y": ["isl"], "life": ["isl"], "arr": ["versions"],
    "hits": ["last_isl", "cust"], "status": ["hits"],
    "prof": ["last_isl", "person", "days1y", "life", "arr", "status"], "latest_batch": ["batch"],
}


def sql(select: str, *needs: str, **more: str) -> str:
    """A query over the named relations and ``more`` ones, which follow them or replace one of them."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            visit(needed)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    # Named relations used more than once are computed once.
    parts = [f"{name} AS MATERIALIZED ({more.pop(name, _CTES[name])})" for name in order]
    parts += [f"{name} AS ({body})" for name, body in more.items()]
    return f"WITH {', '.join(parts)} {select}" if parts else select
