"""Upserts, label corrections, imports, files and the drop folder. Files are written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sojourn.operators import upsert as up
from sojourn.plans.imports import import_rows
from sojourn.schema import STAY_SCHEMA
from sojourn.session import materialize, scratch_dir
from sojourn.sources import files, tables
from sojourn.streaming.ingest import ingest_folder, read_outcomes
from workload.cleaning import _CHECKED, _ERRORS, _RAW, KNOWN
from workload.tables import AS_OF, NOW, NOW_SQL, batch, customers, fact, orders, raw, sql, table

COLUMNS = [f.name for f in STAY_SCHEMA.fields]


def tagged(spark, sf):
    return up.upsert_tagged(fact(spark, sf), batch(spark, sf), NOW, "position")


def upsert_matched(spark, sf):
    """Stored rows whose key the batch names, counted per subject."""
    found = up.matched_rows(fact(spark, sf), batch(spark, sf))
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


def upsert_new(spark, sf):
    latest = materialize(up.last_per_key(batch(spark, sf), up.KEYS, "position"), "batch")
    return up.new_rows(fact(spark, sf), latest).select("subject", "start_date", "end_date", "place")


def upsert_twice(spark, sf):
    """Actions of a second load of the same batch: dated keys are all found, undated ones come again."""
    latest = materialize(up.last_per_key(batch(spark, sf), up.KEYS, "position"), "batch")
    once = up.upsert_latest(fact(spark, sf), latest, NOW).drop(up.ACTION)
    return up.action_counts(up.upsert_latest(once, latest, NOW))


def apply_labels(spark, sf):
    """Every order corrects the label of its customer; the last order wins, blank labels do nothing."""
    label = F.when(F.col("o_orderstatus") == "O", " ").otherwise(F.concat(F.lit(" SEEN "), F.col("o_orderpriority")))
    given = orders(spark, sf).select(F.lower(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("subject"), label.alias("verified_label"), F.col("o_orderkey").alias("pos"))
    return up.apply_labels(fact(spark, sf), given, NOW, "pos")


def import_summary(spark, sf):
    return import_rows(fact(spark, sf), raw(spark, sf), NOW, AS_OF, KNOWN).summary


def stored_fact(spark, sf):
    path = scratch_dir(spark, "fact")
    tables.append_stays(fact(spark, sf), path)
    return path


def append_stays(spark, sf):
    """The same rows loaded twice are there twice; a load does not de-duplicate."""
    path = stored_fact(spark, sf)
    tables.append_stays(fact(spark, sf).withColumn("subject", F.lower("subject")).drop("source_file"), path)
    return tables.read_stays(spark, path)


def upsert_table(spark, sf):
    path = stored_fact(spark, sf)
    tables.upsert_table(spark, path, batch(spark, sf), NOW, "position")
    return tables.read_stays(spark, path)


def upsert_replayed(spark, sf):
    """Two loads, each sent twice under its id, the first one again at the end: rows without a start come once per load."""
    path = stored_fact(spark, sf)
    part = F.col("position.l_linenumber") % 2
    for load in (0, 0, 1, 1, 0):
        tables.upsert_table(spark, path, batch(spark, sf).filter(part == load), NOW, "position", load_id=f"load-{load}")
    return tables.read_stays(spark, path)


def accented_customers(spark, sf):
    return customers(spark, sf).select(
        "c_custkey", F.concat("c_name", F.lit(" café 5€, "), F.col("c_mktsegment")).alias("title"),
        F.when(F.col("c_acctbal") >= 0, F.col("n_name")).alias("nation"),
    )


def mixed_files(spark, sf):
    """All customers as CSV in four encodings; one of the folders has its columns in another order."""
    base, rows = scratch_dir(spark, "csv"), accented_customers(spark, sf)
    split = [rows.filter(F.col("c_custkey") % 4 == i) for i in range(4)]
    files.export_csv(split[0], f"{base}/utf8", byte_order_mark=False)
    files.export_csv(split[1].select("nation", "title", "c_custkey"), f"{base}/marked")
    western = split[2].withColumn("title", F.translate("title", "€", "\x80"))  # byte 80 is the euro sign in cp1252
    western.write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{base}/western")
    split[3].write.option("header", True).option("encoding", "UTF-16").csv(f"{base}/wide")
    return [f"{base}/{name}" for name in ("utf8", "marked", "western", "wide")]


def read_csv_encodings(spark, sf):
    found = files.read_csv(spark, mixed_files(spark, sf), files.EXPORT_ENCODINGS)
    return found.select(F.col("c_custkey").cast("long").alias("c_custkey"), "title", "nation")


def stamp_source(spark, sf):
    """Rows carry the name of the file they came from: one file per order status."""
    base = scratch_dir(spark, "stamped")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    rows.write.partitionBy("o_orderstatus").option("header", True).csv(base)
    found = files.read_csv(spark, base)
    named = F.col("source_file").rlike(r"^part-.*\.csv$").alias("named")
    return found.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), named)


def export_csv_roundtrip(spark, sf):
    """Whole documents, with line breaks and quotes, out to CSV and back."""
    path = scratch_dir(spark, "export")
    files.export_csv(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), path)
    found = files.read_csv(spark, path, multi_line=True, missing=files.OWN_MISSING)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")


def split_output(spark, sf):
    """Parts of at most 3000 rows: how many rows in all, and whether any part is larger."""
    path = scratch_dir(spark, "split")
    files.write_split(table(spark, sf, "orders"), path, 3000, "parquet")
    parts = files.rows_per_file(spark.read.parquet(path))
    return parts.agg(F.sum("n").alias("n"), (F.max("n") <= 3000).alias("within"))


def ingest(spark, sf):
    """Two drops of the raw load, the second one corrected, through the drop folder into a stored table.

    Half of each drop is in UTF-8, the other half in UTF-16 with its columns in reverse; line breaks are kept.
    """
    base = scratch_dir(spark, "drop")
    # Stored once, as every half of every drop reads it: the tables behind it are joined once instead of four times.
    load = materialize(raw(spark, sf).drop("source_file", "position"), "raw")
    path = stored_fact(spark, sf)
    first = load.withColumn("NgayDi", F.lit("2001-06-30"))
    second = load.withColumn("Địa chỉ", F.lit("moved"))
    for drop in (first, second):
        half = F.pmod(F.xxhash64(*[f"`{c}`" for c in load.columns]), F.lit(2))
        for i, (encoding, columns) in enumerate((("UTF-8", drop.columns), ("UTF-16", drop.columns[::-1]))):
            part = drop.filter(half == i).select(*[f"`{c}`" for c in columns])
            part.write.mode("append").option("header", True).option("escape", '"').option("encoding", encoding).csv(f"{base}/in")
        query = ingest_folder(
            spark, f"{base}/in", f"{base}/done", f"{base}/state", path, load.columns, lambda: NOW, KNOWN
        )
        query.awaitTermination()
    origin = F.when(F.col("place") == "moved", "second").when(F.length("place") == 1, "stored").otherwise("first")
    return tables.read_stays(spark, path).groupBy(origin.alias("origin")).agg(F.count(F.lit(1)).alias("n"))


def drop_outcomes(spark, sf):
    """One file per customer nation, files of the seventh without a key column: what became of every file, by nation.

    Names may repeat, so the key has the customer number too: every customer is a subject of its own, as the SQL counts them.
    """
    base, path = scratch_dir(spark, "drops"), stored_fact(spark, sf)
    rows = customers(spark, sf).select(
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit("-c"), F.col("c_custkey").cast("string")).alias("Passport"), F.col("c_name").alias("Họ tên"),
        F.when(F.col("c_acctbal") >= 0, "03/02/2001").otherwise("03/02/2031").alias("Ngày đến"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("nation"),
    )
    for broken in (False, True):
        part = rows.filter((F.col("nation") == "n7") == broken)
        part = part.withColumnRenamed("Passport", "Code") if broken else part
        part.repartition("nation").write.mode("append").partitionBy("nation").option("header", True).csv(f"{base}/in")
    query = ingest_folder(
        spark, f"{base}/in/*", f"{base}/done", f"{base}/state", path, ["Passport", "Họ tên", "Ngày đến"], lambda: NOW, KNOWN,
        max_files=20, outcomes=f"{base}/outcomes", failed_dir=f"{base}/failed",
    )
    query.awaitTermination()
    nation = F.regexp_extract("file", "nation=(n[0-9]+)", 1).alias("nation")
    found = read_outcomes(spark, f"{base}/outcomes").groupBy(nation, "outcome").agg(F.sum("rows").alias("rows"), F.sum("skipped").alias("skipped"))
    loaded = tables.read_stays(spark, path).filter("start_date = date'2001-02-03' and source_file like 'part-%'").count()
    return found.withColumn("loaded", F.lit(loaded))


QUERIES = {
    "drop_outcomes": drop_outcomes,
    "upsert_matched": upsert_matched,
    "upsert_new": upsert_new,
    "upsert_stays": lambda s, d: tagged(s, d),
    "upsert_twice": upsert_twice,
    "upsert_table": upsert_table,
    "upsert_replayed": upsert_replayed,
    "apply_labels": apply_labels,
    "import_summary": import_summary,
    "append_stays": append_stays,
    "read_csv_encodings": read_csv_encodings,
    "stamp_source": stamp_source,
    "export_csv_roundtrip": export_csv_roundtrip,
    "split_output": split_output,
    "ingest_folder": ingest,
}

_SHARED = "SELECT DISTINCT subject, start_date FROM batch WHERE start_date IS NOT NULL"
UPSERTED = f"""
  SELECT f.subject, coalesce(b.name, f.name) AS name, coalesce(b.birth_date, f.birth_date) AS birth_date,
    coalesce(b.category, f.category) AS category, f.start_date, coalesce(b.end_date, f.end_date) AS end_date,
    coalesce(b.place, f.place) AS place, coalesce(nullif(b.verified_label, ''), f.verified_label) AS verified_label,
    CASE WHEN b.subject IS NULL THEN f.updated_at ELSE {NOW_SQL} END AS updated_at,
    coalesce(b.source_file, f.source_file) AS source_file, CASE WHEN b.subject IS NULL THEN 'kept' ELSE 'updated' END AS action
  FROM fact f LEFT JOIN latest_batch b ON f.subject = b.subject AND f.start_date = b.start_date
  UNION ALL
  SELECT subject, name, birth_date, category, start_date, end_date, place, verified_label, {NOW_SQL}, source_file, 'inserted'
  FROM latest_batch b WHERE NOT EXISTS (SELECT 1 FROM fact f WHERE f.subject = b.subject AND f.start_date = b.start_date)"""

LAST_OF = """SELECT * EXCLUDE (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) FROM batch WHERE l_linenumber % 2 = {}
  QUALIFY row_number() OVER (PARTITION BY subject, start_date ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1"""

ORACLES = {
    "drop_outcomes": """
      SELECT 'n' || n_nationkey AS nation, CASE WHEN n_nationkey = 7 THEN 'failed' ELSE 'loaded' END AS outcome,
        CASE WHEN n_nationkey = 7 THEN 0 ELSE count(*) END AS rows, CASE WHEN n_nationkey = 7 THEN 0 ELSE count(*) FILTER (WHERE c_acctbal < 0) END AS skipped,
        (SELECT count(*) FROM customer WHERE c_acctbal >= 0 AND c_nationkey <> 7) AS loaded
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey""",
    "upsert_replayed": sql(
        "SELECT * EXCLUDE (action) FROM upserted", "fact", "batch", one=LAST_OF.format(0), two=LAST_OF.format(1),
        first=UPSERTED.replace("latest_batch", "one"), later="SELECT * EXCLUDE (action) FROM first",
        upserted=UPSERTED.replace("latest_batch", "two").replace("FROM fact", "FROM later"),
    ),
    "upsert_matched": sql(
        f"SELECT subject, count(*) AS n FROM fact SEMI JOIN ({_SHARED}) USING (subject, start_date) GROUP BY subject", "fact", "batch"
    ),
    "upsert_new": sql(
        """SELECT subject, start_date, end_date, place FROM latest_batch b
        WHERE NOT EXISTS (SELECT 1 FROM fact f WHERE f.subject = b.subject AND f.start_date = b.start_date)""", "fact", "latest_batch",
    ),
    "upsert_stays": sql(UPSERTED, "fact", "latest_batch"),
    "upsert_twice": sql(
        f"""SELECT count(*) FILTER (WHERE n.start_date IS NULL) AS inserted,
        (SELECT count(*) FROM upserted u WHERE u.start_date IS NOT NULL AND u.action <> 'kept') AS updated
        FROM latest_batch n""", "fact", "latest_batch", upserted=UPSERTED,
    ),
    "upsert_table": sql("SELECT * EXCLUDE (action) FROM upserted", "fact", "latest_batch", upserted=UPSERTED),
    "apply_labels": sql(
        f"""SELECT subject, name, birth_date, category, start_date, end_date, place, coalesce(label, verified_label) AS verified_label,
        CASE WHEN label IS NULL THEN updated_at ELSE {NOW_SQL} END AS updated_at, source_file
        FROM fact LEFT JOIN given USING (subject)""", "fact",
        given="""SELECT upper(replace(c_name, '#', '')) AS subject, arg_max('SEEN ' || o_orderpriority, o_orderkey) AS label
          FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'O' GROUP BY 1""",
    ),
    "import_summary": sql(
        f"""SELECT (SELECT count(*) FROM valid) AS imported,
          (SELECT count(*) FROM keys ANTI JOIN fact USING (subject, start_date)) AS inserted,
          (SELECT count(*) FROM fact SEMI JOIN keys USING (subject, start_date)) AS updated,
          (SELECT count(*) FROM raw) - (SELECT count(*) FROM valid) AS skipped,
          (SELECT CAST(sum({_ERRORS}) AS BIGINT) FROM checked) AS errors,
          (SELECT count(i6) FROM checked) AS warnings""", "fact",
        raw=_RAW[len("raw AS ("):-1], checked=_CHECKED[len("checked AS ("):-1],
        valid=f"FROM checked WHERE {_ERRORS} = 0", keys="SELECT DISTINCT subject, start_date FROM valid",
    ),
    "append_stays": sql("SELECT * FROM fact UNION ALL SELECT * REPLACE (CAST(NULL AS VARCHAR) AS source_file) FROM fact", "fact"),
    "read_csv_encodings": """SELECT c_custkey, c_name || ' café 5€, ' || c_mktsegment AS title,
      CASE WHEN c_acctbal >= 0 THEN n_name END AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "stamp_source": "SELECT o_orderkey, true AS named FROM orders",
    "export_csv_roundtrip": "SELECT doc_id, text, lang, source FROM documents",
    "split_output": "SELECT count(*) AS n, true AS within FROM orders",
    "ingest_folder": sql(
        """SELECT origin, count(*) AS n FROM (
          SELECT CASE WHEN s.subject IS NOT NULL THEN 'second' WHEN f.subject IS NOT NULL THEN 'first' ELSE 'stored' END AS origin
          FROM (SELECT subject, start_date FROM fact UNION ALL (FROM (FROM one UNION FROM two) ANTI JOIN fact USING (subject, start_date))) t
            LEFT JOIN one f USING (subject, start_date) LEFT JOIN two s USING (subject, start_date)) GROUP BY origin""",
        "fact", raw=_RAW[len("raw AS ("):-1],
        good="FROM raw WHERE length(subject) >= 5 AND NOT contains(subject, '#') AND birth_date <= DATE '2001-07-01'",
        one="SELECT DISTINCT subject, start_date FROM good WHERE start_date <= DATE '2001-06-30'",
        two="SELECT DISTINCT subject, start_date FROM good WHERE end_date BETWEEN start_date AND DATE '2001-07-01'",
    ),
}
