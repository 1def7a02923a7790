"""From files to tables in one go: labels, lookups, the bulk load, pages that each bring a header."""

from __future__ import annotations

from pyspark.sql import functions as F

from sojourn.operators.lookups import merge_lookup
from sojourn.operators.numbering import ROW_NUMBER, numbered
from sojourn.plans.imports import clean_lookup, import_labels
from sojourn.schema import STAY_SCHEMA
from sojourn.session import scratch_dir
from sojourn.sources import files, tables
from sojourn.sources.headers import align_headers, align_schema
from sojourn.sources.paged import stitch_pages
from workload.cleaning import ORACLES as CLEANING
from workload.cleaning import paged_cells
from workload.intervals import ORACLES as INTERVALS
from workload.intervals import lookup_loads
from workload.loads import ORACLES as LOADS
from workload.tables import NOW, fact, orders, sql


def label_file(spark, sf):
    """A file of labels, one line per order in the order of their keys, read, matched by header and applied; the last one wins."""
    label = F.when(F.col("o_orderstatus") == "O", " ").otherwise(F.concat(F.lit(" SEEN "), F.col("o_orderpriority")))
    lines = orders(spark, sf).select(
        "o_orderkey", F.lower(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("Số hộ chiếu"), label.alias("Kết quả xác minh"),
    )
    path = scratch_dir(spark, "labels")
    files.export_csv(lines.orderBy("o_orderkey"), path)
    return import_labels(fact(spark, sf), files.read_csv(spark, path), NOW)


def lookup_file(spark, sf):
    """A lookup file under its own headers, cleaned and loaded over a stored lookup; the last line of a key wins."""
    stored, loaded = lookup_loads(spark, sf)
    path = scratch_dir(spark, "lookup")
    files.export_csv(loaded.orderBy("at").selectExpr("doc_no as `Doc. No`", "kind as Kind", "origin as `Ref origin`"), path)
    lines = clean_lookup(files.read_csv(spark, path), ["doc_no", "kind", "origin"], "doc_no", {"Doc. No": "doc_no", "Ref origin": "origin"})
    ranked = numbered(lines, [files.POSITION])
    return merge_lookup(stored, ranked, "doc_no", ROW_NUMBER, keep="last")


def bulk_load(spark, sf):
    """An export of the fact table, twice over and under foreign headers, loaded without de-duplication."""
    path, table = scratch_dir(spark, "export"), scratch_dir(spark, "fact")
    named = {"subject": "Passport", "name": "Họ và tên", "start_date": "Ngày đến", "end_date": "Ngày đi", "place": "Địa chỉ"}
    rows = fact(spark, sf).withColumn("subject", F.concat(F.lit(" "), F.lower("subject")))
    for part in ("one", "two"):
        files.export_csv(rows.withColumnsRenamed(named) if part == "two" else rows.drop("source_file"), f"{path}/{part}")
        found = files.read_csv(spark, f"{path}/{part}", files.EXPORT_ENCODINGS, missing=files.OWN_MISSING).drop(files.SOURCE_FILE)
        tables.append_stays(align_schema(align_headers(found), STAY_SCHEMA, ["subject"]), table, load_id=part)
    return tables.read_stays(spark, table)


def stitch_every_page(spark, sf):
    """Every page has a header of its own in its first row, some in another order, none of them repeats the first."""
    cells = paged_cells(spark, sf).filter("row_no > 1")
    swapped = F.col("page") % 3 == 0
    names = F.when(swapped, F.array(F.lit("No"), F.lit("State"), F.lit("Who"))).otherwise(F.array(F.lit("No"), F.lit("Who"), F.lit("State")))
    heads = cells.select("file", "page").distinct().select("file", "page", F.lit(1).cast("long").alias("row_no"), names.alias("cells"))
    return stitch_pages(cells.unionByName(heads), {"No": "number", "Who": "subject", "State": "place"}, number_header="No", every_page=True)


QUERIES = {"label_file": label_file, "lookup_file": lookup_file, "bulk_load": bulk_load, "stitch_every_page": stitch_every_page}
ORACLES = {
    "label_file": LOADS["apply_labels"],
    "lookup_file": INTERVALS["lookup_keep_last"],
    "bulk_load": sql("SELECT fact.* REPLACE (CAST(NULL AS VARCHAR) AS source_file) FROM fact, range(2) twice", "fact"),
    "stitch_every_page": CLEANING["stitch_paged_table"],
}
